import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sitelore.llm import packing, token_files
from sitelore.llm.files import new_folder, read_range
from sitelore.llm.queries import tokenizer_path
from sitelore.llm.tokens import PLAIN_LETTERS, SIGNS, TextEncoder, encoder

NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", "a  b", " x", "x ", "a\n\nb", "a\tb", "\x1c a\x1fb", "a b", "é ́x", "it's don't",
    "12 34ab 7 77", "<|endoftext|> hi", "a \n b", "\n", "x\r\ny", "x7 7", "　a b c d", "İI ß ς", "x " * 3000,
]


def plain_ids(name, text):
    return encoder(tokenizer_path(name)).tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_ids_are_those_of_the_tokenizer(name):
    got = encoder(tokenizer_path(name)).encode_many(ODD + [None])
    for text, ids in zip(ODD + [""], got):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab' 7\n\t é́ßZ.\x1c-"), max_size=30), st.text(max_size=20))
def test_ids_of_any_text(narrow, wide):
    for name in NAMES:
        for text in (narrow, wide.encode("utf-8", "ignore").decode()):
            (ids,) = encoder(tokenizer_path(name)).encode_many([text])
            assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text)


def test_best_fit_respects_every_capacity():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 60, 400)
    for score in ("norm", "dot"):
        capacity = packing.Capacity(tokens=100, documents=4, attention=5000)
        bins, offsets = packing.best_fit(lengths, capacity, score)
        for b in np.unique(bins):
            mine = bins == b
            assert lengths[mine].sum() <= 100 and mine.sum() <= 4 and (lengths[mine] ** 2).sum() <= 5000
            order = np.argsort(offsets[mine])
            ends = np.cumsum(lengths[mine][order])
            assert (offsets[mine][order] == ends - lengths[mine][order]).all()
    bins, _ = packing.best_fit(lengths, packing.Capacity(100, 1000, 10000))
    assert len(np.unique(bins)) <= 1.05 * np.ceil(lengths.sum() / 100)


DOCS = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (4, "w " * 9000, "x"), (4, "w " * 9000, "x"), (None, "q r", None)]


def documents(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")


def test_packing_of_odd_documents(spark):
    path = tokenizer_path(NAMES[0])
    rows = packing.pack_documents(documents(spark), path).collect()
    expected = []
    for doc, text, _ in DOCS:
        ids = plain_ids(NAMES[0], text or "") + [1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at : at + 4096], "<u4")
            expected.append((doc, piece, at, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: (r[0] is None, r)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(expected, key=key)
    for seq in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(documents(spark, []), path).count() == 0


def test_codes_give_any_token():
    rng = np.random.default_rng(2)
    ids = rng.choice([0, 5, 255, 256, 70_000, 2**31], 3000).astype("<u4")
    file = token_files.TokenFile(b"".join(token_files.encode_file([7, None], [1000, 2000], ids)))
    assert (file.all_tokens() == ids).all()
    for i in [0, 1, 511, 512, 513, 1024, 2999, *rng.integers(0, 3000, 60).tolist()]:
        assert file.token(i) == ids[i]
    with pytest.raises(IndexError):
        file.token(3000)


def test_token_files_round_trip(spark):
    path = tokenizer_path(NAMES[1])
    folder = new_folder(spark, "t")
    made = token_files.write_token_files(documents(spark), folder, path, shard_bytes=200, file_tokens=5000)
    assert made.count() > 1
    got = [tuple(r) for r in token_files.read_token_files(made, folder).orderBy("start").collect()]
    start, expected = 0, []
    for doc, text, _ in sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array(plain_ids(NAMES[1], text or "") + [2], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == expected
    first = made.orderBy("shard", "part").first()
    assert token_files.TokenFile(read_range(folder, first.file)).tokens == first.tokens
    assert token_files.token_digest(documents(spark, []), path).count() == 0


def fewest_bins(lengths, most):
    """Exhaustive: pieces one by one into every open bin or a new one."""
    best = len(lengths)

    def place(i, left):
        nonlocal best
        if len(left) >= best:
            return
        if i == len(lengths):
            best = len(left)
            return
        for j in range(len(left)):
            if left[j] >= lengths[i]:
                place(i + 1, left[:j] + [left[j] - lengths[i]] + left[j + 1 :])
        place(i + 1, [*left, most - lengths[i]])

    place(0, [])
    return best


def test_packing_is_near_the_fewest_sequences():
    rng = np.random.default_rng(9)
    exact = 0
    for _ in range(120):
        lengths = rng.integers(1, 21, size=rng.integers(1, 9))
        least = fewest_bins(sorted(lengths.tolist(), reverse=True), 20)
        bins, _ = packing.best_fit(lengths, packing.Capacity(20, 100, 10**6))
        assert least <= len(set(bins)) <= (11 * least + 6) // 9
        exact += len(set(bins)) == least
    assert exact >= 115


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_of_letters_by_the_model_alone(name):
    known = encoder(tokenizer_path(name))
    assert known.direct
    letters = [c for c in map(chr, [*range(0x130)] * 9 + [*range(0x130, 0x11000, 61)]) if c.isalpha()]
    rng = np.random.default_rng(3)
    taken = 0
    for _ in range(3000):
        word = "".join(rng.choice(letters, size=rng.integers(1, 9)))
        for prefix in ("", " ") if known.spaces_matter else ("",):
            ids = known._letters(word, prefix)
            taken += ids is not None
            assert ids is None or ids == known._whole(prefix + word)
    assert taken > 100 and known._letters("a1", "") is None and known._letters("", "") is None


@pytest.mark.parametrize("name", NAMES)
def test_signs_after_letters_are_a_piece_of_their_own(name, monkeypatch):
    known = TextEncoder(tokenizer_path(name))
    letters = [c for c in map(chr, [*range(ord(PLAIN_LETTERS))] * 9 + [*range(0x130, 0x11000, 61)]) if c.isalpha()]
    rng = np.random.default_rng(4)
    pick = lambda chars, most: "".join(rng.choice(list(chars), size=rng.integers(1, most)))
    for _ in range(3000):
        word = pick(letters, 7) + pick(SIGNS, 4)
        for prefix in ("", " ") if known.spaces_matter else ("",):
            ids = known._ended(word, prefix, {})
            assert ids is None or ids == known._whole(prefix + word), word
    texts = [" ".join(pick(letters, 6) + pick(SIGNS + "'\u3002", 3) for _ in range(60)) + "\nend.\n\n." for _ in range(60)]
    for text, ids in zip(texts, known.encode_many(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(name, text)
    known, read = TextEncoder(tokenizer_path(name)), []
    whole = known._whole
    monkeypatch.setattr(known, "_whole", lambda text: read.append(text) or whole(text))
    text = " ".join(pick("abcdefgh\u00e9\u00fc", 9) + pick(",.", 2) for _ in range(2000))
    assert np.frombuffer(known.encode_many([text])[0], "<u4").tolist() == plain_ids(name, text)
    assert sum(map(len, read)) < 100  # the words themselves went to the model


def test_added_tokens_of_letters_and_signs_keep_words_whole(tmp_path):
    from tokenizers import Tokenizer

    changed = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    changed.add_tokens(["b,"])
    changed.save(str(tmp_path / "t.json"))
    known = TextEncoder(str(tmp_path / "t.json"))
    (ids,) = known.encode_many(["ab, cab, c"])
    assert np.frombuffer(ids, "<u4").tolist() == changed.encode("ab, cab, c", add_special_tokens=False).ids
