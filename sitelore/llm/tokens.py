"""Token ids of whole texts with a public tokenizer file, one cached look-up per word.

Both kinds of tokenizer cut a text into pieces that never join a character before a
plain space with one after it. So the ids of a text are the ids of its words one after
the other, and a word that came before costs one dictionary look-up. New words of many
texts go through the tokenizer together. Texts whose white space is unusual go through
it whole. `tests/llm/test_tokens.py` holds the results against the tokenizer itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np

CACHE_WORDS = 200_000  # bounds the memory of a worker; no effect on results
SLICE_TEXTS = 256  # texts whose new words are encoded together
JOINED_WORDS = 4000
# letters below it have one lower-case form each, the same everywhere
PLAIN_LETTERS = "\u0130"
# signs that are a piece of their own after letters, all that follow one another together
SIGNS = "!#$%&()*+,-./:;=?@[]_{}~"
SIGN_RUNS = 10_000  # kinds of such runs that are kept

_LOADED: dict[tuple[str, int], object] = {}


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others for the next free ones from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def _letters_are_pieces(tokenizer) -> tuple[bool, bool]:
    """Whether a run of letters, with a space before it or none, is one piece to this tokenizer, and
    whether it is lower-cased first: read from its settings, false where they are not known."""
    settings = json.loads(tokenizer.to_str())
    cut, norm = settings["pre_tokenizer"] or {}, settings["normalizer"] or {}
    steps = cut.get("pretokenizers", [cut])
    known = steps[-1].get("type") == "ByteLevel" and not steps[-1].get("add_prefix_space")
    if len(steps) == 1:
        known = known and steps[0].get("use_regex", True)
    else:
        pattern = steps[0].get("pattern", {}).get("Regex", "")
        known = known and len(steps) == 2 and not steps[1].get("use_regex", True) and "|[\\p{L}]+|" in pattern
    kinds = [n.get("type") for n in norm.get("normalizers", [norm] if norm else [])]
    known = known and set(kinds) <= {"NFC", "Replace", "Lowercase"} and settings["model"].get("type") == "BPE"
    return known and not settings["model"].get("dropout"), "Lowercase" in kinds


class TextEncoder:
    """Ids of texts as little-endian bytes of `size` (2 or 4) each."""

    def __init__(self, path: str, size: int = 4, cache: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the strings of special tokens inside a text are ordinary text
        self.tokenizer.encode_special_tokens = True
        self.cache = cache
        self.size, self.code = size, {2: "H", 4: "I"}[size]
        self.spaces_matter = self._whole("a b") != self._whole("a\nb")
        self.plain: dict[str, bytes] = {}  # words at the start of a line
        self.spaced: dict[str, bytes] = {}  # words after a space
        # a separator between words that is one id, and no part of any of them
        self.mark, self.joint = ("\n", "\n") if self.spaces_matter else ("7", " 7 ")
        self.newline = self._whole("\n")
        self.direct, self.lowers = _letters_are_pieces(self.tokenizer)
        self.signs: dict[str, bytes] = {}  # runs of signs at the ends of words
        self.of_byte = _byte_letters()
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        found = [t.content.strip() for t in added]  # in ordinary words, if they hold nothing but letters and signs
        self.direct = self.direct and not any(t and all(c.isalpha() or c in SIGNS for c in t) for t in found)

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array(self.code, ids).tobytes()

    def _letters(self, word: str, prefix: str) -> bytes | None:
        """Ids of a word of letters by the model alone; None where that is not known to be the same."""
        if not word.isalpha():
            return None
        if self.lowers:
            if not word.isascii() and (max(word) >= PLAIN_LETTERS or not unicodedata.is_normalized("NFC", word)):
                return None
            word = word.lower()
        if not word.isascii():
            of_byte = self.of_byte
            word = "".join([of_byte[b] for b in word.encode()])
        if prefix:
            word = self.of_byte[32] + word
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _ended(self, word: str, prefix: str, known: dict[str, bytes]) -> bytes | None:
        """Ids of a word of letters and the signs at its end; None where that is not known to be the same."""
        stem = word.rstrip(SIGNS)
        if len(stem) == len(word):
            return self._letters(word, prefix)
        # not every table of letters knows the later ones
        if not stem.isalpha() or not stem.isascii() and max(stem) >= PLAIN_LETTERS:
            return None
        first = known.get(stem)
        if first is None:
            first = self._letters(stem, prefix)
        if first is None:
            return None
        signs = word[len(stem) :]
        if signs not in self.signs:
            if len(self.signs) >= SIGN_RUNS:
                self.signs.clear()
            self.signs[signs] = self._whole(signs)
        return first + self.signs[signs]

    def _learn(self, words: set[str], known: dict[str, bytes], prefix: str) -> list[str]:
        """Add the ids of new words to `known`; words with white space at an end stay out."""
        new, clean = [], []
        ended, direct, mark = self._ended, self.direct, self.mark
        for w in words.difference(known):
            if not w or w != w.strip():
                continue
            new.append(w)
            ids = ended(w, prefix, known) if direct else None
            if ids is not None:
                known[w] = ids
            elif mark in w:
                known[w] = self._whole(prefix + w)
            else:
                clean.append(w)
        kind, size = np.dtype(f"<u{self.size}"), self.size
        (mark,) = np.frombuffer(self._whole(self.mark), kind)
        for i in range(0, len(clean), JOINED_WORDS):
            part = clean[i : i + JOINED_WORDS]
            ids = np.frombuffer(self._whole(self.joint.join([prefix + w for w in part])), kind)
            cuts = np.flatnonzero(ids == mark).tolist()
            if len(cuts) != len(part) - 1:  # never with the public files
                known.update((w, self._whole(prefix + w)) for w in part)
                continue
            data, at = ids.tobytes(), 0
            for w, cut in zip(part, cuts + [len(ids)]):
                known[w] = data[size * at : size * cut]
                at = cut + 1
        return new

    def _slice(self, texts: list[str]) -> list[bytes]:
        starts, others = set(), set()
        rows: list[list[list[str]]] = []
        for text in texts:
            if self.spaces_matter:
                lines = [line.split(" ") for line in text.split("\n")]
            else:  # these four count as white space in Python alone
                odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
                lines = [[""]] if odd else [text.split()]
            rows.append(lines)
            for words in lines:
                if self.spaces_matter:
                    starts.add(words[0])
                    others.update(words[1:])
                else:
                    starts.update(words)
        new_starts = self._learn(starts, self.plain, "")
        new_others = self._learn(others, self.spaced, " ")
        plain, spaced = self.plain.__getitem__, self.spaced.__getitem__
        out = []
        for text, lines in zip(texts, rows):
            try:
                if self.spaces_matter:
                    out.append(
                        self.newline.join([plain(w[0]) + b"".join(map(spaced, w[1:])) for w in lines])
                    )
                else:
                    out.append(b"".join(map(plain, lines[0])))
            except KeyError:
                out.append(self._whole(text))
        # frequent words come early, so the first ones stay
        for known, new in ((self.plain, new_starts), (self.spaced, new_others)):
            for w in new[: max(0, len(known) - self.cache)]:
                del known[w]
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null and empty texts have none."""
        out: list[bytes] = []
        for i in range(0, len(texts), SLICE_TEXTS):
            out += self._slice([t or "" for t in texts[i : i + SLICE_TEXTS]])
        return out


def encoder(path: str, size: int = 4, cache: int = CACHE_WORDS) -> TextEncoder:
    """The encoder of a tokenizer file, loaded once per worker."""
    if (path, size) not in _LOADED:
        _LOADED[path, size] = TextEncoder(path, size, cache)
    return _LOADED[path, size]


def id_bytes(path: str, *others: int) -> int:
    """Bytes that hold every id of a tokenizer file and the ids given: 2 or 4."""
    from tokenizers import Tokenizer

    most = max([Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True) - 1, *others])
    return 2 if most <= 0xFFFF else 4
