import random
import re

from sitelore.llm import license_scan as ls

SCHEMA = "doc_id long, text string, n_words string, spans int, label string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_brute_force(text, notices):
    """(label, notice, first word, edits) over every word start and end, by edit distance."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for n in notices:
        found = []
        for a in range(len(words)):
            best = None
            for b in range(a + 1, len(words) + 1):
                piece = " ".join(words[a:b])
                if len(piece) > len(n.words) + n.edits:
                    break
                d = distance(piece, n.words)
                if d <= n.edits and (best is None or d < best[0]):
                    best = (d, a, b)
            if best:
                found.append(best)
        kept = []
        for d, a, b in sorted(found):
            if all(b <= x or y <= a for _, x, y in kept):
                kept.append((d, a, b))
        out += [(n.label, n.words, a, d) for d, a, _ in kept]
    return len(words), sorted(out)


def noisy(rng, notices):
    """Sentences with notices, some with a few edits, between ordinary words."""
    parts = []
    for _ in range(rng.randrange(1, 7)):
        s = list(rng.choice(notices).words)
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(s)) if s else 0
            s[at : at + rng.randrange(2)] = rng.choice(["", "x", " ", "é", s[at] if s else "", "-"])
        parts.append("".join(s).title() if rng.random() < 0.4 else "".join(s))
        parts.append(rng.choice([" ", ", ", "\n", ". the license of ", " by und Lizenz ", "-", ""]))
    return "".join(parts)


def test_scanner_equals_edit_distances():
    rng = random.Random(5)
    scanner = ls.Scanner(ls.NOTICES)
    seen = [0] * 5
    for _ in range(60):
        text = noisy(rng, ls.NOTICES)
        n, spans = scanner.scan(text)
        want_n, want = by_brute_force(text, ls.NOTICES)
        got = sorted((s.label, s.notice, s.first_word, s.edits) for s in spans)
        assert (n, got) == (want_n, want), text
        for s in spans:
            seen[s.edits] += 1
    assert min(seen[:4]) > 1


def test_pieces_cover_the_notice():
    for n in ls.NOTICES:
        cut = ls.pieces(n.words, n.edits)
        assert "".join(p for _, p in cut) == n.words and len(cut) == n.edits + 1
        assert all(n.words[o : o + len(p)] == p for o, p in cut)


def test_digest_counts_every_exact_place(spark):
    rng = random.Random(6)
    texts = [noisy(rng, ls.NOTICES) for _ in range(60)]
    texts += [None, "", "...", "MIT License", "cc by cc by cc-by", "mit license " * 30000, "a" * 300000, "ÀMIT License É", "MİT LICENSE"]
    rows = [(i // 2, t, "q", 3, "l") for i, t in enumerate(texts)] + [(None, "mit license", "", 0, "")]
    got = ls.license_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = []
    for i, t, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places, labels = [], set()
        for n in ls.BASE:
            p = n.words.split()
            at = [k for k in range(len(words)) if words[k] == p[0] and words[k : k + len(p)] == p]
            places += at
            labels |= {n.label} if at else set()
        want.append((i, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got], key=key) == sorted(want, key=key)
    assert all(set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert any(r.labels != r.base_labels for r in got) and any(0 < r.score < 1 for r in got)


def test_no_notices_and_no_rows(spark):
    df = spark.createDataFrame([(1, "mit license", "", 0, "")], SCHEMA)
    assert [(r.n_words, r.labels, r.score) for r in ls.license_digest(df, notices=[]).collect()] == [(2, "", 0.0)]
    assert ls.license_digest(df.limit(0)).count() == 0
