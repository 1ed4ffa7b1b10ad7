"""Short license notices found with bounded errors.

A notice of m characters with at most k edits keeps one of its k + 1 pieces unchanged
(pigeonhole). All pieces of all notices are one Aho-Corasick automaton; each hit names the
few word starts at which that notice could begin, and there the regex library's fuzzy
matching decides: at most k edits up to the end of a word, the fewest that do. Every word
start that can match is tried, so nothing is lost to the search; long texts are read once.
Texts are compared as lower-case words with one space between.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelore.llm.files import whole_texts
from sitelore.llm.runs import small_batches

CHARACTERS_PER_EDIT = 9
MOST_EDITS = 3  # the search by bounded errors grows steeply with them; more need more notices
TEXTS = 64


@dataclass(frozen=True)
class Notice:
    """Words to look for (lower case, one space between) and the label they stand for."""

    label: str
    words: str
    base: bool = False

    @property
    def edits(self) -> int:
        return min(len(self.words) // CHARACTERS_PER_EDIT, MOST_EDITS)


BASE = [
    Notice("gpl", "gnu general public license", True),
    Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True),
    Notice("mit", "mit license", True),
]
NOTICES = BASE + [
    Notice("gpl", "this program is free software you can redistribute it and or modify it"),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("mpl", "mozilla public license"),
    Notice("apache", "licensed under the apache license version 2 0"),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Notice("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-nc", "creative commons attribution noncommercial"),
    Notice("public-domain", "released into the public domain"),
    Notice("all-rights-reserved", "all rights reserved"),
]


def pieces(words: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece): the words cut in edits + 1 pieces of nearly equal length."""
    cuts = [len(words) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def word_line(text: str | None) -> tuple[str, int]:
    """The text's words with one space before, between and after them, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split(b" ")
    words = [w for w in words if w]
    return f" {b' '.join(words).decode('utf-8', 'surrogatepass')} ", len(words)


@dataclass(frozen=True)
class Span:
    label: str
    notice: str
    first_word: int
    last_word: int
    edits: int
    base: bool


class Scanner:
    """Finds all notices in a text; one is built per task."""

    def __init__(self, notices: Iterable[Notice]):
        self.notices = list(notices)
        self.seeds = ahocorasick.Automaton()
        held: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(self.notices):
            for offset, piece in pieces(notice.words, notice.edits):
                held.setdefault(piece, []).append((i, offset))
        for piece, places in held.items():
            self.seeds.add_word(piece, (len(piece), places))
        if held:
            self.seeds.make_automaton()
        self.forms = [
            [regex.compile(f"(?:{regex.escape(n.words, special_only=True)}){{e<={k}}}") for k in range(n.edits + 1)]
            for n in self.notices
        ]

    def _verified(self, i: int, line: str, at: int) -> tuple[int, int, int] | None:
        """(edits, begin, end) of the best match from `at` to the end of a word: every end that
        the edits allow is matched in full, fewest edits first, then the nearest end."""
        notice = self.notices[i]
        shortest, longest = at + len(notice.words) - notice.edits, at + len(notice.words) + notice.edits
        ends, space = [], line.find(" ", max(shortest, at + 1), longest + 1)
        while space >= 0:
            ends.append(space)
            space = line.find(" ", space + 1, longest + 1)
        ends = [e for e in ends if self.forms[i][-1].fullmatch(line, at, e)]
        for edits, form in enumerate(self.forms[i]):
            for end in ends:
                if form.fullmatch(line, at, end):
                    return edits, at, end
        return None

    def _starts(self, line: str) -> set[tuple[int, int]]:
        """(notice, character) of every word start at which a seed says it may begin."""
        found = set()
        if not self.notices:
            return found
        for end, (length, places) in self.seeds.iter(line):
            at = end + 1 - length
            for i, offset in places:
                k = self.notices[i].edits
                low = max(0, at - offset - k - 1)
                space = line.find(" ", low, at - offset + k)
                while space >= 0:
                    found.add((i, space + 1))
                    space = line.find(" ", space + 1, at - offset + k)
        return found

    def scan(self, text: str | None) -> tuple[int, list[Span]]:
        """Number of words, and spans in order of their first word. Of spans of one notice that
        overlap, the one with fewer edits stays, then the earlier one."""
        line, n_words = word_line(text)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for i, at in self._starts(line):
            notice = self.notices[i]
            if line.startswith(notice.words + " ", at):
                hits.setdefault(i, []).append((0, at, at + len(notice.words)))
            elif notice.edits:
                match = self._verified(i, line, at)
                if match:
                    hits.setdefault(i, []).append(match)
        kept = []
        for i, found in hits.items():
            kept += [(begin, end, edits, i) for edits, begin, end in _apart(found)]
        spans, word, seen = [], 0, 0
        for begin, end, edits, i in sorted(kept):
            word += line.count(" ", seen, begin)
            seen = begin
            n = self.notices[i]
            spans.append(Span(n.label, n.words, word - 1, word - 1 + line.count(" ", begin, end), edits, n.base))
        return n_words, spans


def _apart(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans (edits, begin, end) without those that overlap a better one kept before."""
    found.sort()
    first = found[0][0]
    if all(f[0] == first for f in found):  # one pass when all are equally good
        kept, reach = [], -1
        for f in found:
            if f[1] >= reach:
                kept.append(f)
                reach = f[2]
        return kept
    kept: list[tuple[int, int, int]] = []
    begins: list[int] = []
    for f in found:
        at = bisect.bisect_left(begins, f[1])
        if (at == 0 or kept[at - 1][2] <= f[1]) and (at == len(kept) or f[2] <= kept[at][1]):
            kept.insert(at, f)
            begins.insert(at, f[1])
    return kept


_SPAN = "struct<label:string,notice:string,first_word:long,last_word:long,edits:int,base:boolean>"


def find_notices(df: DataFrame, key: str = "doc_id", text: str = "text", notices: list[Notice] | None = None) -> DataFrame:
    """`key`, n_words, spans of every row: each span has its label, the notice's words, the
    numbers of its first and last word (from 0), its edits and whether the notice is a base one.

    Null and empty texts have no words and no spans. Rows are scanned where they lie: repeated
    rows and equal keys give equal rows each, null keys stay; other columns are not read, whatever
    their names. Texts of any length are scanned whole. Equally good overlapping spans of a notice:
    the earlier. An empty table gives no rows; without notices there are no spans.
    """
    kind = df.schema[key].dataType.simpleString()
    wanted = NOTICES if notices is None else notices

    def scan(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner(wanted)
        for batch in small_batches(batches, TEXTS):
            counts, spans = [], []
            for value in batch.column("_text"):
                n, found = scanner.scan(value.as_py())
                counts.append(n)
                spans.append([vars(s) for s in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), pa.array(counts, pa.int64()), pa.array(spans, _ARROW)], ["_key", "n_words", "spans"]
            )

    rows = whole_texts(df).select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(scan, f"_key {kind}, n_words long, spans array<{_SPAN}>").withColumnRenamed("_key", key)


_ARROW = pa.list_(
    pa.struct(
        [("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
         ("edits", pa.int32()), ("base", pa.bool_())]
    )
)


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")


def license_digest(df: DataFrame, key: str = "doc_id", text: str = "text", notices: list[Notice] | None = None) -> DataFrame:
    """One row per row of `df`: n_words, n_base, first_word, last_word, base_labels, labels, score,
    and the spans. Base places are the spans of base notices without any edit; the score is the
    best span's share of unchanged characters, 0 without spans."""
    found = find_notices(df, key, text, notices)
    exact = F.filter("spans", lambda s: s["base"] & (s["edits"] == 0))
    starts = F.transform(exact, lambda s: s["first_word"])
    likeness = F.transform("spans", lambda s: 1 - s["edits"] / F.greatest(F.length(s["notice"]), F.lit(1)))
    return found.select(
        key, "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), _labels(exact).alias("base_labels"), _labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(likeness), F.lit(0.0)).alias("score"), "spans",
    )
