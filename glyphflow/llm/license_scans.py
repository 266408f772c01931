"""Short license notices in texts, with edits: exact seeds locate candidates and bounded-error matching verifies them.

A notice that is met with at most k edits, cut into k + 1 pieces, has one piece that no edit touches (the pigeonhole
principle). So one pass over a text for all pieces of all notices finds every candidate; around each hit the word
spans of fitting length are matched with the notice by a pattern that allows k errors, which counts the edits.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_state

#: A notice has one edit for so many of its characters.
CHARS_AN_EDIT = 10
#: In notices of fewer characters the first word tells the license and stands without edits.
SHORT = 16
#: Different word spans whose edits a worker remembers.
MEMO = 100_000


@dataclass(frozen=True)
class Notice:
    """A notice in lower-case words with one blank between them; ``base`` ones also count word for word."""

    label: str
    text: str
    base: bool = False

    @property
    def edits(self) -> int:
        return len(self.text) // CHARS_AN_EDIT

    @property
    def head(self) -> str:
        """The part that must stand without edits, with the blank behind it."""
        return self.text.split(" ")[0] + " " if len(self.text) < SHORT else ""


NOTICES = (
    Notice("gpl", "gnu general public license", True),
    Notice("apache", "apache license", True),
    Notice("cc-by", "cc by", True),
    Notice("mit", "mit license", True),
    Notice("lgpl", "gnu lesser general public license"),
    Notice("agpl", "gnu affero general public license"),
    Notice("mpl", "mozilla public license"),
    Notice("epl", "eclipse public license"),
    Notice("bsd", "bsd license"),
    Notice("bsd", "redistribution and use in source and binary forms"),
    Notice("mit", "permission is hereby granted free of charge to any person"),
    Notice("cc-by", "creative commons attribution"),
    Notice("cc-by-sa", "cc by sa"),
    Notice("cc-by-nc", "cc by nc"),
    Notice("cc-by-nd", "cc by nd"),
    Notice("unlicense", "free and unencumbered software"),
)

#: Bytes of words: digits, letters in lower case and all beyond ASCII; every other byte is a blank.
_LOWER = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_HIT = "notice: int, label: string, word: long, n_words: int, edits: int, char_start: long, char_end: long"


def pieces(notice: Notice) -> list[tuple[int, str]]:
    """``edits`` + 1 consecutive pieces of nearly equal length, with their offsets; one of them survives any edits allowed."""
    n, k = len(notice.text), notice.edits
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, notice.text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Finder:
    """The seeds and the patterns of a list of notices."""

    def __init__(self, notices: Sequence[Notice]):
        import ahocorasick
        import regex

        self.notices = tuple(notices)
        self.seeds = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for k, notice in enumerate(notices):
            for offset, piece in pieces(notice):
                at.setdefault(piece, []).append((k, offset))
        for piece, places in at.items():
            self.seeds.add_word(piece, (len(piece), places))
        if at:
            self.seeds.make_automaton()
        self.patterns = [regex.compile(f"(?b){regex.escape(n.head, literal_spaces=True)}(?:{regex.escape(n.text[len(n.head) :], literal_spaces=True)}){{e<={n.edits}}}") for n in notices]
        self.edits = lru_cache(MEMO)(self._edits)

    def _edits(self, notice: int, span: str) -> int | None:
        """The least edits that make the notice of the span; None if that is more than it allows."""
        found = self.patterns[notice].fullmatch(span)
        return sum(found.fuzzy_counts) if found else None

    def hits(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(notice, first word, words, edits) of every notice found in ``words``, by place.

        Every span without edits is reported. Of spans with edits those with fewer come first, then those further left,
        then shorter ones; one that overlaps a span reported for the same notice is left out.
        """
        if not words or not self.notices:
            return []
        text = b" ".join(words).decode("latin-1")  # a byte is a character: notices are ASCII, an edit is a byte
        asked: dict[tuple[int, int], None] = {}
        for last, (length, places) in self.seeds.iter(text):
            for notice, offset in places:
                asked[notice, last + 1 - length - offset] = None
        if not asked:
            return []
        starts, at = [], 0
        for w in words:
            starts.append(at)
            at += len(w) + 1
        ends = [s + len(w) for s, w in zip(starts, words, strict=True)]
        tried: dict[tuple[int, int, int], int] = {}
        for notice, place in asked:
            n, k = len(self.notices[notice].text), self.notices[notice].edits
            for first in range(bisect_left(starts, place - k), bisect_right(starts, place + k)):
                for last in range(bisect_left(ends, starts[first] + n - k), bisect_right(ends, starts[first] + n + k)):
                    if last >= first and (notice, first, last) not in tried:
                        tried[notice, first, last] = self.edits(notice, text[starts[first] : ends[last]])
        good = sorted((e, first, last, notice) for (notice, first, last), e in tried.items() if e is not None)
        taken: dict[int, list[tuple[int, int]]] = {}
        out = []
        for e, first, last, notice in good:
            spans = taken.setdefault(notice, [])
            k = bisect_left(spans, (first, first))
            if e == 0 or not any(a <= last and first <= b for a, b in spans[max(0, k - 1) : k + 1]):
                spans.insert(k, (first, last))
                out.append((notice, first, last + 1 - first, e))
        return sorted(out, key=lambda h: (h[1], h[0], h[2]))


def split_words(raw: bytes) -> list[bytes]:
    """Lower-case words; no byte of a word is white space."""
    return raw.translate(_LOWER).split()


def scan_text(finder: Finder, raw: bytes) -> tuple[int, list[tuple]]:
    """The number of words and the hits, with the character span of each in the text."""
    words = split_words(raw)
    hits = finder.hits(words)
    if not hits:
        return len(words), []
    wanted = {w for _, first, n, _ in hits for w in (first, first + n - 1)}
    spans = {k: m.span() for k, m in enumerate(_WORD.finditer(raw)) if k in wanted}
    edges = sorted({at for span in spans.values() for at in span})
    chars, count, before = {}, 0, 0
    for at in edges:
        count += len(raw[before:at].decode("utf-8", "replace"))
        chars[at], before = count, at
    return len(words), [(k, finder.notices[k].label, first, n, e, chars[spans[first][0]], chars[spans[first + n - 1][1]]) for k, first, n, e in hits]


def scan(docs: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """doc_id, n_words and ``hits`` of every row of ``docs`` (doc_id, text): the notices found in its whole text.

    A hit has the notice's place in ``notices``, its label, its first word (from 0), its words, the edits and its
    character span in the text. Words are runs of ASCII letters (A-Z lower-cased), digits and anything beyond ASCII;
    a notice is met by whole words whose join by one blank is at most ``Notice.edits`` edits (inserted, deleted or
    replaced UTF-8 bytes) from it, the first word of a short one without edits. No such span is missed: see
    ``Finder.hits`` for the overlapping ones. Null and empty texts have no words and no hits; a null doc_id stays
    null; repeated rows give a row each; an empty table gives none; other columns are ignored. Rows stay in their
    partitions.
    """
    notices = tuple(notices)
    names = ["doc_id", "n_words", "hits"]
    kinds = pa.list_(pa.struct([("notice", pa.int32()), ("label", pa.string()), ("word", pa.int64()), ("n_words", pa.int32()), ("edits", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64())]))
    fields = [f.name for f in kinds.value_type]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = worker_state("license", notices, lambda: Finder(notices))
        for b in batches:
            n_words, hits = [], []
            for text in b.column("text"):
                n, found = scan_text(finder, text.as_py() or b"")
                n_words.append(n)
                hits.append([dict(zip(fields, h, strict=True)) for h in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, kinds)], names)

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return texts.mapInArrow(work, f"doc_id long, n_words long, hits array<struct<{_HIT}>>")


def summary(found: DataFrame, notices: Sequence[Notice] = NOTICES) -> DataFrame:
    """A digest of what ``scan`` returns, one row for each of its rows.

    ``n_base`` counts the places of base notices without edits, ``first_word`` and ``last_word`` are the first and
    last of them (null if none), ``base_labels`` their labels and ``labels`` all labels found, distinct, sorted and
    joined by commas; ``score`` is the best hit's share of unedited characters, 0 without a hit.
    """
    base = [k for k, n in enumerate(notices) if n.base]
    length = F.array(*(F.lit(float(len(n.text))) for n in notices)) if notices else F.array(F.lit(1.0))
    exact = F.filter("hits", lambda h: (h["edits"] == 0) & h["notice"].isin(base))
    joined = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    shares = F.transform("hits", lambda h: 1.0 - h["edits"] / F.get(length, h["notice"]))
    return found.withColumn("base", exact).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(F.col("base")).alias("base_labels"), joined(F.col("hits")).alias("labels"), F.coalesce(F.array_max(shares), F.lit(0.0)).alias("score"),
    )
