"""Byte-pair encoding of cleaned text, by workers that remember the words they have merged."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions.decode import ascii_lower
from ..functions.text import basic_clean, token_words, whitespace_clean

END = "</w>"
#: Words whose ids a worker keeps.
MEMO_WORDS = 200_000
#: Rows that are put together at once.
STRETCH = 1_000


@lru_cache(1)
def byte_symbols() -> list[str]:
    """A printable character for every byte: itself where printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def vocabulary(merges: list[tuple[str, str]]) -> dict[str, int]:
    """Ids: bytes in the order printable first, the same as word ends, merges in turn, the two marks."""
    symbols = byte_symbols()
    ordered = [s for b, s in enumerate(symbols) if s == chr(b)] + [s for b, s in enumerate(symbols) if s != chr(b)]
    tokens = ordered + [s + END for s in ordered] + [a + b for a, b in merges] + ["<|startoftext|>", "<|endoftext|>"]
    return {t: i for i, t in enumerate(tokens)}


def merge_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Symbols of one word after merging its lowest-ranked pair, everywhere at once from the left, until no pair has a rank.

    Symbols are linked both ways and ranked pairs wait in a heap, so a word of n bytes takes n log n steps.
    """
    symbols = byte_symbols()
    parts: list[str | None] = [symbols[b] for b in word.encode("utf-8")]
    if not parts:
        return []
    parts[-1] += END
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    waiting = [(ranks[p], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in ranks]
    heapify(waiting)
    while waiting:
        rank, places = waiting[0][0], []
        while waiting and waiting[0][0] == rank:
            places.append(heappop(waiting)[1])
        made = []
        for k in places:
            n = after[k]
            if parts[k] is None or n == len(parts) or ranks.get((parts[k], parts[n])) != rank:
                continue  # one of the two has been merged into another
            parts[k] += parts[n]
            parts[n], after[k] = None, after[n]
            if after[k] < len(parts):
                before[after[k]] = k
            made.append(k)
        for k in made:
            for a in (before[k], k):
                if a >= 0 and parts[a] is not None and after[a] < len(parts) and (pair := (parts[a], parts[after[a]])) in ranks:
                    heappush(waiting, (ranks[pair], a))
    return [p for p in parts if p is not None]


def clean(text: Column) -> Column:
    return ascii_lower(whitespace_clean(basic_clean(F.coalesce(text, F.lit("")))))


class _Coder(dict):
    """word -> its ids, merged when first asked for; MEMO_WORDS at most are kept."""

    def __init__(self, merges: tuple[tuple[str, str], ...]):
        super().__init__()
        self.ranks, self.ids = {m: i for i, m in reversed(list(enumerate(merges)))}, vocabulary(list(merges))

    def __missing__(self, word: str) -> np.ndarray:
        if len(self) >= MEMO_WORDS:
            self.clear()
        made = self[word] = np.array([self.ids.get(t, 0) for t in merge_word(word, self.ranks)], np.int32)
        return made


@lru_cache(1)
def _coder(merges: tuple[tuple[str, str], ...]) -> _Coder:
    """One for each worker, which keeps it from one task to the next."""
    return _Coder(merges)


def _joined(words: pa.Array, coder: _Coder) -> pa.Array:
    """Each row's words (list of strings) as one list of ids; a stretch's different words are looked up once."""
    coded = words.flatten().dictionary_encode()
    known = [coder[w] for w in coded.dictionary.to_pylist()]
    sizes = np.array([len(x) for x in known], np.int64)
    at, flat = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0, np.int32), *known])
    which = coded.indices.to_numpy(zero_copy_only=False)
    n = sizes[which]
    ends = np.append(0, np.cumsum(n))
    ids = flat[np.repeat(at[which] - ends[:-1], n) + np.arange(ends[-1])]
    rows = np.append(0, np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pa.array(ids, pa.int32()))


def encode(rows: DataFrame, key: list[str], text: str, merges: list[tuple[str, str]]) -> DataFrame:
    """``key`` columns and the ids of each row's text, a row for a row. Unknown tokens have id 0; a null or empty text has no ids.

    Keys may be null and may repeat. Rows stay where they are: their words are merged by workers that remember them, and nothing is shuffled.
    """
    given = rows.select(F.struct(*key).alias("key"), token_words(clean(F.col(text).cast("string"))).alias("words"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(tuple(merges))
        for whole in batches:
            for b in (whole.slice(k, STRETCH) for k in range(0, whole.num_rows, STRETCH)):
                yield pa.RecordBatch.from_arrays([b.column("key"), _joined(b.column("words"), coder)], ["key", "ids"])

    made = StructType([given.schema["key"], StructField("ids", ArrayType(IntegerType()))])
    return given.mapInArrow(scan, made).select("key.*", "ids")
