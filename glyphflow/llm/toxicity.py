"""Toxicity by compression distance: windows are compressed with a toxic and with an ordinary zstandard dictionary.

A window is one word behind a carrier phrase that both dictionaries end with, so that both sides pay the same for
frame and tables and the difference in bytes is what a dictionary knows of the word. The dictionaries are trained by
zstandard on windows of words that are over-represented in toxic documents, and of common words of ordinary ones.
A document's distance is the sum of its windows' savings above a threshold; thresholds are calibrated on labelled
documents that the dictionaries haven't seen.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped_texts, saved, worker_state

#: Labelled rows to learn from, at most: those of least hash, so the same whatever the order of the input.
SAMPLE_ROWS = 30_000
#: Words whose windows a dictionary is trained on, at most.
DICTIONARY_WORDS = 4_000
#: A toxic window's word is in this share of toxic documents at least, in five at least, and so many times the
#: share of ordinary ones.
LEAST_SHARE, LEAST_DOCS, OVER = 0.005, 5, 30
TOXIC_BYTES, ORDINARY_BYTES = 3_072, 65_536
CARRIER = b" 0123456789 abcdefghijklmnopqrstuvwxyz "
#: Savings in bytes from which a window may count.
STEPS = range(1, 9)
MEMO_WORDS = 300_000
_EDGES = ".,;:!?|\"'()[]{}<>#$%&*+-_=/\\~^`"
#: Characters of a window; a longer run is split at these marks, and what is still longer is cut into overlapping windows.
LONGEST = 64
_MARKS = re.compile(f"[{re.escape(_EDGES)}。、，！？：；「」『』（）…—–·]+")


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    step: int = 1
    enough: float = math.inf
    noise: float = 0.0


def windows(text: str | None) -> list[str]:
    """The words of the text, lower-cased; those over LONGEST characters in parts that cover them."""
    out = []
    for word in (text or "").lower().split():
        if len(word) <= LONGEST or len(bare := word.strip(_EDGES)) <= LONGEST:
            out.append(word if len(word) <= LONGEST else bare)
            continue
        for part in filter(None, _MARKS.split(bare)):
            last = max(len(part) - LONGEST, 0)
            out.extend(part[at : at + LONGEST] for at in [*range(0, last, LONGEST // 2), last])
    return out


class _Savings(dict):
    """word -> bytes that the toxic dictionary saves on its window against the ordinary one, 0 at least."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        def compressor(content: bytes):
            held = z.ZstdCompressionDict(content + CARRIER, dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(19, min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0, format=z.FORMAT_ZSTD1_MAGICLESS)
            held.precompute_compress(compression_params=how)
            return z.ZstdCompressor(dict_data=held, compression_params=how).compress

        super().__init__()
        self.sizes = compressor(ordinary), compressor(toxic)

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        bare = word.strip(_EDGES)
        if bare != word:
            saved = self[bare]
        else:
            window = CARRIER + b" " + word.encode("utf-8", "surrogatepass") + b"  "
            ordinary, toxic = self.sizes
            saved = max(0, len(ordinary(window)) - len(toxic(window))) if word else 0
        self[word] = saved
        return saved


def _savings(model: Model) -> _Savings:
    key = model.toxic, model.ordinary
    return worker_state("savings", key, lambda: _Savings(*key))


def _train_dictionary(counts: dict[str, int], size: int) -> bytes:
    """A zstandard dictionary trained on windows of eight words, each word as often as its count, up to 60 times."""
    import zstandard as z

    drawn = [w for w in sorted(counts) for _ in range(min(60, max(2, counts[w])))]
    random.Random(7).shuffle(drawn)
    samples = [(" " + "  ".join(drawn[i : i + 8]) + " ").encode("utf-8", "surrogatepass") for i in range(0, len(drawn), 8)]
    try:
        return z.train_dictionary(size, samples, k=30, d=6).as_bytes()
    except z.ZstdError:  # too few samples for the trainer: the windows themselves are the dictionary
        return b"".join(samples)[-size:]


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit dictionaries and thresholds to ``labels`` (doc_id, toxic) joined with ``docs`` (doc_id, text).

    Takes SAMPLE_ROWS rows at most; of rows that share a labelled doc_id the one of least text. Three quarters train the dictionaries, from document frequencies counted by Spark
    with each text once, so that exact copies count once; a quarter calibrates. The driver gets
    word counts up to DICTIONARY_WORDS and a row of sums for each calibrating document. Without both labels the
    model rejects nothing.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4))
    fit = rows.where(fold != 0).groupBy(F.xxhash64("text").alias("copy"), F.xxhash64(F.reverse("text")).alias("copy2"), "toxic").agg(F.first("text").alias("text"))
    fit = saved(fit.select("toxic", "text"), "labelled")
    word = F.explode(F.array_distinct(F.split(F.trim(F.lower("text")), r"\s+"))).alias("word")
    totals = {r["toxic"]: r["n"] for r in fit.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Model(b"", b"")
    bare = F.regexp_replace("word", r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "").alias("word")
    counts = fit.select("toxic", word).select("toxic", bare).where("word <> ''").groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = saved(counts, "word-counts")
    least = max(LEAST_DOCS, LEAST_SHARE * bad)
    over = counts.where((F.col("a") >= least) & ((F.col("b") + 0.5) / good * OVER < F.col("a") / bad))
    toxic = {r["word"]: r["a"] for r in over.orderBy(F.desc("a"), "word").limit(DICTIONARY_WORDS).collect()}
    plain = {r["word"]: r["b"] for r in counts.where("b > 0").orderBy(F.desc("b"), "word").limit(DICTIONARY_WORDS).collect()}
    if not toxic:
        return Model(b"", b"")
    model = Model(_train_dictionary(toxic, TOXIC_BYTES), _train_dictionary(plain, ORDINARY_BYTES))
    return _calibrate(model, rows.where(fold == 0))


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """The step and the sum of savings that tell the labels apart best, midway between neighbours."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        savings = _savings(model)
        for b in batches:
            sums = []
            for t in b.column("text"):
                found = np.array([savings[w] for w in windows(t.as_py())] or [0])
                sums.append([int(np.maximum(0, found - s + 1).sum()) for s in STEPS] + [len(found)])
            yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array(sums, pa.list_(pa.int64()))], ["toxic", "sums"])

    seen = rows.select("text", "toxic").mapInArrow(scan, "toxic int, sums array<long>").collect()
    label = np.array([r["toxic"] for r in seen], bool)
    sums = np.array([r["sums"] for r in seen], float).reshape(-1, len(STEPS) + 1)
    if not label.any() or label.all():
        return Model(model.toxic, model.ordinary, max(STEPS) // 2, 2.5)
    best = (-1.0, 0.0, 0, 0.0, 0.0)
    for k, step in enumerate(STEPS):
        noise = 2 * sums[~label, k].sum() / sums[~label, -1].sum()
        net = sums[:, k] - noise * sums[:, -1]
        levels = np.unique(np.concatenate([[0.0], net]))
        for low, high in zip(levels, levels[1:], strict=False):
            cut = (low + high) / 2
            if cut > 0:
                best = max(best, (float(((net >= cut) == label).mean()), float((high - low) / (high + 1)), step, cut, noise))
    return Model(model.toxic, model.ordinary, *best[2:]) if best[2] else model


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row and its score: s / (s + what is enough for its length), for the savings s.

    0.5 is the calibrated threshold. Null, empty and blank texts score 0; texts are read whole; repeated rows are
    scored each; other columns are ignored, and a kept one named score or predicted gives way to the result.
    """

    def make(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        savings, out = _savings(model), []
        for t in texts:
            found = [savings[w] for w in windows(t.as_py())] if model.toxic else []
            s = sum(x - model.step + 1 for x in found if x >= model.step)
            out.append(s / (s + model.enough + model.noise * len(found)) if s else 0.0)
        yield len(out), [pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())]

    return mapped_texts(docs, keep, make, "score double, predicted int")
