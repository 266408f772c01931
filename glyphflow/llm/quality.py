"""Quality by Bradley-Terry ranking: a linear score learned from preference pairs of documents.

For a pair in which document a is preferred to b, P(a beats b) = sigmoid(w . (f(a) - f(b))); w minimises the logistic
loss on feature differences. Features are statistics of the text and the shares of its hashed words and of its hashed
byte trigrams. The threshold is a quantile of the learned scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import let_go, mapped_texts

#: Labelled rows to learn from, at most (those of least hash), and preference pairs drawn from them.
SAMPLE_ROWS, PAIRS = 20_000, 200_000
#: The score that the quantile is mapped to.
ACCEPT = 0.7
FEATURES = (
    "few words", "mean word length", "repeated words", "words equal to the one before", "commonest word", "capital letters",
    "marks among characters", "words ending in a mark other than .,", "bars among words", "digits", "repeated lines", "repeated runs of five words",
    "doubled marks", "words per line", "sentence ends per word",
)
#: Slots that words, and byte trigrams, are hashed to.
WORD_SLOTS, TRIGRAM_SLOTS = 32, 64
WIDTH = len(FEATURES) + WORD_SLOTS + TRIGRAM_SLOTS
#: Pairs whose differences are held at once, and Newton steps.
PAIRS_AT_ONCE, STEPS = 10_000, 8
_MARK_END = re.compile(r"[^\w\s.,;:'\")\]]$")
_DOUBLED = re.compile(r"([^\w\s])\1")


def features(text: str | None) -> np.ndarray:
    """One number for each of FEATURES, then shares of the slots; all 0 except the first for a text without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    out = np.zeros(WIDTH)
    if not n:
        out[0] = 1.0
        return out
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    letters = sum(map(len, words))
    fives = n - 4
    plain = re.sub(r"[^\W_]+", "", text)
    marks = len(plain) - sum(map(plain.count, " \n\t\r"))
    upper = sum(1 for c in text if c.isupper())
    for word, k in counts.items():
        out[len(FEATURES) + crc32(word.encode("utf-8", "surrogatepass")) % WORD_SLOTS] += k / n
    data = text.encode("utf-8", "surrogatepass")
    for at in range(0, len(data), 1 << 20):
        b = np.frombuffer(data[at : at + (1 << 20) + 2], np.uint8).astype(np.uint32)
        slot = ((b[:-2] * 0x9E3779B1) ^ (b[1:-1] * 0x85EBCA6B) ^ (b[2:] * 0xC2B2AE35)) >> 26
        out[-TRIGRAM_SLOTS:] += np.bincount(slot, minlength=TRIGRAM_SLOTS)
    out[-TRIGRAM_SLOTS:] /= max(len(data) - 2, 1)
    out[: len(FEATURES)] = [
        1 / (1 + n),
        min(letters / n, 20.0) / 10,
        1 - len(counts) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        upper / max(letters, 1),
        marks / max(letters, 1),
        sum(k for w, k in counts.items() if _MARK_END.search(w)) / n,
        counts["|"] / n,
        sum(map(text.count, "0123456789")) / max(letters, 1),
        1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))) / fives if fives > 0 else 0.0,
        len(_DOUBLED.findall(plain)) / n,
        min(n / max(len(lines), 1), 400.0) / 400,
        sum(map(text.count, (". ", ".\n", "! ", "? "))) / n,
    ]
    return out


@dataclass(frozen=True)
class Model:
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float = 0.0
    slope: float = 1.0


def fit(values: np.ndarray, preferred: np.ndarray) -> Model:
    """Weights from PAIRS drawn pairs of a preferred and another document; the threshold at the best score quantile."""
    draw = np.random.default_rng(11)
    centre, scale = values.mean(0), values.std(0) + 1e-6
    x = np.clip((values - centre) / scale, -6, 6)
    good, bad = np.flatnonzero(preferred), np.flatnonzero(~preferred)
    better, worse = draw.choice(good, PAIRS), draw.choice(bad, PAIRS)
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):
        slope, bend = -1e-3 * w, 1e-3 * np.eye(len(w))
        for at in range(0, PAIRS, PAIRS_AT_ONCE):
            d = x[better[at : at + PAIRS_AT_ONCE]] - x[worse[at : at + PAIRS_AT_ONCE]]
            lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            slope += d.T @ lost / PAIRS
            bend += (d * (lost * (1 - lost))[:, None]).T @ d / PAIRS
        w += np.linalg.solve(bend, slope)
    s = x @ w
    quantiles = np.unique(np.concatenate([np.linspace(0, 1, 401), [(~preferred).mean()]]))
    cuts = np.quantile(s, quantiles)
    right = np.array([((s >= c) == preferred).mean() for c in cuts])
    cut = float(np.median(cuts[right >= right.max() - 1e-9]))
    return Model(tuple(centre), tuple(scale), tuple(w), cut, float(2 / (s.std() + 1e-9)))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit to ``labels`` (doc_id, quality) joined with ``docs`` (doc_id, text); the driver gets feature rows only.

    Of rows that share a labelled doc_id the one of least text counts, so SAMPLE_ROWS bounds the rows too. Without both labels every document is accepted.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("quality").cast(pa.int32()), pa.array([features(t.as_py()) for t in b.column("text")], pa.list_(pa.float64()))], ["quality", "f"])

    one = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = one.select("quality", "text").mapInArrow(scan, "quality int, f array<double>").toArrow()
    values = np.array(rows.column("f").to_pylist(), float).reshape(-1, WIDTH)
    preferred = np.array(rows.column("quality").to_pylist(), int) == 1
    if not preferred.any() or preferred.all():
        flat = (0.0,) * WIDTH
        return Model(flat, (1.0,) * WIDTH, flat, -1.0)
    order = np.lexsort((*values.T, preferred))
    return fit(values[order], preferred[order])


def scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row, its score (a logistic of the ranking score, ACCEPT at the threshold) and decision.

    A null or word-less text is scored as a text without words. Texts are read whole; repeated rows are scored
    each; other columns are ignored, and a kept one named score or predicted gives way to the result.
    """
    centre, scale, w = (np.array(x) for x in (model.centre, model.scale, model.weights))
    at = float(np.log(ACCEPT / (1 - ACCEPT)))

    def make(texts: pa.Array) -> Iterator[tuple[int, list[pa.Array]]]:
        let_go()
        f = np.array([features(t.as_py()) for t in texts], float).reshape(-1, WIDTH)
        s = np.clip((f - centre) / scale, -6, 6) @ w - model.threshold
        p = 1 / (1 + np.exp(-np.clip(model.slope * s + at, -700, 700)))
        p = np.where(s >= 0, np.maximum(ACCEPT, p), np.minimum(np.nextafter(ACCEPT, 0), p))
        yield len(p), [pa.array(p, pa.float64()), pa.array((p >= ACCEPT).astype(np.int32), pa.int32())]

    return mapped_texts(docs, keep, make, "score double, predicted int")
