"""Hard negatives: rows of another label that score just below an anchor's positives.

Anchors meet all rows block by block. Within a block every anchor's integer scores are sorted in full (by score and
vec_id); its best rows of the same label, and below each positive's score the next rows of other labels (by binary
search), go on, and the few that each block gives are ranked together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Rows and anchors that meet in one task, at most about, and scores that are sorted at a time.
BLOCK_ROWS, BLOCK_ANCHORS, SORTED = 8_192, 2_048, 1 << 20
SCALE = 256
_LONG = 1 << 63


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad, F.lit(False))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """floor(SCALE * x) of every component, a shorter vector filled up with zeros."""
    flat = vectors.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    sizes = np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(flat), width))
    out[np.repeat(np.arange(len(flat)), sizes), np.concatenate([np.arange(n) for n in sizes]) if sizes.sum() else np.empty(0, int)] = flat.flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(SCALE * out)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows; beyond what a long holds, its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return np.clip(exact, -_LONG, _LONG - 1).astype(np.int64)


def _width(*tables: pa.Table) -> int:
    return max((len(v) for t in tables for v in t.column("v")), default=0)


def _sorted_scores(rows: pa.Table, anchors: pa.Table):
    """(anchor's place, vec_ids, labels and scores of all rows of other vec_ids, by falling score and rising vec_id) of each anchor."""
    rows = rows.sort_by("vec_id")
    width = _width(rows, anchors)
    x, a = _matrix(rows.column("v"), width), _matrix(anchors.column("v"), width)
    ids, labels = rows.column("vec_id").to_numpy(), rows.column("label").to_numpy()
    own = anchors.column("vec_id").to_numpy()
    step = max(1, SORTED // max(1, len(ids)))
    for at in range(0, len(a), step):
        scores = inner_products(a[at : at + step], x)
        for k, s in enumerate(scores, at):
            order = np.lexsort((ids, ~s))  # ~s falls as s rises, and holds the smallest long too
            order = order[ids[order] != own[k]]
            yield k, ids[order], labels[order], s[order]


def _positives(most: int):
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        key, ids, scores = [], [], []
        if rows.num_rows and anchors.num_rows:
            label, keys = anchors.column("label").to_numpy(), anchors.column("key").to_pylist()
            for k, i, own, s in _sorted_scores(rows, anchors):
                best = np.flatnonzero(own == label[k])[:most]
                key += [keys[k]] * len(best)
                ids += i[best].tolist()
                scores += s[best].tolist()
        return pa.table({"key": pa.array(key, pa.int64()), "positive_id": pa.array(ids, pa.int64()), "positive_score": pa.array(scores, pa.int64())})

    return work


def at_least(share: int, score: int) -> int:
    """The least whole number whose hundredfold reaches ``share`` times ``score``."""
    return -(-share * score // 100)


def _negatives(most: int, share: int):
    def work(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        key, place, ids, scores = [], [], [], []
        if rows.num_rows and anchors.num_rows:
            label, keys, asked = anchors.column("label").to_numpy(), anchors.column("key").to_pylist(), anchors.column("positives").to_pylist()
            for k, i, own, s in _sorted_scores(rows, anchors):
                other = own != label[k]
                i, s = i[other], s[other]
                falling = ~s
                for n, limit in enumerate(asked[k]):
                    first = int(np.searchsorted(falling, ~np.int64(limit), "left"))
                    best = s[first : first + most]
                    best = best[best >= np.int64(max(at_least(share, limit), -_LONG))] if at_least(share, limit) < _LONG else best[:0]
                    key += [keys[k]] * len(best)
                    place += [n] * len(best)
                    ids += i[first : first + len(best)].tolist()
                    scores += best.tolist()
        return pa.table({"key": pa.array(key, pa.int64()), "place": pa.array(place, pa.int32()), "negative_id": pa.array(ids, pa.int64()), "negative_score": pa.array(scores, pa.int64())})

    return work


def _met(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, work, schema: str) -> DataFrame:
    """What ``work`` makes of every block of rows and block of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("ab", every(anchor_blocks))
    right = anchors.withColumn("rb", every(row_blocks))
    return left.groupBy("rb", "ab").cogroup(right.groupBy("rb", "ab")).applyInArrow(work, schema)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Both tables have vec_id, embedding and label. Every component x counts as floor(256 x), and a row's score is its
    inner product with the anchor, a whole number; higher scores come first, ties by smaller vec_id. An anchor's positives
    are its first ``positives`` rows of the same label. For each of them come the first ``negatives`` rows of another label
    with ``share`` * positive_score <= 100 * negative_score <= 100 * positive_score, ranked from 1; a positive without any
    has no row. An anchor never meets rows of its own vec_id.

    Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Repeated rows of
    ``vectors`` stand for themselves; equal rows of ``anchors`` count once, rows of one vec_id that differ are anchors each.
    A shorter vector counts as filled up with zeros; scores beyond a long stand at its ends. Empty tables give no rows,
    other columns are ignored.

    A task holds one block of rows and one of anchors; an anchor gets ``positives`` (times ``negatives``) rows at most from
    each block, and of these each partition keeps the best only before they are ranked together.
    """
    shown = lambda df: df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").alias("v"))
    base, asked = shown(vectors), shown(anchors).dropDuplicates()
    row_blocks, anchor_blocks = max(1, -(-base.count() // BLOCK_ROWS)), max(1, -(-asked.count() // BLOCK_ANCHORS))
    block = lambda n, *c: F.pmod(F.xxhash64(*c, F.lit("block")), F.lit(n)).cast("int")
    rows = base.withColumn("rb", block(row_blocks, "vec_id"))
    asked = asked.withColumn("key", F.xxhash64("vec_id", "label", "v")).withColumn("ab", block(anchor_blocks, "key"))
    found = _met(rows, asked, row_blocks, anchor_blocks, _positives(positives), "key long, positive_id long, positive_score long")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives)
    best = saved(best, "positives")
    limits = best.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda p: p["positive_score"]).alias("positives"))
    below = _met(rows, asked.join(limits, "key"), row_blocks, anchor_blocks, _negatives(negatives, share), "key long, place int, negative_id long, negative_score long")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = below.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = best.join(asked.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return ranked.join(named, ["key", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
