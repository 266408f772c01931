"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into balanced parts; a small network learns a vector's part. Every vector is
indexed in its most probable part, a query searches several most probable parts, and what is found there is ranked by
the exact inner product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: Vectors that the graph and the network are fitted to (those of least hash): so many times the root of the table's
#: rows, between these bounds. Parts grow with the sample.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST = 60, 6_000, 24_000
#: Graph neighbours, and rows of the sample that a part has at least.
DEGREE, PART_ROWS = 10, 96
HIDDEN = 96
#: Rows that the network sees in training, all epochs together.
TRAINED_ROWS = 360_000
#: Every HELD-th row of the sample is kept from the fit. It asks for its neighbours, and the number of searched parts is the
#: least that finds this share of them.
HELD, RECALL = 8, 0.93
#: Rows and queries that meet in one task, at most about; larger parts are split into blocks.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 2_000


@dataclass(frozen=True)
class Router:
    weights: tuple[np.ndarray, ...]
    parts: int
    probes: int
    recall: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(x @ a + b, 0) @ c + d


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, not zero, all components finite."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, degree: int) -> np.ndarray:
    """Each row's ``degree`` nearest others by inner product."""
    out = np.empty((len(x), min(degree, len(x) - 1)), np.int32)
    for at in range(0, len(x), 256):
        s = x[at : at + 256] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 256] = np.argpartition(s, len(x) - out.shape[1], axis=1)[:, len(x) - out.shape[1] :]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A cut of the graph into parts of nearly equal size: seeded by halving, refined by capacity-bound propagation."""
    label = np.zeros(len(x), np.int64)
    for step in range(parts.bit_length() - 1):
        for p in range(1 << step):
            own = np.flatnonzero(label == p)
            if len(own) < 2:
                continue
            centred = x[own] - x[own].mean(0)
            along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            label[own[np.argsort(along, kind="stable")[len(own) // 2 :]]] = p + (1 << step)
    room = int(np.ceil(len(x) / parts * 1.05))
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
        np.add.at(votes, (graph.ravel(), np.repeat(label, graph.shape[1])), 1.0)
        votes[np.arange(len(x)), label] += 0.5
        free, new = np.full(parts, room), np.full(len(x), -1)
        for i in np.argsort(-votes.max(1), kind="stable"):
            for p in np.argsort(-votes[i], kind="stable"):
                if free[p]:
                    new[i], free[p] = p, free[p] - 1
                    break
        if (new == label).all():
            break
        label = new
    return label


def _network(x: np.ndarray, label: np.ndarray, parts: int, epochs: int) -> tuple[np.ndarray, ...]:
    """One hidden layer, cross entropy, Adam."""
    draw = np.random.default_rng(5)
    w = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = draw.permutation(len(x))
        for at in range(0, len(x), 256):
            b = order[at : at + 256]
            h = np.maximum(x[b] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(b)), label[b]] -= 1
            p /= len(b)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((x[b].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return tuple(w)


def fit(sample: np.ndarray, k: int) -> Router:
    """Partition the sample, learn the parts and choose the probes by rows that the fit hasn't seen (see HELD)."""
    width, scale = sample.shape[1], np.sqrt(sample.shape[1]) / np.linalg.norm(sample, axis=1).mean()
    asked = np.arange(len(sample)) % HELD == 0
    seen, queries = sample[~asked], sample[asked]
    parts = 1
    while len(seen) // (parts * 2) >= PART_ROWS:
        parts *= 2
    if parts == 1:
        return Router((np.zeros((width, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)), 1, 1)
    label = balanced_parts(seen, neighbour_graph(seen, DEGREE), parts)
    a, b, c, d = _network(seen * scale, label, parts, max(10, TRAINED_ROWS // len(seen)))
    router = Router((a * scale, b, c, d), parts, parts)
    home = router.logits(seen).argmax(1)
    order = np.argsort(-router.logits(queries), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None], axis=1)
    k = min(k, len(seen) - 1)
    near = np.concatenate([np.argpartition(-(queries[at : at + 256] @ seen.T), k, axis=1)[:, :k] for at in range(0, len(queries), 256)])
    needed = np.take_along_axis(rank, home[near], axis=1)
    recall = [float((needed < m).mean()) for m in range(1, parts + 1)]
    probes = 1 + next(i for i, r in enumerate(recall) if r >= RECALL)
    return Router(router.weights, parts, probes, recall[probes - 1])


def _routes(router: Router, probes: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").to_pylist(), float)
                top = np.argsort(-router.logits(x), axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(top.tolist(), pa.list_(pa.int32()))], ["vec_id", "v", "parts"])

    return scan


def _search(k: int):
    def scan(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        rows = rows.sort_values("vec_id", kind="stable")
        x, q = np.array(rows["v"].tolist(), float), np.array(queries["v"].tolist(), float)
        ids, out = rows["vec_id"].to_numpy(), []
        for i, (query, s) in enumerate(zip(queries["vec_id"], q @ x.T, strict=True)):
            s[ids == query] = -np.inf
            least = np.partition(s, -k)[-k] if len(s) > k else s.min()
            if not np.isfinite(least):
                least = s[np.isfinite(s)].min() if np.isfinite(s).any() else np.inf
            near = np.flatnonzero(s >= least - 1e-9 * (1 + abs(least)))
            exact = (x[near] * q[i]).sum(1)
            best = np.lexsort((ids[near], -exact))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near][best], "score": exact[best]}))
        return pd.concat(out)

    return scan


def _matches(base: DataFrame, asked: DataFrame, sizes: dict[int, int], queries: dict[int, int], k: int) -> DataFrame:
    """The k best of every block that a query meets. A part of many rows or queries is dealt out over several blocks."""
    blocks = lambda n, most: max(1, -(-n // most))
    parts = sorted(sizes)
    deal = base.sparkSession.createDataFrame([(p, blocks(sizes[p], BLOCK_ROWS), blocks(queries.get(p, 0), BLOCK_QUERIES)) for p in parts], "part int, row_blocks int, query_blocks int")
    deal = F.broadcast(deal)
    own = lambda n: F.pmod(F.xxhash64("vec_id", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = base.join(deal, "part").withColumn("rb", own("row_blocks")).withColumn("qb", every("query_blocks")).select("part", "rb", "qb", "vec_id", "v")
    right = asked.join(deal, "part").withColumn("qb", own("query_blocks")).withColumn("rb", every("row_blocks")).select("part", "rb", "qb", "vec_id", "v")
    return left.groupBy("part", "rb", "qb").cogroup(right.groupBy("part", "rb", "qb")).applyInPandas(_search(k), "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by inner product, nearest first.

    Both tables have vec_id and embedding. A row is never its query's own neighbour (equal vec_id). Ties go to the
    smaller vec_id; fewer rows come only where fewer candidates exist, as a query that its parts leave short searches
    all of them. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without
    a vec_id or of another width than the first of the sample; repeated base rows are candidates each, repeated query
    ids count once. Other columns are ignored; an empty table gives no rows. The driver gets the sample and a few
    counts for each part.
    """
    shown = lambda df: df.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    base, wanted = shown(vectors), shown(queries).dropDuplicates(["vec_id"])
    schema = "query_id long, vec_id long, score double"
    size = min(max(SAMPLE_LEAST, int(SAMPLE_SHARE * base.count() ** 0.5)), SAMPLE_MOST)
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).select("v").toArrow().column("v").to_pylist()
    if not sample:
        return base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = len(sample[0])
    router = fit(np.array([v for v in sample if len(v) == width], float), k)
    base, wanted = base.where(F.size("v") == width), wanted.where(F.size("v") == width)
    routed = "vec_id long, v array<double>, parts array<int>"
    index = saved(base.mapInArrow(_routes(router, 1), routed).select("vec_id", "v", F.element_at("parts", 1).alias("part")), "index")
    asked = saved(wanted.mapInArrow(_routes(router, router.probes), routed).select("vec_id", "v", F.explode("parts").alias("part")), "asked")
    sizes = {r["part"]: r["n"] for r in index.groupBy("part").agg(F.count("*").alias("n")).collect()}
    loads = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = saved(top(_matches(index, asked, sizes, loads, k)), "found")
    enough = min(k, sum(sizes.values()) - 1)
    full = first.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("query_id")
    ids = asked.select("vec_id", "v").dropDuplicates(["vec_id"])
    short = ids.join(full, ids["vec_id"] == full["query_id"], "left_anti")
    if short.isEmpty():
        return first
    everywhere = short.withColumn("part", F.explode(F.array(*(F.lit(p) for p in sorted(sizes)))))
    n = short.count()
    again = top(_matches(index, everywhere, sizes, {p: n for p in sizes}, k))
    return first.join(full, "query_id", "left_semi").unionByName(again)
