"""Source divergence audit: how far the word shares of each source of a language lie from the others and from the language.

Terms are counted once per language and source. The terms that a language keeps are sorted into chunks; within a chunk
a term's id is its place in the sorted array (searchsorted), so ids follow UTF-8 order, and the counts of each source become
a dense vector (bincount). All sums are over integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

LEAST_DOCS = 10
TOP = 10
#: Added to every count, and the whole that shares are parts of.
PRIOR, WHOLE = 2, 1_000_000_000
#: WHOLE in two factors, by which a share is divided in two steps without leaving 64 bits (see ``shares``).
_STEPS = (31_250, 32_000)
#: Different (group, term) counts that a task holds before it passes them on.
HELD = 400_000
#: Terms of a chunk at most, counts (sources x terms) of a task's dense vectors about, and sources whose pairs are summed in one task.
CHUNK_BITS, CELLS, BLOCK = 12, 1 << 22, 256

#: Bytes of terms: letters in lower case and all beyond ASCII; every other byte is a blank.
_LOWER = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term binary, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term by (lang, source), as far as they were met together; every group has a row of the empty term."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    grown = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(lang, k), pa.repeat(source, k), pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        groups.clear()

    for b in batches:
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
            if (lang, source) not in groups:
                groups[lang, source] = Counter({b"": 0}), Counter()
                grown += 1
            n, docs = groups[lang, source]
            terms, before = (text.as_py() or b"").translate(_LOWER).split(), len(n)
            n.update(terms)
            docs.update(set(terms))
            grown += len(n) - before
            if grown > HELD:
                yield from out()
                grown = 0
    yield from out()


def shares(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(WHOLE * (count + PRIOR) / total), exact; ``total`` is at least ``count`` + PRIOR."""
    if np.max(total, initial=0) > (1 << 63) // _STEPS[1]:
        raise OverflowError("more occurrences than 64-bit shares can hold")
    q, r = np.divmod((count + PRIOR) * _STEPS[0], total)
    return 1 + q * _STEPS[1] + (r * _STEPS[1]) // total


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    d = p - q
    return d * d // (p + q)


def _chunk_values(top: int):
    def work(counted: pa.Table, members: pa.Table) -> pa.Table:
        """One chunk of a language: the sums of every pair of a source of the block and any other, and the best terms of the block's sources."""
        found = {k: [] for k in ("source", "part", "item", "value")}
        if counted.num_rows and members.num_rows:
            names = members.column("source").to_pylist()
            own = np.array(members.column("own").to_pylist())
            terms = np.array(counted.column("term").to_pylist(), object)
            vocabulary = np.array(sorted(set(terms.tolist())), object)
            place = {s: i for i, s in enumerate(names)}
            row = np.array([place[s] for s in counted.column("source").to_pylist()], np.int64)
            cell = row * len(vocabulary) + np.searchsorted(vocabulary, terms)
            n = counted.column("n").to_numpy()
            if n.sum() >= 1 << 53:
                raise OverflowError("more occurrences than exact counts can hold")
            count = np.bincount(cell, n, len(names) * len(vocabulary)).astype(np.int64).reshape(len(names), len(vocabulary))
            kinds = members.column("kinds")[0].as_py()
            p = shares(count, (members.column("n").to_numpy() + PRIOR * kinds)[:, None])
            q = shares(count.sum(0), members.column("lang_n")[0].as_py() + PRIOR * kinds)
            for i in np.flatnonzero(own):
                others = np.delete(np.arange(len(names)), i)
                sums = divergence(p[i], p[others]).sum(1)
                best = np.flatnonzero((count[i] > 0) & (p[i] > q))
                value = divergence(p[i, best], q[best])
                first = np.lexsort((best, -value))[:top]
                found["source"] += [names[i]] * (len(others) + len(first))
                found["part"] += ["pair"] * len(others) + ["term"] * len(first)
                found["item"] += [names[j].encode("utf-8", "surrogatepass") for j in others] + vocabulary[best[first]].tolist()
                found["value"] += sums.tolist() + value[first].tolist()
        lang = (counted if counted.num_rows else members).column("lang")[0].as_py()
        return pa.table(
            {
                "lang": pa.array([lang] * len(found["source"]), pa.string()), "source": pa.array(found["source"], pa.string()), "part": pa.array(found["part"], pa.string()),
                "item": pa.array(found["item"], pa.binary()), "value": pa.array(found["value"], pa.int64()),
            }
        )

    return work


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the audit of every source of every language of ``docs`` (text, lang, source).

    Terms are runs of ASCII letters (A-Z lower-cased) and of anything beyond ASCII. A language keeps the V terms that at
    least ``least_docs`` of its rows hold. A group with ``count`` of a term's occurrences and N of all kept terms' gives the
    term the share p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and so does the language; two shares differ by
    f = floor((p - q)^2 / (p + q)). Part ``pair`` has for each source every other source of its language, with f summed over all
    kept terms (0 without any); part ``term`` its ``top`` kept terms that it holds at a share above the
    language's, with f. Ranks count from 1 within source and part by falling value, ties by the item's UTF-8 bytes. All is exact.

    Null text, lang and source count as ''. Sources without terms are groups too; a language of one source has no pairs. Repeated
    rows count each, an empty table gives no rows, other columns are ignored.

    A task never holds more than one chunk of a language's terms: neither its vocabulary nor its counts are gathered.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    given = docs.select(text("lang"), text("source"), text("text")).withColumn("text", F.col("text").cast("binary"))
    met = given.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = saved(met, "term-counts")
    sources = counts.where(F.length("term") == 0).select("lang", "source")
    most = sources.groupBy("lang").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(4, min(CHUNK_BITS, (CELLS // most).bit_length() - 1))
    words = counts.where(F.length("term") > 0)
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "n")
    ordered = saved(kept, "kept-terms").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    chunks = saved(ordered.withColumn("chunk", F.shiftright(F.monotonically_increasing_id(), bits)), "term-chunks")
    langs = chunks.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("n").alias("lang_n"))
    dense = saved(words.select("lang", "source", "term", "n").join(chunks.select("lang", "term", "chunk"), ["lang", "term"]), "chunk-counts")
    totals = dense.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = saved(
        sources.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        .select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "kinds", "lang_n")))
        .withColumn("block", F.expr(f"(row_number() OVER (PARTITION BY lang ORDER BY source) - 1) div {BLOCK}")),
        "groups",
    )
    blocks = groups.where("kinds > 0").groupBy("lang").agg(F.max("block").alias("blocks")).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), "blocks"))).drop("blocks")
    members = saved(chunks.select("lang", "chunk").distinct().join(blocks, "lang").join(groups, "lang").withColumn("own", F.col("block") == F.col("at")), "chunk-members")
    asked = dense.join(blocks, "lang")
    keys = ("lang", "chunk", "at")
    values = asked.groupBy(*keys).cogroup(members.groupBy(*keys)).applyInArrow(_chunk_values(top), "lang string, source string, part string, item binary, value long")
    bare = groups.where("kinds = 0").select("lang", "source")
    none = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), F.col("item").cast("binary").alias("item"), F.lit(0).cast("long").alias("value"))
    summed = values.unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = summed.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value", "rank")
