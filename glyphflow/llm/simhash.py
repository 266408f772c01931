"""SimHash near-duplicates: 64-bit fingerprints of word shingles linked through covering locality-sensitive hashing.

A covering family for radius r draws one vector of r + 1 bits for each fingerprint position and makes a mask for each
of the 2^(r+1) - 1 non-zero vectors v: the positions whose vector has an odd product with v. Any r positions span at
most r dimensions, so some v is orthogonal to all of them and its mask avoids them: two fingerprints at most r bits
apart agree under that mask, with certainty. Equal fingerprints are merged first.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

SEED = 42
#: Buckets beyond this many different fingerprints are split by a further covering family over their free bits.
BUCKET = 4096
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Eight 0/1 lanes of one byte each for every byte value: lane k is bit k.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of the text, A-Z lower-cased, cut at blanks and 09-0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words where there are fewer."""
    w = words(text)
    runs = map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)] * bool(w)
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in more than half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 512):
        lanes = _LANES[hashes[at : at + 255 * 512].astype("<u8").view(np.uint8).reshape(-1, 8)]
        counts += np.add.reduceat(lanes, np.arange(0, len(lanes), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and signed 64-bit fingerprint ``fp`` of every row; a null or word-less text has fingerprint 0."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), shingle)) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, "doc_id long, fp long")


def covering_masks(radius: int, level: int = 0, bits: int = 64) -> list[int]:
    """The masks of one family; a level has its own random vectors."""
    draw = random.Random(1_000_003 * radius + level)
    vectors = [draw.randrange(1 << (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _spanning_edges(group: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links within one bucket, found breadth-first."""
    left = group
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                for y in left[near].tolist():
                    yield int(x), y
                queue.extend(left[near])
                left = left[~near]


def _bucket_links(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; a bucket may go on in the next batch."""
        kept_key, kept = np.empty((0, 2), np.int64), np.empty(0, np.int64)

        def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(fp)]])
            size = ends - starts
            two = starts[size == 2]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
            out = list(zip(fp[two].tolist(), fp[two + 1].tolist(), strict=True))
            for a, b in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
                out.extend(_spanning_edges(fp[a:b], radius))
            return pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            key = np.concatenate([kept_key, np.stack([b.column("bucket").to_numpy(zero_copy_only=False), b.column("masked").to_numpy(zero_copy_only=False)], 1)])
            fp = np.concatenate([kept, b.column("fp").to_numpy(zero_copy_only=False)])
            whole = int(np.flatnonzero((key == key[-1]).all(1))[0])
            if whole:
                yield links(key[:whole], fp[:whole])
            kept_key, kept = key[whole:], fp[whole:]
        if len(kept):
            yield links(kept_key, kept)

    return scan


def _dealt(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """fp, fixed, bucket and masked bits of every row in every table of the level's family.

    Rows are short and few bytes, so Spark reads many in one task; as each becomes 31 (radius 4), they are dealt out first.
    """
    tables = F.array(*(F.struct(F.lit(i).cast("long").alias("t"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(covering_masks(radius, level))))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by another hash than that of distinct values, else Spark leaves the step out
    return rows.repartition(parts, F.xxhash64("fp")).withColumn("table", F.explode(tables)).select(
        "fp", (F.col("fixed").bitwiseOR(F.col("table.mask"))).alias("fixed"), (F.xxhash64("bucket", F.lit(level), "table.t")).alias("bucket")
    ).withColumn("masked", F.col("fp").bitwiseAND(F.col("fixed")))


def near_links(nodes: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect exactly what lies within ``radius`` bits among the different values ``fp``.

    Buckets of one value are dropped before any Python work. Those beyond ``bucket`` values are dealt out again by a
    family over the bits that their mask leaves free, which again covers every pair; each level about halves the free
    bits. On the fourth, which isn't split again, 16 are left at most (five on average; a test counts them), so no
    bucket holds over 65,536 values, whatever the data.
    """
    parts, spark = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.sparkSession
    rows = nodes.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("fixed"))
    found = None
    for level in range(4):
        dealt = _dealt(rows, radius, level)
        sizes = dealt.groupBy("bucket", "masked").agg(F.count("*").alias("n")).where("n > 1")
        # Spark takes the size of what was exploded for that of the rows before, 31 times too low, and would broadcast the buckets
        live = dealt.join(sizes.hint("merge"), ["bucket", "masked"])
        last = level == 3
        small = live if last else live.where(F.col("n") <= bucket)
        links = small.select("bucket", "masked", "fp").repartition(parts, "bucket", "masked").sortWithinPartitions("bucket", "masked", "fp").mapInArrow(_bucket_links(radius), "a long, b long")
        links = saved(links, "links")
        found = links if found is None else found.unionByName(links)
        if last or sizes.where(F.col("n") > bucket).isEmpty():
            break
        rows = saved(live.where(F.col("n") > bucket).select("fp", "bucket", "fixed"), "hot")
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint and component of every row of ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable over links of at most ``radius`` differing bits, the row's own
    included; rows without a doc_id take part and get the component of their fingerprint, null where no row in it has
    a doc_id. Null, empty and blank texts share fingerprint 0. Repeated rows give repeated rows; an empty table gives
    none; other columns are ignored. Links are found among different fingerprints only and connected by repeated
    joins, never on the driver. No table is broadcast but, in those joins, small ones of links.
    """
    marked = saved(fingerprints(docs, shingle), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    roots = connected_components(near_links(nodes.select("fp"), radius))
    member = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = member.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = member.join(least.hint("merge"), "root").select("fp", "component_id")
    return marked.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
