"""Groups of near copies at a given Jaccard similarity of their word shingles, one document of each kept.

SimHash links of a few bits find copies with slight changes, but a pair at similarity 0.8 differs in about ten of 64
fingerprint bits, beyond what a covering family can reach with a bearable number of tables. The fingerprints' shingle
hashes therefore also give minima under 80 permutations, in 16 bands of five: a pair at 0.8 shares a band with
probability 0.998. Candidates of both kinds are verified by the exact similarity of their shingle sets.

A spanning forest a bucket comes first. Members of a bucket that its verified links leave apart then all meet one
another, in pairs of chunks, and are compared exactly until no candidate pair of different components is left. Where a
bucket leaves many apart, as under a header that unlike texts share, only those meet that share a shingle among their
rarest: two sets of similarity s or more share one of the first (1 - s) n + 1 of their n shingles in any common order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let_go, saved, stretches
from .components import connected_components
from .simhash import fingerprint, near_links, shingle_hashes

BANDS, ROWS = 16, 5
#: A bucket's members meet in chunks of about so many; what heads each chunk's groups meets in the next round.
CHUNK = 2_048
ROUNDS = 6
#: What the verified links leave apart meets in pairs of chunks of about so many.
HALF = 512
#: A bucket that leaves more members apart is gone through by their rarest shingles.
MANY = 2_048
#: Parts that a shingle's rows are dealt out over where its number is looked up.
SALT = 16
#: Three deviations of the estimate from 80 values.
MARGIN = 0.14
_DRAW = np.random.default_rng(17)
_A = _DRAW.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def prepared(docs: DataFrame) -> DataFrame:
    """row (every column), text and node of every row: equal texts are one node, different texts never; a null text is empty.

    A node is a 64-bit hash. Where two texts share it, told by a second hash, both are hashed anew with both; over
    10^10 texts some few hashes are shared, so their list is broadcast.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"one": text_hash(F.col("text")), "two": F.xxhash64(F.lit("two"), "text")})
    shared = saved(rows.groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).where("low <> high").select("one", F.lit(True).alias("shared")), "shared")
    node = F.when(F.col("shared"), F.xxhash64("one", "two")).otherwise(F.col("one"))
    return rows.join(F.broadcast(shared), "one", "left").select("row", "text", node.alias("node"))


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the hashes under each permutation (multiply and add, upper 32 bits); zeros for none."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at : at + 4096, None] * _A + _B).min(0))
    return (least >> np.uint64(32)).astype(np.uint32) if len(hashes) else np.zeros(BANDS * ROWS, np.uint32)


def _sketches(shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for b in (part for whole in batches for part in stretches(whole)):
            fps, bands, low = [], [], []
            for t in b.column("text"):
                h = shingle_hashes(t.as_py(), shingle)
                m = minima(h)
                fps.append(fingerprint(h))
                bands.append([xxhash.xxh64_intdigest(m[k * ROWS : (k + 1) * ROWS].tobytes(), k) - (1 << 63) for k in range(BANDS)])
                low.append(m.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["node", "fp", "bands", "low"])

    return scan


def _forest(nodes: np.ndarray, low: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int]]:
    """Maximum spanning forest of a chunk by estimated similarity, and one node of each tree."""
    near, parent = np.full(len(nodes), -1.0), np.zeros(len(nodes), np.int64)
    left = np.arange(len(nodes))
    edges, heads = [], []
    while len(left):
        pick = int(near[left].argmax())
        x = left[pick]
        if near[x] >= least:
            edges.append((int(nodes[x]), int(nodes[parent[x]])))
        else:
            heads.append(int(x))
        left = np.delete(left, pick)
        alike = (low[left] == low[x]).mean(1)
        closer = alike > near[left]
        near[left[closer]], parent[left[closer]] = alike[closer], x
    return edges, heads


def _chunk_links(least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, salt); output rows are links (a, b) and, with a null b, heads."""
        key: tuple | None = None
        nodes: list[int] = []
        low: list[bytes] = []
        out: list[tuple] = []

        def close() -> None:
            if len(nodes) > 1:
                table = np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1)
                edges, heads = _forest(np.array(nodes), table, least)
                out.extend((key[0], a, b, None) for a, b in edges)
                out.extend((key[0], nodes[h], None, low[h]) for h in heads)
            elif nodes:
                out.append((key[0], nodes[0], None, low[0]))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["bucket", "a", "b", "low"])
            out.clear()
            return made

        for b in batches:
            for at, salt, n, x in zip(*(b.column(c).to_pylist() for c in ("bucket", "salt", "node", "low")), strict=True):
                if (at, salt) != key:
                    close()
                    key, nodes, low = (at, salt), [], []
                nodes.append(n)
                low.append(x)
            yield batch()
        close()
        yield batch()

    return scan


def _buckets(sketched: DataFrame) -> DataFrame:
    """(node, bucket) for every band of a node."""
    return sketched.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("bucket"))


def _band_links(sketched: DataFrame, similarity: float) -> DataFrame:
    """Candidate links (a, b) among nodes that share a band, a spanning forest a bucket."""
    spark = sketched.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _buckets(sketched)
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = dealt.join(sizes, "bucket").join(sketched.select("node", "low"), "node").select("bucket", "n", "node", "low")
    found = None
    for turn in range(ROUNDS):
        salted = rows.select("bucket", "node", "low", F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("n") / CHUNK)).alias("salt"), "n")
        heads_of = salted.select("bucket", "salt", "node", "low").repartition(parts, "bucket", "salt").sortWithinPartitions("bucket", "salt", "node")
        made = saved(heads_of.mapInArrow(_chunk_links(similarity - MARGIN), "bucket long, a long, b long, low binary"), "chunks")
        links = made.where("b is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        large = sizes.where(F.col("n") > CHUNK).select("bucket")
        heads = made.where("b is null").join(large, "bucket", "left_semi").select("bucket", F.col("a").alias("node"), "low")
        rows = saved(heads.withColumn("n", F.count("*").over(Window.partitionBy("bucket"))).where("n > 1"), "heads")
        if rows.isEmpty():
            break
        sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    return found


def _cells(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows come sorted by (bucket, i, j): key and columns of one cell after the other."""
    key, held = None, [[] for _ in columns]
    for b in batches:
        for at, *row in zip(zip(*(b.column(c).to_pylist() for c in ("bucket", "i", "j"))), *(_items(b.column(c)) for c in columns), strict=True):
            if at != key:
                if key is not None:
                    yield key, held
                key, held = at, [[] for _ in columns]
            for column, x in zip(held, row, strict=True):
                column.append(x)
    if key is not None:
        yield key, held


def _items(column: pa.Array) -> list:
    """Python values, but numpy arrays for lists, which own their memory."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b].copy() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _apart(least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The members of each cell that are alike, by the estimate, to a member of another component."""
        for key, (nodes, roots, low) in _cells(batches, ["node", "root", "low"]):
            root, table = np.array(roots), np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1)
            values, n = np.unique(root, return_counts=True)
            mark = np.zeros(len(root), bool)
            for x in np.flatnonzero(root != values[n.argmax()]):
                near = (root != root[x]) & ((table == table[x]).mean(1) >= least)
                mark |= near
                mark[x] |= near.any()
            at = np.flatnonzero(mark)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * len(at), pa.int64()) for k in key), pa.array([nodes[x] for x in at], pa.int64()), pa.array(root[at], pa.int64()), pa.array([low[x] for x in at], pa.binary())],
                ["bucket", "i", "j", "node", "root", "low"],
            )

    return scan


def _joined(root: np.ndarray, table: np.ndarray, sets: list[np.ndarray], similarity: float, least: float) -> list[tuple[int, int]]:
    """Pairs at the similarity or above that join all components (given by ``root``) which any candidate pair joins.

    A component grows from each of its members in turn; what joins it brings its own component's members along. So
    every candidate pair of different components is compared once, unless other pairs have joined its ends before.
    """
    size = np.array([len(x) for x in sets])
    done = np.zeros(len(root), bool)
    links = []
    for start in range(len(root)):
        if done[start]:
            continue
        queue = list(np.flatnonzero(root == root[start]))
        done[queue] = True
        while queue:
            x = queue.pop()
            alike = np.flatnonzero(~done)
            alike = alike[np.minimum(size[alike], size[x]) >= similarity * np.maximum(size[alike], size[x])]
            alike = alike[(table[alike] == table[x]).mean(1) >= least]
            for y in alike:
                if done[y]:
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if common >= similarity * (size[x] + size[y] - common):
                    links.append((int(x), int(y)))
                    more = np.flatnonzero(root == root[y])
                    done[more] = True
                    queue.extend(more)
    return links


def _exact_links(similarity: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (nodes, roots, low, sets) in _cells(batches, ["node", "root", "low", "shingles"]):
            table = np.frombuffer(b"".join(low), np.uint8).reshape(len(low), -1)
            links = _joined(np.array(roots), table, sets, similarity, similarity - MARGIN)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[e[k]] for e in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return scan


def _rarest(nodes: DataFrame, sets_of, similarity: float) -> DataFrame:
    """(node, bucket): the shingles by which a node meets every other at the similarity or above, the rarest among ``nodes`` first."""
    held = saved(sets_of(nodes), "hot-shingles")
    each = held.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    numbers = each.groupBy("shingle").agg(F.count("*").alias("count")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    numbered = each.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int")).join(numbers, ["shingle", "salt"])
    ranked = numbered.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("count", "shingle")))
    return ranked.where((F.col("rank") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("count") > 1)).select("node", F.col("shingle").alias("bucket"))


def _split(members: DataFrame) -> DataFrame:
    """bucket, main, its members and ``apart``, those outside ``main``, of every bucket with members of several components."""
    by_root = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots")).where("roots > 1")
    return split.select("bucket", F.col("main.root").alias("main"), F.col("main.n").alias("n"), (F.col("n") - F.col("main.n")).alias("apart"))


def _links_left(sketched: DataFrame, links: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Verified links (a, b) between nodes that share a band and that ``links`` leaves in different components.

    Of a bucket's members, those of its largest component don't meet one another; all others meet every member. The members
    of a bucket that leaves over MANY apart meet by their rarest shingles instead, which loses no pair of the similarity.
    """
    parts = int(sketched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = connected_components(links)
    rooted = lambda dealt: dealt.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = saved(rooted(_buckets(sketched)), "members")
    split = saved(_split(members), "buckets")
    hot = split.where(F.col("apart") > MANY).select("bucket")
    if not hot.isEmpty():
        rare = saved(rooted(_rarest(members.join(hot, "bucket", "left_semi").select("node").distinct(), sets_of, similarity)), "rare-members")
        members = members.join(hot, "bucket", "left_anti").select("node", "bucket", "root").unionByName(rare.select("node", "bucket", "root"))
        # by the rarest shingles every pair meets, so what is still large is alike
        split = split.where(F.col("apart") <= MANY).unionByName(_split(rare))
    split = split.select("bucket", "main", F.ceil(F.col("apart") / HALF).alias("p"), F.ceil(F.col("n") / HALF).alias("q"))
    met = members.join(split, "bucket").join(sketched.select("node", "low"), "node").withColumn("chunk", F.when(F.col("root") == F.col("main"), F.col("p") + F.pmod(F.xxhash64("node"), "q")).otherwise(F.pmod(F.xxhash64("node"), "p")))
    others = F.when(F.col("chunk") < F.col("p"), F.sequence(F.lit(0).cast("long"), F.col("p") + F.col("q") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("p") - 1))
    met = met.withColumn("other", F.explode(others)).where("other <> chunk").select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", "root", "low")
    met = met.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    apart = saved(met.mapInArrow(_apart(similarity - MARGIN), "bucket long, i long, j long, node long, root long, low binary"), "apart")
    # cells of the same members are one
    same = apart.groupBy("bucket", "i", "j").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "i", "j")).alias("cell")).select("cell.*")
    held = saved(sets_of(apart.select("node").distinct()), "shingles")
    full = apart.join(one, ["bucket", "i", "j"], "left_semi").join(held, "node")
    full = full.repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    return full.mapInArrow(_exact_links(similarity), "a long, b long").distinct()


def shingle_sets(texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node and its different shingle hashes, sorted, of every node of ``texts`` that ``nodes`` (node) names, once each.

    A hash table of the nodes, a few bytes each, is met by the texts as they come, so that no text is sorted for those that are left out.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in stretches(whole)):
            found = [np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(found, pa.list_(pa.int64()))], ["node", "shingles"])

    return texts.join(nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]).mapInArrow(sets, "node long, shingles array<long>")


def near_copy_links(texts: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """Verified links (a, b) between nodes (different texts) at or above the similarity; ``texts`` has node and text (see ``prepared``)."""
    texts = texts.select("node", "text")
    sketched = saved(texts.mapInArrow(_sketches(shingle), "node long, fp long, bands array<long>, low binary").dropDuplicates(["node"]), "sketches")
    bits = near_links(sketched.select("fp").distinct(), radius)
    first = sketched.groupBy("fp").agg(F.min("node").alias("head"))
    same = sketched.join(first, "fp").where(F.col("node") != F.col("head")).select(F.col("node").alias("a"), F.col("head").alias("b"))
    fewer = bits.join(first.select(F.col("fp").alias("a"), F.col("head").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("head").alias("y")), "b")
    pairs = _band_links(sketched, similarity).unionByName(same).unionByName(fewer.select(F.col("x").alias("a"), F.col("y").alias("b")))
    pairs = saved(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return shingle_sets(texts, nodes, shingle)

    linked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    held = saved(sets_of(linked), "shingles")
    both = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(held.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    links = saved(both.where(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")
    return links.unionByName(saved(_links_left(sketched, links, sets_of, similarity), "links-left"))


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of equal texts or near copies: that of the smallest doc_id, with all columns.

    Groups are connected over links of ``similarity`` or more. Null and empty texts are one group. A row without a
    doc_id stays only where its group has none with one; of rows equal in doc_id and text one stays.
    """
    rows = prepared(docs).withColumn("id", F.col("row.doc_id"))
    roots = connected_components(near_copy_links(rows, shingle, similarity))
    least = rows.groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("first"))
    placed = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = placed.groupBy("root").agg(F.min(F.struct("first", "node")).alias("best")).select(F.col("best.node").alias("kept"), F.col("best.first.id").alias("kept_id"))
    mine = (rows["node"] == kept["kept"]) & rows["id"].eqNullSafe(kept["kept_id"])
    return rows.join(kept.hint("shuffle_hash"), mine, "left_semi").dropDuplicates(["node", "id"]).select("row.*")
