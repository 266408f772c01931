"""Token files, SimHash, URL filter, decontamination, token counts and pieces against brute force."""

import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import decontaminate, near_copies, pieces, registry, simhash, token_counts, token_files, url_filter

from glyphflow.llm.common import new_folder

from ..conftest import SF

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string"
ODD = [(5, None, "x"), (3, "", "x"), (3, "", "x"), (None, "Hello there, world. It's <|endoftext|> é", None), (9, "a b " * 3000, "y"), (-2, "naïve Ünïts 12 !?.,", None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_elias_fano_round_trip():
    draw = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (5, 10), (3000, 3000), (3000, 10**9), (700, 3)):
        v = np.sort(draw.integers(0, top, n))
        e = token_files.EliasFano.from_bytes(token_files.EliasFano.of(v).to_bytes())
        assert (e.values() == v).all()
        assert all(e.select(i) == v[i] for i in range(0, n, 37))
    assert len(token_files.EliasFano.of(np.arange(0, 10**6, 100)).to_bytes()) < 10**4 * 9 / 8 + 400


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_files.token_files(docs(spark, ODD), path).orderBy("start").collect()]
    at = 0
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(ordered)
    for row, (d, text, _) in zip(got, ordered, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert row == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.token_files(docs(spark, []), path).count() == 0


def test_shard_random_access():
    ids = np.arange(70_000) % 66_000
    data = token_files.shard_bytes([None, -5, 7, 7], [1, 2, 0, 69_997], ids)
    shard = token_files.Shard(data)
    assert [shard.doc_id(i) for i in range(4)] == [None, -5, 7, 7]
    assert [len(shard.document(i)) for i in range(4)] == [1, 2, 0, 69_997]
    assert (shard.document(3) == ids[3:]).all()


def test_other_tokenizers_take_the_library_itself(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_files.word_by_word(Tokenizer.from_file(P.path("word_bpe_49k.json"))) and not token_files.word_by_word(library)
    got = {(r["doc_id"], r["n_tokens"]) for r in token_files.token_files(docs(spark, ODD), path).collect()}
    assert got == {(d, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for d, t, _ in ODD}


def test_rows_without_an_id_are_dealt_out(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    made = token_files.write_token_files(rows, new_folder(spark, "dealt"), P.path("word_bpe_49k.json"), partitions=4)
    assert made.select("part").distinct().count() > 1
    read = token_files.read_token_files(made).toPandas().sort_values("start")
    assert len(read) == 4000 and (read["start"].iloc[1:].to_numpy() == (read["start"] + read["n_tokens"]).iloc[:-1].to_numpy()).all()


def test_covering_masks_cover():
    masks = simhash.covering_masks(3)
    draw = random.Random(1)
    for _ in range(300):
        flip = sum(1 << b for b in draw.sample(range(64), 3))
        assert any(not flip & m for m in masks)


def test_last_level_leaves_few_bits():
    fixed = np.zeros(1, np.uint64)
    for level in range(4):
        fixed = np.unique(fixed[:, None] | np.array(simhash.covering_masks(4, level), np.uint64))
    assert 64 - int(np.bitwise_count(fixed).min()) <= 16


@pytest.mark.parametrize("bucket", [4096, 3])
def test_near_links_connect_like_all_pairs(spark, bucket):
    draw = random.Random(2)
    base = [draw.getrandbits(64) for _ in range(4)]
    values = {b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 5))) for b in base for _ in range(25)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.near_links(spark.createDataFrame([(v,) for v in signed], "fp long"), 4, bucket).collect()

    def groups(pairs):
        root = {v: v for v in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(a)] = find(b)
        return {frozenset(v for v in signed if find(v) == r) for r in map(find, signed)}

    near = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4]
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 4 for r in links)
    assert groups((r["a"], r["b"]) for r in links) == groups(near)


def _joins(made) -> list[str]:
    """Join and first key of every join in the plan that Spark begins with."""
    return re.findall(r"(\w+Join) \[?(\w+)", made._jdf.queryExecution().executedPlan().toString())


def test_near_duplicates_broadcast_nothing(spark, monkeypatch, tmp_path):
    made, write = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, *what: (made.append(df), write(df, *what))[1])
    docs(spark, [(k, f"some words {k // 2} of a text", None) for k in range(20)]).write.parquet(f"{tmp_path}/docs")
    found = simhash.near_duplicates(spark.read.parquet(f"{tmp_path}/docs"))
    joins = [x for df in (*made, found) for x in _joins(df)]
    assert ("SortMergeJoin", "bucket") in joins and len(joins) >= 4
    assert not [x for x in joins if x[0].startswith("Broadcast")]
    assert {r["component_id"] for r in found.collect()} >= {0} and found.count() == 20


def test_near_duplicates_odd_rows(spark):
    got = simhash.near_duplicates(docs(spark, [*ODD, (1, "A  B a\tb " * 3000, None), (8, " \n", None)])).collect()
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert len(got) == 8
    assert by[5, "0" * 16] == by[3, "0" * 16] == by[8, "0" * 16] == 3
    assert [c for (d, _), c in by.items() if d in (1, 9)] == [1, 1]
    assert [c for (d, _), c in by.items() if d is None] == [None]
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_near_copies_match_brute_force(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(6):
        text = [draw.choice(words) for _ in range(160)]
        for edits in (0, 0, 1, 2, 9, 30):
            copy = list(text)
            for at in draw.sample(range(160), edits):
                copy[at] = draw.choice(words) + "x"
            rows.append((k, " ".join(copy), None))
            k += 1
    rows += [(900, "short text", None), (901, "SHORT text", None), (902, None, None), (903, "", None)]

    def sets(text):
        return set(simhash.shingle_hashes(text, 5).tolist())

    shingles = [sets(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(shingles[i] | shingles[j])
        if not both or len(shingles[i] & shingles[j]) / both >= 0.8:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    want = sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)
    got = near_copies.one_of_each(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in got.collect()) == want


def _brute_groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(x) for x in range(len(sets))]


def test_texts_of_one_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "text_hash", lambda text: F.length(text).cast("long"))
    rows = [(k, f"{k} alpha beta gamma delta epsilon {k} zeta eta theta {k}", None) for k in range(10, 40)] + [(50, "10 alpha beta gamma delta epsilon 10 zeta eta theta 10", None)]
    frame = docs(spark, rows).withColumn("node", F.lit(1)).withColumn("root", F.lit("r")).withColumn("one", F.lit(None).cast("int"))
    got = near_copies.one_of_each(frame)
    assert got.columns == frame.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(10, 40)]


@pytest.mark.parametrize(("chunk", "many"), [(2048, 2048), (40, 2048), (40, 15)])
def test_near_copies_of_many_variants(spark, monkeypatch, chunk, many):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    monkeypatch.setattr(near_copies, "MANY", many)
    monkeypatch.setattr(near_copies, "HALF", chunk, raising=False)
    draw = random.Random(11)
    base = [f"w{draw.randrange(5000)}" for _ in range(300)]
    texts = []
    for k in range(300):
        copy = list(base)
        for at in draw.sample(range(300), draw.choice((4, 5))):
            copy[at] = f"v{k}x{at}"
        texts.append(" ".join(copy))
    want = _brute_groups([set(simhash.shingle_hashes(t, 5).tolist()) for t in texts])
    assert 20 < len(set(want)) < 280
    got = near_copies.one_of_each(docs(spark, [(k, t, None) for k, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(want))


def test_unlike_texts_under_one_header_do_not_all_meet(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "MANY", 30)
    monkeypatch.setattr(near_copies, "HALF", 8)
    rows_of, save = {}, near_copies.saved

    def counted(df, what, *partition_by):
        made = save(df, what, *partition_by)
        rows_of[what] = made.count()
        return made

    monkeypatch.setattr(near_copies, "saved", counted)
    draw = random.Random(3)
    header = [f"h{i}" for i in range(180)]
    own = [[f"x{draw.randrange(10**6)}" for _ in range(70)] for _ in range(600)]
    texts = [" ".join(header + o) for o in own] + [" ".join(header + [f"y{k}", *o[1:]]) for k, o in enumerate(own[:25])]
    got = near_copies.one_of_each(docs(spark, [(k, t, None) for k, t in enumerate(texts)]))
    assert sorted(r["doc_id"] for r in got.collect()) == [*range(600)]
    assert rows_of["hot-shingles"] > 400  # all in large buckets
    assert rows_of.get("apart", 0) < 600  # of the 600 * 600 / 2 pairs that share a bucket somewhere


def test_texts_are_not_sorted_for_the_few_that_are_compared(spark):
    words = "a b c d e f g".split()
    texts = spark.createDataFrame([(1, " ".join(words)), (1, " ".join(words)), (2, "x y"), (3, ""), (4, "left out")], "node long, text string")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (9,)], "node long")
    got = near_copies.shingle_sets(texts, nodes, 5)
    want = {1: simhash.shingle_hashes(" ".join(words), 5), 2: simhash.shingle_hashes("x y", 5), 3: simhash.shingle_hashes("", 5)}
    assert sorted((r["node"], r["shingles"]) for r in got.collect()) == [(k, np.unique(h).view(np.int64).tolist()) for k, h in want.items()]
    kept = near_copies.one_of_each(docs(spark, ODD))
    for frame in (got, kept):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and not re.search("(SortMergeJoin|BroadcastHashJoin).*LeftSemi", plan)


def test_near_copies_of_nothing(spark):
    assert near_copies.one_of_each(docs(spark, [])).count() == 0
    assert near_copies.one_of_each(docs(spark, [(1, None, "a"), (2, "", "b"), (3, " ", "c")])).count() == 1


def test_url_filter(spark):
    urls = ["https://a.COM/en/1", "http://com/en/", "x://b.example.com/en/7?q#f", "example.com/en/7", None, "http://example.net/de/81", "ftp://xcom/en/", "://m.net/de/#a", "http://h.org", "http://h.org/es/é"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, registry.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[i] == (host, path, best[1], best[2])


def test_url_rules_are_the_contracts(spark):
    """One page for each rule, with the contract's word and not the registry's."""
    want = {"http://a.com/en/x": ("com/en/", "block"), "http://example.com/en/71": ("example.com/en/7", "allow"), "http://net/de/8": ("net/de/", "block"), "http://m.example.net/de/82": ("example.net/de/8", "block"), "http://b.org/es/1": ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    got = url_filter.judge_urls(pages, registry.URL_RULES).orderBy("page_id").collect()
    assert [(r["rule"], r["verdict"]) for r in got] == list(want.values())


def test_hosts_of_many_labels(spark):
    urls = ["http://" + "a." * 4000 + "example.com/en/7", "http://" + "." * 4000 + "net/de/", "http://com./en/", "http://.com/en/", "http:///en/", "http://a.b.c.d.e/x"]
    began = time.time()
    got = [r["rule"] for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), registry.URL_RULES).orderBy("page_id").collect()]
    assert got == ["example.com/en/7", "net/de/", None, "com/en/", None, None]
    assert time.time() - began < 60


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    levels = url_filter.build_cascade(universe.where("key like '%7'"), universe)
    wrong = universe.where(url_filter.listed(F.col("key"), levels) != F.col("key").like("%7"))
    assert len(levels) > 1
    assert wrong.count() == 0
    assert url_filter.build_cascade(universe.limit(0), universe) == []


def test_decontamination(spark):
    passage = [f"word{i}" for i in range(30)]
    changed = [w + "x" if i % 9 == 4 else w for i, w in enumerate(passage)]
    noise = [f"n{i}" for i in range(40)]
    rows = [
        (1, " ".join(noise + passage + noise), None), (2, " ".join(noise + changed), None), (3, " ".join(noise), None), (4, None, None), (5, "", None),
        (6, " ".join(passage[:9] + noise), None), (7, "one two THREE, four five six!", None), (7, "one two THREE, four five six!", None), (None, " ".join(passage), None), (8, "a b c", None),
    ]
    bench = spark.createDataFrame([(10, " ".join(passage)), (11, "two three four five six"), (12, "a b c"), (13, None)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.overlaps(docs(spark, rows), bench).collect()}
    assert found == {(1, 10), (2, 10), (None, 10), (7, 11), (8, 12)}
    clean = decontaminate.clean_documents(docs(spark, rows), bench)
    assert clean.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in clean.collect()) == [3, 4, 5, 6]
    assert decontaminate.overlaps(docs(spark, []), bench).count() == 0
    assert decontaminate.overlaps(docs(spark, rows), bench, least_words=5).where("item_id = 12").count() == 0


@pytest.mark.parametrize("n", range(1, 16))
def test_masks_meet_every_pattern_that_is_accepted(n):
    window = min(n, decontaminate.WINDOW)
    masks = decontaminate.MASKS[max(k for k in decontaminate.MASKS if k <= n)]
    placed = [{at + i for i, c in enumerate(m) if c == "1"} for m in masks for at in range(window - len(m) + 1)]
    for gone in range(window + 1):
        if window - gone >= decontaminate.AGREE * window:
            assert all(any(not p & set(pattern) for p in placed) for pattern in itertools.combinations(range(window), gone))


def _brute_overlaps(rows, bench):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for d, text, _ in rows:
        doc = split(text)
        for i, item in bench:
            item = split(item)
            if not item:
                continue
            window, best = min(len(item), 13), None
            for start in range(1 - len(item), len(doc)):
                e = [0 <= start + k < len(doc) and doc[start + k] == w for k, w in enumerate(item)]
                if max(sum(e[s : s + window]) for s in range(len(item) - window + 1)) >= 0.8 * window and (best is None or sum(e) > best[1]):
                    best = (start, sum(e))
            if best:
                out.add((d, i, *best, len(item)))
    return out


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_overlaps_match_all_diagonals(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    draw = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    bench = [(i, " ".join(draw.choice(words) for _ in range(n))) for i, n in enumerate([*range(2, 18), 30, 45])] + [(99, None), (98, "w1 w1 w1 w1 w1 w1 w1")]
    rows = []
    for k in range(90):
        item = draw.choice(bench)[1]
        copy = (item or "").split()
        for at in draw.sample(range(len(copy)), min(len(copy), draw.randint(0, 5))):
            copy[at] = draw.choice(words)
        noise = [draw.choice(words) for _ in range(draw.randint(0, 12))]
        rows.append((k if k % 11 else None, " ".join([*noise, *copy[draw.randint(0, 3) :], *noise]), None))
    rows += [(200, None, None), (201, "", None), (202, "w1 " * 5000, None), rows[1], rows[1]]
    frame = docs(spark, rows).withColumn("_dirty_id", F.lit(1)).withColumn("dirty_id", F.lit(2)).withColumn("h", F.lit(3))
    bench_frame = spark.createDataFrame(bench, "item_id long, text string").withColumn("seed", F.lit(1))
    found = decontaminate.overlaps(frame, bench_frame)
    want = _brute_overlaps(rows, bench)
    assert {(r["doc_id"], r["item_id"], r["doc_start"], r["n_equal"], r["n_words"]) for r in found.collect()} == want and len(want) > 25
    kept = decontaminate.clean_documents(frame, bench_frame)
    assert kept.columns == frame.columns and len([r for r in kept.collect() if r["doc_id"] is None or r["doc_id"] < 300]) == kept.count()
    dirty = {w[0] for w in want}
    assert {r["doc_id"] for r in kept.collect()} >= {r[0] for r in rows} - dirty
    assert decontaminate.overlaps(frame, bench_frame.limit(0)).count() == decontaminate.overlaps(frame.limit(0), bench_frame).count() == 0


def test_large_benchmark_isnt_broadcast(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    made, write = [], getattr(decontaminate, "saved", None)
    monkeypatch.setattr(decontaminate, "saved", lambda df, *what: (made.append(df), write(df, *what))[1], raising=False)
    # of files Spark knows the size, but not that of what is exploded from them
    spark.createDataFrame([(k // 3, " ".join(f"w{k // 3}x{i}" for i in range(30))) for k in range(90)], "item_id long, text string").write.parquet(f"{tmp_path}/bench")
    docs(spark, [(1, " ".join(f"w7x{i}" for i in range(30)), None)]).write.parquet(f"{tmp_path}/docs")
    found = decontaminate.overlaps(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/bench"))
    joins = [x for df in (*made, found) for x in _joins(df)]
    assert {key for join, key in joins if join.startswith("Broadcast")} <= {"block"} and len(joins) >= 3
    assert [r["item_id"] for r in found.collect()] == [7]


@pytest.mark.parametrize("seeds", [decontaminate.BROADCAST_SEEDS, 0])
def test_items_of_the_same_words(spark, monkeypatch, seeds):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", seeds)
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    bench = spark.createDataFrame([(1, one), (2, one.upper()), (2, one), (2, two), (None, one)], "item_id long, text string")
    found = decontaminate.overlaps(docs(spark, [(5, f"x {one} y {two}", None), (6, two, None), (6, two, None)]), bench).select("doc_id", "item_id", "doc_start", "n_equal")
    assert sorted(found.collect(), key=str) == [(5, 1, 1, 20), (5, 2, 1, 20), (5, None, 1, 20), (6, 2, 0, 20)]


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(spark, rule):
    library, width = token_counts._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    rows = [*ODD, (11, "naïve\n\n\nends é\n", None), (12, "\n", None)]
    got = token_counts.section_tokens(docs(spark, rows), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, rule).collect()
    for d, text, _ in rows:
        text = text or ""
        ids = library.encode_ordinary(text)
        lines = text.splitlines(keepends=True) if text else [""]
        edges = np.cumsum([0, *(len(x.encode()) for x in lines)])
        want, at = np.zeros(len(lines)), 0
        for i in ids:
            for k in range(len(lines)):
                a, b = max(at, edges[k]), min(at + width[i], edges[k + 1])
                if rule == "split":
                    want[k] += max(0, b - a) / width[i]
                else:
                    want[k] += edges[k] <= (at if rule == "start" else at + width[i] - 1) < edges[k + 1]
            at += width[i]
        mine = sorted({(r["section"], round(r["n_tokens"], 6), r["doc_tokens"]) for r in got if r["doc_id"] == d})
        assert mine == [(k, round(float(w), 6), len(ids)) for k, w in enumerate(want)]


def test_field_tokens(spark):
    rows = spark.createDataFrame([(1, "ab cd", None, "x")], "k long, a string, b string, c string")
    got = {r["field"]: r["n_tokens"] for r in token_counts.field_tokens(rows, "k", ["a", "b", "c"], P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    library, _ = token_counts._encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert set(got) == {"a", "b", "c"}
    assert sum(got.values()) == len(library.encode_ordinary("ab cd\n\nx"))


def _all_paths(voc, text):
    raw = " " + text
    marked = raw.replace(pieces.BLANK, "\0").replace(" ", pieces.BLANK)

    def go(i):
        if i == len(marked):
            return [(0, ())]
        out = []
        for j in range(i + 1, len(marked) + 1):
            if hit := voc.scores.get(marked[i:j]):
                out += [(hit[0] + s, (hit[1], *r)) for s, r in go(j)]
        if marked[i] not in voc.scores:
            data = raw[i].encode()
            out += [(voc.byte_score * len(data) + s, (*(voc.byte_id + b for b in data), *r)) for s, r in go(i + 1)]
        return out

    return sorted(go(0), key=lambda r: (-r[0], r[1][::-1]))


def _expanded(ids, changes):
    out, at = [], 0
    for place, n, new in changes:
        out += [*ids[at:place], *new]
        at = place + n
    return (*out, *ids[at:])


def test_pieces_against_all_paths():
    voc = pieces.vocabulary(P.path("piece_bpe_32k.model"))
    solver, draw = pieces.Chunks(voc), random.Random(5)
    texts = ["", " ", "  a", "▁", "\0", "the the the", *("".join(draw.choice("theanig oéñ.\n▁ ") for _ in range(draw.randint(0, 9))) for _ in range(150))]
    for text, (ids, score, best, exact) in zip(texts, solver.encode(texts, 5), strict=True):
        want = _all_paths(voc, text)
        whole = [_expanded(ids.tolist(), changes) for _, changes in best]
        assert [s for s, _ in best] == [s for s, _ in want[:5]]
        assert score == want[0][0] and whole[0] == tuple(ids.tolist())
        assert all((s, i) in set(want) for (s, _), i in zip(best, whole, strict=True))
        assert len(set(whole)) == len(best)
        assert exact and pieces.decode(voc, ids) == text


def test_pieces_of_a_long_run_and_of_many_chunks(monkeypatch):
    voc = pieces.vocabulary(P.path("piece_bpe_32k.model"))
    draw = random.Random(6)
    words = ["".join(draw.choice("theanig") for _ in range(draw.randint(1, 12))) for _ in range(3000)]
    texts = [" ".join(words), "the" * 30_000, "é漢" * 3_000, "word " * 20_000]
    solver = pieces.Chunks(voc)
    whole = solver.encode(texts, 5)
    monkeypatch.setattr(pieces, "MEMO_CHUNKS", 1)
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    for text, a, b in zip(texts, whole, (pieces.Chunks(voc).encode([t], 5)[0] for t in texts), strict=True):
        assert a[0].tolist() == b[0].tolist() and a[1:] == b[1:]
        assert pieces.decode(voc, a[0]) == text and a[3]
        ends, best, _ = pieces.lattice(voc, *pieces._marked(text.split(" ")[0]))
        assert pieces.search(ends, best, 1)[0] == (best[-1], tuple(solver.encode([text.split(" ")[0]], 1)[0][0].tolist()))


def test_pieces_rows(spark):
    path = P.path("piece_bpe_32k.model")
    out = pieces.encode_texts(docs(spark, ODD).withColumn("score", F.lit("mine")), path, keep=("doc_id", "lang", "Score"))
    assert out.count() == len(ODD) and out.columns[:3] == ["doc_id", "lang", "ids"]
    assert out.where("not decoded").count() == 0
    assert sorted(r["text"] for r in pieces.decode_ids(out, path).collect()) == sorted(t or "" for _, t, _ in ODD)
    best = out.select("doc_id", F.explode("n_best").alias("b"), "ids").select("doc_id", pieces.segmentation(F.col("ids"), F.col("b.changes")).alias("ids"))
    assert {r["text"] for r in pieces.decode_ids(best, path).collect()} == {t or "" for _, t, _ in ODD}
    assert pieces.encode_texts(docs(spark, []), path).count() == 0


def _plain_fingerprint(text, size=4):
    import xxhash

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return f"{sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)):016x}"


def test_fingerprints_match_a_plain_count(spark):
    draw = random.Random(9)
    texts = [t for _, t, _ in ODD] + ["A\x1cb\x0bc\u00a0d\u2003e ÄÖ f G", *(" ".join(draw.choice("aBcdÉ") * draw.randint(1, 3) for _ in range(draw.randint(0, 60))) for _ in range(60))]
    got = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()}
    assert got == {k: _plain_fingerprint(t) for k, t in enumerate(texts)}


def test_urls_odd_rows(spark):
    rows = [(1, "http://a.com/en/" + "x/" * 40_000, "z"), (1, "http://a.com/en/", "z"), (1, "http://a.com/en/", "z"), (None, "http://" + "a." * 500 + "com/en/q", "z"), (2, "http://EXAMPLE.com/en/7?", "z"), (3, "", "z"), (4, None, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string").withColumn("host", F.lit(1)).withColumn("keys", F.lit(2))
    got = sorted(((r["page_id"], r["verdict"], r["rule"]) for r in url_filter.judge_urls(pages, registry.URL_RULES).collect()), key=str)
    assert got == sorted([(1, "block", "com/en/")] * 3 + [(None, "block", "com/en/"), (2, "allow", "example.com/en/7"), (3, "allow", None), (4, "allow", None)], key=str)
    assert url_filter.judge_urls(pages.limit(0), registry.URL_RULES).count() == 0


def test_token_counts_odd_rows(spark):
    path, long = P.path("byte_bpe_50k.tiktoken"), "word\n" * 30_000
    frame = docs(spark, [(1, long, None), (1, long, None), (None, None, None)]).withColumn("section", F.lit("x")).withColumn("spans", F.lit(1))
    got = token_counts.section_tokens(frame, path, P.PATTERN)
    assert got.count() == 60_001
    totals = {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    library, _ = token_counts._encoding(path, P.PATTERN)
    assert totals == {1: 2 * len(library.encode_ordinary(long)), None: 0}
    assert token_counts.section_tokens(frame.limit(0), path, P.PATTERN).count() == 0
    overlap = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(a).alias("char_start"), F.lit(b).alias("char_end")) for k, (a, b) in enumerate(((0, 9), (0, 9), (5, 2), (3, 10**9)))))
    spans = token_counts.section_tokens(docs(spark, [(1, "one two three", None)]), path, P.PATTERN, "start", overlap).orderBy("section").collect()
    assert [r["n_tokens"] for r in spans] == [3, 3, 0, 2]


def test_workers_hand_back_stretches_and_keep_no_other_state():
    import pyarrow as pa

    from glyphflow.llm import common

    common.worker_state("savings", ("of another operator",), dict)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2_500), pa.int64()), pa.array([f"one two three four five {i}" for i in range(2_500)])], ["node", "text"])
    got = list(near_copies._sketches(5)(iter([batch])))
    assert not common._kept
    assert [b.num_rows for b in got] == [1_000, 1_000, 500] and pa.Table.from_batches(got).column("node").to_pylist() == list(range(2_500))


def test_a_worker_gives_the_memory_of_a_state_back(monkeypatch):
    import gc
    import weakref

    from glyphflow.llm import common

    class State:
        def __init__(self):
            self.itself = self

    asked = []
    monkeypatch.setattr(common, "pa", type("Arrow", (), {"default_memory_pool": lambda: type("Pool", (), {"release_unused": lambda: asked.append(1)})}))
    gc.disable()
    try:
        for leave in (lambda: common.worker_state("other", (), dict), common.let_go):
            gone, before = weakref.ref(common.worker_state("state", (), State)), len(asked)
            leave()
            assert gone() is None and len(asked) > before
    finally:
        gc.enable()
        common._kept.clear()


def test_fingerprints_are_dealt_out_before_they_are_repeated_for_the_tables(spark):
    distinct = spark.range(2_000).select(F.xxhash64("id").alias("fp")).distinct()
    rows = distinct.select("fp", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("fixed"))
    tasks = [r["count"] for r in simhash._dealt(rows, 4, 0).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 2_000 * 31
    assert len(tasks) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(tasks) < 2 * sum(tasks) / len(tasks)


def test_a_kept_text_is_sent_once(spark):
    import pyarrow as pa

    from glyphflow.llm.common import mapped_texts

    rows = docs(spark, [(k, None if k % 7 == 0 else "ab" * (k % 5), "x") for k in range(2_300)]).coalesce(1)
    sizes = lambda texts: iter([(len(texts), [pa.array([len(t.as_py() or "") for t in texts], pa.int64())])])
    made = mapped_texts(rows, ("doc_id", "text"), sizes, "n long")
    got = sorted(tuple(r) for r in made.select("doc_id", F.coalesce("text", F.lit("-")), "n").collect())
    assert got == [(k, "-" if k % 7 == 0 else "ab" * (k % 5), 0 if k % 7 == 0 else k % 5 * 2) for k in range(2_300)]
    sent = next(line for line in made._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Project" in line and "AS row" in line)
    assert sent.count("text#") == 1


def test_pipeline_run_matches_brute_force(spark, monkeypatch):
    import duckdb

    import corpus_pipeline
    from glyphflow.llm import quality, toxicity
    from glyphflow.llm.common import saved, table

    kept = [("documents", table(spark, SF, "documents").toPandas())]

    def spy(df, name):
        out = saved(df, name)
        kept.append((name, out.toPandas()))
        return out

    monkeypatch.setattr(corpus_pipeline, "saved", spy)
    last = corpus_pipeline.run(spark, SF).toPandas()
    frames = dict(kept)
    assert list(frames) == ["documents", "toxicity", "quality", "near-copies", "decontamination"]
    assert all(list(f.columns) == list(kept[0][1].columns) for f in frames.values())
    labels = table(spark, SF, "labels")
    names = list(frames)

    def ids(name):
        return sorted(frames[name]["doc_id"])

    # learned stages: the same decision, one text at a time and without Spark
    model = toxicity.train(table(spark, SF, "documents"), labels)
    assert ids("toxicity") == sorted(d for d, t in frames["documents"][["doc_id", "text"]].itertuples(index=False) if not _toxic(model, t))
    given = spark.createDataFrame(frames["toxicity"][["doc_id", "text"]])
    model = quality.train(given, labels)
    score = lambda t: float(np.clip((quality.features(t) - np.array(model.centre)) / np.array(model.scale), -6, 6) @ np.array(model.weights))
    assert ids("quality") == sorted(d for d, t in frames["toxicity"][["doc_id", "text"]].itertuples(index=False) if score(t) >= model.threshold)
    # near copies: all pairs
    rows = sorted(frames["quality"][["doc_id", "text"]].itertuples(index=False))
    root = _brute_groups([set(simhash.shingle_hashes(t, 5).tolist()) for _, t in rows])
    assert ids("near-copies") == [rows[k][0] for k in range(len(rows)) if root[k] == k]
    # decontamination: every diagonal
    con = duckdb.connect()
    con.register("documents", frames["near-copies"])
    con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
    dirty = {r[0] for r in con.sql(f"select doc_id from ({registry.OP8_SQL})").fetchall()}
    assert ids("decontamination") == [d for d in ids("near-copies") if d not in dirty]
    # pieces: every text back
    voc = pieces.vocabulary(P.path("piece_bpe_32k.model"))
    texts = dict(frames[names[-1]][["doc_id", "text"]].itertuples(index=False))
    assert {d: pieces.decode(voc, np.array(i)) for d, i in last[["doc_id", "ids"]].itertuples(index=False)} == texts
    assert 0 < len(texts) < len(frames["documents"])


def _toxic(model, text):
    """Score at least a half: every window compressed on its own, without memo."""
    from glyphflow.llm import toxicity

    ordinary, toxic = toxicity._Savings(model.toxic, model.ordinary).sizes
    total = n = 0
    for word in toxicity.windows(text):
        bare, n = word.strip(toxicity._EDGES), n + 1
        window = toxicity.CARRIER + b" " + bare.encode() + b"  "
        total += max(0, (len(ordinary(window)) - len(toxic(window)) if bare else 0) - model.step + 1)
    return bool(total) and total >= model.enough + model.noise * n


def test_pipeline_stages(spark):
    import corpus_pipeline

    seen = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[2:4]:
        kept = stage(spark, seen, SF)
        assert kept.columns == seen.columns, name
        assert kept.join(seen, "doc_id", "left_anti").count() == 0
        assert 0 < kept.count() <= seen.count()


def _tables(spark, documents, labels, benchmark):
    folder = new_folder(spark, "tables")
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long, score string, row int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_of_empty_tables(spark):
    import corpus_pipeline
    from glyphflow.llm import quality

    made = corpus_pipeline.run(spark, _tables(spark, [], [], []))
    assert made.count() == 0 and {"doc_id", "lang", "source", "n_chars"} <= set(made.columns)
    empty = spark.createDataFrame([], DOCS)
    assert quality.scores(empty, quality.train(empty, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_pipeline_of_odd_rows(spark):
    import corpus_pipeline

    plain = [f"the {a} {b} went over the hill and saw {c} and {a} again on day {k}" for k, (a, b, c) in enumerate(itertools.product(["fox", "cat", "hen"], ["old", "red"], ["rain", "snow", "fog"]))]
    documents = [(k, t, "en", "s", len(t), "clash", k) for k, t in enumerate(plain)]
    documents += [documents[3], (None, plain[3], None, None, None, None, None), (90, None, "en", None, 0, None, None), (91, "", None, "s", 0, None, None), (None, None, None, None, None, None, None)]
    documents += [(92, "word " * 40_000, "en", "s", 200_000, "x", 1), (93, "x" * 150_000, "en", "s", 150_000, "x", 1), (94, "exam question one two three four five six seven eight nine ten", "en", "s", 60, "x", 1)]
    benchmark = [(1, "question one two three four five six seven eight nine ten"), (2, None), (3, "")]
    made = corpus_pipeline.run(spark, _tables(spark, documents, [(1, 1, 0), (None, 0, 1), (2, None, None)], benchmark))
    got = made.toPandas()
    # one kind of label alone: nothing is rejected; equal and empty texts leave one row each
    assert sorted(got["doc_id"].dropna().astype(int)) == [*range(len(plain)), 90, 92, 93] and not got["doc_id"].isna().any()
    assert {"lang", "source", "n_chars", "row"} <= set(made.columns)
