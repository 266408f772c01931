"""Keyed state over triggers and restarts, pauses, results that come late or never, replayed batches, changed settings."""

import numpy as np
from pyspark.sql import functions as F

from glyphflow.storage import new_folder
from glyphflow.streaming import frames, stateful

RAW = "stream_id long, ts string, event_id long"


def table(spark, rows):
    return spark.createDataFrame(rows, RAW).withColumn("ts", F.col("ts").cast("timestamp"))


def streamed(spark, parts, make, schema):
    """What ``make`` of a stream gives, run to its end and restarted after each part."""
    folder = new_folder(spark, "stream-test")
    for rows in parts:
        table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        frames.run_available(make(spark.readStream.schema(table(spark, []).schema).parquet(f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    return [tuple(r) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect()]


PARTS = [
    [(1, "2024-01-01 00:00:05", 3), (1, "2024-01-01 00:00:01", 9), (1, "2024-01-01 00:00:01", 2), (None, "2024-01-01 00:00:02", 4), (2, None, 5), (2, "2024-01-01 00:00:03", None)],
    [(1, "2024-01-01 00:00:09", 1), (None, "2024-01-01 00:00:09", 7), (3, "2024-01-01 00:00:09", 8), (1, "2024-01-01 00:00:09", 1)],
    [(4, "2024-01-01 02:00:00", 10)],
]


def test_numbers_go_on_after_a_restart(spark):
    got = streamed(spark, PARTS, stateful.numbered_stream, stateful.NUMBERED)
    assert sorted(((s, e, n) for s, _, e, n in got), key=str) == sorted([(1, 2, 0), (1, 9, 1), (1, 3, 2), (1, 1, 3), (1, 1, 4), (None, 4, 0), (None, 7, 1), (3, 8, 0), (4, 10, 0)], key=str)


def test_numbers_of_a_table(spark):
    rows = [(1, f"2024-01-01 00:00:{k % 60:02d}", k) for k in range(400)] + [(2, "2024-01-01 00:00:00", 5), (None, None, 1), (None, "2024-01-01 00:00:00", 0), (2, "2024-01-01 00:00:00", 5)]
    got = frames.numbered(table(spark, rows).repartition(3)).collect()
    for stream in (1, 2, None):
        own = sorted((r for r in got if r["stream_id"] == stream), key=lambda r: r["frame_num"])
        assert [r["frame_num"] for r in own] == [*range(len(own))]
        order = [(r["ts"] is not None, str(r["ts"]), r["event_id"]) for r in own]
        assert order == sorted(order)
    assert len(got) == len(rows) and frames.numbered(table(spark, [])).count() == 0


def test_cut_batches():
    assert stateful.cut_batches(np.array([1, 2, 3, 4, 5, 50, 51, 99]), 2, 10) == [(0, 2, True), (2, 4, True), (4, 5, True), (5, 7, True), (7, 8, False)]
    assert stateful.cut_batches(np.array([], int), 2, 10) == []
    assert stateful.cut_batches(np.array([1, 2, 3]), 3, 10) == [(0, 3, True)]


def test_batches_close_when_full_or_paused(spark):
    got = streamed(spark, PARTS, lambda f: stateful.batched_stream(f, 3, 600), stateful.BATCHES)
    batches = sorted(((s, b, n, tuple(ids)) for s, b, n, _, _, ids in got), key=str)
    # stream 4's frame still waits; the others are closed by the watermark that it brings
    assert batches == sorted([(1, 0, 3, (2, 9, 3)), (1, 1, 2, (1, 1)), (None, 0, 2, (4, 7)), (3, 0, 1, (8,))], key=str)


def test_results_that_come_late_or_never(spark):
    def results(f):
        return f.where("event_id <> 7").select("event_id", (F.col("ts") + F.when(F.col("event_id") == 3, F.expr("INTERVAL 1 HOUR")).otherwise(F.expr("INTERVAL 1 SECOND"))).alias("done_at"), F.lit("x").alias("label"))

    make = lambda f: stateful.with_results(f, results(f), "10 SECONDS")
    got = {(s, e, label) for s, e, _, _, label in streamed(spark, PARTS, make, "stream_id long, event_id long, ts timestamp, done_at timestamp, label string")}
    known = table(spark, [r for part in PARTS for r in part])
    want = {(r["stream_id"], r["event_id"], r["label"]) for r in stateful.with_results(known, results(known), "10 SECONDS").collect()}
    assert (1, 3, None) in got and (None, 7, None) in got and got == want


def test_a_replayed_batch_adds_nothing(spark):
    path = new_folder(spark, "ledger")
    sink = stateful.ledger_sink(path, lambda rows: rows.select("event_id"))
    one, two = table(spark, PARTS[0]), table(spark, PARTS[1])
    assert stateful.ledger_rows(spark, path, "event_id long").count() == 0
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    sink(one, 0)
    read = lambda: sorted(r[0] or 0 for r in stateful.ledger_rows(spark, path, "event_id long").collect())
    assert read() == [0, 1, 1, 2, 3, 4, 5, 7, 8, 9]
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=1/_SUCCESS")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)  # as if the write had been cut short
    assert read() == [0, 2, 3, 4, 5, 9]
    sink(two, 1)
    assert read() == [0, 1, 1, 2, 3, 4, 5, 7, 8, 9]


def test_a_changed_setting_takes_effect_with_the_next_batch(spark):
    now = [[(1, "b"), (3, "nonsense"), (None, "b"), (1, "c")]]
    settings = lambda: spark.createDataFrame(now[0], "stream_id long, mode string")
    ways = {name: lambda rows, name=name: rows.select("event_id", F.lit(name).alias("way")) for name in "abc"}
    treat = stateful.by_setting(settings, ways, "a")
    shown = lambda rows: sorted(tuple(r) for r in treat(table(spark, rows)).collect())
    assert shown(PARTS[1]) == [(1, "b"), (1, "b"), (7, "a"), (8, "a")]
    now[0] = [(3, "c")]
    assert shown(PARTS[1]) == [(1, "a"), (1, "a"), (7, "a"), (8, "c")]


def test_state_is_kept_by_bucket_and_not_by_stream(spark):
    folder = new_folder(spark, "stream-test")
    spark.range(3_000).select((F.col("id") % 2_000).alias("stream_id"), F.timestamp_seconds(F.col("id") + 10**9).alias("ts"), F.col("id").alias("event_id")).coalesce(1).write.parquet(f"{folder}/in")
    schema = table(spark, []).schema
    for make, n in ((stateful.numbered_stream, 3_000), (lambda f: stateful.batched_stream(f, 2, 10**6), 1_000)):
        query = make(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.format("parquet").option("path", f"{folder}/out{n}").option("checkpointLocation", f"{folder}/state{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= stateful.BUCKETS
        assert spark.read.parquet(f"{folder}/out{n}").count() == n


def test_buckets_change_no_result(spark, monkeypatch):
    draw = np.random.default_rng(3)
    at = np.sort(draw.integers(0, 3_000, 200))
    rows = [(None if s == 9 else int(s) * 2**53 + 1, f"2024-01-01 00:{t // 60:02d}:{t % 60:02d}", k) for k, (s, t) in enumerate(zip(draw.integers(0, 10, 200), at, strict=True))]
    parts = [rows[:70], rows[70:71], rows[71:150], rows[150:]]
    got = []
    for n in (1, 1_024):
        monkeypatch.setattr(stateful, "BUCKETS", n)
        numbers = streamed(spark, parts, stateful.numbered_stream, stateful.NUMBERED)
        batches = streamed(spark, parts, lambda f: stateful.batched_stream(f, 3, 200), stateful.BATCHES)
        got.append((sorted(numbers, key=str), sorted(batches, key=str)))
    assert got[0] == got[1] and len(got[0][0]) == 200
    seen = {s: [e for x, _, e in rows if x == s] for s in {x for x, _, _ in rows}}
    for s, ids in seen.items():
        assert [e for _, e in sorted((n, e) for x, _, e, n in got[0][0] if x == s)] == ids
        made = [e for b in sorted((b for b in got[0][1] if b[0] == s), key=lambda b: b[1]) for e in b[5]]
        assert made == ids[: len(made)] and len(ids) - len(made) < 3
