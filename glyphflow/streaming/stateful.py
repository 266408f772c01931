"""Frames of many streams with keyed state: running numbers, batches by count or gap, results that arrive later, and a replay-safe sink.

A frame has stream_id, ts (timestamp) and event_id. State is kept by bucket of streams, so that a call into Python goes through many
streams at once; a stream's frames meet in one task, with those of a trigger at a time; its pace is bounded by the source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NUMBERED = "stream_id long, ts timestamp, event_id long, frame_num long"
#: Buckets that streams are dealt out over; a checkpoint holds for the number that it was begun with.
BUCKETS = 1_024
BATCHES = "stream_id long, batch long, n_frames int, begins timestamp, ends timestamp, frames array<long>"


def _timed(frames: DataFrame) -> DataFrame:
    """The columns of frames; those without time or id are no frames."""
    return frames.select(F.col("stream_id").cast("long"), F.col("ts").cast("timestamp"), F.col("event_id").cast("long")).where("ts is not null and event_id is not null")


def _dealt(timed: DataFrame) -> DataFrame:
    """Frames with their bucket; a null stream is told by ``known``, as pandas would make its ids floats."""
    known = F.col("stream_id").isNotNull().alias("known")
    return timed.select(F.pmod(F.xxhash64("stream_id"), F.lit(BUCKETS)).alias("bucket"), known, F.coalesce("stream_id", F.lit(0)).alias("of"), "ts", "event_id")


def _edges(known: np.ndarray, of: np.ndarray) -> list[int]:
    """Where the streams of sorted frames begin, and the end."""
    return [*np.flatnonzero(np.append(True, (known[1:] != known[:-1]) | (of[1:] != of[:-1]))[: len(of)]).tolist(), len(of)]


def _ids(streams: list[tuple[bool, int]]) -> pd.api.extensions.ExtensionArray:
    return pd.array([of if known else None for known, of in streams], "Int64")


def numbered_stream(frames: DataFrame) -> DataFrame:
    """``frame_num`` of every frame in its stream, counted on from 0 over triggers and restarts, by time and id within a trigger.

    Where frames arrive in the order of their times, these are the numbers that ``frames.numbered`` gives a table. Frames without time or
    id are left out, those of a null stream are one stream; a repeated frame is numbered again.
    """

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts).sort_values(["known", "of", "ts", "event_id"], kind="stable")
        known, of = rows["known"].to_numpy(bool), rows["of"].to_numpy(np.int64)
        held = state.get if state.exists else ([], [], [])
        following = {(k, x): n for k, x, n in zip(*held, strict=True)}
        numbers, edges = np.arange(len(rows)), _edges(known, of)
        for a, b in zip(edges, edges[1:], strict=False):
            stream = bool(known[a]), int(of[a])
            first = following.get(stream, 0)
            numbers[a:b] += first - a
            following[stream] = first + b - a
        state.update(([k for k, _ in following], [x for _, x in following], list(following.values())))
        yield pd.DataFrame({"stream_id": pd.arrays.IntegerArray(of.copy(), ~known), "ts": rows["ts"].to_numpy(), "event_id": rows["event_id"].to_numpy(), "frame_num": numbers})

    kept = "known array<boolean>, streams array<long>, next array<long>"
    return _dealt(_timed(frames)).groupBy("bucket").applyInPandasWithState(number, NUMBERED, kept, "append", GroupStateTimeout.NoTimeout)


def cut_batches(times: np.ndarray, size: int, gap: int) -> list[tuple[int, int, bool]]:
    """(from, to, closed) of the batches of frames at ordered ``times``: one ends when it is full or the next frame is more than ``gap`` later."""
    edges = [0, *(np.flatnonzero(np.diff(times) > gap) + 1).tolist(), len(times)]
    cuts = [(at, min(at + size, b)) for a, b in zip(edges, edges[1:], strict=False) for at in range(a, b, size)]
    return [(a, b, b - a == size or b < len(times)) for a, b in cuts]


def batched_stream(frames: DataFrame, size: int, gap_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Batches of ``size`` frames of each stream, in the order of their numbers; a ragged one where a stream pauses.

    A batch is given out when it is full, when the stream's next frame is more than ``gap_seconds`` later, or when the watermark (the
    latest time of all streams less ``late``) has passed its last frame by that gap, so a stream that ends doesn't keep its last frames
    back. Until then at most ``size`` - 1 frames of a stream wait in the state. ``batch`` counts from 0. Frames as in ``numbered_stream``.
    """
    gap = gap_seconds * 1_000_000_000

    def cut(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], [], [], [])
        following = {(k, x): n for k, x, n in zip(*held[:3], strict=True)}
        streams, waiting = list(following), held[3]
        whose = np.repeat(np.arange(len(streams)), waiting)
        known, of = (np.array([x[i] for x in streams], t)[whose] for i, t in ((0, bool), (1, np.int64)))
        times, ids = np.array(held[4], np.int64), np.array(held[5], np.int64)
        if not state.hasTimedOut:
            rows = pd.concat(parts).sort_values(["ts", "event_id"], kind="stable")
            known, of = np.concatenate([known, rows["known"].to_numpy(bool)]), np.concatenate([of, rows["of"].to_numpy(np.int64)])
            times, ids = np.concatenate([times, rows["ts"].to_numpy("datetime64[ns]").astype(np.int64)]), np.concatenate([ids, rows["event_id"].to_numpy(np.int64)])
        order = np.lexsort((of, known))  # stable: a stream's waiting frames stay before its new ones
        known, of, times, ids = known[order], of[order], times[order], ids[order]
        now, next_due, made, left = state.getCurrentWatermarkMs(), [], [], {}
        edges = _edges(known, of)
        for start, end in zip(edges, edges[1:], strict=False):
            stream, own = (bool(known[start]), int(of[start])), times[start:end]
            due = (int(own[-1]) + gap) // 1_000_000 + 1
            cuts = cut_batches(own, size, gap)
            done = [c for c in cuts if c[2] or due <= now]
            rest = start + cuts[len(done)][0] if len(done) < len(cuts) else end
            first = following.get(stream, 0)
            made.extend((stream, first + k, start + a, start + b) for k, (a, b, _) in enumerate(done))
            following[stream] = first + len(done)
            if rest < end:
                left[stream] = (rest, end)
                next_due.append(due)
        rests = [left.get(x, (0, 0)) for x in following]
        flat = lambda values: [x for a, b in rests for x in values[a:b].tolist()]
        state.update(([k for k, _ in following], [x for _, x in following], list(following.values()), [b - a for a, b in rests], flat(times), flat(ids)))
        if next_due:
            state.setTimeoutTimestamp(min(next_due))
        if made:
            yield pd.DataFrame(
                {
                    "stream_id": _ids([x for x, *_ in made]), "batch": [k for _, k, _, _ in made], "n_frames": [b - a for *_, a, b in made],
                    "begins": pd.to_datetime([times[a] for *_, a, _ in made]), "ends": pd.to_datetime([times[b - 1] for *_, b in made]), "frames": [ids[a:b].tolist() for *_, a, b in made],
                }
            )

    kept = "known array<boolean>, streams array<long>, next array<long>, waiting array<int>, times array<long>, ids array<long>"
    return _dealt(_timed(frames).withWatermark("ts", late)).groupBy("bucket").applyInPandasWithState(cut, BATCHES, kept, "append", GroupStateTimeout.EventTimeTimeout)


def with_results(frames: DataFrame, results: DataFrame, within: str, late: str = "0 seconds") -> DataFrame:
    """Every frame with each of its results (event_id, done_at, label) that comes ``within`` its time, a null result where none does.

    Both sides may be streams: a frame waits until the watermark tells that no result can follow, then it is given out without. On
    tables it is the plain left join. Frames without time or id are left out, results without them join nothing.
    """
    left = _timed(frames)
    right = results.select(F.col("event_id").cast("long").alias("of"), F.col("done_at").cast("timestamp").alias("done_at"), F.col("label").cast("string"))
    if frames.isStreaming:
        left, right = left.withWatermark("ts", late), right.withWatermark("done_at", late)
    met = (F.col("event_id") == F.col("of")) & (F.col("done_at") >= F.col("ts")) & (F.col("done_at") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return left.join(right, met, "left").select("stream_id", "event_id", "ts", "done_at", "label")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def ledger_sink(path: str, make: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that writes what ``make`` gives of each batch to a folder of the batch's number, once.

    A batch whose folder is complete (its success mark is written last) is left alone, one that a failure cut short is written anew,
    so a replayed batch adds nothing and loses nothing. ``ledger_rows`` reads complete batches only.
    """

    def write(rows: DataFrame, number: int) -> None:
        folder = f"{path.rstrip('/')}/batch={number}"
        if not _exists(rows.sparkSession, f"{folder}/_SUCCESS"):
            make(rows).write.mode("overwrite").parquet(folder)

    return write


def ledger_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the complete batches below ``path``; none where there is no batch."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [f.getPath().toString() for f in files.listStatus(root)] if files.exists(root) else []
    done = sorted(f for f in folders if "/batch=" in f and _exists(spark, f"{f}/_SUCCESS"))
    return spark.read.schema(schema).parquet(*done) if done else spark.createDataFrame([], schema)


def by_setting(settings: Callable[[], DataFrame], ways: dict[str, Callable[[DataFrame], DataFrame]], default: str) -> Callable[[DataFrame], DataFrame]:
    """A function of a batch that treats each stream's rows in the way that the settings name at that time.

    ``settings`` gives the table (stream_id, mode) anew for every batch, so a change takes effect with the next one. Streams without a
    mode, or with one that isn't among ``ways``, go by ``default``; of several modes of a stream the smallest counts. All ways give
    the same columns.
    """

    def treat(rows: DataFrame) -> DataFrame:
        modes = settings().where(F.col("mode").isin(*ways)).groupBy("stream_id").agg(F.min("mode").alias("mode"))
        moded = rows.join(modes, "stream_id", "left").withColumn("mode", F.coalesce("mode", F.lit(default)))
        parts = [way(moded.where(F.col("mode") == name).drop("mode")) for name, way in ways.items()]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    return treat
