"""Streaming queries, run to completion over files and read back as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import tiling
from ..streaming import frames as s
from ..streaming import stateful
from .inputs import POLYGONS_SQL, polygons, table


def q_frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.windowed_counts(table(spark, sf_dir, "events"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    # a stream reads folders: the table's files as a glob
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parquet*")


def q_stream_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event through a file stream, by a stateless projection with exactly-once files."""
    folder, stream = s.scratch(spark), event_stream(spark, sf_dir)
    picked = stream.select("event_id", F.col("user_id").alias("stream_id"), F.col("ts"), F.round(F.col("value") * 2, 6).alias("doubled"))
    s.run_available(picked, f"{folder}/out", f"{folder}/state")
    return spark.read.schema("event_id long, stream_id long, ts timestamp_ntz, doubled double").parquet(f"{folder}/out")


def _landing(spark: SparkSession, sf_dir: str, parts: int, process: Callable[[DataFrame, str], None]) -> str:
    """Events landing in ``parts`` files' worth of rising times, a stream run to its end and stopped after each: what it left is the folder given."""
    folder, events = s.scratch(spark), table(spark, sf_dir, "events")
    seconds = events.select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    bounds = [None, *seconds.approxQuantile("at", [k / parts for k in range(1, parts)], 0.001), None]
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double")
    for low, high in zip(bounds, bounds[1:], strict=False):
        own = events if low is None else events.where(at > low)
        (own if high is None else own.where(at <= high)).write.mode("append").parquet(f"{folder}/landing")
        process(spark.readStream.schema(events.schema).parquet(f"{folder}/landing").withColumnRenamed("user_id", "stream_id"), folder)
    return folder


def _appended(make: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, str], None]:
    return lambda frames, folder: s.run_available(make(frames), f"{folder}/out", f"{folder}/state")


def q_stream_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event's number in its stream, counted on a stream whose counters are kept over three restarts."""
    folder = _landing(spark, sf_dir, 4, _appended(stateful.numbered_stream))
    return spark.read.schema(stateful.NUMBERED).parquet(f"{folder}/out").select("stream_id", "event_id", "frame_num")


def q_stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 8 frames of each stream, ragged where it pauses for more than a day."""
    folder = _landing(spark, sf_dir, 4, _appended(lambda frames: stateful.batched_stream(frames, 8, 86_400)))
    made = spark.read.schema(stateful.BATCHES).parquet(f"{folder}/out")
    return made.select("stream_id", "batch", "n_frames", F.array_join("frames", ",").alias("frames"))


def _results(events: DataFrame) -> DataFrame:
    """A result for each event that is no error, up to 50 minutes later."""
    key = F.col("event_id")
    return events.where("event_type <> 'error'").select("event_id", (F.col("ts").cast("timestamp") + F.make_dt_interval(mins=(key % 50).cast("int"))).alias("done_at"), F.col("event_type").alias("label"))


def q_stream_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with the results that follow within 40 minutes, joined as streams; those of the last hours still wait."""
    def join(frames: DataFrame) -> DataFrame:
        return stateful.with_results(frames, _results(frames), "40 MINUTES", "1 hour")

    folder = _landing(spark, sf_dir, 3, _appended(join))
    made = spark.read.schema("stream_id long, event_id long, ts timestamp, done_at timestamp, label string").parquet(f"{folder}/out")
    return made.select("stream_id", "event_id", F.col("done_at").cast("timestamp_ntz").alias("done_at"), "label")


OBJECTS = "event_id long, image_id long, poly_id long, left int, top int, width int, height int, label string"


def q_object_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of every frame's image, written batch by batch with a ledger."""
    left, top, width, height = g.bounding_box(g.vertices())
    boxes = polygons(spark, sf_dir).select("image_id", "poly_id", left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height"), F.substring(F.concat(F.lit("object-"), F.col("poly_id")), 1, 12).alias("label"))

    def objects(frames: DataFrame) -> DataFrame:
        return frames.select("event_id", F.col("stream_id").alias("image_id")).join(boxes, "image_id").select("event_id", "image_id", "poly_id", "left", "top", "width", "height", "label")

    def process(frames: DataFrame, folder: str) -> None:
        sink = stateful.ledger_sink(f"{folder}/objects", objects)
        frames.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    return stateful.ledger_rows(spark, _landing(spark, sf_dir, 3, process) + "/objects", OBJECTS)


def q_stream_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that every frame is detected in: a customer's balance below 0 has its stream tiled, all others are taken whole."""
    size = lambda f: (64 + F.col("event_id") * f % 1200).cast("int")
    settings = lambda: table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("stream_id"), F.when(F.col("c_acctbal") < 0, "tiled").alias("mode"))
    tiled = lambda frames: frames.select("event_id", "stream_id", F.explode(tiling.tiles(size(31), size(17), 320, 160)).alias("t")).select("event_id", "stream_id", "t.row", "t.col")
    whole = lambda frames: frames.select("event_id", "stream_id", F.lit(0).alias("row"), F.lit(0).alias("col"))
    treat = stateful.by_setting(settings, {"tiled": tiled, "whole": whole}, "whole")

    def process(frames: DataFrame, folder: str) -> None:
        frames.writeStream.foreachBatch(stateful.ledger_sink(f"{folder}/tiles", treat)).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()

    return stateful.ledger_rows(spark, _landing(spark, sf_dir, 2, process) + "/tiles", "event_id long, stream_id long, row int, col int")


_NUMBERS = "SELECT user_id AS stream_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_num FROM events"
QUERIES = [q_frame_windows, q_stream_frames, q_stream_numbers, q_stream_batches, q_stream_results, q_object_sink, q_stream_modes]
SQL = {
    "q_frame_windows": "SELECT user_id AS stream_id, date_trunc('hour', ts) AS start, count(*) AS n_frames, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "q_stream_frames": "SELECT event_id, user_id AS stream_id, ts, round(value * 2, 6) AS doubled FROM events",
    "q_stream_numbers": _NUMBERS,
    "q_stream_batches": """WITH f AS (SELECT user_id AS stream_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 DAY AS pause FROM events),
s AS (SELECT *, count(*) FILTER (pause) OVER (PARTITION BY stream_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
k AS (SELECT *, (row_number() OVER (PARTITION BY stream_id, run ORDER BY ts, event_id) - 1) // 8 AS part FROM s),
b AS (SELECT stream_id, run, part, count(*) AS n, max(ts) AS ends, string_agg(event_id, ',' ORDER BY ts, event_id) AS frames FROM k GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY run, part) - 1 AS batch, lead(ends) OVER (PARTITION BY stream_id ORDER BY run, part) IS NOT NULL AS followed FROM b)
SELECT stream_id, batch, n::INT AS n_frames, frames FROM m WHERE n = 8 OR followed OR ends + INTERVAL 1 DAY < (SELECT max(ts) FROM events)""",
    "q_stream_results": """WITH r AS (SELECT event_id, ts + INTERVAL 1 MINUTE * (event_id % 50) AS done_at, event_type AS label FROM events WHERE event_type <> 'error'),
seen AS (SELECT least((SELECT max(ts) FROM events), (SELECT max(done_at) FROM r)) - INTERVAL 1 HOUR AS mark),
j AS (SELECT e.user_id AS stream_id, e.event_id, e.ts, r.done_at, r.label FROM events e LEFT JOIN r ON r.event_id = e.event_id AND r.done_at BETWEEN e.ts AND e.ts + INTERVAL 40 MINUTE)
SELECT stream_id, event_id, done_at, label FROM j, seen WHERE done_at IS NOT NULL OR ts + INTERVAL 40 MINUTE < mark""",
    "q_object_sink": f"""WITH {POLYGONS_SQL} SELECT event_id, image_id, poly_id, least(x1, x2, x3, x4) AS "left", least(y1, y2, y3, y4) AS top, greatest(x1, x2, x3, x4) - least(x1, x2, x3, x4) AS width,
greatest(y1, y2, y3, y4) - least(y1, y2, y3, y4) AS height, substr('object-' || poly_id, 1, 12) AS label FROM events JOIN polys ON image_id = user_id""",
    "q_stream_modes": """WITH e AS (SELECT event_id, user_id AS stream_id, 64 + event_id * 31 % 1200 AS h, 64 + event_id * 17 % 1200 AS w, coalesce(c_acctbal < 0, false) AS tiled FROM events LEFT JOIN customer ON c_custkey = user_id),
c AS (SELECT *, CASE WHEN tiled THEN greatest(1, ceil((h - 320) / 160.0)::INT + 1) ELSE 1 END AS nr, CASE WHEN tiled THEN greatest(1, ceil((w - 320) / 160.0)::INT + 1) ELSE 1 END AS nc FROM e),
r AS (SELECT event_id, stream_id, nc, unnest(range(0, nr))::INT AS "row" FROM c) SELECT event_id, stream_id, "row", unnest(range(0, nc))::INT AS col FROM r""",
}
