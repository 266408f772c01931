"""Helpers shared by the training-data operators: table access and the shared folder of a cluster."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

_kept: list[tuple] = []


def worker_state(kind: str, key: tuple, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps for an operator from one task to the next (tables, memos of words).

    Workers live on between stages, so a worker holds one operator's state at a time: that of another is let go.
    """
    if not _kept or _kept[0][:2] != (kind, key):
        let_go()
        _kept.append((kind, key, make()))
    return _kept[0][2]


def let_go() -> None:
    """Free what the worker keeps: for operators without a state of their own, which follow others in one job.

    The memory goes back to the system: Python, Arrow and the C library would hold it for the worker's next tasks.
    """
    if _kept:
        _kept.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


#: Texts whose results a worker hands back at once.
STRETCH = 1_000


def stretches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in stretches, so that what is made of it is handed back before the rest is read; one for an empty batch."""
    for at in range(0, max(batch.num_rows, 1), STRETCH):
        yield batch.slice(at, STRETCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only where the session names none and runs on one machine, as in tests, a temporary folder is set up for it; a
    cluster's session without the setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, *partition_by: str) -> DataFrame:
    """Cut lineage: write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped_texts(docs: DataFrame, keep: Sequence[str], make: Callable[[pa.Array], Iterable[tuple[int, list[pa.Array]]]], schema: str) -> DataFrame:
    """Columns ``keep`` of every row of ``docs`` and, behind them, the columns of ``schema`` that ``make`` reads off its text.

    ``make`` takes the texts of a batch and yields (rows, columns) for one stretch of them after the other. Kept
    columns travel inside a struct, so that no name of theirs meets one of ``schema``; of two equal names the result
    has the new column only. A text that is kept is sent once; without a column text it is that of the first kept struct with one.
    """
    made = StructType.fromDDL(schema)
    given = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"))
    held = given.schema["row"].dataType
    structs = [c for c in keep if isinstance(held[c].dataType, StructType) and "text" in held[c].dataType.names]
    path = ["text"] if "text" in map(str.lower, docs.columns) else [*structs[:1], "text"]
    inside = path[0] in keep and reduce(lambda kind, name: kind[name].dataType, path, held) == StringType()
    if not inside:
        given = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(".".join(f"`{c}`" for c in path)).cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in stretches(whole):
                at = 0
                for n, columns in make(reduce(pa.StructArray.field, path, b.column("row")) if inside else b.column("text")):
                    yield pa.RecordBatch.from_arrays([b.column("row").slice(at, n), *columns], ["row", *made.names])
                    at += n

    out = given.mapInArrow(scan, StructType([given.schema["row"], *made]))
    taken = {c.lower() for c in made.names}
    return out.select(*(F.col("row").getField(c).alias(c) for c in keep if c.lower() not in taken), *made.names)
