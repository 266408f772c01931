"""A training-corpus pipeline: each stage works on all rows that the one before it kept, written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphflow.llm import decontaminate, near_copies, pieces, quality, toxicity
from glyphflow.llm.common import saved, table


def _kept(docs: DataFrame, score: Callable[[DataFrame], DataFrame], wanted: int) -> DataFrame:
    """The rows that ``score`` predicts ``wanted`` for, with all their columns, whatever these are called."""
    is_text = lambda c: c.lower() == "text"
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias("text" if is_text(c) else c) for c in docs.columns)).alias("row"))
    return score(rows).where(F.col("predicted") == wanted).select(*(F.col("row").getField("text" if is_text(c) else c).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't reject; it learns from all labelled rows of its input.

    Null and empty texts stay. Without labels of both kinds every document stays. Equal texts have equal scores; repeated rows stay.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: toxicity.scores(rows, model, ("row",)), 0)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at or above the ranking threshold, those at it too.

    A null or empty text is scored as one without words. Without labels of both kinds every document stays; repeated rows stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _kept(docs, lambda rows: quality.scores(rows, model, ("row",)), 1)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies (five-word shingles, similarity 0.8): that of the smallest doc_id.

    Null and empty texts are one group. A row without doc_id stays only where its group has none with one; of equal rows one stays.
    """
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts stay, null and empty items match nothing, repeated rows stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars and the pieces of every document, with the scores of its five best segmentations.

    A null text has the pieces of an empty one, a single blank piece. Of segmentations of equal score the order is the operator's.
    """
    import public_tokenizers

    keep = tuple(c for c in docs.columns if c != "text")
    return pieces.encode_texts(docs, public_tokenizers.path("piece_bpe_32k.model"), n=5, keep=keep)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: Learned stages have no SQL form; tests compare each stage with its own brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
