"""Every recognition query against its DuckDB oracle on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphflow.config import OcrConfig
from glyphflow.functions import pixels
from glyphflow.operators import contours
from glyphflow.plans import catalogue
from glyphflow.plans.inputs import rasters

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(frame, columns):
    show = lambda x: "null" if x is None or x != x else repr(round(float(x), 6)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(show(x) for x in row) for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, db, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), db.sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.parametrize("name", ["q_unclip", "q_homography"])
def test_every_polygon_counts(spark, db, name):
    got = catalogue.queries()[name](spark, SF)
    assert {r["poly_id"] for r in got.select("poly_id").collect()} == {r[0] for r in db.sql("select o_orderkey from orders").fetchall()}
    column = "x1" if name == "q_unclip" else "m0"
    flat = got.where("poly_id % 25 = 0")
    assert 0 < flat.where(f"{column} is null").count() < got.where("poly_id % 25 <= 3").count()


def test_rect_pipeline_reads_every_region(spark):
    got = catalogue.queries()["q_rect_pipeline"](spark, SF).collect()
    maps = rasters(spark, SF).select("image_id", F.lit(16).alias("h"), F.lit(16).alias("w"), pixels.resize(F.col("p"), 8, 8, 16, 16).alias("p"))
    found = contours.candidates(contours.contours(maps, 0.1), OcrConfig().max_candidates, 0.1)
    assert 0 < len(got) == len({(r["image_id"], r["poly_idx"]) for r in got}) <= found.count()
    assert {r["image_id"] for r in got} <= {r["image_id"] for r in found.collect()}
    read = [r for r in got if r["text"] is not None]
    assert read and all(0 < r["conf"] <= 1 for r in read)


def test_decoders_read_every_word_of_documents(spark, db):
    words = db.sql("select count(*) from (select unnest(string_split(text, ' ')) as w from documents) where w <> ''").fetchall()[0][0]
    for name in ("q_ctc_decode_docs", "q_attention_decode_docs", "q_decode_alnum_lower_docs", "q_token_pad16_docs"):
        assert catalogue.queries()[name](spark, SF).count() == words


@pytest.mark.parametrize("name", ["q_ctc_decode_docs", "q_attention_decode_docs", "q_upsidedown_select_docs"])
def test_only_different_words_get_steps(spark, name):
    """Every occurrence of a word is shuffled once, as a string; neither sorted nor aggregated with its arrays."""
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "first(" not in plan
