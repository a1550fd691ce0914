"""Every registered query against its SQL in DuckDB, and plain checks of column functions."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from palimpsest import plans
from palimpsest.functions import scores, text

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "none"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert rows(plans.queries()[name](spark, DATA).toPandas()) == rows(con.execute(plans.oracle_sql()[name]).df())


def test_scores(spark):
    row = spark.range(1).select(
        scores.half_up(F.lit(-0.5), 0).alias("half"), scores.retrievability(F.lit(0.0), F.lit(1.0)).alias("now"), scores.retrievability(F.lit(9.0), F.lit(9.0)).alias("due"),
        scores.retrievability(F.lit(9.0), F.lit(0.0)).alias("none"), scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), text.tokens(F.lit("The  Cat's, a DOG!")).alias("tokens"),
    ).first()
    assert (row.half, row.now, row.none, row.zero, row.tokens) == (0.0, 1.0, 0.0, 0.0, ["the", "cat", "dog"])
    assert row.due == pytest.approx(0.9)
