from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from orderloom.operators.distinct import distinct_count, grouped

ROWS = [
    ("a", None, "x", 1), ("a", None, "x", 2), ("a", None, None, 3), ("a", "k", "y", 4), (None, "k", "y", 5), (None, None, None, 6), (None, None, "", 7),
]
SCHEMA = "g string, h string, v string, n long"


@pytest.mark.parametrize("keys", [["g"], ["g", "h"], ["h"]])
def test_same_as_count_distinct(spark, keys):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = grouped(df, keys, [F.count("*").alias("lines"), F.sum("n").alias("total")], {"vs": "v", "ns": "n"})
    want = df.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum("n").alias("total"), F.countDistinct("v").alias("vs"), F.countDistinct("n").alias("ns"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert grouped(df.limit(0), keys, [F.count("*").alias("lines")], {"vs": "v"}).collect() == []


def test_scalar_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    row = df.agg(F.count("*").alias("lines")).select("lines", distinct_count(df, "v").alias("v"), distinct_count(df, F.upper("h")).alias("h")).first()
    assert tuple(row) == (7, 3, 1)
    assert df.limit(0).agg(F.count("*")).select(distinct_count(df.limit(0), "v")).first()[0] == 0
