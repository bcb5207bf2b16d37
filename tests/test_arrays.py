from __future__ import annotations

import json

import pytest
from pyspark.sql import types as T

from orderloom.sources.arrays import _pieces, split_json_array

C = T.StructType([T.StructField("c", T.StringType())])
INNER = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(C))])
SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("record", T.LongType()),
    T.StructField("inner", INNER),
])
ODD = ['a "quoted" {brace}', "}{", "\\", '\\"}', "line\nend", "é€𝄞 }", "", '{"a": 1}', '"', "[,]", "x" * 3_000, "{" * 900]


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def rows(df):
    return sorted((json.dumps(r.asDict(recursive=True)) for r in df.collect()))


@pytest.mark.parametrize("indent", [None, 2])
def test_equal_to_the_reader_of_whole_files(small_splits, tmp_path, indent):
    spark = small_splits
    objects = [
        {"id": i, "text": ODD[i % len(ODD)], "value": None, "record": -i, "inner": {"a": i, "b": [{"c": ODD[(i + 3) % len(ODD)]}, {}]}}
        for i in range(60)
    ]
    (tmp_path / "a.json").write_text(json.dumps(objects + objects[:5], indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" [ " + ",\n".join(json.dumps(o) for o in objects[::7]) + " ]\n")
    (tmp_path / "none.json").write_text("[]")
    (tmp_path / "empty.json").write_text("")
    path = str(tmp_path)
    assert _pieces(spark, path).select("file", "block").distinct().count() > 20
    found = rows(split_json_array(spark, path, SCHEMA))
    assert len(found) == 74
    assert found == rows(spark.read.schema(SCHEMA).json(path, multiLine=True))


def test_cut_and_broken_files(small_splits, tmp_path):
    (tmp_path / "cut.json").write_text('[{"id": 1}, {"id": 2, "inner": {"a": 3}}, {"id": 4, "text": "}')
    (tmp_path / "broken.json").write_text('[{"id": 5}, {"id": x}, {"id": 6}]')
    found = split_json_array(small_splits, str(tmp_path), SCHEMA).select("id").collect()
    assert sorted((r["id"] is None, r["id"]) for r in found if r["id"] is not None) == [(False, 1), (False, 2), (False, 5), (False, 6)]
    assert sum(r["id"] is None for r in found) == 1
