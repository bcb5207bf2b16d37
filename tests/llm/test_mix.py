from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import mix

from .helpers import documents, empty, words


def plain_targets(sizes):
    """source -> target by repeated sharing; sizes by source."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / free > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        capped |= over


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    sources = ["big"] * 60 + ["a", "b", None, "c", "C", "é"] * 8 + ["none"]
    texts = [words(rng, int(rng.integers(1, 60))) for _ in sources]
    texts[3], texts[4], texts[70], texts[-1] = None, " \t\x0b ", words(rng, 7000), ""
    docs = documents(spark, texts, sources=sources)
    return docs.union(docs.filter("doc_id in (3, 7, 61)"))


def test_words_taken(spark, table):
    rows = mix.words_taken(table.withColumn("size", F.lit("x")).withColumn("_start", F.lit(0)), block_words=64, bucket_rows=10).collect()
    text = {r["doc_id"]: (r["text"], r["source"]) for r in table.collect()}
    assert len(rows) == table.count()
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", text[r["doc_id"]][0] or ""))
        sizes[text[r["doc_id"]][1]] += r["size"]
    targets = plain_targets(sizes)
    taken = defaultdict(int)
    for r in rows:
        source = text[r["doc_id"]][1]
        assert r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 1


def test_block_and_bucket_sizes_do_not_change_what_is_taken(spark, table):
    small = sorted(map(tuple, mix.words_taken(table, block_words=16, bucket_rows=2).collect()))
    assert small == sorted(map(tuple, mix.words_taken(table).collect()))


def test_same_as_sql(spark, table, tmp_path):
    table.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(con.execute(mix.words_taken_sql()).fetchall())
    assert sorted(map(tuple, mix.words_taken(table).collect())) == want


def test_pieces_are_whole_and_evenly_spread(spark, table):
    pieces = mix.Mix(table, block_words=32).pieces().collect()
    by_slot = defaultdict(list)
    for p in pieces:
        by_slot[p["slot"]].append(p)
        assert p["words"] > 0 and p["from_word"] >= 0 and p["from_word"] + p["words"] <= p["size"]
    assert max(sum(p["words"] for p in s) for s in by_slot.values()) <= 32
    assert all(len({p["source"] for p in s}) == 1 for s in by_slot.values())
    # Half of the mix has close to half of what every source gives.
    half = sorted(by_slot)[len(by_slot) // 2]
    for source in {p["source"] for p in pieces}:
        own = [p for p in pieces if p["source"] == source]
        first = sum(p["words"] for p in own if p["slot"] < half)
        assert abs(first - sum(p["words"] for p in own) / 2) <= 5 * 32


def test_whole_documents_keep_columns_and_repeats(spark, table):
    docs = table.withColumn("at", F.lit("mine"))
    out = mix.Mix(docs, block_words=32).whole_documents()
    assert out.columns == docs.columns
    rows = out.collect()
    assert {r["at"] for r in rows} == {"mine"}
    counts = defaultdict(int)
    for r in rows:
        counts[r["doc_id"]] += 1
    assert max(counts.values()) <= 4 and all(r["text"].strip() for r in rows)


def test_plan_has_no_python(spark, table):
    plan = mix.words_taken(table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)


def test_empty_tables(spark):
    assert mix.words_taken(empty(spark)).collect() == []
    assert [r["taken"] for r in mix.words_taken(documents(spark, [None, ""])).collect()] == [0, 0]
    assert mix.Mix(empty(spark)).whole_documents().collect() == []


def test_columns_of_any_name(spark, table):
    names = ["_source", "_bucket", "_offset", "_slot_source", "_slot_block", "of_source", "of_block", "start", "block", "place", "take"]
    clashing = table
    for name in names:
        clashing = clashing.withColumn(name, F.lit(name))
    whole = mix.Mix(clashing).whole_documents()
    assert whole.columns == clashing.columns
    assert sorted(r["doc_id"] for r in whole.collect()) == sorted(r["doc_id"] for r in mix.Mix(table).whole_documents().collect())
    assert all(r[name] == name for r in whole.limit(3).collect() for name in names)
    assert mix.Mix(clashing).pieces().count() == mix.Mix(table).pieces().count()
