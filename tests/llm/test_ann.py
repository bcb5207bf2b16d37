from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_nearest(rows, query, k=20):
    own = np.array(query[1], dtype=np.float64)
    found = [(-float((np.array(v, dtype=np.float64) * own).sum()), i) for i, v in rows if (i, v) != query]
    return sorted(found)[:k]


def test_recall_and_scores_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    x *= rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert sorted(by) == list(range(0, 3000, 20))
    d = x.astype(np.float64)
    hits = 0
    for q, found in by.items():
        found.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        score = d @ d[q]
        assert all(r["score"] == pytest.approx(score[r["vec_id"]], rel=1e-12) for r in found)
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in found} & set(np.lexsort((np.arange(3000), -score))[:20].tolist()))
    assert hits / (20 * len(by)) >= 0.9


def test_ties_copies_and_vectors_without_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0, 0.5], 1) for i in range(50)]
    rows += [(60, [0.0, 0.0, 0.0], 1), (80, None, 1), (100, [nan, 1.0, 1.0], 1), (120, [inf, 1.0, 1.0], 1), (140, [1.0], 1), (160, [None, 1.0, 1.0], 1)]
    rows += [(None, [9.0, 9.0, 9.0], 1), (40, [1.0, 0.0, 0.5], 1), (41, [-0.0, 0.25, 0.0], 1), (20, [0.5, 0.5, 0.5], 1), (180, [], 1)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)), F.col("vec_id") % 20 == 0).collect()
    usable = list({(r[0], tuple(r[1])) for r in rows[:50] + [(40, [1.0, 0.0, 0.5]), (41, [-0.0, 0.25, 0.0]), (20, [0.5, 0.5, 0.5])]})
    for q in [u for u in usable if u[0] % 20 == 0]:
        want = plain_nearest(usable, q)
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q[0])
        if q[0] != 20:
            assert [(s, i) for _, s, i in mine] == [(-s, i) for s, i in want]
    # Two vectors with the id 20 are two queries.
    assert {r["query_id"] for r in got} == {0, 20, 40}
    assert len([r for r in got if r["query_id"] == 20]) == 40


def test_fewer_candidates_and_empty_tables(spark):
    rows = [(0, [1.0, 2.0], 0), (1, [-1.0, -2.0], 0), (2, [0.5, 0.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got)] == [(1, 2, 0.5), (2, 1, -5.0)]
    assert ann.nearest(spark.createDataFrame(rows[:1], SCHEMA), F.col("vec_id") == 0).collect() == []
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []


@pytest.mark.parametrize("radius", [0, 7, 8, 30, 64])
def test_probing_loses_no_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 16, (200, 8), dtype=np.uint16)
    queries = base[:20].copy()
    for q in queries:
        for bit in rng.choice(128, radius, replace=False):
            q[bit // 16] ^= np.uint16(1 << bit % 16)
    found = ann.Index(base).probe(queries, radius)
    apart = ann.distances(queries, base)
    assert found[apart <= radius].all()
    assert (apart[np.arange(20), np.arange(20)] == radius).all()
    if radius < 8:
        assert found.mean() < 0.05


def test_blocks_find_the_same(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(300)]
    frame = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, ann.nearest(frame, F.col("vec_id") < 30, k=3).collect()))
    monkeypatch.setattr(ann, "INDEX_ROWS", (50, 50))
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    got = sorted(map(tuple, ann.nearest(frame, F.col("vec_id") < 30, k=3).collect()))
    assert len(got) == len(want) == 90
    assert len(set(got) & set(want)) >= 81
