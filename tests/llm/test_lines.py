from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import lines

from .helpers import documents, empty, words

SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def plain(rows, least_docs=10, least_chars=1, keep_first=False):
    """(doc_id, n_lines, n_dropped, digest) of every row of (doc_id, text)."""
    holders = defaultdict(set)
    for doc_id, text in rows:
        for pos, line in enumerate((text or "").split("\n")):
            holders[ascii_lower(line.strip(SPACE))].add((doc_id, text))
    common = {k for k, d in holders.items() if len(k) >= least_chars and len(d) >= least_docs}
    first = {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for pos, line in enumerate((text or "").split("\n")):
            first.setdefault(ascii_lower(line.strip(SPACE)), (doc_id, pos))
    out = []
    for doc_id, text in rows:
        all_lines = (text or "").split("\n")
        keys = [ascii_lower(x.strip(SPACE)) for x in all_lines]
        left = [x for i, (x, k) in enumerate(zip(all_lines, keys)) if k not in common or (keep_first and first[k] == (doc_id, i))]
        out.append((doc_id, len(all_lines), len(all_lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    pool = [words(rng, 3, 40) for _ in range(12)] + ["", "  ", "É", "ſ"]
    texts = []
    for i in range(120):
        own = [words(rng, 5) for _ in range(int(rng.integers(0, 4)))]
        shared = [pool[int(k)] for k in rng.integers(0, len(pool), int(rng.integers(0, 7)))]
        mixed = [*own, *(f"\t{x.upper()}\r" if rng.random() < 0.3 else x for x in shared)]
        rng.shuffle(mixed)
        texts.append("\n".join(mixed))
    texts[7], texts[8], texts[9], texts[10] = None, "", "\n\n", "\n".join(pool * 500)
    texts[20:40] = ["all gone"] * 20
    docs = documents(spark, texts)
    return docs.union(docs.filter("doc_id in (3, 7, 25)")).union(docs.filter("doc_id = 11").withColumn("doc_id", F.lit(None).cast("long")))


@pytest.mark.parametrize("slot_docs", [5, 4_096])
def test_same_as_brute_force(spark, table, slot_docs):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = lines.kept_digests(table.withColumn("keep", F.lit(1)).withColumn("mark", F.lit("x")), slot_docs=slot_docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 100


def test_same_as_sql(spark, table, tmp_path):
    table.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(con.execute(lines.kept_digests_sql()).fetchall(), key=repr)
    assert sorted(map(tuple, lines.kept_digests(table).collect()), key=repr) == want


def test_keep_first_and_lengths(spark):
    texts = ["a\nbb\nb", "bb\na\nbb", "bb \n A\nccc", "ccc"]
    docs = documents(spark, texts)
    rows = list(enumerate(texts))
    for options in ({"least_docs": 2, "keep_first": True}, {"least_docs": 2, "least_chars": 2}, {"least_docs": 3}):
        assert sorted(map(tuple, lines.kept_digests(docs, slot_docs=1, **options).collect()), key=repr) == plain(rows, **options)
    left = lines.without_common_lines(docs.withColumn("n_dropped", F.lit(1)), least_docs=2, keep_first=True)
    assert left.columns == [*docs.columns, "n_dropped"]
    assert [r["text"] for r in left.orderBy("doc_id").collect()] == ["a\nbb\nb", "", "ccc", ""]


def test_bitmaps_are_runs_of_kept_lines(spark):
    text = "\n".join(["x", "own 1", "own 2", "x", "x", "own 3", "x"])
    docs = documents(spark, [text, "x", "none"])
    found = {r["doc_id"]: r for r in lines.keep_bitmaps(docs, least_docs=2).collect()}
    assert set(found) == {0, 1}
    assert [tuple(r) for r in found[0]["keep"]] == [(1, 2), (5, 1)] and found[0]["n_dropped"] == 4
    assert found[1]["keep"] == []


def test_empty_table(spark):
    assert lines.kept_digests(empty(spark)).collect() == []
    assert lines.without_common_lines(empty(spark)).collect() == []


def test_plan_has_no_python_and_one_exchange_before_the_window(spark, table):
    plan = lines.kept_digests(table)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    first = lines.first_occurrences(lines.line_rows(table).withColumn("slot", F.pmod("mark", F.lit(4))))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
