from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import middle

from .helpers import documents, empty, words

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """n, form, prefix_chars, middle_chars, output by string operations."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    tokens = TOKEN.findall(text)
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward():
    rng = np.random.default_rng(3)
    alphabet = np.array(list("ab é\t\n\x0b\x85 €m😀<PSM>  "))
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 40)))) for _ in range(600)]
    texts += [None, "", " ", "  \n ", "<P>", "a <S> b", "x<M>", "<", "a", "é" * 50, words(rng, 30_000), " lead", "trail "]
    return texts


@pytest.mark.parametrize("block", [7, 1 << 20])
def test_same_as_brute_force(spark, block, monkeypatch):
    """Small blocks make every carry and boundary occur."""
    texts = awkward()
    data = b"".join((t or "").encode() for t in texts)
    starts = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    monkeypatch.setattr(middle, "BLOCK", block)
    if block < 10:
        keep = [i for i, t in enumerate(texts) if len(t or "") < 100]
        texts = [texts[i] for i in keep]
        data = b"".join((t or "").encode() for t in texts)
        starts = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    draw = []
    for i in range(len(texts)):
        digest = hashlib.sha256(f"42:{i}".encode()).hexdigest()
        draw.append([int(digest[8 * k : 8 * k + 8], 16) for k in range(4)])
    got = middle._transform(np.frombuffer(data, dtype=np.uint8), starts, np.array(draw), 50, 80)
    assert list(zip(*[x.to_pylist() for x in got])) == [plain(i, t) for i, t in enumerate(texts)]
    assert {f for f in got[1].to_pylist()} == {"plain", "psm", "spm"}


def test_query_and_round_trip(spark):
    texts = awkward()
    docs = documents(spark, texts).withColumn("draw", F.lit(1)).withColumn("output", F.lit("x")).withColumn("n", F.lit("y"))
    docs = docs.union(docs.filter("doc_id < 5")).union(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    cut = middle.fill_in_middle(docs)
    assert cut.columns == ["doc_id", "lang", "source", "n_chars", "draw", "n", "form", "prefix_chars", "middle_chars", "output"]
    text = dict(enumerate(texts)) | {None: texts[0]}
    for r in cut.collect():
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain(r["doc_id"], text[r["doc_id"]])
    for r in middle.restore(cut).collect():
        assert r["restored"] == (text[r["doc_id"]] or "")
    for r in middle.digests(docs).collect():
        want = plain(r["doc_id"], text[r["doc_id"]])
        assert tuple(r)[1:5] == want[:4]
        assert r["output_sha256"] == hashlib.sha256(want[4].encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((text[r["doc_id"]] or "").encode()).hexdigest()


def test_same_as_sql(spark, tmp_path):
    docs = documents(spark, [t for t in awkward()])
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    want = sorted(con.execute(middle.digests_sql()).fetchall(), key=repr)
    assert sorted(map(tuple, middle.digests(docs).collect()), key=repr) == want


def test_runs_of_rows_do_not_change_results(spark, monkeypatch):
    texts = awkward()[:200]
    whole = sorted(map(tuple, middle.digests(documents(spark, texts)).collect()))
    monkeypatch.setattr(middle, "LAID", 64)
    assert sorted(map(tuple, middle.digests(documents(spark, texts)).collect())) == whole


def test_share_of_forms(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    n = {r["form"]: r["count"] for r in middle.fill_in_middle(docs, share=100, spm_share=25).groupBy("form").count().collect()}
    assert set(n) == {"psm", "spm"} and abs(n["spm"] - 1000) < 120


def test_empty_table(spark):
    assert middle.digests(empty(spark)).collect() == []
