from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import separators as S

from .helpers import documents, empty


def plain_documents(ids):
    out, start = [], 0
    for at, token in enumerate(ids):
        if token == 0:
            out.append((len(out), start, at - start))
            start = at + 1
    if start < len(ids):
        out.append((len(out), start, len(ids) - start))
    return out


@pytest.mark.parametrize("block,chunk", [(1, 2), (4, 3), (64, 1024)])
def test_same_as_brute_force(spark, tmp_path, block, chunk):
    rng = np.random.default_rng(block)
    files = {}
    for name, n, share in (("a", 500, 0.1), ("b", 300, 0.0), ("c", 64, 1.0), ("d", 0, 0.1), ("e", 257, 0.5), ("f", 1, 0.0)):
        ids = np.where(rng.random(n) < share, 0, rng.integers(1, 1 << 16, n)).astype("<u2")
        (tmp_path / name).write_bytes(ids.tobytes())
        files[name] = ids
    got: dict = {}
    for r in S.scan_blocks(S.read_blocks(spark, str(tmp_path), block), block, chunk).collect():
        got.setdefault(r["path"][-1], []).append((r["doc_no"], r["start"], r["n_tokens"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: plain_documents(v) for k, v in files.items() if len(v)}


def test_token_files_round_trip(spark, tmp_path):
    encoder = S.encoder(Path(S.VOCABULARY).read_bytes())
    texts = ["Hello, wörld!", None, "", "\x00\x00 zero", "😀" * 3, "a " * 100_000, "<|endoftext|>", " \n\n "]
    docs = documents(spark, texts).withColumn("block", F.lit(1)).coalesce(1)
    S.write_token_files(docs, str(tmp_path / "t"))
    stored = b"".join(p.read_bytes() for p in sorted((tmp_path / "t").glob("part-*")))
    ids = np.frombuffer(stored, dtype="<u2").astype(int)
    want = [encoder.encode_ordinary(t) if t else [] for t in texts]
    assert ids.tolist() == [x for w in want for x in [*(i + 1 for i in w), 0]]
    counted = sorted((r["doc_no"], r["n_tokens"]) for r in S.token_counts(docs).collect())
    assert counted == list(enumerate(map(len, want)))


def test_counts_of_all_files_and_empty_tables(spark):
    docs = documents(spark, [f"text number {i} " * (i % 7) for i in range(200)])
    rows = S.token_counts(docs.repartition(4).union(docs)).collect()
    assert len(rows) == 400
    for file in {r["file"] for r in rows}:
        own = sorted((r["doc_no"], r["start"], r["n_tokens"]) for r in rows if r["file"] == file)
        assert [o[0] for o in own] == list(range(len(own)))
        assert all(b[1] == a[1] + a[2] + 1 for a, b in zip(own, own[1:]))
    assert S.token_counts(empty(spark)).collect() == []
