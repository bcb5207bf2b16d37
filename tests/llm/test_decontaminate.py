from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import decontaminate as D

from .helpers import documents, empty, words

ITEMS = "item_id long, text string"


def plain_align(item, passage):
    """Best local alignment score, cell by cell."""
    best = 0
    rows = [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(passage, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
            best = max(best, rows[i][j])
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(0)
    for _ in range(200):
        item, passage = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = D.align(item, passage)
        assert score == plain_align(item.tolist(), passage.tolist())
        if score:
            assert plain_align(item.tolist(), passage[start : end + 1].tolist()) == score


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(5)
    items = [words(rng, n) for n in (15, 30, 59, 40)]
    edited = items[1].split()
    edited[4], edited[17] = "other", "changed"
    del edited[22]
    edited.insert(9, "extra")
    half = items[3].split()[:12]
    texts = [
        words(rng, 50) + " " + items[0] + " " + words(rng, 40),
        words(rng, 5) + " " + " ".join(edited).upper() + ". " + words(rng, 300),
        items[2].replace(" ", ",\n"),
        words(rng, 400),
        words(rng, 20) + " " + " ".join(half) + " " + words(rng, 20),
        None,
        "",
        words(rng, 40_000) + " " + items[0] + " " + items[0] + " " + items[3],
    ]
    benchmark = spark.createDataFrame([*enumerate(items), (9, None), (8, "one"), (7, ""), (None, items[3]), (2, items[2])], ITEMS)
    return documents(spark, texts), benchmark, texts, items


def test_finds_exact_and_edited_copies(spark, case):
    docs, benchmark, texts, items = case
    rows = D.contaminated_pairs(docs.withColumn("item_id", F.lit(1)), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == {(0, 0), (1, 1), (2, 2), (7, 0), (7, 3)}
    for r in rows:
        found = D.split_words(texts[r["doc_id"]])[r["first_word"] : r["last_word"] + 1]
        want = D.split_words(items[r["item_id"]])
        if r["doc_id"] != 1:
            assert found == want and r["score"] == 1.0
        else:
            assert 0.75 < r["score"] < 1 and len(set(found) & set(want)) >= 26


def test_scores_are_those_of_brute_force(spark, case):
    docs, benchmark, texts, items = case
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated_pairs(docs, benchmark, threshold=0.3).collect()}
    for d, text in enumerate(texts[:5]):
        for i, item in enumerate(items):
            a, b = D.split_words(item), D.split_words(text)
            score = plain_align(a, b) / (2 * len(a))
            assert got.get((d, i), 0.0) == pytest.approx(score if score >= 0.3 else 0.0)


def test_blocks_of_items_find_the_same(spark, case, monkeypatch):
    docs, benchmark, _, _ = case
    want = sorted(map(tuple, D.contaminated_pairs(docs, benchmark).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 40)
    assert sorted(map(tuple, D.contaminated_pairs(docs, benchmark).collect())) == want
    assert sorted(r["doc_id"] for r in D.decontaminate(docs, benchmark).collect()) == [3, 4, 5, 6]


def test_empty_tables(spark, case):
    docs, benchmark, _, _ = case
    assert D.contaminated_pairs(empty(spark), benchmark).collect() == []
    assert D.contaminated_pairs(docs, empty(spark, ITEMS)).collect() == []
    assert D.decontaminate(docs, empty(spark, ITEMS)).count() == docs.count()
    repeated = docs.filter("doc_id = 0").withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["doc_id"] for r in D.contaminated_pairs(repeated.union(repeated), benchmark).collect()] == [None, None]


def edited_copies(rng, item, step):
    """Copies with every ``step``-th word changed, left out or followed by another, from each first place."""
    for first in range(step):
        at = range(first, len(item), step)
        yield [f"z{k}" if k in at else w for k, w in enumerate(item)]
        yield [w for k, w in enumerate(item) if k not in at]
        yield [x for k, w in enumerate(item) for x in ([w, f"z{k}"] if k in at else [w])]


def test_evenly_edited_copies_are_those_of_brute_force(spark):
    rng = np.random.default_rng(11)
    items = [words(rng, n).split() for n in (3, 5, 10, 16, 40)] + [words(rng, 24, vocabulary=9).split()]
    texts = []
    for item in items:
        for step in (1, 2, 3, 4, 5, 6):
            for copy in edited_copies(rng, item, step):
                texts.append(" ".join([words(rng, 20, vocabulary=30), *copy, words(rng, 20, vocabulary=30)]))
    texts.append(" ".join([*items[3][:5], "zz", *items[3][6:10], "zz", *items[3][11:]]))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], ITEMS)
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            score = plain_align(item, D.split_words(text)) / (2 * len(item))
            if score >= D.THRESHOLD:
                want[d, i] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in D.contaminated_pairs(documents(spark, texts), benchmark).collect()}
    assert got == pytest.approx(want) and len(want) > 100 and want[len(texts) - 1, 3] == 26 / 32


def test_low_threshold_takes_single_words(spark):
    docs = documents(spark, ["a q r", "q r s"])
    benchmark = spark.createDataFrame([(0, "a b c")], ITEMS)
    assert [r["doc_id"] for r in D.contaminated_pairs(docs, benchmark, threshold=1 / 3).collect()] == [0]
