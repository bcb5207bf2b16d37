from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderloom.llm import toxicity as T

from .helpers import documents, empty, words

LABELS = "doc_id long, quality int, toxic int"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = T.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    features = rng.normal(size=(7, 5, T.FEATURES))
    mask = (np.arange(7)[:, None] < np.array([7, 3, 1, 5, 0])).astype(float)
    toxic = np.array([0, 1, 1, 0, 1.0])
    _, grads = net.gradients(features, mask, toxic)
    for name, value in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in value.shape)
            kept, e = value[at], 1e-5
            value[at] = kept + e
            up = net.gradients(features, mask, toxic)[0]
            value[at] = kept - e
            down = net.gradients(features, mask, toxic)[0]
            value[at] = kept
            assert grads[name][at] == pytest.approx((up - down) / (2 * e), abs=1e-6)


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, T.WINDOW, T.WINDOW + 1, 1000):
        starts = T.window_starts(n)
        covered = set().union(*(range(s, min(n, s + T.WINDOW)) for s in starts))
        assert covered == set(range(n))
        assert all(b - a <= T.STRIDE for a, b in zip(starts, starts[1:]))


def test_grams_are_those_of_each_word():
    some = [b"ab", b"", b"stupid", "né".encode()]
    owner, slot = T.gram_slots(some)
    for k, word in enumerate(some):
        whole = b"<" + word + b">"
        want = sum(max(0, len(whole) - n + 1) for n in T.GRAMS)
        assert (owner == k).sum() == want
    again = T.gram_slots([b"stupid"])[1]
    assert sorted(slot[owner == 2]) == sorted(again)


def corpus(rng, n):
    """Texts of which every fifth has a word of a rude stem with an ending of its own."""
    texts, toxic = [], []
    for i in range(n):
        parts = words(rng, int(rng.integers(5, 200)), 800).split()
        if i % 5 == 0:
            stem = ("grobian", "zzyrp")[i % 2]
            for _ in range(2):
                parts[int(rng.integers(0, len(parts)))] = stem + chr(97 + int(rng.integers(0, 26))) * 2
        texts.append(" ".join(parts))
        toxic.append(int(i % 5 == 0))
    return texts, toxic


@pytest.fixture(scope="module")
def case(spark):
    texts, toxic = corpus(np.random.default_rng(3), 700)
    rng = np.random.default_rng(4)
    texts += [None, "", words(rng, 9000, 800), words(rng, 9000, 800) + " grobianqq zzyrpkk " + words(rng, 3000, 800)]
    docs = documents(spark, texts)
    marks = [(i, 0, t) for i, t in enumerate(toxic)] + [(None, 0, 1), (5, 0, None), (0, 0, 1), (700, 0, 0), (9999, 0, 1)]
    return docs, spark.createDataFrame(marks, LABELS), toxic


def test_held_out_texts_are_told_apart(spark, case):
    docs, labels, toxic = case
    rows = {r["doc_id"]: r for r in T.score_documents(docs.withColumn("score", F.lit("x")), labels).collect()}
    assert len(rows) == 704
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [i for i in range(700) if rows[i]["held_out"]]
    right = np.mean([rows[i]["predicted"] == toxic[i] for i in held])
    caught = np.mean([rows[i]["predicted"] for i in held if toxic[i]])
    assert right > 0.93 and caught > 0.8
    assert rows[700]["score"] == rows[701]["score"] < 0.5
    # A stem deep in a long text counts as in a short one.
    assert rows[703]["predicted"] == 1 and rows[703]["score"] > rows[702]["score"]


def test_labels_held_out_are_not_learned_from(spark, case):
    docs, labels, _ = case
    turned = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    some = docs.filter("doc_id < 60")
    a, b = (sorted(map(tuple, T.score_documents(some, x).collect())) for x in (labels.filter("doc_id < 60"), turned.filter("doc_id < 60")))
    assert a == b


def test_scores_do_not_depend_on_other_texts(case):
    texts, toxic = corpus(np.random.default_rng(7), 200)
    scorer = T.train([T.split_words(t) for t in texts], np.array(toxic), 0.2)
    together = scorer.scores(texts)
    assert together == pytest.approx(np.array([scorer.scores([t])[0] for t in texts]), abs=1e-5)


def test_one_class_no_labels_and_empty_tables(spark, case):
    docs, labels, _ = case
    some = docs.filter("doc_id < 5 or doc_id = 700").union(docs.filter("doc_id = 1"))
    assert {r["predicted"] for r in T.score_documents(some, empty(spark, LABELS)).collect()} <= {0, 1}
    clean = T.score_documents(some, labels.filter("toxic = 0")).collect()
    assert len(clean) == 7 and all(r["score"] < 0.5 for r in clean)
    assert T.score_documents(empty(spark), labels).collect() == []
    nameless = some.withColumn("doc_id", F.lit(None).cast("long"))
    assert {r["held_out"] for r in T.score_documents(nameless, labels).collect()} == {False}


@pytest.mark.parametrize("word", ["a", "ab", "é", "hi"])
def test_texts_of_one_short_word(word):
    """Training on, and scoring of, nothing but words of one or two bytes."""
    scorer = T.train([[word], [word]], np.array([0, 1]), 0.5)
    assert 0 <= scorer.scores([word])[0] <= 1
    texts, toxic = corpus(np.random.default_rng(7), 60)
    scorer = T.train([T.split_words(t) for t in texts] + [[word]], np.array([*toxic, 0]), 0.2)
    assert 0 <= scorer.scores([word])[0] <= 1
    owner, slot = T.gram_slots([word.encode()])
    assert len(owner) == len(slot) >= 1


def test_repeated_ids_are_learned_from_once(spark, case):
    docs, labels, _ = case
    some = docs.filter("doc_id < 60")
    again = some.union(some).union(some.withColumn("text", F.concat("text", F.lit("~ more"))))
    one, many = (T.score_documents(some, labels.filter("doc_id < 60")), T.score_documents(again, labels.filter("doc_id < 60")))
    scores = {r["doc_id"]: r["score"] for r in one.collect()}
    assert many.count() == 180
    assert all(any(r["score"] == scores[r["doc_id"]] for r in rows) for rows in [[r] for r in many.limit(60).collect()])
