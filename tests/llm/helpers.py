"""Small tables with the awkward rows every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, *, sources=None, first=0):
    sources = sources or ["s"] * len(texts)
    rows = [(first + i, t, "en", s, None if t is None else len(t)) for i, (t, s) in enumerate(zip(texts, sources))]
    return spark.createDataFrame(rows, DOCS)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(rng, n, vocabulary=5000):
    return " ".join(f"w{k}x" for k in rng.integers(0, vocabulary, n))
