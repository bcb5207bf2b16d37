"""Line dedup over documents: which lines stay, as a compressed bitmap per document.

A line's key is the line without ASCII white space at both ends, A-Z lowered, by two 64-bit
hashes.  Rows of key, document and position are dealt by range of key and slot and sorted by
document and position below it, so one pass streams each key's first occurrence in each
document.  A slot is a hashed share of the documents: a line that a third of all documents
hold is many slots of bounded size.  Slots tell how many documents hold a key; the positions
that a document loses come back to it as runs of the lines that stay, not as text.

All steps are DataFrame expressions.  Documents are told apart by doc_id and text: rows equal
in both count once and share a bitmap; a null doc_id is one like others.  A null or empty
text is one empty line.  A text of any length is one row of runs.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle

#: Documents that must hold a line for it to go, and code points of the shortest key that counts.
LEAST_DOCS = 10
LEAST_CHARS = 1
#: Documents of a slot of a key on average.
SLOT_DOCS = 4_096

SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, UPPER.lower())


def text_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, *, text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """h, g (the key's hashes), doc_id, mark (the text's hash), n_lines, pos of every line whose key counts."""
    lines = docs.select(
        "doc_id", F.xxhash64(text).alias("mark"), F.size(text_lines(F.col(text))).alias("n_lines"), F.posexplode(text_lines(F.col(text))).alias("pos", "line")
    )
    keyed = lines.withColumn("line", line_key(F.col("line"))).filter(F.length("line") >= least_chars)
    return keyed.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc_id", "mark", "n_lines", "pos")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """h, g, slot, doc_id, mark, pos of the first line of each key in each document (rows: ``line_rows`` with a slot).

    The rows are dealt by range and sorted; the window finds both as it needs them.
    """
    order = ["doc_id", "mark", "pos"]
    dealt = rows.repartitionByRange("h", "g", "slot").sortWithinPartitions("h", "g", "slot", *order)
    before = F.lag(F.struct("doc_id", "mark")).over(Window.partitionBy("h", "g", "slot").orderBy(*order))
    return dealt.withColumn("before", before).filter("before is null or not (before.doc_id <=> doc_id and before.mark = mark)").drop("before", "n_lines")


def kept_runs(dropped: Column, n_lines: Column) -> Column:
    """Runs (first, n) of the lines that stay, where ``dropped`` has the positions of the others in order."""
    starts = F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) < p - 1))
    ends = F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) > p + 1))
    first = F.concat(F.array(F.lit(0)), F.transform(ends, lambda p: p + 1))
    stop = F.concat(starts, F.array(n_lines))
    runs = F.zip_with(first, stop, lambda a, b: F.struct(a.alias("first"), (b - a).alias("n")))
    return F.filter(runs, lambda r: r["n"] > 0)


def keep_bitmaps(
    docs: DataFrame, *, text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, keep_first: bool = False, slot_docs: int = SLOT_DOCS
) -> DataFrame:
    """doc_id, mark, n_lines, n_dropped, keep of every document that loses lines; the others keep all.

    A key found in ``least_docs`` documents loses all its lines or, with ``keep_first``, all but
    the first of the smallest doc_id (null first; ties by the text's hash).  ``keep`` is the
    run-length form of the bitmap: array<struct<first, n>> of the lines that stay.
    """
    slots = max(1, -(-docs.count() // slot_docs))
    slot = F.pmod(F.xxhash64("doc_id", "mark"), F.lit(slots)).cast("int")
    rows = settle(line_rows(docs, text=text, least_chars=least_chars)).withColumn("slot", slot)
    by_slot = first_occurrences(rows).groupBy("h", "g", "slot").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "pos")).alias("low"))
    key = Window.partitionBy("h", "g")
    common = (
        by_slot.withColumn("n", F.sum("n").over(key)).withColumn("low", F.min("low").over(key))
        .filter(F.col("n") >= least_docs)
        .select("h", "g", "slot", *(["low"] if keep_first else []))
    )
    lost = rows.join(common, ["h", "g", "slot"])
    if keep_first:
        lost = lost.filter("not (low.doc_id <=> doc_id and low.mark = mark and low.pos = pos)")
    places = lost.groupBy("doc_id", "mark", "n_lines").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    return places.select("doc_id", "mark", "n_lines", F.size("lost").cast("long").alias("n_dropped"), kept_runs(F.col("lost"), F.col("n_lines")).alias("keep"))


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, text: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the bitmap of each row (null: all lines stay) and n_dropped; the names of these two columns."""
    keep, dropped, mark, of = (free_name(docs, x) for x in ("keep", "n_dropped", "mark", "of_doc_id"))
    held = bitmaps.select(F.col("doc_id").alias(of), F.col("mark").alias(mark), F.col("n_dropped").alias(dropped), F.col("keep").alias(keep))
    same = docs["doc_id"].eqNullSafe(held[of]) & (F.xxhash64(docs[text]) == held[mark])
    return docs.join(held, same, "left").drop(of, mark), keep, dropped


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of ``text`` that a bitmap keeps, joined; the whole text where it is null."""
    lines = text_lines(text)
    runs = F.transform(keep, lambda r: F.slice(lines, r["first"] + 1, r["n"]))
    return F.when(keep.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.flatten(runs), "\n"))


def without_common_lines(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with the text that is left; a document that loses no line is as it was."""
    rows, keep, _ = with_bitmaps(docs, keep_bitmaps(docs, text=text, **options), text=text)
    left = F.when(F.col(keep).isNull(), F.col(text)).otherwise(kept_text(F.col(text), F.col(keep)))
    return rows.select(*[left.alias(c) if c == text else F.col(c) for c in docs.columns])


def kept_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row."""
    docs = docs.select("doc_id", "text")
    rows, keep, dropped = with_bitmaps(docs, keep_bitmaps(docs, **options))
    return rows.select(
        "doc_id",
        F.size(text_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce(F.col(dropped), F.lit(0)).cast("long").alias("n_dropped"),
        F.sha2(kept_text(F.col("text"), F.col(keep)).cast("binary"), 256).alias("kept_sha256"),
    )


def kept_digests_sql() -> str:
    """The same rows in DuckDB."""
    return rf"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text, md5(text) AS mark FROM documents),
split AS (SELECT doc_id, mark, text, string_split(text, chr(10)) AS lines FROM docs),
numbered AS (SELECT doc_id, mark, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') AS key FROM numbered),
common AS (SELECT key FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT (doc_id, mark)) >= {LEAST_DOCS}),
result AS (
  SELECT doc_id, mark, count(*)::BIGINT AS n_lines, count(common.key)::BIGINT AS n_dropped,
         sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
  FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id, mark)
SELECT documents.doc_id, n_lines, n_dropped, kept_sha256
FROM documents JOIN result ON documents.doc_id IS NOT DISTINCT FROM result.doc_id AND md5(text) IS NOT DISTINCT FROM mark
"""
