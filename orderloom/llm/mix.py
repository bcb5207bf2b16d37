"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are put in a seeded random order and form one stream of words,
which repeats from its end.  The stream is cut into blocks of equal words.  The slots of
the mix are points of the golden-ratio sequence mapped through the cumulative shares of
the sources, so every stretch of the mix is close to the target weights.  A source's n-th
slot takes its n-th block.

All steps are DataFrame expressions.  Running totals are taken within buckets of a source
and added to the totals of the buckets before, so no source is handled by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, settle, words_in

#: Words a block holds, rows a bucket of a source holds on average, slots a chunk holds.
BLOCK_WORDS = 2_048
BUCKET_ROWS = 8_192
CHUNK_SLOTS = 16_384
#: Cells of the unit interval by which slots meet the sources' shares.
GRID = 4_096
GOLDEN = 0.6180339887498949
#: Weights of the sources in code point order, repeating; share of all words that the mix takes; most repeats.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, repeats: int = MOST_REPEATS
) -> DataFrame:
    """source, source_size, target from source, source_size: one row per source.

    Sources in code point order, null last, weigh ``weights`` in turn.  Targets are by weight
    but at most ``repeats`` times the source; what is above is shared again by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    rows = (
        sizes.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("level", F.col("cap") / F.col("weight"))
    )
    # With the sources of lower level capped, the rest share at this rate per weight; the
    # first source whose level is not below the rate, and all after it, are not capped.
    up_to = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumn("rate", (F.sum("source_size").over(everything) * total_share - F.coalesce(F.sum("cap").over(up_to), F.lit(0))) / F.sum("weight").over(rest))
        .withColumn("rate", F.min(F.when(F.col("level") >= F.col("rate"), F.struct("level", "rate"))).over(everything)["rate"])
        .select("source", "source_size", F.when(F.col("level") < F.col("rate"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rate")).alias("target"))
    )


class Mix:
    """The mix of ``docs`` (columns doc_id, text, source and any more).

    Null texts have no words and take no part; a null source is a source.  Rows equal in
    doc_id may trade places.  An empty table gives no rows.
    """

    def __init__(
        self, docs: DataFrame, *, size: Column | None = None, seed: int = 0, block_words: int = BLOCK_WORDS, bucket_rows: int = BUCKET_ROWS,
        weights: tuple[int, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, repeats: int = MOST_REPEATS,
    ):
        self.block_words, self.repeats = block_words, repeats
        self.kept = docs.columns
        names = {x: free_name(docs, x) for x in ("size", "source_size", "target", "start", "take", "key", "bucket", "at", "block", "of_source", "of_bucket", "offset", "of_block", "place")}
        self.names = names
        size_name, start, key, bucket = names["size"], names["start"], names["key"], names["bucket"]
        digits = max(1, math.ceil(math.log(max(1, docs.count() / bucket_rows), 16)))
        rows = (
            docs.withColumn(size_name, words_in(F.col("text")) if size is None else size)
            .withColumn(key, F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")))
            .withColumn(bucket, F.substring(key, 1, digits))
        )
        totals = rows.groupBy("source", bucket).agg(F.sum(size_name).alias("words"))
        before = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = totals.withColumn("words", F.coalesce(F.sum("words").over(before), F.lit(0)))
        targets = source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, total_share, repeats)
        #: One row per source: source, source_size, target, take (whole words to take).
        self.sources = settle(targets.withColumn("take", F.round("target").cast("long")))
        of_source, of_bucket, offset = names["of_source"], names["of_bucket"], names["offset"]
        held = self.sources.select(
            F.col("source").alias(of_source), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"]), F.col("take").alias(names["take"])
        )
        offsets = offsets.select(F.col("source").alias(of_source), F.col(bucket).alias(of_bucket), F.col("words").alias(offset))
        inside = Window.partitionBy("source", bucket).orderBy(key, "doc_id", size_name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        placed = rows.withColumn(start, F.sum(size_name).over(inside) - F.col(size_name))
        placed = placed.join(offsets, placed["source"].eqNullSafe(offsets[of_source]) & (placed[bucket] == offsets[of_bucket]))
        placed = placed.withColumn(start, F.col(start) + F.col(offset)).drop(of_source, of_bucket, offset, key, bucket)
        #: Documents with size, start (their first word's place in their source's stream), source_size, target, take.
        self.documents = placed.join(held, placed["source"].eqNullSafe(held[of_source])).drop(of_source)

    def schedule(self) -> DataFrame:
        """source, block, slot: the place in the mix of each block that the mix takes.

        A source's blocks follow its slots in order.  Blocks beyond a source's slots (a few,
        since the sequence is even) come after all slots.
        """
        needs = self.sources.withColumn("blocks", F.ceil(F.col("take") / self.block_words))
        by_name = Window.orderBy(F.col("source").asc_nulls_last())
        everything = by_name.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        shares = needs.select(
            "source", "blocks",
            F.sum("blocks").over(everything).alias("all_blocks"),
            (F.sum("blocks").over(by_name.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("blocks").over(everything)).alias("high"),
        ).withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0.0)))
        cells = shares.filter("blocks > 0").withColumn(
            "cell", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.least(F.floor(F.col("high") * GRID), F.lit(GRID - 1))))
        )
        total = needs.agg(F.sum("blocks")).first()[0] or 0
        points = self.sources.sparkSession.range(total).select(
            F.col("id").alias("slot"), (((F.col("id") + 0.5) * GOLDEN) - F.floor((F.col("id") + 0.5) * GOLDEN)).alias("point")
        )
        dealt = (
            points.withColumn("cell", F.floor(F.col("point") * GRID)).join(cells, "cell")
            .filter("point >= low and point < high")
            .withColumn("chunk", F.floor(F.col("slot") / CHUNK_SLOTS))
        )
        chunks = dealt.groupBy("source", "chunk").agg(F.count("*").alias("n"))
        before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = chunks.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
        ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("source", "chunk").orderBy("slot")))
        ranked = ranked.join(offsets, ranked["source"].eqNullSafe(offsets["_source"]) & (ranked["chunk"] == offsets["_chunk"])).select(
            "source", (F.col("_before") + F.col("rank") - 1).alias("block"), "slot", "blocks"
        )
        slots = chunks.groupBy("source").agg(F.sum("n").alias("n")).withColumnRenamed("source", "_source")
        late = (
            shares.join(slots, shares["source"].eqNullSafe(slots["_source"]), "left").withColumn("n", F.coalesce("n", F.lit(0)))
            .filter("n < blocks")
            .select("source", "all_blocks", F.explode(F.sequence("n", F.col("blocks") - 1)).alias("block"))
        )
        return (
            ranked.filter("block < blocks").select("source", "block", "slot")
            .union(late.select("source", "block", (F.col("all_blocks") + F.col("block")).alias("slot")))
        )

    def appearances(self) -> DataFrame:
        """``documents`` once for every pass of their source's stream that the mix reaches, with the place there of their first word."""
        start, size, take, source_size = (F.col(self.names[x]) for x in ("start", "size", "take", "source_size"))
        passes = F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.repeats - 1)), lambda k: start + k * source_size), lambda at: at < take)
        return self.documents.filter(size > 0).withColumn(self.names["at"], F.explode(passes))

    def pieces(self) -> DataFrame:
        """The mix: columns of ``docs``, size, start, target, source_size, and slot, from_word (of the document, from 0), words taken."""
        size, take = F.col(self.names["size"]), F.col(self.names["take"])
        n = self.block_words
        at, block = F.col(self.names["at"]), F.col(self.names["block"])
        end = F.least(at + size, take)
        cut = self.appearances().withColumn(self.names["block"], F.explode(F.sequence(F.floor(at / n), F.floor((end - 1) / n))))
        of_source, of_block, place = (self.names[x] for x in ("of_source", "of_block", "place"))
        slots = self.schedule().select(F.col("source").alias(of_source), F.col("block").alias(of_block), F.col("slot").alias(place))
        low = F.greatest(at, block * n)
        return cut.join(
            slots, cut["source"].eqNullSafe(slots[of_source]) & (cut[self.names["block"]] == slots[of_block])
        ).select(
            *[cut[c] for c in dict.fromkeys([*self.kept, *(self.names[x] for x in ("size", "start", "target", "source_size"))])],
            F.col(place).alias("slot"), (low - at).alias("from_word"), (F.least(end, (block + 1) * n) - low).alias("words"),
        )

    def whole_documents(self) -> DataFrame:
        """The columns of ``docs``: every document once for each time the mix takes its first word."""
        block = self.names["block"]
        first = self.appearances().withColumn(block, F.floor(F.col(self.names["at"]) / self.block_words))
        of_source, of_block = self.names["of_source"], self.names["of_block"]
        slots = self.schedule().select(F.col("source").alias(of_source), F.col("block").alias(of_block))
        taken = first.join(slots, first["source"].eqNullSafe(slots[of_source]) & (first[block] == slots[of_block]), "left_semi")
        return taken.select(*self.kept)


def words_taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``; a document without words has taken 0."""
    # Four numbers a document, read several times; the texts are read once.
    rows = settle(docs.select("doc_id", "source", words_in(F.col("text")).alias("size")))
    mix = Mix(rows, size=F.col("size"), **options)
    columns = ["doc_id", "source", "size", "source_size", "target", "start"]
    named = mix.documents.withColumnsRenamed({mix.names[x]: x for x in ("source_size", "target", "start") if mix.names[x] != x})
    pieces = mix.pieces()
    taken = pieces.groupBy(F.col("source").alias("_source"), F.col(mix.names["start"]).alias("_start")).agg(F.sum("words").alias("taken"))
    some = named.select(*columns).filter("size > 0")
    some = some.join(taken, some["source"].eqNullSafe(taken["_source"]) & (some["start"] == taken["_start"]), "left")
    out = ["doc_id", "size", "source_size", "target"]
    return some.select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken")).union(
        named.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    )


def words_taken_sql() -> str:
    """The same rows in DuckDB: what of a source's repeated stream lies before its target."""
    return r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM sizes),
levels AS (SELECT *, cap / weight AS level FROM weighed),
rates AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
            / (sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS own_rate
  FROM levels),
rate AS (SELECT own_rate AS rate FROM rates WHERE level >= own_rate ORDER BY level, own_rate LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN level < rate THEN cap::DOUBLE ELSE weight * rate END AS target,
         round(CASE WHEN level < rate THEN cap::DOUBLE ELSE weight * rate END)::BIGINT AS take
  FROM rates, rate),
placed AS (
  SELECT docs.*, source_size, target, take,
         (sum(size) OVER (PARTITION BY docs.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS start
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(start + size, take) - start) + greatest(0, least(start + source_size + size, take) - start - source_size))::BIGINT AS taken
FROM placed
"""
