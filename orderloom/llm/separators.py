"""Token counts of documents by a separator scan over flat token files.

A flat token file is token ids of fixed width end to end, documents closed by an
end-of-document id, without index.  Files are cut into blocks of equal tokens wherever
documents lie.  Each block is searched for the identifier by one vectorised comparison.  A
prefix scan over the blocks' summaries (identifiers so far, place of the last one) says
where the document began that a block's first identifier closes and what its number is.
The scan runs within chunks of blocks and then over the chunks, so one long file is not
one task's work.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_folder, settle

#: Ids are little-endian 16-bit numbers; 0 ends a document and the vocabulary's ids are shifted by one.
END = 0
SHIFT = 1
WIDTH = 2
BLOCK_TOKENS = 1 << 16
CHUNK_BLOCKS = 1_024
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the published pattern that splits text before this vocabulary's merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Bytes of a text's shifted token ids; null and empty texts have none.  The driver reads the vocabulary and sends it."""
    ranks = Path(vocabulary).read_bytes()
    held: list = []

    @F.pandas_udf("binary")
    def encode(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(encoder(ranks))
        ordinary = held[0].encode_ordinary
        return pd.Series([(np.array(ordinary(t), dtype="<u2") + np.uint16(SHIFT)).tobytes() if t else b"" for t in texts], dtype=object)

    return encode.asNondeterministic()(text)


def write_token_files(docs: DataFrame, folder: str, *, text: str = "text", vocabulary: str = VOCABULARY) -> None:
    """One flat token file per partition of ``docs``, in row order.  Spark's text sink writes the bytes and closes each row with the end id."""
    end = END.to_bytes(WIDTH, "little").decode("ascii")
    rows = docs.select(tokens(F.col(text), vocabulary).cast("string").alias("value"))
    rows.write.option("lineSep", end).option("compression", "none").text(folder)


def read_blocks(spark: SparkSession, folder: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, block, payload of the flat token files below ``folder``; a file is one row of a task before it is cut, 2 GB at most."""
    size = block_tokens * WIDTH
    files = spark.read.format("binaryFile").load(folder).filter("length > 0")
    starts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))
    blocks = files.select("path", "content", F.explode(starts).alias("block"))
    return blocks.select("path", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("payload"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of tokens and places of the end id in each block."""
    for batch in batches:
        size, ends = [], []
        for payload in batch.column(2):
            ids = np.frombuffer(payload.as_buffer(), dtype="<u2")
            size.append(len(ids))
            ends.append(np.flatnonzero(ids == END).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], ["path", "block", "size", "ends"]
        )


def scan_blocks(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """path, doc_no, start, n_tokens of every document in the blocks (path, block, payload) of flat token files.

    Numbers and starts count from 0 in the file; the end id is not counted.  Tokens after a
    file's last end id are one more document.  Two end ids in a row close an empty one.
    An empty file has none.
    """
    marks = settle(blocks.select("path", "block", "payload").mapInArrow(_marks, "path string, block long, size long, ends array<int>"))
    n = F.size("ends").cast("long")
    base = F.col("block") * block_tokens
    rows = marks.select(
        "path", "block", "ends", base.alias("base"), (base + F.col("size")).alias("stop"), n.alias("n"),
        F.when(n > 0, base + F.element_at("ends", -1)).alias("last"),
        F.floor(F.col("block") / chunk_blocks).alias("chunk"),
    )
    chunks = rows.groupBy("path", "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier = Window.partitionBy("path").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("path", "chunk", F.sum("n").over(earlier).alias("chunk_n"), F.max("last").over(earlier).alias("chunk_last"))
    before = Window.partitionBy("path", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        rows.withColumn("n_before", F.sum("n").over(before)).withColumn("last_before", F.max("last").over(before))
        .join(chunks, ["path", "chunk"])
        .select(
            "path", "ends", "base",
            (F.coalesce("n_before", F.lit(0)) + F.coalesce("chunk_n", F.lit(0))).alias("number"),
            F.coalesce("last_before", "chunk_last", F.lit(-1)).alias("previous"),
        )
    )
    found = stitched.select("path", "base", "number", "previous", "ends", F.posexplode("ends").alias("k", "end")).select(
        "path",
        (F.col("number") + F.col("k")).alias("doc_no"),
        F.when(F.col("k") == 0, F.col("previous")).otherwise(F.col("base") + F.get("ends", F.col("k") - 1)).alias("after"),
        (F.col("base") + F.col("end")).alias("end"),
    )
    open_end = rows.groupBy("path").agg(F.sum("n").alias("doc_no"), F.coalesce(F.max("last"), F.lit(-1)).alias("after"), F.max("stop").alias("end"))
    everything = found.union(open_end.filter(F.col("end") > F.col("after") + 1))
    return everything.select("path", "doc_no", (F.col("after") + 1).alias("start"), (F.col("end") - F.col("after") - 1).alias("n_tokens"))


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """file, doc_no, start, n_tokens of every document, found in the flat token files that ``docs`` is written to.

    The files go to the shared folder and are removed once their blocks are scanned.
    """
    spark = docs.sparkSession
    folder = fresh_folder(spark, "token-files")
    write_token_files(docs, folder, vocabulary=vocabulary)
    found = scan_blocks(read_blocks(spark, folder))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("file"), "doc_no", "start", "n_tokens")
