"""Helpers shared by the operators: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import released_shuffles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir``, else one set here in a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor reaches")
    folder = tempfile.mkdtemp(prefix="orderloom-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, survives lost executors, leaves no shuffle files."""
    shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    with released_shuffles(df.sparkSession):
        # A table keeps the setting that it was made under; ``df`` itself may be run again.
        return df.select("*").checkpoint(eager=True)


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Sends tasks' Python workers at most ``rows`` rows at a time: whole texts are held in the batch, its copy and the results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    if not 0 < held <= rows:
        spark.conf.set(name, rows)


def narrow(df: DataFrame, most_rows: int = 1 << 20) -> DataFrame:
    """A settled table of a few numbers a row, to be sent to all tasks if it is counted to have at most ``most_rows``."""
    with released_shuffles(df.sparkSession):
        rows = df.count()
    return F.broadcast(df) if rows <= most_rows else df


def hash_sample(rows: DataFrame, n: int, *keys: str, seed: int = 0) -> DataFrame:
    """``n`` rows of smallest hash of ``keys``, or all if fewer.

    Rows are counted first, so that each task passes on about its share of the sample only.
    """
    space = 1 << 52
    total = rows.count()
    share = min(1.0, (n + 6 * n**0.5 + 20) / max(total, 1))
    order = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(space))
    return rows.filter(order < int(share * space) + 1).orderBy(order, *keys).limit(n)


def free_name(df: DataFrame, name: str) -> str:
    """``name`` or the first variant of it that is no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in batches sorted by it, one table each."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        part = pa.table(batch)
        if not part.num_rows:
            continue
        keys = part.column(key).to_numpy()
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and keys[a] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(part.slice(a, b - a))
            last = keys[a]
    if held:
        yield pa.concat_tables(held)


def words_in(column) -> "F.Column":
    """Number of runs of characters other than blank, tab, newline, vertical tab, form feed and return."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
