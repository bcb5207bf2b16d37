"""Table store: run-scoped Parquet tables, the run log and the override log.

Every refresh writes its tables under its own run directory and then appends one
success row to the run log.  Readers resolve the newest successful run, so a
half-written run is never visible and a table is never replaced while it is read.
One refresh runs at a time: it holds a marker file that only one can create.

Override edits are batches, each a folder of its own.  A snapshot holds the newest
change of each line of the batches it names; readers take the newest complete snapshot
and the batches after it, so reads do not grow with the edits ever made.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Layout
from .schemas import OVERRIDES, struct_of

OVERRIDE_KEYS = ["purchase_order", "purchase_order_item"]

# Smaller files than those of Spark's default, for some more CPU time.
COMPRESSION = "zstd"

# Columns of the run log, and the characters of a summary.
SUMMARY_WIDTH = 120
RUN_COLUMNS = {
    "run_id": "string",
    "started_at": "timestamp",
    "finished_at": "timestamp",
    "status": "string",
    "message": "string",
}


#: Seconds after which the marker of a refresh counts as left behind by a driver that is gone.
LEASE_SECONDS = 6 * 3600


class RefreshBusy(RuntimeError):
    """Another refresh holds the store."""


def _now() -> datetime:
    return datetime.now(timezone.utc)


class TableStore:
    """Tables of one warehouse folder, which all executors must be able to reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    # Tables -----------------------------------------------------------------

    def path(self, run_id: str, table: str) -> str:
        return f"{self.root}/runs/{run_id}/{table}"

    def write(
        self, df: DataFrame, run_id: str, table: str, layout: Layout | list[str] | None = None, append: bool = False
    ) -> DataFrame:
        """Write a table of a run, or with ``append`` more rows of it, and return it as read back.

        A ``layout`` places the rows, by one more shuffle, so that filters on its columns
        read little; a list of columns orders them inside each file only, without one.  An
        empty input keeps its schema.
        """
        options, placed = {"compression": COMPRESSION}, df
        if isinstance(layout, Layout):
            options, placed = options | layout.options(), layout.place(df)
        elif layout:
            placed = df.sortWithinPartitions(*layout)
        placed.write.mode("append" if append else "overwrite").options(**options).parquet(self.path(run_id, table))
        return self.read(table, run_id)

    def drop(self, path: str = "") -> None:
        """Remove a folder of the store, or all of it, that nobody reads any more."""
        where, files = self._at(path) if path else self._at(".")
        files.delete(where, True)

    def read(self, table: str, run_id: str | None = None) -> DataFrame:
        run_id = run_id or self.current_run()
        if run_id is None:
            raise LookupError("no successful run yet")
        return self.spark.read.parquet(self.path(run_id, table))

    def has(self, table: str, run_id: str) -> bool:
        return self._read_or_none(self.path(run_id, table)) is not None

    def _read_or_none(self, path: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    # Files of the store -----------------------------------------------------

    def _at(self, path: str):
        """Hadoop's path and file system of a path below the root."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[str]:
        where, files = self._at(path)
        if not files.exists(where):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isDirectory())

    @contextmanager
    def single_flight(self, lease_seconds: float = LEASE_SECONDS) -> Iterator[None]:
        """Holds the store for one refresh; raises RefreshBusy while another does.

        The marker is a file that the file system creates only if it is absent.  One older
        than the lease is moved aside first, which only one of several callers can do.
        """
        marker, files = self._at("refresh.running")
        if files.exists(marker):
            age = _now().timestamp() - files.getFileStatus(marker).getModificationTime() / 1000
            aside, _ = self._at(f"refresh.left_behind_{uuid.uuid4().hex}")
            if age <= lease_seconds or not files.rename(marker, aside):
                raise RefreshBusy(f"a refresh has been running for {age:.0f} s")
            files.delete(aside, False)
        files.mkdirs(marker.getParent())
        # Hadoop's local file system looks before it creates; Java's own call does both at once.
        local = files.getUri().getScheme() == "file"
        if not (self.spark._jvm.java.io.File(marker.toUri().getPath()).createNewFile() if local else files.createNewFile(marker)):
            raise RefreshBusy("another refresh has just started")
        try:
            yield
        finally:
            files.delete(marker, False)

    # Run log ----------------------------------------------------------------

    def start_run(self) -> str:
        now = _now()
        run_id = f"run_{now:%Y%m%d%H%M%S}_{uuid.uuid4().hex[:8]}"
        self._log(run_id, now, None, "running", "")
        return run_id

    def finish_run(self, run_id: str, status: str, message: dict | str) -> None:
        """Append the outcome; a dict of counts is stored as JSON text."""
        started = self.runs().filter(F.col("run_id") == run_id).first()["started_at"]
        text = message if isinstance(message, str) else json.dumps(message)
        self._log(run_id, started, _now(), status, text)

    def _log(self, *row) -> None:
        entry = self.spark.createDataFrame([row], struct_of(RUN_COLUMNS))
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/sync_runs")

    def runs(self) -> DataFrame:
        """One row per run: its outcome, or its start while it is running."""
        log = self._read_or_none(f"{self.root}/sync_runs")
        if log is None:
            return self.spark.createDataFrame([], struct_of(RUN_COLUMNS))
        return latest_run_rows(log)

    def current_run(self) -> str | None:
        newest = (
            self.runs()
            .filter(F.col("status") == "success")
            .orderBy(F.col("finished_at").desc(), F.col("run_id").desc())
            .first()
        )
        return newest["run_id"] if newest else None

    # Overrides --------------------------------------------------------------

    def put_overrides(self, changes: DataFrame) -> None:
        """Record new values for some order lines; both keys are required."""
        self._append_changes(changes, deleted=False)

    def delete_overrides(self, keys: DataFrame) -> None:
        self._append_changes(keys, deleted=True)

    def _append_changes(self, changes: DataFrame, deleted: bool) -> None:
        blank = F.coalesce(F.col("purchase_order"), F.lit("")) == ""
        blank |= F.coalesce(F.col("purchase_order_item"), F.lit("")) == ""
        if not changes.filter(blank).isEmpty():
            raise ValueError("purchase_order and purchase_order_item are required")
        have = set(changes.columns)
        filled = changes.select(
            *[
                (F.col(c) if c in have else F.lit(None)).cast(kind).alias(c)
                for c, kind in OVERRIDES.items()
                if c != "updated_at"
            ],
            F.current_timestamp().alias("updated_at"),
            F.lit(deleted).alias("deleted"),
        )
        batch = f"batch_{_now():%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"
        filled.write.parquet(f"{self.root}/override_log/{batch}")

    def _complete(self, path: str) -> list[str]:
        """Folders below ``path`` whose write ended; a batch or snapshot that failed half way is none."""
        found = []
        for name in self._folders(path):
            mark, files = self._at(f"{path}/{name}/_SUCCESS")
            if files.exists(mark):
                found.append(name)
        return found

    def _override_sources(self) -> tuple[str | None, list[str], list[str]]:
        """The newest complete snapshot, the batches that it does not hold, and those that it does."""
        snapshots = self._complete("override_snapshots")
        batches = self._complete("override_log")
        if not snapshots:
            return None, batches, []
        held = self.spark.read.parquet(f"{self.root}/override_snapshots/{snapshots[-1]}/batches")
        covered = {r["batch"] for r in held.collect()}
        return snapshots[-1], [b for b in batches if b not in covered], [b for b in batches if b in covered]

    def _newest_changes(self, snapshot: str | None, batches: list[str]) -> DataFrame | None:
        """The newest change of each line in a snapshot and batches, deletes among them."""
        paths = [f"{self.root}/override_snapshots/{snapshot}/rows"] if snapshot else []
        paths += [f"{self.root}/override_log/{b}" for b in batches]
        if not paths:
            return None
        rest = [c for c in OVERRIDES if c not in (*OVERRIDE_KEYS, "updated_at")]
        changes = self.spark.read.schema(struct_of(OVERRIDES).add("deleted", "boolean")).parquet(*paths)
        newest = changes.groupBy(*OVERRIDE_KEYS).agg(F.max(F.struct("updated_at", "deleted", *rest)).alias("last"))
        return newest.select(*OVERRIDE_KEYS, "last.*")

    def overrides(self) -> DataFrame:
        """Present overrides: the newest change of each line, unless it is a delete."""
        newest = self._newest_changes(*self._override_sources()[:2])
        if newest is None:
            return self.spark.createDataFrame([], struct_of(OVERRIDES))
        return newest.filter(~F.col("deleted")).select(*OVERRIDES)

    def compact_overrides(self) -> str | None:
        """Write a snapshot of all changes so far, under a new version; returns its name, or None if there is nothing new.

        Edits made meanwhile are batches that the snapshot does not name.  Deleted lines stay in
        it as such, so an older batch that arrives late cannot bring one back.  The snapshot
        counts once its last file, the success mark, is written.  Batches and snapshots before
        it stay for readers that have begun; ``forget_compacted`` removes them.
        """
        snapshot, batches, covered = self._override_sources()
        if not batches:
            return None
        version = f"v_{_now():%Y%m%d%H%M%S%f}_{uuid.uuid4().hex[:8]}"
        folder = f"{self.root}/override_snapshots/{version}"
        self._newest_changes(snapshot, batches).write.parquet(f"{folder}/rows")
        self.spark.createDataFrame([(b,) for b in [*covered, *batches]], "batch string").coalesce(1).write.parquet(f"{folder}/batches")
        mark, files = self._at(f"override_snapshots/{version}/_SUCCESS")
        files.create(mark, False).close()
        return version

    def forget_compacted(self) -> int:
        """Remove the batches that the newest snapshot holds and the snapshots before it; returns how many folders."""
        newest, _, covered = self._override_sources()
        gone = [f"override_snapshots/{s}" for s in self._complete("override_snapshots") if newest and s < newest]
        gone += [f"override_log/{b}" for b in covered]
        for path in gone:
            where, files = self._at(path)
            files.delete(where, True)
        return len(gone)


def latest_run_rows(log: DataFrame) -> DataFrame:
    """Collapse log entries to one row per run; a finished entry wins over the start."""
    rest = [c for c in RUN_COLUMNS if c != "run_id"]
    newest = log.groupBy("run_id").agg(F.max(F.struct("finished_at", *[c for c in rest if c != "finished_at"])).alias("last"))
    return newest.select("run_id", *[F.col(f"last.{c}").alias(c) for c in rest])


def run_history(runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest runs first."""
    return runs.orderBy(F.col("started_at").desc_nulls_last(), F.col("run_id").desc()).limit(n)


def run_summary(runs: DataFrame, n: int = 10, width: int = SUMMARY_WIDTH) -> DataFrame:
    """Newest runs with the message of successful ones cut to ``width`` characters."""
    short = F.when(F.col("status") == "success", F.substring("message", 1, width)).otherwise(F.col("message"))
    return run_history(runs, n).select("run_id", "started_at", "finished_at", "status", short.alias("summary"))
