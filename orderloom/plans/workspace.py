"""Tables the registered queries read: raw tables, fact and mart of one refresh.

Tables are stored on first use, once per application and input folder, in the folder the
cluster names in ``spark.checkpoint.dir``: a raw table, or some of its columns, alone; some
columns of fact or mart by a refresh of these; an index alone; everything by one refresh, where a caller
asks for it, which all later reads take.  So a query that reads a few columns
does not wait for all of them.  Large inputs are stored slice by slice, and what such a
query reads once is removed after it.  Without a folder, a local session uses a temporary one and any
other session plans every query from the raw inputs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from ..operators.fact import FACT_COLUMNS, RawInputs, build_fact
from ..operators.mart import MART_COLUMNS, OVERRIDE_KEYS, build_mart
from ..sources.store import TableStore
from .fixtures import adapter_frames, land_pages
from .refresh import CONCURRENT_WRITES, INDEXES, RAW_TABLES, refresh, refresh_columns, slices_of, write_sliced
from .session import configure, released_shuffles

_open: dict[tuple[str, str], "Workspace"] = {}
_scratch: list[tempfile.TemporaryDirectory] = []


def _shared_folder(spark: SparkSession) -> str | None:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        return None
    if not _scratch:
        _scratch.append(tempfile.TemporaryDirectory(prefix="orderloom-"))
    return _scratch[0].name


class Workspace:
    """Named tables over one input folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.frames = adapter_frames(spark, sf_dir)
        self.store: TableStore | None = None
        self._landed = False
        folder = _shared_folder(spark)
        inputs = RawInputs(**{slot: self.frames[table] for slot, table in RAW_TABLES.items()})
        # Spreading hot keys numbers rows, which only a stored table keeps in order.
        self.find_hot = folder is not None
        if folder is None:
            self.frames["fact_po_item"] = build_fact(inputs, find_hot=False)
            self.frames["mart_po_item"] = build_mart(self.frames["fact_po_item"], self.frames["po_item_overrides"])
            return
        self.store = TableStore(spark, f"{folder.rstrip('/')}/orderloom/{uuid.uuid4().hex}")
        self.inputs = inputs
        self.run_id: str | None = None
        self._stored: dict[tuple[str, tuple[str, ...]], DataFrame] = {}
        self._parts: dict[tuple[str, tuple[str, ...]], TableStore] = {}
        # The copy is this application's own and goes with it.
        root = spark._jvm.org.apache.hadoop.fs.Path(self.store.root)
        root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)

    def refresh(self) -> None:
        """Store everything, unless it is stored already: raw tables, fact, mart and indexes of one run."""
        if self.store is not None and self.run_id is None:
            extra = {"pr_po_summary": self.frames["pr_po_summary"]}
            self.run_id = refresh(self.store, self.inputs, overrides=self.frames["po_item_overrides"], extra=extra).run_id

    def table(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        """A table, stored on first use; with ``columns`` at least these of it."""
        if self.store is None or name == "fx_item_src":
            return self.frames[name]
        if columns is None and name not in self.frames:
            self.refresh()
        if self.run_id is not None:
            return self.store.read(name, self.run_id)
        for (held, found), df in list(self._stored.items()):
            if held == name and (not found or columns is not None and set(columns) <= set(found)):
                return df
        key = (name, tuple(columns or ()))
        part = self._part()
        if name in self.frames:
            rows = self.frames[name]
            self._stored[key] = self._write(part, rows.select(*columns) if columns else rows, name, len(rows.columns))
        else:
            run_id = refresh_columns(part, self.inputs, name, columns, overrides=self.frames["po_item_overrides"]).run_id
            self._stored[key] = part.read(name, run_id)
        self._parts[key] = part
        return self._stored[key]

    def _part(self) -> TableStore:
        """A new store for one table, below that of the workspace."""
        return TableStore(self.frames[RAW_TABLES["header"]].sparkSession, f"{self.store.root}/parts/{uuid.uuid4().hex}")

    def _write(self, part: TableStore, rows: DataFrame, name: str, width: int) -> DataFrame:
        """A raw table of ``width`` columns, or some of them, stored in slices if its files are large."""
        return write_sliced(part, rows, "first", name, slices_of(rows, len(rows.columns) / width))

    @property
    def slices(self) -> int:
        """In how many slices whole lines are stored."""
        return 1 if self.store is None else slices_of(self.inputs.items)

    def once(self, name: str) -> DataFrame:
        """A raw table for a read of few columns: as it is stored, else planned from the input."""
        if self.store is not None and (self.run_id is not None or (name, ()) in self._stored):
            return self.table(name)
        return self.frames[name]

    def _lines_are_those_of_the_mart(self) -> bool:
        """No line has two overrides, so the mart has one row for each of the fact."""
        keyed = self.frames["po_item_overrides"].groupBy(*OVERRIDE_KEYS).count()
        return keyed.filter("count > 1").dropna(subset=OVERRIDE_KEYS).isEmpty()

    def in_turn(self, names: Sequence[str]) -> Iterator[tuple[str, DataFrame]]:
        """Whole tables one after the other; large ones that are stored for it are removed after their turn.

        Where the mart has the lines of the fact, one stored table serves both.
        """
        if self.store is None:
            yield from ((name, self.frames[name]) for name in names)
            return
        held, large = set(self._stored), self.run_id is None and self.slices > 1
        shared = self.run_id is None and "mart_po_item" in names and self._lines_are_those_of_the_mart()
        whole = {"fact_po_item": FACT_COLUMNS, "mart_po_item": MART_COLUMNS}
        for name in names:
            if name == "fact_po_item" and shared:
                yield name, self.table("mart_po_item", MART_COLUMNS).select(*FACT_COLUMNS)
                continue
            yield name, self.table(name, whole.get(name))
            for key in [k for k in self._stored if large and k not in held]:
                del self._stored[key]
                self._parts.pop(key).drop()

    def settled(self, rows: DataFrame) -> DataFrame:
        """A small result, computed now and stored."""
        if self.store is None:
            return rows
        with released_shuffles(rows.sparkSession):
            return self._part().write(rows.select("*"), "first", "result")

    def lines(self, name: str) -> DataFrame | None:
        """Fact or mart built from large inputs, slice by slice; None where they are not large."""
        if self.slices == 1:
            return None
        return self.table(name, FACT_COLUMNS if name == "fact_po_item" else MART_COLUMNS)

    def tables(self, names: Sequence[str]) -> dict[str, DataFrame]:
        """Whole tables by name, those not stored yet written side by side."""
        if any(n not in self.frames for n in names):
            self.refresh()
        with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
            return dict(zip(names, pool.map(self.table, names)))

    def index(self, table: str) -> DataFrame:
        """The covering index of a raw table, or the table where none is stored."""
        if self.store is None:
            return self.frames[table]
        index = next(i for i in INDEXES if i.table == table)
        if self.run_id is not None:
            return self.store.read(index.name, self.run_id)
        key = (index.name, ())
        if key not in self._stored:
            self._parts[key] = part = self._part()
            # Placing reads the rows three times: they are computed once, before.
            rows = self._write(part, index.rows(self.frames[table]), table, len(self.frames[table].columns))
            with released_shuffles(part.spark):
                self._stored[key] = part.write(rows, "first", index.name, index.layout)
            part.drop(f"runs/first/{table}")
        return self._stored[key]

    def landed_header(self) -> str:
        """Folder of the header as landed page files, written on first use."""
        if self.store is None:
            raise RuntimeError("landing pages needs a shared folder: set spark.checkpoint.dir")
        path = f"{self.store.root}/landing/raw_po_header"
        if not self._landed:
            land_pages(self.table("raw_po_header"), path)
            self._landed = True
        return path

    def output(self, name: str) -> str:
        """Folder for files that a query writes and reads back."""
        if self.store is None:
            raise RuntimeError("writing files needs a shared folder: set spark.checkpoint.dir")
        return f"{self.store.root}/output/{name}"

    def raw_inputs(self) -> RawInputs:
        held = self.tables(list(RAW_TABLES.values()))
        return RawInputs(**{slot: held[table] for slot, table in RAW_TABLES.items()})

    def fact(self) -> DataFrame:
        """The fact built from the raw tables, not read back."""
        return build_fact(self.raw_inputs(), find_hot=self.find_hot)


def workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """The workspace of a folder, opened on first use in this application."""
    configure(spark)
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _open:
        _open[key] = Workspace(spark, sf_dir.rstrip("/"))
    return _open[key]
