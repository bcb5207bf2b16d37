"""Refresh job: raw snapshot, fact table and mart of one run, published together."""

from __future__ import annotations

import math
import time
from collections import Counter
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fact import FACT_COLUMNS, RawInputs, build_fact, narrowed
from ..operators.mart import build_mart, fact_columns_of
from ..sources.layout import Index, Layout
from ..sources.store import TableStore
from .session import released_shuffles

# Bytes of input files behind the rows that are shuffled at a time; more are taken slice by slice.
SLICE_BYTES = 512 << 20

# Raw tables are independent jobs; submitted together they keep the cluster busy.
CONCURRENT_WRITES = 8

RAW_TABLES = {
    "header": "raw_po_header",
    "items": "raw_po_item",
    "receipts": "raw_gr",
    "notices": "raw_asn",
    "requisitions": "raw_pr",
    "suppliers": "raw_supplier",
    "materials": "raw_material",
}

# Inputs whose rows belong to an order.
BY_ORDER = ("header", "items", "receipts", "notices", "requisitions")

# One order, one month or one reference then read a few pages; a large order is spread over its lines.
MART_LAYOUT = Layout(
    ["creation_date", "purchase_order"], ties=["purchase_order_item"], bloom=["purchase_order", "customer_po", "customer_pr"]
)
# Raw rows by the reference that a prefix lookup asks for.
INDEXES = (
    Index("raw_po_header", "CorrespncExternalReference", ["PurchaseOrder", "CorrespncExternalReference", "Supplier"]),
    Index("raw_po_item", "PurchaseRequisition", ["PurchaseOrder", "PurchaseOrderItem", "PurchaseRequisition", "Material"]),
)


@dataclass
class RefreshResult:
    run_id: str
    counts: dict[str, int] = field(default_factory=dict)
    stale: list[str] = field(default_factory=list)
    seconds: float = 0.0


def refresh(
    store: TableStore,
    inputs: RawInputs,
    overrides: DataFrame | None = None,
    extra: dict[str, DataFrame] | None = None,
    strict_keys: bool = False,
) -> RefreshResult:
    """Write raw tables, fact and mart under a new run and publish it last.

    An input that is not given is taken from the last successful run and recorded
    as stale.  ``extra`` tables are stored beside the raw ones.  ``overrides``
    defaults to the store's own.  Any error leaves the previous run in place.  While
    another refresh of the store runs, RefreshBusy is raised and nothing is written.
    """
    with store.single_flight():
        return _refresh(store, inputs, overrides, extra, strict_keys)


def _refresh(store: TableStore, inputs: RawInputs, overrides: DataFrame | None, extra: dict[str, DataFrame] | None, strict_keys: bool) -> RefreshResult:
    started = time.monotonic()
    previous = store.current_run()
    result = RefreshResult(store.start_run())
    try:
        sources = dict(extra or {})
        for slot, table in RAW_TABLES.items():
            df = getattr(inputs, slot)
            if df is None and previous and store.has(table, previous):
                df = store.read(table, previous)
                result.stale.append(table)
            if df is not None:
                sources[table] = df
        sources["po_item_overrides"] = store.overrides() if overrides is None else overrides
        stored, result.counts = _write_all(store, sources, result.run_id)
        raw = replace(RawInputs(), **{slot: stored[t] for slot, t in RAW_TABLES.items() if t in stored})
        fact = store.write(build_fact(raw, strict_keys), result.run_id, "fact_po_item")
        mart = store.write(build_mart(fact, stored["po_item_overrides"]), result.run_id, "mart_po_item", MART_LAYOUT)
        _write_indexes(store, stored, result.run_id)
        result.counts |= {"fact_po_item": fact.count(), "mart_po_item": mart.count()}
        store.finish_run(result.run_id, "success", {**result.counts, "stale": result.stale})
    except Exception as error:
        store.finish_run(result.run_id, "failed", str(error))
        raise
    result.seconds = time.monotonic() - started
    return result


def slices_of(df: DataFrame, share: float = 1.0) -> int:
    """In how many slices a table made of large files is stored; ``share``: the part of its columns that is."""
    total = 0
    for name in df.inputFiles():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return max(1, math.ceil(total * share / SLICE_BYTES))


def sliced(df: DataFrame | None, k: int, slices: int) -> DataFrame | None:
    """The rows whose order falls into slice ``k``.  Lines of an order share a slice, those without one do too."""
    if df is None or slices == 1:
        return df
    order = df["PurchaseOrder" if "PurchaseOrder" in df.columns else "purchase_order"].cast("string")
    return df.filter(F.pmod(F.xxhash64(order), F.lit(slices)) == k)


def write_sliced(store: TableStore, df: DataFrame, run_id: str, table: str, slices: int) -> DataFrame:
    """Store a table slice by slice, so that its plan shuffles a part of the rows at a time.

    A plan without a shuffle, or a table without orders, is written at once.
    """
    if "Exchange" not in df._jdf.queryExecution().executedPlan().toString() or not {"PurchaseOrder", "purchase_order"} & set(df.columns):
        slices = 1
    with released_shuffles(df.sparkSession):
        for k in range(slices):
            stored = store.write(sliced(df, k, slices), run_id, table, append=k > 0)
    return stored


def refresh_columns(
    store: TableStore, inputs: RawInputs, table: str, columns: Sequence[str], overrides: DataFrame | None = None, slices: int | None = None
) -> RefreshResult:
    """Write ``columns`` of the fact or mart (``table``) under a new run of a store of their own and publish it.

    Header and items are stored with the columns that these need, since the spreading of hot
    keys numbers stored rows; the other inputs are read as they are, and only where needed.  The
    rows are those of ``refresh``.  They are not placed: what reads few columns once reads them whole.

    Large inputs are taken in ``slices`` of the orders, one after the other (every join but those with
    suppliers and materials is on the order).  So disk holds the shuffles and the header and items of one
    slice, and the lines made so far.
    """
    with store.single_flight(), released_shuffles(store.spark):
        started = time.monotonic()
        result = RefreshResult(store.start_run())
        try:
            fact_columns = columns if table == "fact_po_item" else fact_columns_of(columns)
            slices = slices or slices_of(inputs.items, len(fact_columns) / len(FACT_COLUMNS))
            inputs = narrowed(inputs, fact_columns)
            counts: Counter[str] = Counter()
            for k in range(slices):
                part = replace(inputs, **{slot: sliced(getattr(inputs, slot), k, slices) for slot in BY_ORDER})
                folder = result.run_id if slices == 1 else f"{result.run_id}/slice_{k}"
                stored, found = _write_all(store, {RAW_TABLES[slot]: getattr(part, slot) for slot in ("header", "items")}, folder)
                counts.update(found)
                part = replace(part, **{slot: stored[RAW_TABLES[slot]] for slot in ("header", "items")})
                rows = build_fact(part, columns=fact_columns)
                if table == "mart_po_item":
                    rows = build_mart(rows, sliced(overrides, k, slices), columns)
                lines = store.write(rows, result.run_id, table, append=k > 0)
                if slices > 1:
                    store.drop(f"runs/{folder}")
            result.counts = {**counts, table: lines.count()}
            store.finish_run(result.run_id, "success", result.counts)
        except Exception as error:
            store.finish_run(result.run_id, "failed", str(error))
            raise
        result.seconds = time.monotonic() - started
    return result


def _write_indexes(store: TableStore, stored: dict[str, DataFrame], run_id: str) -> None:
    """Write the covering indexes of the tables that have their columns, side by side."""

    def write(index: Index) -> None:
        store.write(index.rows(stored[index.table]), run_id, index.name, index.layout)

    kept = [i for i in INDEXES if i.table in stored and set(i.columns) <= set(stored[i.table].columns)]
    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        list(pool.map(write, kept))


def _write_all(store: TableStore, sources: dict[str, DataFrame], run_id: str) -> tuple[dict[str, DataFrame], dict[str, int]]:
    """Write and count independent tables side by side; counts come from the written files' footers."""

    def write(table: str) -> tuple[str, DataFrame, int]:
        df = store.write(sources[table], run_id, table)
        return table, df, df.count()

    with ThreadPoolExecutor(CONCURRENT_WRITES) as pool:
        written = list(pool.map(write, sources))
    return {table: df for table, df, _ in written}, {table: n for table, _, n in written}
