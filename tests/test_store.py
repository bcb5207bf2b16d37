"""One refresh at a time, and an override log whose reads do not grow with the edits ever made."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier

import pytest
from pyspark.sql import functions as F

from orderloom.operators.fact import RawInputs
from orderloom.plans import refresh as job
from orderloom.sources.store import RefreshBusy, TableStore

EDIT = "purchase_order string, purchase_order_item string, status_override string"


@pytest.fixture()
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "w"))


@pytest.fixture()
def inputs(spark):
    return RawInputs(
        header=spark.createDataFrame([("1", "S")], "PurchaseOrder string, Supplier string"),
        items=spark.createDataFrame([("1", "10", 2.0)], "PurchaseOrder string, PurchaseOrderItem string, OrderQuantity double"),
    )


def test_of_two_refreshes_at_once_one_is_refused(store, inputs, monkeypatch):
    both, build = Barrier(2, timeout=120), job.build_fact

    def slow(*args, **named):
        both.wait()
        return build(*args, **named)

    monkeypatch.setattr(job, "build_fact", slow)
    with ThreadPoolExecutor(2) as pool:
        running = pool.submit(job.refresh, store, inputs)
        while not Path(store.root, "refresh.running").exists():
            assert not running.done()
        with pytest.raises(RefreshBusy):
            job.refresh(TableStore(store.spark, store.root), inputs)
        assert store.current_run() is None
        both.wait()
        result = running.result()
    assert store.current_run() == result.run_id and store.runs().count() == 1
    monkeypatch.setattr(job, "build_fact", build)
    assert job.refresh(store, inputs).run_id == store.current_run()


def test_many_callers_get_one_marker(store):
    def hold(_):
        try:
            with TableStore(store.spark, store.root).single_flight():
                start.wait()
                return 1
        except RefreshBusy:
            start.wait()
            return 0

    start = Barrier(8, timeout=120)
    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(hold, range(8))) == 1


def test_a_failed_refresh_lets_go_and_a_left_marker_expires(store, inputs):
    with pytest.raises(ValueError):
        job.refresh(store, RawInputs(items=inputs.items))
    marker = Path(store.root, "refresh.running")
    assert not marker.exists()
    marker.touch()
    with pytest.raises(RefreshBusy, match="running for"), store.single_flight():
        pass
    os.utime(marker, (1_000_000, 1_000_000))
    with store.single_flight():
        assert marker.exists()
    assert not marker.exists() and not list(marker.parent.glob("refresh.left*"))


# Override log -----------------------------------------------------------------


def put(store, *rows):
    store.put_overrides(store.spark.createDataFrame(rows, EDIT))


def present(store):
    return {(r[0], r[1]): r["status_override"] for r in store.overrides().collect()}


def test_reads_do_not_grow_with_edits(store):
    for k in range(12):
        put(store, ("1", "10", f"s{k}"), (str(k), "20", "x"))
        if k % 4 == 3:
            assert store.compact_overrides()
    want = present(store)
    assert want == {("1", "10"): "s11"} | {(str(k), "20"): "x" for k in range(12)}
    assert store.forget_compacted() == 2 + 12
    assert present(store) == want
    assert len(store._folders("override_log")) == 0 and len(store._folders("override_snapshots")) == 1
    files = {f.rsplit("/", 2)[1] for f in store.overrides().inputFiles()}
    assert files == {"rows"}
    assert store.compact_overrides() is None


def test_deletes_stay_deleted_and_later_edits_count(spark, store):
    put(store, ("1", "10", "a"), ("2", "10", "b"))
    late = store.spark.read.parquet(f"{store.root}/override_log/{store._folders('override_log')[0]}").withColumn("status_override", F.lit("old"))
    late = spark.createDataFrame(late.collect(), late.schema)
    store.delete_overrides(store.spark.createDataFrame([("1", "10")], ["purchase_order", "purchase_order_item"]))
    store.compact_overrides()
    store.forget_compacted()
    assert present(store) == {("2", "10"): "b"}
    # A batch of older edits that arrives after the snapshot brings nothing back.
    late.write.parquet(f"{store.root}/override_log/batch_0_late")
    assert ("1", "10") not in present(store)
    put(store, ("1", "10", "again"))
    assert present(store)[("1", "10")] == "again"
    store.compact_overrides()
    assert present(store)[("1", "10")] == "again" and ("2", "10") in present(store)


def test_a_failed_compaction_changes_nothing(store, monkeypatch):
    put(store, ("1", "10", "a"))
    want = present(store)
    monkeypatch.setattr(store.spark, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.compact_overrides()
    monkeypatch.undo()
    assert len(store._folders("override_snapshots")) == 1
    assert present(store) == want
    put(store, ("1", "10", "b"))
    assert present(store) == {("1", "10"): "b"}
    assert store.compact_overrides() and present(store) == {("1", "10"): "b"}


def test_an_edit_during_compaction_is_kept(store, monkeypatch):
    put(store, ("1", "10", "a"))
    newest = store._newest_changes

    def meanwhile(*args):
        put(store, ("2", "10", "during"))
        return newest(*args)

    monkeypatch.setattr(store, "_newest_changes", meanwhile)
    store.compact_overrides()
    monkeypatch.undo()
    store.forget_compacted()
    assert present(store) == {("1", "10"): "a", ("2", "10"): "during"}


def test_half_written_batches_are_not_read(store):
    put(store, ("1", "10", "a"))
    put(store, ("1", "10", "b"))
    batches = store._folders("override_log")
    Path(store.root, "override_log", batches[-1], "_SUCCESS").unlink()
    assert present(store) == {("1", "10"): "a"}
