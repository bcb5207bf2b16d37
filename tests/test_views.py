"""Boundaries of views, lists, searches, audits, profiles and rules on hand-made rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderloom.functions import find_column, round_half_up
from orderloom.functions.exprs import exact_sum
from orderloom.operators import audit, lists, profile, rules, search, views
from orderloom.operators.mart import MART_COLUMNS

D = dt.date
KINDS = {
    "creation_date": "date",
    "pr_requested_delivery_date": "date",
    "earliest_asn_delivery_date": "date",
    "last_gr_date": "date",
    "order_qty": "double",
    "net_price": "double",
    "net_amount": "double",
    "spend": "double",
    "asn_qty": "double",
    "gr_qty": "double",
    "planned_delivery_days": "int",
    "days_po_to_asn": "bigint",
    "override_updated_at": "timestamp",
    "is_completely_delivered": "boolean",
    "is_finally_invoiced": "boolean",
    "gr_is_expected": "boolean",
    "invoice_is_expected": "boolean",
}


@pytest.fixture(scope="module")
def make_mart(spark):
    ddl = ", ".join(f"{c} {KINDS.get(c, 'string')}" for c in MART_COLUMNS)

    def make(*rows):
        filled = []
        for i, row in enumerate(rows):
            base = {"purchase_order": "1", "purchase_order_item": str(i), "dashboard_status": "PO Created", "spend": 1.0}
            base |= {"creation_date": D(2001, 1, 1), "supplier": "S", "gr_qty": 0.0, "asn_qty": 0.0, **row}
            filled.append(tuple(base.get(c) for c in MART_COLUMNS))
        return spark.createDataFrame(filled, ddl)

    return make


def test_rounding_and_exact_sum(spark):
    df = spark.createDataFrame([(1.005,), (2.5,), (-2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(round_half_up(F.col("x"), 2)).collect()] == [1.0, 2.5, -2.5, None]
    assert [r[0] for r in df.select(round_half_up(F.col("x"))).collect()] == [1.0, 3.0, -3.0, None]
    tricky = spark.createDataFrame([(0.1,), (0.2,), (-0.3,), (1e9 + 0.123456,), (float("nan"),), (None,)], "x double")
    assert tricky.agg(exact_sum(F.col("x"))).first()[0] == 1000000000.123456
    for alone in (1 / 3, -1 / 3, 3e-7, 1e-9, 2.0**52 + 0.5, 1e300, float("inf"), 12345.678901234567):
        one = spark.createDataFrame([(alone,), (None,)], "x double")
        assert one.agg(exact_sum(F.col("x"))).first()[0] == alone
    many = spark.createDataFrame([(1e16,), (1.0,), (1e19,), (-1e16,)], "x double")
    assert many.agg(exact_sum(F.col("x"))).first()[0] == pytest.approx(1e19)
    assert tricky.filter("x is null").agg(exact_sum(F.col("x"))).first()[0] is None
    assert find_column(df, ["y", "X"], ignore_case=True) == "x" and find_column(df, ["X"]) is None


def test_kpis(make_mart):
    row = views.dashboard_kpis(
        make_mart(
            {"dashboard_status": "Fully Delivered", "customer_po": ""},
            {"dashboard_status": "Cancelled"},
            {"po_deletion_code": "", "plant": "P1"},
            {"po_deletion_code": "L", "dashboard_status": "Fully Delivered"},
        )
    ).first()
    assert (row["total_lines"], row["cancelled_lines"], row["fulfillment_rate_pct"]) == (3, 1, 50.0)
    assert (row["pos_with_customer_po"], row["customer_po_fill_pct"], row["active_plants"]) == (1, 33.3, 1)
    empty = views.dashboard_kpis(make_mart({}).filter("1 = 0")).first()
    assert empty["total_lines"] == 0 and empty["fulfillment_rate_pct"] is None


def test_shares_add_up(make_mart):
    mart = make_mart(*[{"supplier": s, "spend": v} for s, v in (("A", 10.0), ("B", 20.0), ("C", 70.0), ("C", None))])
    shares = {r["supplier"]: r["spend_share_pct"] for r in views.spend_by_supplier(mart).collect()}
    assert shares == {"A": 10.0, "B": 20.0, "C": 70.0}
    free = make_mart({"spend": 0.0})
    assert views.spend_by_supplier(free).first()["spend_share_pct"] is None


@pytest.mark.parametrize(
    "days,open_lines,tier",
    [
        (120.1, 0, "High Risk"),
        (120.0, 0, "Medium Risk"),
        (45.0, 0, "Medium Risk"),
        (44.9, 0, "Low Risk"),
        (44.9, 31, "Medium Risk"),
        (60.1, 101, "High Risk"),
        (60.0, 101, "Medium Risk"),
        (None, 30, "Low Risk"),
        (None, 101, "Medium Risk"),
    ],
)
def test_risk_tiers(spark, days, open_lines, tier):
    by_supplier = spark.createDataFrame(
        [("S", "n", "o", 1.0, 5, 1, open_lines, days), ("T", "n", "o", 1.0, 4, 1, 0, 1.0)],
        "supplier string, supplier_name string, purchasing_org string, total_spend double, lines bigint,"
        " delivered_lines bigint, open_lines bigint, avg_days_to_asn double",
    )
    (row,) = views.supplier_risk_tiers(by_supplier).collect()
    assert row["risk_tier"] == tier
    assert row["risk_score"] == round(open_lines * (days or 0))


def test_delivery_needs_five_lines(make_mart):
    mart = make_mart(*[{"plant": "P5", "days_po_to_asn": 4, "planned_delivery_days": 2}] * 5, *[{"plant": "P4"}] * 4)
    (row,) = views.delivery_performance(mart).collect()
    assert (row["plant"], row["avg_delay_days"]) == ("P5", 2.0)


def test_overdue(make_mart):
    mart = make_mart(
        {"planned_delivery_days": 0},
        {"planned_delivery_days": None},
        {"planned_delivery_days": 31},
        {"item_deletion_code": "L"},
        {"dashboard_status": "Cancelled"},
        {"creation_date": None},
    )
    late = views.overdue_lines(mart, D(2001, 2, 1))
    assert [r["purchase_order_item"] for r in late.orderBy("purchase_order_item").collect()] == ["0", "1"]
    rows = lists.lead_time_gap(lists.overdue_by_days(late)).orderBy("purchase_order_item").collect()
    assert [r["overdue_by"] for r in rows] == [31, 1]
    assert [r["lead_time_gap"] for r in rows] == [None, None]
    assert views.overdue_lines(mart).count() == 3


def test_blank_status_is_unknown_and_stages_add_up(make_mart):
    mart = make_mart({"dashboard_status": ""}, {"dashboard_status": None}, {}, {})
    stages = {r["stage"]: (r["lines"], r["share_pct"]) for r in lists.stage_shares(mart).collect()}
    assert stages == {"Unknown": (2, 50.0), "PO Created": (2, 50.0)}


def test_limits_are_checked(make_mart):
    mart = make_mart({})
    for call in (
        lambda: lists.list_suppliers(mart, 201),
        lambda: lists.trend(mart, 0),
        lambda: search.search(mart, "x", 1001),
        lambda: search.dataset(mart, limit=5001),
        lambda: search.customer_reference_samples(mart, 21),
    ):
        with pytest.raises(ValueError):
            call()


def test_search_routes_and_wildcards(make_mart):
    mart = make_mart(
        {"purchase_order": "a", "customer_po": "4500000001"},
        {"purchase_order": "b", "customer_pr": "5000000001", "purchase_requisition": "5000000001"},
        {"purchase_order": "c", "material_name": "50% off\\deal_x", "supplier_name": "4500000001"},
    )

    def hits(q):
        return {r["purchase_order"] for r in search.search(mart, q).collect()}

    assert hits("4500") == {"a"} and hits(" 5000 ") == {"b"}
    assert hits("OFF\\deal") == {"c"} and hits("o_f") == {"c"} and hits("of%x") == {"c"}
    assert hits("   ") == set()


def test_dataset_filters(make_mart):
    mart = make_mart(
        {"purchase_order": "1", "creation_date": D(2001, 1, 1), "plant": "x"},
        {"purchase_order": "2", "creation_date": D(2001, 1, 2), "supplier_name": "x"},
        {"purchase_order": "3", "creation_date": D(2001, 1, 3), "customer_po": "45x"},
    )

    def orders(**filters):
        return [r["purchase_order"] for r in search.dataset(mart, **filters).collect()]

    assert orders() == ["3", "2", "1"]
    assert orders(date_from="2001-01-02", date_to=D(2001, 1, 2)) == ["2"]
    assert orders(search="X") == ["3", "2"] and orders(supplier="x", search="x") == ["2"]
    assert orders(po="45", customer_po="45X") == ["3"] and orders(plant="x") == ["1"]
    assert orders(customer_pr="5") == [] and orders(material="m") == []
    assert len(search.dataset(mart).columns) == 44
    assert search.order_detail(mart, "2").first()["supplier_name"] == "x"


def test_list_filter_is_literal(spark):
    df = spark.createDataFrame([("a%b", "Low Risk"), ("axb", "High Risk"), (None, "Low Risk")], "s string, risk_tier string")
    assert search.list_filter(df, ["s"], "A%").count() == 1
    assert search.list_filter(df, ["s"], "", "Low Risk").count() == 2


def test_reference_coverage(make_mart):
    mart = make_mart({"customer_po": "b"}, {"customer_po": "a"}, {"customer_po": " "}, {"customer_po": "a", "purchase_order": "2"})
    stats = {r["field"]: r for r in search.customer_reference_stats(mart).collect()}
    po = stats["customer_po"]
    assert (po["non_null"], po["distinct_vals"], po["fill_pct"], po["pos_with_ref"]) == (4, 3, 100.0, 2)
    assert stats["customer_pr"]["non_null"] == 0
    assert [r["sample"] for r in search.customer_reference_samples(mart, 2).collect()] == ["a", "b"]


def test_dashboard_series(make_mart):
    charts = lists.dashboard(make_mart({}, {"supplier": None}))
    assert set(charts) == {"kpis", "status_distribution", "spend_timeline", "top_suppliers", "spend_by_material_group", "supplier_risk"}
    assert all(r["avg_days_to_asn"] == 0 for r in charts["top_suppliers"].collect())


# Audit ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def audited(spark):
    line = "PurchaseOrder string, PurchaseOrderItem string"
    return {
        "raw_po_header": spark.createDataFrame([("1", None), ("1", D(2001, 1, 1))], "PurchaseOrder string, CreationDate date"),
        "raw_po_item": spark.createDataFrame([("1", "10"), ("1", "10"), ("2", "10"), ("3", "10")], line),
        "raw_gr": spark.createDataFrame([("1", "10")], line),
        "raw_asn": spark.createDataFrame([("1", "20"), ("2", "10")], line),
        "raw_pr": spark.createDataFrame([("1",), ("1",), ("2",), (None,)], "PurchaseOrder string"),
        "raw_supplier": spark.createDataFrame([("S1",), (None,)], "Supplier string"),
        "pr_po_summary": spark.createDataFrame(
            [
                ("1", "10", "Fulfilled", "S1", "2", 2.0, 4.0),
                ("1", "20", "Fulfilled", "S2", "2", 2.0, 4.02),
                ("2", "10", "Shipped", "S2", "n/a", 2.0, 4.0),
                ("3", "10", None, None, "2", None, 4.0),
            ],
            f"{line}, CurrentStatus string, SupplierID string, OrderQuantity string, NetPriceAmount double,"
            " TotalEstimatedSpend double",
        ),
    }


def test_audit(audited):
    a = audited
    dup = {r["key"]: (r["duplicates"], r["unique_keys"]) for r in audit.duplicates(a["raw_po_header"], a["raw_po_item"], a["pr_po_summary"]).collect()}
    assert dup == {"po_header": (1, 1), "po_item": (1, 3), "pr_po_summary": (0, 4)}
    rates = {r["input"]: r["null_rate"] for r in audit.null_rate({n: a[n] for n in ("raw_po_header", "raw_po_item")}).collect()}
    assert rates == {"raw_po_header": 0.5, "raw_po_item": None}
    assert audit.join_explosion(a["raw_po_item"], a["raw_pr"]).first()[0] == 2 * 2 + 1
    assert audit.worst_multipliers(a["raw_po_item"], a["raw_pr"]).first()["multiplier"] == 4
    evidence = (a["pr_po_summary"], a["raw_gr"], a["raw_asn"])
    expected = {(r[0], r[1]): (r[3], r[4]) for r in audit.expected_status(*evidence).collect()}
    assert expected == {
        ("1", "10"): ("Fulfilled", "Fulfilled"),
        ("1", "20"): ("Fulfilled", "Shipped"),
        ("2", "10"): ("Shipped", "Shipped"),
        ("3", "10"): ("PO Created", "PO Created"),
    }
    assert tuple(audit.status_mismatch(*evidence).first()) == (1, 2, 1)
    assert [tuple(r) for r in audit.status_sample(*evidence).collect()] == [("1", "20", "Fulfilled", "Shipped")]
    doubled = (a["pr_po_summary"].union(a["pr_po_summary"]), *evidence[1:])
    assert audit.status_sample(*doubled).count() == 2 and audit.status_sample(*doubled, n=1).count() == 1
    assert [tuple(r) for r in audit.missing_suppliers(a["pr_po_summary"], a["raw_supplier"]).collect()] == [("S2", 2)]
    assert tuple(audit.spend_check(a["pr_po_summary"]).first()) == (0.75, 1, 2)


def test_audit_report_notes_missing_columns(audited):
    report = audit.audit_report(audited)
    assert report.filter("section = 'status_validation'").count() == 3
    bare = {**audited, "pr_po_summary": audited["pr_po_summary"].drop("CurrentStatus", "SupplierID")}
    assert audit.audit_report(bare).filter("section = 'notes'").count() == 2


# Profile and rules ------------------------------------------------------------


def test_profiles(spark):
    df = spark.createDataFrame([("a", None), ("b", 1), (" ", 2)], "PurchaseRequisition string, n int")
    assert {r[0]: r[1] for r in profile.null_profile(df).collect()} == {"PurchaseRequisition": 0.0, "n": 33.3}
    notes = {r["column_name"]: (r["data_type"], r["note"]) for r in profile.schema_profile(df).collect()}
    assert notes == {"PurchaseRequisition": ("string", "tracked"), "n": ("int", "")}
    assert profile.sample_rows(df, 2).count() == 2
    probe = profile.field_probe({"t": df, "u": df.select("n")}, ["purchaserequisition"]).collect()
    assert [(r["table_name"], r["samples"], r["non_null"], r["pos_with_ref"]) for r in probe] == [("t", "a | b", 3, None)]
    with pytest.raises(LookupError):
        profile.field_probe({"u": df.select("n")}, ["x"])


def test_worst_line_status(make_mart):
    def status(*states):
        return rules.worst_line_status(make_mart(*[{"dashboard_status": s} for s in states])).first()["document_status"]

    assert status("Cancelled", "Cancelled") == "Cancelled"
    assert status("Cancelled", "Fully Delivered") == "Fully Delivered"
    assert status("Shipped (Full)", "Partially Delivered") == "Shipped (Full)"
    assert status("Fully Delivered", "held") == "Unknown"


def test_business_days_against_a_calendar(spark):
    holidays = [D(2001, 3, 5), D(2001, 3, 9), D(1999, 12, 31)]
    pairs = [(D(1999, 12, 20) + dt.timedelta(days=3 * i), D(2001, 3, 1) + dt.timedelta(days=i)) for i in range(40)]
    pairs += [(D(2001, 3, 2), D(2001, 3, 2)), (D(1890, 1, 1), D(1890, 2, 1))]
    df = spark.createDataFrame(pairs, "a date, b date")
    for weekend in ((5, 6), (6, 7), ()):
        got = df.select(rules.business_days(F.col("a"), F.col("b"), weekend, holidays)).collect()
        for (start, end), (days,) in zip(pairs, got):
            span = [start + dt.timedelta(days=k) for k in range(1, (end - start).days + 1)]
            assert days == sum(d.isoweekday() not in weekend and d not in holidays for d in span)


def test_restricted_projection(make_mart):
    seen = rules.restricted_projection(make_mart({}), "technical_evaluator").columns
    assert len(seen) == 54 and not {"net_price", "net_amount", "spend"} & set(seen)
    with pytest.raises(ValueError):
        rules.restricted_projection(make_mart({}), "guest")
