"""DuckDB statements that state what each registered query returns.

Each statement is one WITH query over the test tables: the adapter, then the
shared definitions below, then the body of the key.
"""

from __future__ import annotations

from ..operators.fact import FACT_COLUMNS, HEADER_COLUMNS, ITEM_COLUMNS
from ..operators.mart import MART_COLUMNS
from ..operators.profile import FILL_COLUMNS, TRACKED
from ..operators.rules import HIDDEN, SEVERITY
from ..operators.search import DATASET_RESULT, REFERENCE_FIELDS, SEARCH_RESULT, SEARCHED
from ..operators.views import OVERDUE_COLUMNS, REFERENCE_COLUMNS
from ..sources.normalize import LAST_MILLISECOND
from ..sources.schemas import ENTITIES
from . import registry as reg
from .fixtures import adapter_ctes


#: One run per order date, as the run log of the registered queries has them.
_RUNS = """WITH days AS (SELECT CreationDate AS d, count(*) AS orders FROM raw_po_header WHERE CreationDate IS NOT NULL GROUP BY 1),
            runs AS (
                SELECT 'run_' || strftime(d, '%Y%m%d') AS run_id, CAST(d AS TIMESTAMP) AS started_at,
                       CASE WHEN day(d) % 7 <> 0 THEN CAST(d AS TIMESTAMP) + INTERVAL 10 MINUTE END AS finished_at,
                       CASE WHEN day(d) % 7 = 0 THEN 'running' WHEN day(d) % 5 = 0 THEN 'failed' ELSE 'success' END AS status,
                       CASE WHEN day(d) % 7 = 0 THEN '' WHEN day(d) % 5 = 0 THEN 'no answer ' || repeat('x', 150)
                            ELSE '{"raw_po_header": ' || orders || ', "tables": "' || repeat('ab', 80) || '"}' END AS message
                FROM days)
"""


def _cols(names) -> str:
    return ", ".join(names)


def _exact(column: str) -> str:
    """Sum in whole units and three limbs of 30 bits after the point, as HUGEINT: exact, whatever the row order."""
    rest, limbs = f"CAST({column} AS DOUBLE)", []
    for _ in range(3):
        limbs.append(f"SUM(CAST(trunc({rest}) AS BIGINT))::DOUBLE")
        rest = f"(({rest} - trunc({rest})) * 1073741824::DOUBLE)"
    total = f"SUM(CAST(round_even({rest}, 0) AS BIGINT))::DOUBLE"
    for limb in reversed(limbs):
        total = f"({total} / 1073741824::DOUBLE + {limb})"
    return total


def _money(column: str) -> str:
    return _exact(f"COALESCE({column}, 0)")


def _n(status: str) -> str:
    return f"count_if(dashboard_status = '{status}')::BIGINT"


def _share(part: str, whole: str, digits: int = 1) -> str:
    return f"ROUND(1e2 * ({part}) / NULLIF(CAST({whole} AS DOUBLE), 0), {digits})"


def _distinct(column: str) -> str:
    return f"COUNT(DISTINCT {column})"


def _blank(column: str) -> str:
    return f"(LENGTH(TRIM(COALESCE({column}, ''))) = 0)"


def _like(columns, text: str) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{text}%'" for c in columns) + ")"


def _ranked(columns, order, n: int) -> str:
    """ORDER BY with all other columns as tie-breakers, then LIMIT."""
    keys = [f"{o[1:]} DESC NULLS LAST" if o.startswith("-") else f"{o} ASC NULLS LAST" for o in order]
    named = {o.lstrip("-") for o in order}
    return "ORDER BY " + ", ".join(keys + [f"{c} ASC NULLS LAST" for c in columns if c not in named]) + f" LIMIT {n}"


def _top(source: str, columns, order, n: int) -> str:
    return f"SELECT {_cols(columns)} FROM {source} {_ranked(columns, order, n)}"


def _renamed(columns: dict, table: str) -> str:
    return ", ".join(f"{table}.{names[0]} AS {c}" for c, (names, _) in columns.items() if names[0] != "PurchaseOrderItemCategory")


# Columns of the views.
BY_SUPPLIER = (
    "supplier supplier_name purchasing_org pos lines total_spend spend_share_pct delivered_lines open_lines"
    " avg_days_to_asn"
).split()
RISK = (
    "supplier supplier_name purchasing_org total_spend lines delivered_lines open_lines avg_days_to_asn"
    " delivery_rate_pct risk_score risk_tier"
).split()
BY_MONTH = "year_month purchasing_org pos lines spend gr_qty open_lines".split()
BY_GROUP = "material_group material_group_text pos lines total_spend supplier_count plant_count".split()
DELIVERY = (
    "supplier supplier_name plant total_lines delivered_lines pending_lines delivery_rate_pct avg_days_to_asn"
    " avg_planned_days avg_delay_days"
).split()

SHARED: dict[str, str] = {
    "moved_in": f"""
        SELECT PurchaseOrder AS po, PurchaseOrderItem AS item,
               {_exact("QuantityInBaseUnit")} AS qty, MAX(PostingDate) AS last_day
        FROM raw_gr
        WHERE GoodsMovementType <> '102' AND GoodsMovementType <> '122' AND GoodsMovementIsCancelled IS NOT TRUE
        GROUP BY ALL""",
    "announced": f"""
        SELECT PurchaseOrder AS po, PurchaseOrderItem AS item,
               {_exact("ConfirmedQuantity")} AS qty, MIN(DeliveryDate) AS first_day
        FROM raw_asn GROUP BY ALL""",
    "wanted": """
        SELECT PurchaseOrder AS po, PurchaseRequisition AS pr, PurchaseRequisitionItem AS pri,
               MIN(DeliveryDate) AS day, MIN(MaterialGroup_Text) AS txt
        FROM raw_pr GROUP BY ALL""",
    "described": "SELECT Material AS material, MIN(MaterialName) AS material_name FROM raw_material GROUP BY ALL",
    "plain": f"""
        SELECT i.PurchaseOrder AS purchase_order, i.PurchaseOrderItem AS purchase_order_item,
               {_renamed(HEADER_COLUMNS, "h")}, {_renamed(ITEM_COLUMNS, "i")},
               CAST(NULL AS VARCHAR) AS item_category,
               i.PlannedDeliveryDurationInDays AS planned_delivery_days,
               d.material_name AS master_name,
               w.day AS pr_requested_delivery_date, w.txt AS material_group_text,
               COALESCE(m.qty, 0) AS gr_qty, m.last_day AS last_gr_date,
               COALESCE(a.qty, 0) AS asn_qty, a.first_day AS earliest_asn_delivery_date
        FROM raw_po_item i
        LEFT JOIN raw_po_header h USING (PurchaseOrder)
        LEFT JOIN described d ON d.material = i.Material
        LEFT JOIN moved_in m ON (m.po, m.item) = (i.PurchaseOrder, i.PurchaseOrderItem)
        LEFT JOIN announced a ON (a.po, a.item) = (i.PurchaseOrder, i.PurchaseOrderItem)
        LEFT JOIN wanted w ON (w.po, w.pr, w.pri) = (i.PurchaseOrder, i.PurchaseRequisition, i.PurchaseRequisitionItem)""",
    "wide": """
        SELECT p.*, s.SupplierName AS supplier_name
        FROM plain p LEFT JOIN raw_supplier s ON s.Supplier = p.supplier""",
    "judged": """
        SELECT *, purchase_requisition AS customer_pr, purchase_requisition_item AS customer_pr_item,
               COALESCE(master_name, item_text) AS material_name,
               order_qty * net_price AS spend,
               date_diff('day', creation_date, earliest_asn_delivery_date) AS days_po_to_asn,
               LENGTH(COALESCE(po_deletion_code, '') || COALESCE(item_deletion_code, '')) > 0 AS gone,
               order_qty > 0 AND gr_qty >= order_qty AS all_in,
               order_qty > 0 AND asn_qty >= order_qty AS all_announced
        FROM wide""",
    "fact": f"""
        SELECT {_cols(c for c in FACT_COLUMNS if c != "system_status")},
               CASE WHEN gone THEN 'Cancelled'
                    ELSE CASE WHEN is_completely_delivered IS TRUE OR all_in IS TRUE THEN 'Fully Delivered'
                              WHEN gr_qty > 0 THEN 'Partially Delivered'
                              WHEN asn_qty > 0 THEN IF(all_announced IS TRUE, 'Shipped (Full)', 'Shipped (Partial)')
                              ELSE 'PO Created' END END AS system_status
        FROM judged""",
    "mart": """
        SELECT fact.*, COALESCE(o.status_override, system_status) AS dashboard_status,
               o.owner, o.priority, o.note, o.updated_at AS override_updated_at
        FROM fact LEFT JOIN po_item_overrides o USING (purchase_order, purchase_order_item)""",
    "live": "SELECT * FROM mart WHERE po_deletion_code IS NULL OR po_deletion_code = ''",
    "by_supplier": f"""
        SELECT supplier, supplier_name, purchasing_org, {_distinct("purchase_order")} AS pos, COUNT(*) AS lines,
               ROUND({_money("spend")}, 2) AS total_spend,
               {_share(_money("spend"), f"(SELECT {_money('spend')} FROM live)", 2)} AS spend_share_pct,
               {_n("Fully Delivered")} AS delivered_lines, {_n("PO Created")} AS open_lines,
               ROUND(AVG(days_po_to_asn), 1) AS avg_days_to_asn
        FROM live GROUP BY ALL""",
    "risk": f"""
        SELECT supplier, supplier_name, purchasing_org, total_spend, lines, delivered_lines, open_lines,
               avg_days_to_asn, {_share("delivered_lines", "lines")} AS delivery_rate_pct,
               ROUND(open_lines * COALESCE(avg_days_to_asn, 0), 0) AS risk_score,
               CASE WHEN (avg_days_to_asn > 120) IS TRUE
                      OR (open_lines > 100 AND avg_days_to_asn > 60) IS TRUE THEN 'High Risk'
                    WHEN (avg_days_to_asn >= 45 AND avg_days_to_asn <= 120) IS TRUE OR open_lines > 30 THEN 'Medium Risk'
                    ELSE 'Low Risk' END AS risk_tier
        FROM by_supplier WHERE lines >= 5""",
    "by_month": f"""
        SELECT strftime(creation_date, '%Y-%m') AS year_month, purchasing_org,
               {_distinct("purchase_order")} AS pos, COUNT(*) AS lines, ROUND({_money("spend")}, 2) AS spend,
               ROUND({_money("gr_qty")}, 2) AS gr_qty, {_n("PO Created")} AS open_lines
        FROM live WHERE creation_date IS NOT NULL GROUP BY 1, 2""",
    "by_group": f"""
        SELECT material_group, material_group_text, {_distinct("purchase_order")} AS pos, COUNT(*) AS lines,
               ROUND({_money("spend")}, 2) AS total_spend, {_distinct("supplier")} AS supplier_count,
               {_distinct("plant")} AS plant_count
        FROM live GROUP BY ALL""",
    "delivery": f"""
        SELECT *, ROUND(raw_days, 1) AS avg_days_to_asn, ROUND(raw_planned, 1) AS avg_planned_days,
               ROUND(raw_days - raw_planned, 1) AS avg_delay_days,
               {_share("delivered_lines", "total_lines")} AS delivery_rate_pct
        FROM (SELECT supplier, supplier_name, plant, COUNT(*) AS total_lines,
                     {_n("Fully Delivered")} AS delivered_lines, {_n("PO Created")} AS pending_lines,
                     AVG(days_po_to_asn) AS raw_days, AVG(planned_delivery_days) AS raw_planned
              FROM live GROUP BY ALL)
        WHERE total_lines >= 5""",
    "overdue": f"""
        SELECT {_cols(OVERDUE_COLUMNS)}
        FROM (SELECT *, date_diff('day', creation_date, DATE '{reg.AS_OF}') AS age_days FROM live)
        WHERE COALESCE(item_deletion_code, '') = ''
          AND dashboard_status <> 'Fully Delivered' AND dashboard_status <> 'Cancelled'
          AND age_days > COALESCE(planned_delivery_days, 30)""",
    "by_plant": f"""
        SELECT plant, purchasing_org, {_distinct("purchase_order")} AS pos, COUNT(*) AS lines,
               ROUND({_money("spend")}, 2) AS total_spend, {_distinct("supplier")} AS supplier_count,
               {_n("PO Created")} AS open_lines
        FROM live GROUP BY ALL""",
    "by_month_all": f"""
        SELECT strftime(creation_date, '%Y-%m') AS month, {_distinct("purchase_order")} AS pos,
               ROUND({_money("spend")}, 2) AS spend
        FROM mart WHERE creation_date IS NOT NULL GROUP BY 1""",
    "edits": """
        SELECT PurchaseOrder AS purchase_order, PurchaseOrderItem AS purchase_order_item,
               CASE WHEN GoodsMovementType = '101' THEN 'PO Created' END AS status_override,
               GoodsMovementType AS owner, 'High' AS priority, 'receipt cancelled' AS note,
               CAST(PostingDate AS TIMESTAMP) AS updated_at
        FROM raw_gr WHERE GoodsMovementIsCancelled""",
    "kpis": f"""
        SELECT COUNT(*) AS total_lines, {_distinct("purchase_order")} AS total_pos,
               {_distinct("supplier")} AS active_suppliers, {_distinct("plant")} AS active_plants,
               ROUND({_money("spend")}, 2) AS total_estimated_spend,
               {_n("Fully Delivered")} AS fully_delivered_lines,
               {_n("Partially Delivered")} AS partially_delivered_lines,
               {_n("Shipped (Full)")} AS shipped_full_lines, {_n("Shipped (Partial)")} AS shipped_partial_lines,
               {_n("PO Created")} AS open_lines, {_n("Cancelled")} AS cancelled_lines,
               {_share(_n("Fully Delivered"), f"(COUNT(*) - {_n('Cancelled')})")} AS fulfillment_rate_pct,
               ROUND({_money("gr_qty")}, 2) AS total_gr_qty, ROUND({_money("asn_qty")}, 2) AS total_asn_qty,
               COUNT(customer_po) AS pos_with_customer_po, COUNT(customer_pr) AS lines_with_customer_pr,
               {_share("COUNT(customer_po)", "COUNT(*)")} AS customer_po_fill_pct,
               {_share("COUNT(customer_pr)", "COUNT(*)")} AS customer_pr_fill_pct
        FROM live""",
    "seen": """
        SELECT c.*, EXISTS (FROM raw_gr g WHERE g.PurchaseOrder = c.PurchaseOrder) AS po_in,
               EXISTS (FROM raw_asn a WHERE a.PurchaseOrder = c.PurchaseOrder) AS po_announced,
               EXISTS (FROM raw_gr g WHERE g.PurchaseOrder = c.PurchaseOrder
                       AND g.PurchaseOrderItem = c.PurchaseOrderItem) AS line_in,
               EXISTS (FROM raw_asn a WHERE a.PurchaseOrder = c.PurchaseOrder
                       AND a.PurchaseOrderItem = c.PurchaseOrderItem) AS line_announced
        FROM pr_po_summary c""",
    "expected": """
        SELECT PurchaseOrder, PurchaseOrderItem, CurrentStatus,
               IF(po_in, 'Fulfilled', IF(po_announced, 'Shipped', 'PO Created')) AS expected_po,
               IF(line_in, 'Fulfilled', IF(line_announced, 'Shipped', 'PO Created')) AS expected_item
        FROM seen""",
    "per_order": """
        SELECT PurchaseOrder, n AS items_per_po, COALESCE(m, 0) AS pr_items_per_po, n * COALESCE(m, 0) AS multiplier
        FROM (SELECT PurchaseOrder, COUNT(*) AS n FROM raw_po_item GROUP BY 1)
        LEFT JOIN (SELECT PurchaseOrder, COUNT(*) AS m FROM raw_pr GROUP BY 1) USING (PurchaseOrder)""",
    "unknown": """
        SELECT SupplierID, COUNT(*) AS lines FROM pr_po_summary
        WHERE SupplierID NOT IN (SELECT Supplier FROM raw_supplier) GROUP BY 1""",
}


def _labelled(source: str, label: str, value: str, extras) -> str:
    return f"(SELECT {label} AS label, {value} AS value, {_cols(extras)} FROM {source})"


SUPPLIER_EXTRAS = ["supplier", "spend_share_pct", "delivered_lines", "open_lines", "avg_days_to_asn"]
RISK_EXTRAS = ["risk_tier", "open_lines", "avg_days_to_asn", "delivery_rate_pct"]
TOP_SUPPLIERS = _labelled("by_supplier", "COALESCE(supplier_name, supplier)", "total_spend", SUPPLIER_EXTRAS)
TOP_GROUPS = _labelled(
    "by_group", "COALESCE(material_group_text, material_group)", "total_spend", ["lines", "supplier_count"]
)
TOP_RISK = _labelled("risk", "COALESCE(supplier_name, supplier)", "risk_score", RISK_EXTRAS)


def _charts() -> dict[str, str]:
    supplier_columns = ["label", "value", *SUPPLIER_EXTRAS]
    filled = ", ".join(
        c if c in ("label", "supplier") else f"COALESCE({c}, 0) AS {c}" for c in supplier_columns
    )
    zero = "COALESCE(COLUMNS(* EXCLUDE ({})), 0), {}"
    shown = {
        "status_distribution": ("status_distribution", "label"),
        "spend_timeline": ("spend_timeline", "label"),
        "top_suppliers": ("top_suppliers", "label, supplier"),
        "spend_by_material_group": ("top_material_groups", "label"),
        "supplier_risk": ("top_supplier_risk", "label, risk_tier"),
    }
    charts = {
        "status_distribution": "SELECT dashboard_status AS label, COUNT(*) AS value FROM mart GROUP BY 1",
        "spend_timeline": _top(
            "(SELECT year_month AS label, spend AS value, pos FROM by_month)", ["label", "value", "pos"], ["label"], 18
        ),
        "spend_timeline_latest": _top(
            "(SELECT month AS label, spend AS value, pos FROM by_month_all)", ["label", "value", "pos"], ["-label"], 18
        ),
        "top_suppliers": _top(TOP_SUPPLIERS, supplier_columns, ["-value"], 10),
        "top_material_groups": _top(TOP_GROUPS, ["label", "value", "lines", "supplier_count"], ["-value"], 10),
        "top_supplier_risk": _top(TOP_RISK, ["label", "value", *RISK_EXTRAS], ["-value"], 15),
        "chart_series": f"SELECT {filled} FROM {TOP_SUPPLIERS}",
    }
    return charts | {f"dashboard_{k}": f"SELECT {zero.format(texts, texts)} FROM ({charts[c]})" for k, (c, texts) in shown.items()}


def _lists() -> dict[str, str]:
    return {
        "list_suppliers": _top("by_supplier", BY_SUPPLIER, ["-total_spend"], 50),
        "list_supplier_risk": _top("risk", RISK, ["-risk_score"], 100),
        "trend": _top("by_month", BY_MONTH, ["-year_month"], 12),
        "list_material_groups": _top("by_group", BY_GROUP, ["-total_spend"], 20),
        "list_overdue": _top("overdue", OVERDUE_COLUMNS, ["-age_days"], 500),
        "list_delivery": _top("delivery", DELIVERY, ["-avg_delay_days"], 100),
        "list_plants": "SELECT * FROM by_plant",
        "p2p_stages": f"""
            SELECT COALESCE(NULLIF(dashboard_status, ''), 'Unknown') AS stage, COUNT(*) AS lines,
                   COALESCE({_exact("spend")}, 0) AS spend,
                   ROUND(COUNT(*) / (SELECT COUNT(*) FROM mart) * 1e2, 1) AS share_pct
            FROM mart GROUP BY 1""",
        "p2p_kpis": f"""
            SELECT {_n("PO Created")} AS po_created, {_n("Shipped (Full)")} + {_n("Shipped (Partial)")} AS shipped,
                   {_n("Partially Delivered")} AS partially_delivered, {_n("Fully Delivered")} AS fully_delivered,
                   {_n("Cancelled")} AS cancelled, COUNT(*) AS total
            FROM mart""",
        "mart_row_count": "SELECT COUNT(*) AS rows FROM mart",
        "list_filter_contains": """
            SELECT * FROM by_supplier
            WHERE contains(supplier, '#00000001') OR contains(COALESCE(supplier_name, ''), '#00000001')""",
        "list_filter_risk_tier": """
            SELECT * FROM risk WHERE risk_tier = 'Medium Risk'
              AND (contains(lower(supplier), 'supplier') OR contains(lower(COALESCE(supplier_name, '')), 'supplier'))""",
        "overdue_by_days": "SELECT *, age_days - COALESCE(planned_delivery_days, 30) AS overdue_by FROM overdue",
        "supplier_delivery_pct": "SELECT *, delivered_lines / lines * 1e2 AS delivery_pct FROM by_supplier",
        "lead_time_gap": """
            SELECT *, NULLIF(age_days, 0) - NULLIF(planned_delivery_days, 0) AS lead_time_gap FROM overdue""",
    }


def _searches() -> dict[str, str]:
    f = reg.DATASET_FILTERS
    spend = "(SELECT *, spend AS estimated_spend FROM mart)"
    dataset_order = ["-creation_date", "-purchase_order", "purchase_order_item"]
    filtered = f"""(SELECT *, spend AS estimated_spend FROM mart
        WHERE {_like(SEARCHED, f["search"])} AND dashboard_status = '{f["status"]}'
          AND {_like(["material", "material_name"], f["material"])} AND plant = '{f["plant"]}'
          AND creation_date BETWEEN DATE '{f["date_from"]}' AND DATE '{f["date_to"]}')"""

    def hits(columns, text):
        return _top(f"(SELECT * FROM mart WHERE {_like(columns, text)})", SEARCH_RESULT, ["-creation_date"], 100)

    def coverage(field, label, series):
        return f"""
            SELECT '{field}' AS field, '{label}' AS label, '{series}' AS series, COUNT(*) AS total_rows,
                   COUNT({field}) AS non_null, COUNT(DISTINCT {field}) AS distinct_vals,
                   {_share(f"COUNT({field})", "COUNT(*)")} AS fill_pct,
                   COUNT(DISTINCT purchase_order) FILTER (NOT {_blank(field)}) AS pos_with_ref
            FROM mart"""

    def samples(field):
        return f"""(SELECT DISTINCT '{field}' AS field, {field} AS sample FROM mart
                    WHERE NOT {_blank(field)} ORDER BY sample LIMIT 5)"""

    return {
        "search_customer_po": hits(["customer_po", "purchase_order"], reg.FIND_PO),
        "search_customer_pr": hits(["customer_pr", "purchase_order"], reg.FIND_PR),
        "search_generic": hits(SEARCHED, reg.FIND_TEXT),
        "dataset_all": _top(spend, DATASET_RESULT, dataset_order, 500),
        "dataset_filtered": _top(filtered, DATASET_RESULT, dataset_order, 500),
        "order_detail": _top(
            f"(SELECT *, spend AS estimated_spend FROM mart WHERE purchase_order = '{reg.DETAIL_PO}')",
            DATASET_RESULT,
            dataset_order,
            1,
        ),
        "prefix_lookup": _top(
            f"(FROM raw_po_header WHERE CorrespncExternalReference LIKE '{reg.FIND_PO}%')",
            ["PurchaseOrder", "CorrespncExternalReference", "Supplier"],
            ["PurchaseOrder"],
            10,
        ),
        "prefix_lookup_item": _top(
            f"(FROM raw_po_item WHERE PurchaseRequisition LIKE '{reg.FIND_PR}%')",
            ["PurchaseOrder", "PurchaseOrderItem", "PurchaseRequisition", "Material"],
            ["PurchaseOrder"],
            10,
        ),
        "customer_reference_stats": " UNION ALL ".join(coverage(*r) for r in REFERENCE_FIELDS),
        "customer_reference_samples": " UNION ALL ".join(samples(r[0]) for r in REFERENCE_FIELDS),
    }


def _facts() -> dict[str, str]:
    line = "purchase_order, purchase_order_item"
    return {
        "normalize_odata_dates": f"""
            SELECT PurchaseOrder AS purchase_order,
                   CASE WHEN ms IS NOT NULL AND ms <= {LAST_MILLISECOND}
                        THEN strftime(epoch_ms(ms), '%Y-%m-%d') ELSE txt END AS date_text
            FROM (SELECT PurchaseOrder, txt,
                         TRY_CAST(NULLIF(regexp_extract(txt, '/Date\\((\\d+)([+-]\\d{{4}})?\\)/', 1), '') AS BIGINT) AS ms
                  FROM (SELECT PurchaseOrder,
                               CASE PurchaseOrderType WHEN '1' THEN '/Date(' || t || ')/'
                                    WHEN '2' THEN 'due /Date(' || t || '+0300)/'
                                    WHEN '3' THEN '/Date(-' || t || ')/'
                                    WHEN '4' THEN '/Date(' || t || '99999)/'
                                    ELSE CAST(CreationDate AS VARCHAR) END AS txt
                        FROM (SELECT *, CAST(epoch_ms(CAST(CreationDate AS TIMESTAMP)) + 3600000 AS VARCHAR) AS t
                              FROM raw_po_header)))""",
        "ingest_header": "SELECT * FROM raw_po_header",
        "ingest_odd_items": """
            SELECT PurchaseOrder AS "Purchase_Order", PurchaseOrderItem AS "Item_No",
                   '{"Plant":' || coalesce('"' || Plant || '"', 'null') || ',"City":'
                       || CASE WHEN Plant = 'P7' THEN '"Köln \\"x\\""' ELSE 'null' END || '}' AS "to_Partner",
                   CASE WHEN PurchaseOrderItem <> '2' THEN '["' || PurchaseOrder || '","a, b"]' END AS "Notes",
                   CASE WHEN NetAmount > 50000 THEN NULL ELSE OrderQuantity END AS "Net_Price_USD",
                   CASE WHEN PurchaseOrderItem <> '3'
                        THEN CAST(DATE '1970-01-01' + CAST(CAST(PurchaseOrder AS BIGINT) % 10000 AS INTEGER) AS VARCHAR) ELSE 'none' END AS "Due"
            FROM raw_po_item""",
        "run_history": f"""SELECT * FROM ({_RUNS} SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 20)""",
        "run_summary": f"""
            SELECT * FROM ({_RUNS}
                SELECT run_id, started_at, finished_at, status,
                       CASE WHEN status = 'success' THEN left(message, 120) ELSE message END AS summary
                FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 10)""",
        "json_array_suppliers": "SELECT * FROM raw_supplier",
        "csv_round_trip": f"""
            SELECT {line}, status_override, '"a", ' || chr(10) || owner AS owner, note FROM po_item_overrides""",
        "fact_item_header": f"SELECT {line}, {_cols(HEADER_COLUMNS)} FROM plain",
        "gr_per_item": f"SELECT {line}, gr_qty, last_gr_date FROM plain",
        "asn_per_item": f"SELECT {line}, asn_qty, earliest_asn_delivery_date FROM plain",
        "pr_per_item": f"""
            SELECT {line}, purchase_requisition AS customer_pr, purchase_requisition_item AS customer_pr_item,
                   pr_requested_delivery_date, material_group_text
            FROM plain""",
        "supplier_lookup": """
            SELECT h.PurchaseOrder AS purchase_order, h.Supplier AS supplier, s.SupplierName AS supplier_name
            FROM raw_po_header h LEFT JOIN raw_supplier s USING (Supplier)""",
        "material_dedup": """
            SELECT Material AS material, MaterialName AS material_name
            FROM (SELECT *, row_number() OVER (PARTITION BY Material ORDER BY MaterialName) AS place FROM raw_material)
            WHERE place = 1""",
        "po_item_status": f"SELECT {line}, order_qty, system_status FROM fact",
        "fact_po_item": f"SELECT {_cols(FACT_COLUMNS)} FROM fact",
        "key_report": """
            SELECT 'header' AS input, COUNT(*) AS total, COUNT(DISTINCT PurchaseOrder) AS unique_keys,
                   COUNT(PurchaseOrder) - COUNT(DISTINCT PurchaseOrder) AS surplus FROM raw_po_header
            UNION ALL
            SELECT 'suppliers', COUNT(*), COUNT(DISTINCT Supplier), COUNT(Supplier) - COUNT(DISTINCT Supplier)
            FROM raw_supplier""",
        "mart_po_item": f"SELECT {_cols(MART_COLUMNS)} FROM mart",
        "override_upsert": """
            SELECT * FROM po_item_overrides
            WHERE (purchase_order, purchase_order_item) NOT IN (SELECT purchase_order, purchase_order_item FROM edits)
            UNION ALL
            SELECT * EXCLUDE (place)
            FROM (SELECT *, row_number() OVER (
                      PARTITION BY purchase_order, purchase_order_item
                      ORDER BY updated_at DESC NULLS LAST, status_override DESC NULLS LAST, owner DESC NULLS LAST,
                               priority DESC NULLS LAST, note DESC NULLS LAST) AS place
                  FROM edits)
            WHERE place = 1""",
        "override_delete": """
            SELECT * FROM po_item_overrides
            WHERE (purchase_order, purchase_order_item) NOT IN (SELECT purchase_order, purchase_order_item FROM edits)""",
        "reference_fill_rate": " UNION ALL ".join(
            f"""SELECT '{c}' AS field, COUNT(*) AS total, COUNT({c}) AS non_null,
                       {_share(f"COUNT({c})", "COUNT(*)")} AS fill_pct FROM mart"""
            for c in ("customer_po", "customer_pr")
        ),
    }


def _views() -> dict[str, str]:
    return {
        "dashboard_kpis": "SELECT * FROM kpis",
        "spend_by_supplier": "SELECT * FROM by_supplier",
        "spend_by_month": "SELECT * FROM by_month",
        "spend_by_material_group": "SELECT * FROM by_group",
        "delivery_performance": f"SELECT {_cols(DELIVERY)} FROM delivery",
        "overdue_lines": "SELECT * FROM overdue",
        "spend_by_plant": "SELECT * FROM by_plant",
        "supplier_risk_tiers": "SELECT * FROM risk",
        "customer_reference_lines": f"""
            SELECT {_cols(c for c in REFERENCE_COLUMNS if c != "spend")}, ROUND(spend, 2) AS spend
            FROM live WHERE COALESCE(customer_po, customer_pr) IS NOT NULL""",
    }


def _audits() -> dict[str, str]:
    def keyed(name, table, key):
        return f"""
            SELECT '{name}' AS key, COUNT(*) - COUNT(DISTINCT {key}) AS duplicates, COUNT(DISTINCT {key}) AS unique_keys
            FROM {table}"""

    line = "(PurchaseOrder, PurchaseOrderItem)"
    numbers = """
        FROM (SELECT TRY_CAST(OrderQuantity AS DOUBLE) AS q, TRY_CAST(NetPriceAmount AS DOUBLE) AS p,
                     TRY_CAST(TotalEstimatedSpend AS DOUBLE) AS t FROM pr_po_summary)"""
    return {
        "audit_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS input, COUNT(*) AS rows FROM {t}" for t in reg.AUDITED),
        "audit_duplicates": " UNION ALL ".join(
            [
                keyed("po_header", "raw_po_header", "PurchaseOrder"),
                keyed("po_item", "raw_po_item", line),
                keyed("pr_po_summary", "pr_po_summary", line),
            ]
        ),
        "audit_null_rate": """
            SELECT 'raw_po_header' AS input, count_if(CreationDate IS NULL) / COUNT(*) AS null_rate FROM raw_po_header
            UNION ALL SELECT 'raw_po_item', NULL
            UNION ALL SELECT 'pr_po_summary', count_if(CreationDate IS NULL) / COUNT(*) FROM pr_po_summary
            UNION ALL SELECT 'raw_supplier', NULL""",
        "audit_top_pr_per_po": _top(
            "(SELECT PurchaseOrder, COUNT(*) AS pr_items FROM raw_pr GROUP BY 1)",
            ["PurchaseOrder", "pr_items"],
            ["-pr_items"],
            10,
        ),
        "audit_join_explosion": "SELECT CAST(SUM(multiplier) AS BIGINT) AS estimated_rows FROM per_order",
        "audit_worst_multipliers": _top(
            "per_order", ["PurchaseOrder", "items_per_po", "pr_items_per_po", "multiplier"], ["-multiplier"], 20
        ),
        "audit_expected_status": "SELECT * FROM expected",
        "audit_status_mismatch": """
            SELECT count_if(CurrentStatus IS DISTINCT FROM expected_po)::BIGINT AS mismatch_vs_po_level,
                   count_if(CurrentStatus IS DISTINCT FROM expected_item)::BIGINT AS mismatch_vs_item_level,
                   count_if(CurrentStatus = 'Fulfilled' AND expected_item <> 'Fulfilled')::BIGINT
                       AS fulfilled_without_item_receipt
            FROM expected""",
        "audit_status_sample": _top(
            "(FROM expected WHERE CurrentStatus = 'Fulfilled' AND expected_item <> 'Fulfilled')",
            ["PurchaseOrder", "PurchaseOrderItem", "CurrentStatus", "expected_item"],
            ["PurchaseOrder", "PurchaseOrderItem"],
            25,
        ),
        "audit_missing_suppliers": _top("unknown", ["SupplierID", "lines"], ["-lines"], 50),
        "audit_missing_supplier_count": "SELECT COUNT(*) AS missing_suppliers FROM unknown",
        "audit_spend": f"""
            SELECT count_if(COALESCE(ABS(q * p - t), 0) < 1e-6) / COUNT(*) AS exact_match_share,
                   count_if(ABS(q * p - t) > 0.01)::BIGINT AS rows_diff_gt_0_01,
                   count_if(q IS NULL OR p IS NULL OR t IS NULL)::BIGINT AS rows_with_missing
            {numbers}""",
    }


def _report(audits: dict[str, str]) -> str:
    """The other audit statements in long form."""

    def long(section, key, labels, numbers, texts=()):
        label = " || '.' || ".join([*(f"COALESCE({c}, '?')" for c in labels), "'{}'"])
        return [
            f"SELECT '{section}' AS section, {label.format(c)} AS metric, {n} AS number, {v} AS value FROM ({audits[key]})"
            for c, n, v in [
                *((c, f"CAST({c} AS DOUBLE)", "CAST(NULL AS VARCHAR)") for c in numbers),
                *((c, "CAST(NULL AS DOUBLE)", c) for c in texts),
            ]
        ]

    counted = f"""
        SELECT PurchaseOrder, PurchaseOrderItem, CurrentStatus, expected_item, COUNT(*) AS rows
        FROM ({audits["audit_status_sample"]}) GROUP BY ALL"""
    audits = audits | {"counted": counted}
    mismatches = ["mismatch_vs_po_level", "mismatch_vs_item_level", "fulfilled_without_item_receipt"]
    line = ["PurchaseOrder", "PurchaseOrderItem"]
    return " UNION ALL ".join(
        [
            *long("row_counts", "audit_row_counts", ["input"], ["rows"]),
            *long("duplicates", "audit_duplicates", ["key"], ["duplicates", "unique_keys"]),
            *long("creation_date_nulls", "audit_null_rate", ["input"], ["null_rate"]),
            *long("top_requisitions_per_order", "audit_top_pr_per_po", line[:1], ["pr_items"]),
            *long("join_explosion", "audit_join_explosion", [], ["estimated_rows"]),
            *long("worst_multipliers", "audit_worst_multipliers", line[:1], ["items_per_po", "pr_items_per_po", "multiplier"]),
            *long("status_validation", "audit_status_mismatch", [], mismatches),
            *long("status_sample", "counted", line, ["rows"], ["CurrentStatus", "expected_item"]),
            *long("missing_suppliers", "audit_missing_suppliers", ["SupplierID"], ["lines"]),
            *long("missing_suppliers", "audit_missing_supplier_count", [], ["missing_suppliers"]),
            *long("spend_validation", "audit_spend", [], ["exact_match_share", "rows_diff_gt_0_01", "rows_with_missing"]),
        ]
    )


def _profiles() -> dict[str, str]:
    def probe(table, field, order):
        return f"""
            SELECT '{table}' AS table_name, '{field}' AS field, COUNT(*) AS total_rows, COUNT({field}) AS non_null,
                   COUNT(DISTINCT {field}) AS distinct_vals, {_share(f"COUNT({field})", "COUNT(*)")} AS fill_pct,
                   COUNT(DISTINCT {order}) FILTER (NOT {_blank(field)}) AS pos_with_ref,
                   (SELECT string_agg(v, ' | ' ORDER BY v)
                    FROM (SELECT DISTINCT {field} AS v FROM {table} WHERE NOT {_blank(field)} ORDER BY v LIMIT 8))
                       AS samples
            FROM {table}"""

    tables = {t: t for t in reg.STORED} | {"fact_po_item": "fact", "mart_po_item": "mart"}
    inventory = " UNION ALL ".join(
        f"""SELECT '{name}' AS table_name, (SELECT COUNT(*) FROM {t}) AS rows, COUNT(*)::INTEGER AS columns
            FROM (SELECT unnest(map_keys(cells)) FROM (
                SELECT from_json(to_json(r), '"map(varchar, varchar)"') AS cells FROM {t} r LIMIT 1))"""
        for name, t in tables.items()
    )
    kinds = "WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp'"
    core = {t: (tables[t], {"fact_po_item": FACT_COLUMNS, "mart_po_item": MART_COLUMNS}.get(t) or tuple(ENTITIES[t])) for t in reg.CORE}
    overdue_sample = (
        "purchase_order supplier material_name creation_date age_days planned_delivery_days dashboard_status"
    ).split()
    return {
        "table_inventory": inventory,
        "null_profile": " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, {_share(f'count_if({c} IS NULL)', 'COUNT(*)')} AS null_pct FROM mart"
            for c in MART_COLUMNS
        ),
        "schema_profile": " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, {_share(f'count_if({c} IS NULL)', 'COUNT(*)')} AS null_pct,
                       CASE typeof(MIN({c})) {kinds} ELSE lower(typeof(MIN({c}))) END AS data_type,
                       '{'tracked' if c in TRACKED else ''}' AS note FROM mart"""
            for c in MART_COLUMNS
        ),
        "sample_rows": _top("mart", MART_COLUMNS, [], 3),
        "core_null_profile": " UNION ALL ".join(
            f"SELECT '{name}' AS table_name, '{c}' AS column_name, {_share(f'count_if({c} IS NULL)', 'COUNT(*)')} AS null_pct FROM {t}"
            for name, (t, columns) in core.items()
            for c in columns
        ),
        "core_schema_profile": " UNION ALL ".join(
            f"""SELECT '{name}' AS table_name, '{c}' AS column_name, {_share(f'count_if({c} IS NULL)', 'COUNT(*)')} AS null_pct,
                       CASE typeof(MIN({c})) {kinds} ELSE lower(typeof(MIN({c}))) END AS data_type,
                       '{'tracked' if c.lower() in TRACKED else ''}' AS note FROM {t}"""
            for name, (t, columns) in core.items()
            for c in columns
        ),
        "core_sample_rows": " UNION ALL ".join(
            f"""SELECT '{name}' AS table_name, sample::INTEGER AS sample, '{c}' AS column_name, {c}::VARCHAR AS value
                FROM (SELECT *, row_number() OVER (ORDER BY {', '.join(f'{x} NULLS LAST' for x in columns)}) AS sample FROM {t})
                WHERE sample <= 3"""
            for name, (t, columns) in core.items()
            for c in columns
        ),
        "field_probe": " UNION ALL ".join(
            [
                probe("raw_pr", "PurchaseRequisition", "PurchaseOrder"),
                probe("raw_po_item", "PurchaseRequisition", "PurchaseOrder"),
                probe("fact", "customer_pr", "purchase_order").replace("'fact'", "'fact_po_item'"),
                probe("mart", "customer_pr", "purchase_order").replace("'mart'", "'mart_po_item'"),
            ]
        ),
        "status_profile": f"""
            SELECT dashboard_status, COUNT(*) AS lines, {_distinct("purchase_order")} AS pos,
                   ROUND({_money("spend")}, 2) AS spend,
                   {_share("COUNT(*)", "(SELECT COUNT(*) FROM mart)")} AS pct
            FROM mart GROUP BY 1""",
        "supplier_top10_raw": _top(
            f"""(SELECT supplier, {_distinct("purchase_order")} AS pos, COUNT(*) AS lines,
                        ROUND({_money("spend")}, 2) AS total_spend
                 FROM mart WHERE supplier IS NOT NULL GROUP BY 1)""",
            ["supplier", "pos", "lines", "total_spend"],
            ["-total_spend"],
            10,
        ),
        "monthly_trend12": _top("by_month_all", ["month", "pos", "spend"], ["-month"], 12),
        "pr_linkage": f"""
            SELECT COUNT(*) AS total_lines, COUNT(customer_pr) AS lines_with_pr,
                   {_share("COUNT(customer_pr)", "COUNT(*)")} AS pr_fill_pct FROM fact""",
        "system_status_dist": f"""
            SELECT system_status, COUNT(*) AS lines, {_share("COUNT(*)", "(SELECT COUNT(*) FROM fact)")} AS pct
            FROM fact GROUP BY 1""",
        "fact_fill_counts": "SELECT " + ", ".join(f"COUNT({c}) AS {n}" for n, c in FILL_COLUMNS.items()) + " FROM fact",
        "kpi_unpivot": """
            SELECT metric, value FROM (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM kpis)
            UNPIVOT INCLUDE NULLS (value FOR metric IN (*))""",
        "overdue_sample": _top("overdue", overdue_sample, ["-age_days"], 5),
    }


def _rules() -> dict[str, str]:
    ranks = "[" + ", ".join(f"'{s}'" for s in SEVERITY) + "]"
    holidays = ", ".join(f"DATE '{h}'" for h in reg.HOLIDAYS)
    return {
        "po_worst_line_status": f"""
            SELECT purchase_order, COALESCE({ranks}[place], 'Unknown') AS document_status
            FROM (SELECT purchase_order, MIN(list_position({ranks}, dashboard_status)) AS place FROM mart GROUP BY 1)""",
        "ageing_business_days": f"""
            SELECT purchase_order, purchase_order_item, creation_date, dashboard_status,
                   CASE WHEN creation_date IS NOT NULL THEN
                   (SELECT COUNT(*) FROM (SELECT CAST(x AS DATE) AS day FROM generate_series(
                        TIMESTAMP '1995-01-01', TIMESTAMP '{reg.AS_OF}', INTERVAL 1 DAY) t(x))
                    WHERE day > creation_date AND isodow(day) NOT IN (5, 6) AND day NOT IN ({holidays})) END
                       AS ageing_business_days
            FROM mart""",
        "restricted_projection": f"""
            SELECT {_cols(c for c in MART_COLUMNS if c not in HIDDEN["technical_evaluator"])} FROM mart""",
    }


def statements() -> dict[str, str]:
    ctes = adapter_ctes() | SHARED
    prefix = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items()) + "\n"
    bodies = (
        _facts() | _views() | _charts() | _lists() | _searches() | _audits() | _profiles() | _rules()
    )
    bodies["json_report_round_trip"] = bodies["audit_null_rate"]
    bodies["audit_report"] = _report(_audits())
    return {key: prefix + body for key, body in bodies.items()}
