"""Classification of orders in several currencies, and whole jobs over CSV files, against what the order key tells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.classify import AMOUNTS, classify
from . import jobs
from .adapter import dirty_orders, mixed_orders
from .queries_rules import BAD, TOTAL
from .scratch import scratch

# what mixed_orders must become, by key arithmetic
MIXED = """m0 AS (SELECT o_orderkey k, o_custkey c, o_orderdate d, CASE o_orderkey % 4 WHEN 0 THEN 530 WHEN 1 THEN 140 ELSE 1 END r, o_orderkey % 5 <> 1 AS ok,
 CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 2 THEN 'طلب ' || (o_orderkey - o_orderkey % 2 + 200000) ELSE 'طلب-' || (o_orderkey - o_orderkey % 2 + 200000) END oid FROM orders),
 m1 AS (SELECT *, 1 + (k % 8) / 8.0 AS q, k % 50 + 1.5 AS p, CASE WHEN k % 5 = 0 THEN 2000 ELSE 3 END AS pb, CASE WHEN k % 3 = 2 THEN 10 * r END AS a_del, oid <> '' AND row_number() OVER (PARTITION BY oid ORDER BY k) > 1 AS dup FROM m0),
 m2 AS (SELECT *, round(CAST(q AS DOUBLE) * CAST(p AS DOUBLE) * r, 2) + 2 * pb * r AS items, CASE WHEN k % 3 = 2 THEN 10 * r WHEN ok AND k % 3 = 0 THEN 2000 WHEN ok THEN 3000 END AS delivery FROM m1),
 m3 AS (SELECT *, items + coalesce(a_del, 0) AS calc0, items + coalesce(delivery, 0) AS calc, CASE WHEN k % 7 = 1 THEN NULL WHEN k % 7 = 0 AND r = 1 THEN -1 ELSE 1 END AS sign FROM m2),
 m4 AS (SELECT *, ok AND sign = -1 AS flipped, CASE WHEN sign = -1 AND ok THEN calc0 WHEN sign = -1 THEN -calc0 WHEN sign = 1 THEN r END AS tot1 FROM m3),
 m5 AS (SELECT *, ok AND tot1 >= 0 AND abs(tot1 - calc) > 0.01 AS again, ok AND k % 2 = 0 AND tot1 IS NOT NULL AS pays,
  CAST(k % 11 = 0 AND k % 13 = 0 AS INT) AS none, CAST(NOT ok AS INT) + CAST(ok AND tot1 IS NULL AS INT) AS unknown FROM m4),
 m AS (SELECT *, 2 * none + CAST(dup AS INT) + unknown AS n FROM m5)"""
MIXED_ERRORS = "concat_ws(',', CASE WHEN none = 1 THEN 'MISSING_ORDER_ID,MISSING_CUSTOMER_ID' END, CASE WHEN dup THEN 'DUPLICATE_ORDER_ID' END, CASE WHEN unknown = 1 THEN 'UNKNOWN_PRICE' END, CASE WHEN n > 1 THEN 'MULTIPLE_CONFLICTING_ERRORS' END)"
MIXED_ID = "CASE WHEN k % 11 <> 0 THEN 'طلب-' || (k - k % 2 + 200000) WHEN k % 13 <> 0 THEN 'طلب-' || (c + 100000) ELSE '' END"
#: How often a row has each of the 21 rule codes.
CODES = {
    "TEXT_NORMALIZATION": "1", "STANDARDIZE_ORDER_ID": "CAST(k % 11 <> 0 AND k % 5 = 2 AS INT)", "INFER_ORDER_ID_FROM_CUSTOMER_ID": "CAST(k % 11 = 0 AND k % 13 <> 0 AS INT)",
    "STANDARDIZE_CUSTOMER_ID": "CAST(k % 13 <> 0 AS INT)", "INFER_CUSTOMER_ID_FROM_ORDER_ID": "CAST(k % 13 = 0 AND k % 11 <> 0 AS INT)", "NAME_REMOVE_TITLES": "1",
    "CURRENCY_CONVERSION_TO_YER": "CAST(r > 1 AS INT)", "CURRENCY_TO_YER": "CAST(k % 4 = 2 AS INT)", "CURRENCY_STANDARDIZE": "CAST(k % 4 = 3 AS INT)",
    "NUMBER_NORMALIZATION": "1 + CAST(k % 3 = 2 AS INT) + CAST(k % 2 = 1 AS INT) + CAST(k % 7 <> 1 AS INT)", "PRICE_KNOWN_WORD": "CAST(k % 5 = 0 AS INT)",
    "CURRENCY_VALUE_CONVERSION": "CASE WHEN r > 1 THEN 1 + CAST(ok AS INT) + CAST(k % 3 = 2 AS INT) + CAST(k % 2 = 1 AS INT) + CAST(k % 7 <> 1 AS INT) ELSE 0 END",
    "PHONE_REMOVE_SPACES_AND_COUNTRY_CODE": "1", "EMAIL_REPEATED_SYMBOLS": "1", "DATE_STANDARDIZE": "1", "DICTIONARY_STANDARDIZATION": "4",
    "ITEMS_NUMERIC_NORMALIZATION": "CAST(ok AND r = 1 AS INT)", "NEGATIVE_SIGN_TYPO_REPAIR": "CAST(flipped AS INT)", "INFER_DELIVERY_COST": "CAST(ok AND k % 3 <> 2 AS INT)",
    "INFER_PAYMENT_AMOUNT_FROM_TOTAL": "CAST(pays AS INT)", "TOTAL_RECALCULATE_FROM_ITEMS_AND_DELIVERY": "CAST(again AS INT)",
}


def _mixed(s, d, only):
    return classify(mixed_orders(s, d), only=only)


def _status(s, d):
    money = [F.col(x).cast("double").alias(x) for x in ("delivery_cost", "payment_amount", "total_amount")]
    return _mixed(s, d, ("quality_status", "order_id", "customer_id", "currency", "error_codes", *AMOUNTS)).select("source_row_number", "quality_status", "order_id", "customer_id", "currency", *money, F.array_join("error_codes", ",").alias("errors"))


def _codes(s, d):
    x = _mixed(s, d, ("corrections",)).select("source_row_number", F.explode("corrections").alias("c")).select("source_row_number", F.col("c.rule_code").alias("rule_code"))
    return x.groupBy("source_row_number", "rule_code").agg(F.count("*").alias("count"))


def _items(s, d):
    x = _mixed(s, d, ("items_json",)).select("source_row_number", F.explode("items_json").alias("i"))
    return x.select("source_row_number", "i.sku", F.col("i.qty").cast("double").alias("qty"), F.col("i.unit_price").cast("double").alias("unit_price"), F.col("i.total").cast("double").alias("total"), "i.other")


def _as_csv(s, d, name, **changed):
    """The dirty orders, with a key of its own for each row and changed columns, as CSV in an order of columns of its own."""
    at, k = scratch(s, name), F.col("source_row_number")
    own = {"order_id": F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("طلب "), (2 * k + 200001).cast("string"))), "customer_id": F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("عميل-"), (2 * k).cast("string")))}
    x = dirty_orders(s, d).withColumns(own | changed)
    x.select(*sorted(c for c in x.columns if c != "source_row_number")).write.option("header", True).option("escape", '"').csv(f"{at}/in")
    return at


def _loaded(s, d):
    at = _as_csv(s, d, "full-load")
    jobs.full_load(s, f"{at}/w", f"{at}/in", "r1", stamp_version=True, find_duplicates=False)
    return jobs.Warehouse(s, f"{at}/w")


def _full(s, d):
    rows = _loaded(s, d).orders.read()
    return rows.select("order_id", "order_date", F.col("total_amount").cast("double").alias("total_amount"), "version", "ingest_seq")


def _replay(s, d):
    """Metrics and tables after a load, its replay under another run, and a replay of the first: nothing is there twice."""
    at = _as_csv(s, d, "replay")
    for run in ("r1", "r2", "r1"):
        jobs.full_load(s, f"{at}/w", f"{at}/in", run, stamp_version=True, find_duplicates=False)
    w = jobs.Warehouse(s, f"{at}/w")
    runs = s.read.parquet(w.path("run_metrics")).select("run_id", "raw", "corrected", "quarantined", "consistent")
    held = s.read.parquet(w.path("quarantine")).groupBy("run_id").agg(F.count("*").alias("held"))
    return runs.join(held, "run_id").withColumn("orders", F.lit(w.orders.read().count()))


def _delta(s, d):
    """Orders after a full load and a delta in which all come again with another city and version 0, 1 or 2."""
    w = _loaded(s, d)
    at = _as_csv(s, d, "delta", version=(F.col("source_row_number") % 3).cast("string"), city=F.lit("مارب"))
    jobs.delta_load(s, w.root, f"{at}/in", "d1")
    return w.orders.read().select("order_id", "city", "version")


def _refreshed(s, d):
    """The daily view after a full load, its refresh, a delta that gives all orders one date, and an incremental refresh."""
    w = _loaded(s, d)
    first = jobs.refresh_job(s, w.root)
    at = _as_csv(s, d, "refresh", version=(F.col("source_row_number") % 3).cast("string"), order_date=F.lit("2030-01-01"))
    jobs.delta_load(s, w.root, f"{at}/in", "d1")
    second, third = jobs.refresh_job(s, w.root), jobs.refresh_job(s, w.root)
    view = jobs.read_view(w, "mv_daily", 1_000_000)
    return view.select("date", "total_orders", F.round("total_revenue", 2).alias("total_revenue"), F.lit(f"{first},{second},{third}").alias("outcomes"))


GOOD = f"WITH {BAD}, g AS (SELECT *, 'طلب-' || CASE WHEN k % 11 = 0 THEN 2 * k + 100000 ELSE 2 * k + 200001 END AS order_id FROM b WHERE n = 0)"
Q = {
    "mixed_orders": (_status, f"""WITH {MIXED} SELECT k source_row_number, CASE WHEN n > 0 THEN 'quarantined' ELSE 'corrected' END quality_status,
 {MIXED_ID} order_id,
 CASE WHEN k % 13 <> 0 THEN 'عميل-' || c WHEN k % 11 <> 0 THEN 'عميل-' || (k - k % 2 + 100000) ELSE '' END customer_id, CASE WHEN k % 4 = 3 THEN 'EUR' ELSE 'YER' END currency,
 CAST(delivery AS DOUBLE) delivery_cost, CAST(CASE WHEN pays THEN tot1 WHEN k % 2 = 1 THEN 5 * r END AS DOUBLE) payment_amount, CAST(CASE WHEN again THEN calc ELSE tot1 END AS DOUBLE) total_amount,
 concat_ws(',', CASE WHEN none = 1 THEN 'MISSING_ORDER_ID,MISSING_CUSTOMER_ID' END, CASE WHEN dup THEN 'DUPLICATE_ORDER_ID' END, CASE WHEN unknown = 1 THEN 'UNKNOWN_PRICE' END, CASE WHEN n > 1 THEN 'MULTIPLE_CONFLICTING_ERRORS' END) AS errors FROM m"""),
    "mixed_corrections": (_codes, f"WITH {MIXED}, x AS ({' UNION ALL '.join(f'SELECT k source_row_number, {chr(39)}{code}{chr(39)} rule_code, {n} AS n FROM m' for code, n in CODES.items())}) SELECT source_row_number, rule_code, CAST(n AS BIGINT) AS count FROM x WHERE n > 0"),
    "mixed_items": (_items, f"""WITH {MIXED} SELECT k source_row_number, 'a' AS sku, CAST(q AS DOUBLE) qty, CAST(p * r AS DOUBLE) unit_price, round(CAST(q AS DOUBLE) * CAST(p AS DOUBLE) * r, 2) AS total, '{{"color":"red"}}' AS other FROM m WHERE ok
 UNION ALL SELECT k, 'b', CAST(2 AS DOUBLE), CAST(pb * r AS DOUBLE), CAST(2 * pb * r AS DOUBLE), NULL FROM m WHERE ok"""),
    "job_replay": (_replay, f"WITH {BAD} SELECT r.run_id, count(*) raw, count(*) FILTER (WHERE n = 0) corrected, count(*) FILTER (WHERE n > 0) quarantined, true AS consistent, count(*) FILTER (WHERE n > 0) held, (SELECT count(*) FROM b WHERE n = 0) AS orders FROM b, (SELECT 'r1' AS run_id UNION ALL SELECT 'r2') r GROUP BY r.run_id"),
    "job_full_load": (_full, f"{GOOD} SELECT order_id, strftime(d, '%Y-%m-%d') order_date, {TOTAL} total_amount, CAST(1 AS BIGINT) AS version, CAST(1 AS BIGINT) ingest_seq FROM g"),
    "job_delta_load": (_delta, f"{GOOD} SELECT order_id, CASE WHEN k % 3 = 2 THEN 'مأرب' WHEN k % 2 = 0 THEN 'صنعاء' ELSE 'عدن' END city, CAST(CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END AS BIGINT) AS version FROM g"),
    "job_refresh_views": (_refreshed, f"WITH {BAD}, f AS (SELECT CASE WHEN dat = 1 OR k % 3 = 2 THEN '2030-01-01' ELSE strftime(d, '%Y-%m-%d') END AS date, {TOTAL} t FROM b WHERE n = 0 OR (n = 1 AND dat = 1)) SELECT date, count(*) total_orders, round(sum(t), 2) total_revenue, 'success,incremental,up_to_date' AS outcomes FROM f GROUP BY date"),
}
