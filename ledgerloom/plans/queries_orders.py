"""Catalog, view, join and job queries over the given tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rules import stable_id
from ..operators import keys as K
from ..sources import orders as S
from ..sources.buckets import BucketTable
from ..sources.layout import RangeLayout
from . import catalog as C
from . import jobs, views
from .adapter import DELIVERED, MONEY, item_rows, order_heads, orders_doc, raw_skus, table
from .scratch import scratch

ORDERS = """od AS (SELECT CAST(o_orderkey AS VARCHAR) order_id, CAST(o_custkey AS VARCHAR) customer_id, c_name customer_name, n_name city,
 strftime(o_orderdate, '%Y-%m-%d') order_date, o_orderstatus status, o_orderpriority payment_method,
 CASE o_orderkey % 3 WHEN 0 THEN 'paid' WHEN 1 THEN 'pending' ELSE 'unpaid' END payment_status,
 CAST((o_orderkey % 4) * 500 AS DECIMAL(18,2)) delivery_cost, CAST(o_totalprice AS DECIMAL(18,2)) total_amount, o_orderkey k
 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
ITEMS = """it AS (SELECT CAST(l_orderkey AS VARCHAR) order_id, CAST(l_partkey AS VARCHAR) sku, p_name name, CAST(l_quantity AS DECIMAL(18,2)) qty,
 CAST(p_retailprice AS DECIMAL(18,2)) unit_price, CAST(round(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2)), 2) AS DECIMAL(18,2)) total
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)"""
# the mean of a money column, ties to even: whole cents with the remainder judged
AVG = "CAST((CAST(sum({0}) * 100 AS HUGEINT) // count({0}) + CASE WHEN CAST(sum({0}) * 100 AS HUGEINT) % count({0}) * 2 > count({0}) THEN 1 WHEN CAST(sum({0}) * 100 AS HUGEINT) % count({0}) * 2 = count({0}) THEN (CAST(sum({0}) * 100 AS HUGEINT) // count({0})) % 2 ELSE 0 END) AS DOUBLE) / 100"
FLAT = ("order_id", "customer_id", "customer_name", "city", "order_date", "status", "payment_method", "payment_status", "total_amount")
FLAT_SQL = "order_id, customer_id, customer_name, city, order_date, status, payment_method, payment_status, CAST(total_amount AS DOUBLE) total_amount"
PRODUCT_SQL = f"CAST(sum(qty) AS DOUBLE) total_units_sold, CAST(sum(total) AS DOUBLE) total_revenue, count(*) orders_count, {AVG.format('unit_price')} avg_unit_price"
BY_STATUS = "SELECT status, count(*) AS count, CAST(sum(total_amount) AS DOUBLE) cumulative_value, string_agg(DISTINCT payment_method, ',' ORDER BY payment_method) payment_methods_used FROM od GROUP BY status"
DAILY_SQL = f"SELECT order_date AS date, count(*) total_orders, CAST(sum(total_amount) AS DOUBLE) total_revenue, {AVG.format('total_amount')} avg_order_value, count(*) FILTER (WHERE status = 'F') delivered_orders FROM {{0}} GROUP BY order_date"


def _flat(df):
    return df.select(*FLAT[:-1], F.col("total_amount").cast("double").alias("total_amount"))


def _named(name, **params):
    return lambda s, d: _flat(C.run_named(orders_doc(s, d) if "sku" in params else order_heads(s, d), name, **params))


def _stable_ids(s, d):
    k = F.col("o_orderkey").cast("string")
    return table(s, d, "orders").select("o_orderkey", stable_id(F.lit("req"), k, F.lit("file"), F.col("o_custkey").cast("string")).alias("id"))


def _payload_hashes(s, d):
    c = table(s, d, "customer").select("c_name", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"), F.lit("now").alias("ingested_at"))
    return c.select("c_custkey", K.payload_hash(c, "ingested_at").alias("hash"))


def _newest(s, d):
    rows = order_heads(s, d).withColumn("ingest_seq", F.col("order_id").cast("long") % 97)
    return _flat(views.newest_orders(rows, 40))


def _found(where, order="order_date DESC, order_id", n=50):
    return f"WITH {ORDERS} SELECT {FLAT_SQL} FROM od WHERE {where} ORDER BY {order} LIMIT {n}"


def _top_customers(s, d):
    return C.top_customers(order_heads(s, d)).withColumn("cities_active", F.array_join("cities_active", ","))


def _by_status(s, d):
    return C.orders_by_status(order_heads(s, d)).withColumn("payment_methods_used", F.array_join("payment_methods_used", ","))


# versions from the events table: key user_id, version event_id % 7, ties by event_id


def _versions(s, d):
    e = table(s, d, "events")
    return e.select(F.col("user_id").cast("string").alias("order_id"), (F.col("event_id") % 7).alias("version"), F.col("event_id").alias("row"), "event_type", "value")


def _merge(s, d):
    v = _versions(s, d)
    old = K.latest_per_key(v.where("row % 2 = 0"), "order_id", "version", "row").withColumn("ingest_seq", F.lit(1))
    new = v.where("row % 2 = 1").withColumn("version", F.when(F.col("row") % 5 == 0, F.lit(None)).otherwise(F.col("version")))
    return K.merge_orders(old, new, tie_break=("row",), ingest_seq=2)


MERGE = """ev AS (SELECT CAST(user_id AS VARCHAR) order_id, event_id % 7 AS version, event_id AS r, event_type, value FROM events),
 o AS (SELECT * FROM ev WHERE r % 2 = 0 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC NULLS LAST, r DESC) = 1),
 n0 AS (SELECT order_id, CASE WHEN r % 5 = 0 THEN NULL ELSE version END AS version, r, event_type, value FROM ev WHERE r % 2 = 1),
 n AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY version DESC NULLS LAST, r DESC) = 1),
 m AS (SELECT o.order_id oid, n.order_id nid, o.version ov, n.version nv, o.r orr, n.r nr, o.event_type ot, n.event_type nt, o.value oval, n.value nval,
  CASE WHEN n.order_id IS NULL THEN NULL WHEN o.order_id IS NULL THEN 'inserted' WHEN o.version IS NOT NULL AND (n.version IS NULL OR n.version <= o.version) THEN 'unchanged'
  WHEN o.event_type IS NOT DISTINCT FROM n.event_type AND o.value IS NOT DISTINCT FROM n.value THEN 'unchanged' ELSE 'updated' END act FROM o FULL JOIN n ON o.order_id = n.order_id)"""


def _ledger(s, d):
    o = table(s, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey")
    ledger = o.where(k % 3 != 0).select(k.cast("string").alias("request_key"), (k % 10).cast("string").alias("payload_hash"), F.when(k % 2 == 0, "completed").otherwise("processing").alias("status"))
    requests = o.select(k.cast("string").alias("request_key"), F.when(k % 7 == 0, "other").otherwise((k % 10).cast("string")).alias("payload_hash"))
    return K.ledger_decision(ledger, requests)


def _append_new(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("_id"), "o_orderkey")
    return K.append_new(o.where("o_orderkey % 3 = 0"), o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 4 = 0")), "_id").select("_id")


def _duplicates(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("order_id"), F.col("event_id").alias("source_row_number"))
    return K.flag_duplicates(e)


def _fingerprint(s, d):
    whole = K.fingerprint(table(s, d, "orders"), "o_orderkey", "o_custkey", "o_orderstatus").select("n", F.col("xor").alias("x"), "sum")
    parts = K.fingerprint(table(s, d, "orders").repartition(7), "o_orderkey", "o_custkey", "o_orderstatus")
    return whole.join(parts, (whole["x"] == parts["xor"]) & (whole["sum"] == parts["sum"])).select(parts["n"].alias("n"))


def _refresh(s, d, items=False):
    """Orders before and after a change of every tenth (new amounts and dates; every hundredth goes to another day). items: theirs are read too, and are put together once for all who do."""
    before = orders_doc(s, d).withColumn("ingest_seq", F.lit(1).cast("long"))
    if items:
        at = scratch(s, "refresh")
        before.write.parquet(at)
        before = s.read.parquet(at)
    k = F.col("order_id").cast("long")
    after = before.where(k % 50 != 1).withColumns({
        "total_amount": F.when(k % 10 == 0, F.col("total_amount") + 100).otherwise(F.col("total_amount")).cast(MONEY),
        "order_date": F.when(k % 100 == 0, "2030-01-01").otherwise(F.col("order_date")),
        "ingest_seq": F.when(k % 10 == 0, 2).otherwise(1).cast("long"),
    })
    gone = before.where(k % 50 == 1)
    return before, after, gone


def _refresh_daily(s, d):
    before, after, gone = _refresh(s, d)
    dates, _ = views.affected_keys(before, after, 1)
    dates = dates.unionByName(gone.select(F.col("order_date").alias("date"))).distinct()
    return views.refresh_daily(views.daily_sales(before, DELIVERED), after, dates, DELIVERED)


def _refresh_products(s, d):
    before, after, gone = _refresh(s, d, items=True)
    _, skus = views.affected_keys(before, after, 1)
    skus = skus.unionByName(C.exploded_items(gone).select("sku")).distinct()
    return views.refresh_products(views.product_sales(before), after, skus)


def _affected(s, d):
    before, after, _ = _refresh(s, d, items=True)
    dates, skus = views.affected_keys(before, after, 1)
    return dates.select(F.lit("date").alias("kind"), F.col("date").alias("key")).unionByName(skus.select(F.lit("sku").alias("kind"), F.col("sku").alias("key")))


REFRESHED = "af AS (SELECT * REPLACE (CASE WHEN k % 10 = 0 THEN total_amount + 100 ELSE total_amount END AS total_amount, CASE WHEN k % 100 = 0 THEN '2030-01-01' ELSE order_date END AS order_date) FROM od WHERE k % 50 <> 1)"


def _layout(s, d):
    at = scratch(s, "layout")
    jobs.write_lookup_layout(orders_doc(s, d), at)
    return _flat(jobs.orders_by_sku(s, at, "1"))


def _layout_updated(s, d):
    """Orders of a city from ranges of cities, of which an update rewrote those of the orders that moved there."""
    at = scratch(s, "ranges")
    rows = order_heads(s, d).withColumn("version", F.lit(1).cast("long"))
    orders, layout = BucketTable(s, f"{at}/orders", buckets=8), RangeLayout(s, f"{at}/layout", ranges=8)
    orders.merge(rows)
    layout.build(orders.read(), orders.state()[0])
    moved = rows.where(F.col("order_id").cast("long") % 10 == 0).withColumns({"city": F.lit("NATION_1"), "version": F.lit(2).cast("long")})
    orders.merge(moved)
    layout.update(orders.changes(layout.commit()["seq"]), orders.state()[0])
    return _flat(layout.read(city="NATION_1"))


def _counts(s, d):
    return S.table_counts({t: table(s, d, t) for t in ("orders", "customer", "lineitem")})


def _json(s, d):
    return S.to_json_rows(table(s, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment")))


def _nested_json(s, d):
    k = F.col("c_custkey")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (k % 700).cast("int"))
    items = F.transform(F.sequence(F.lit(1), (k % 3).cast("int")), lambda i: F.struct(i.alias("n"), F.when(i == 2, F.lit(None)).otherwise((k + i).cast("decimal(18,2)") / 2).cast("decimal(18,2)").alias("price")))
    c = table(s, d, "customer").select(
        "c_custkey", (k.cast("decimal(18,2)") / 4).cast("decimal(18,2)").alias("quarter"), day.alias("day"), F.timestamp_add("SECOND", k % 86400, day.cast("timestamp_ntz")).alias("at"),
        F.when(k % 2 == 0, F.encode(F.lit('a"é'), "utf-8")).otherwise(F.unhex(F.lit("ff00"))).alias("raw"), F.when(k % 3 > 0, items).alias("items"), F.create_map(F.lit("x"), k % 2 == 0, F.lit("y"), F.lit(None).cast("boolean")).alias("flags"),
    )
    return S.to_json_rows(c)


NESTED_JSON = """WITH c AS (SELECT c_custkey k, DATE '2020-01-01' + CAST(c_custkey % 700 AS INT) AS dd FROM customer),
 i AS (SELECT k, dd, k % 3 AS n FROM c)
 SELECT '{"c_custkey":' || k || ',"quarter":' || CASE WHEN k % 4 = 0 THEN CAST(k // 4 AS VARCHAR) ELSE CAST(CAST(k AS DOUBLE) / 4 AS VARCHAR) END || ',"day":"' || strftime(dd, '%Y-%m-%d') || '","at":"' || strftime(CAST(dd AS TIMESTAMP) + to_seconds(k % 86400), '%Y-%m-%dT%H:%M:%S')
 || '","raw":' || CASE WHEN k % 2 = 0 THEN '"a\\"é"' ELSE '"ff00"' END || ',"items":' || CASE n WHEN 0 THEN 'null' WHEN 1 THEN '[{"n":1,"price":' || p || '}]' ELSE '[{"n":1,"price":' || p || '},{"n":2,"price":null}]' END || ',"flags":{"x":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"y":null}}' AS json
 FROM (SELECT *, CASE WHEN (k + 1) % 2 = 0 THEN CAST((k + 1) // 2 AS VARCHAR) ELSE CAST(CAST(k + 1 AS DOUBLE) / 2 AS VARCHAR) END p FROM i)"""


def _history(s, d):
    e = table(s, d, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("name"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("started_at"))
    first = e.agg(F.min("name").alias("first"))
    return S.run_history(e.join(first, F.col("name") == F.col("first")).drop("first"), None, 30)


def _sample(s, d):
    return S.sample_rows(table(s, d, "orders").select(F.col("o_orderkey").alias("source_row_number"), "o_orderstatus"), 100)


def _numbers(s, d):
    return S.exact_row_numbers(table(s, d, "orders").select(F.col("o_orderkey").alias("source_row_number"))).select(F.col("source_row_number").alias("o_orderkey"), F.col("row_number").cast("long"))


def _restrict(s, d):
    keys = table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return _flat(K.restrict_to_keys(order_heads(s, d), keys, "customer_id"))


def _raw_resume(s, d):
    raw = table(s, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("order_id"), F.col("event_id").alias("source_row_number"))
    return K.after_row(K.flag_duplicates(raw), 500)


Q = {
    "sales_by_city": (lambda s, d: C.sales_by_city(order_heads(s, d), delivered=DELIVERED), f"WITH {ORDERS} SELECT city, CAST(sum(total_amount) AS DOUBLE) total_revenue, count(*) order_count, {AVG.format('total_amount')} avg_order_value, count(*) FILTER (WHERE status = 'F') delivered_orders FROM od GROUP BY city ORDER BY total_revenue DESC, city LIMIT 20"),
    "orders_by_customer": (_named("orders_by_customer", customer_id="7"), _found("customer_id = '7'")),
    "orders_by_city_and_status": (_named("orders_by_city_and_status", city="NATION_13", status="O"), _found("city = 'NATION_13' AND status = 'O'")),
    "high_value_orders": (_named("high_value_orders", min_amount="200000", limit="500"), _found("total_amount >= 200000", "total_amount DESC, order_id", 500)),
    "orders_by_payment_status": (_named("orders_by_payment_status", payment_status="unpaid"), _found("payment_status = 'unpaid'")),
    "orders_by_payment_status_method": (_named("orders_by_payment_status", payment_status="paid", payment_method="1-URGENT"), _found("payment_status = 'paid' AND payment_method = '1-URGENT'")),
    "orders_containing_item_sku": (lambda s, d: _flat(C.orders_with_sku(order_heads(s, d), raw_skus(s, d), "10")), f"WITH {ORDERS}, {ITEMS} SELECT {FLAT_SQL} FROM od WHERE order_id IN (SELECT order_id FROM it WHERE sku = '10') ORDER BY order_date DESC, order_id LIMIT 50"),
    "top_products": (lambda s, d: C.top_products_of(item_rows(s, d)), f"WITH {ITEMS} SELECT sku, name AS product_name, {PRODUCT_SQL} FROM it GROUP BY sku, name ORDER BY total_revenue DESC, sku, product_name LIMIT 10"),
    "top_customers": (_top_customers, f"WITH {ORDERS} SELECT customer_id, min(customer_name) customer_name, CAST(sum(total_amount) AS DOUBLE) total_spent, count(*) orders_count, {AVG.format('total_amount')} avg_order_value, string_agg(DISTINCT city, ',' ORDER BY city) cities_active FROM od GROUP BY customer_id ORDER BY total_spent DESC, customer_id LIMIT 10"),
    "sales_by_period": (lambda s, d: C.sales_by_period(order_heads(s, d)), f"WITH {ORDERS} SELECT order_date[1:7] AS period, CAST(sum(total_amount) AS DOUBLE) total_revenue, count(*) order_count, {AVG.format('total_amount')} avg_order_value, CAST(sum(delivery_cost) AS DOUBLE) total_delivery_fees FROM od GROUP BY 1"),
    "orders_by_status": (_by_status, f"WITH {ORDERS} {BY_STATUS}"),
    "mv_daily_sales": (lambda s, d: views.daily_sales(order_heads(s, d), DELIVERED), f"WITH {ORDERS} {DAILY_SQL.format('od')}"),
    "mv_top_products": (lambda s, d: views.product_sales_of(item_rows(s, d)), f"WITH {ITEMS} SELECT sku, min_by(name, order_id) product_name, {PRODUCT_SQL} FROM it GROUP BY sku"),
    "mv_refresh_daily": (_refresh_daily, f"WITH {ORDERS}, {REFRESHED} {DAILY_SQL.format('af')}"),
    "mv_refresh_products": (_refresh_products, f"WITH {ITEMS} SELECT sku, min_by(name, order_id) product_name, {PRODUCT_SQL} FROM it WHERE CAST(order_id AS BIGINT) % 50 <> 1 GROUP BY sku"),
    "mv_affected_keys": (_affected, f"WITH {ORDERS}, {REFRESHED}, {ITEMS} SELECT 'date' AS kind, order_date AS key FROM (SELECT order_date FROM af WHERE k % 10 = 0 UNION SELECT order_date FROM od WHERE k % 10 = 0 AND k % 50 <> 1) UNION SELECT 'sku', sku FROM it WHERE CAST(order_id AS BIGINT) % 10 = 0"),
    "job_sales_snapshot": (lambda s, d: C.sales_snapshot(order_heads(s, d), 5, DELIVERED), f"WITH {ORDERS}, c AS (SELECT sum(total_amount) t FROM od GROUP BY city ORDER BY t DESC LIMIT 5) SELECT (SELECT count(*) FROM od) total_orders, (SELECT count(DISTINCT status) FROM od) statuses, (SELECT CAST(sum(t) AS DOUBLE) FROM c) top_cities_revenue, (SELECT count(*) FROM c) cities"),
    "duplicate_keys": (_duplicates, "SELECT CASE WHEN event_id % 11 = 0 THEN ' ' ELSE ' ' || user_id END order_id, event_id source_row_number, event_id % 11 <> 0 AND row_number() OVER (PARTITION BY CASE WHEN event_id % 11 = 0 THEN 'b' ELSE CAST(user_id AS VARCHAR) END ORDER BY event_id) > 1 is_duplicate FROM events"),
    "latest_version": (lambda s, d: C.latest_versions(_versions(s, d), "version", "row"), "SELECT CAST(user_id AS VARCHAR) order_id, event_id % 7 AS version, event_id AS row, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 7 DESC, event_id DESC) = 1"),
    "resume_after_row": (_raw_resume, "SELECT * FROM (SELECT 'u' || user_id AS order_id, event_id source_row_number, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 is_duplicate FROM events) WHERE source_row_number > 500"),
    "versioned_upsert_state": (lambda s, d: _merge(s, d)[0], f"WITH {MERGE} SELECT coalesce(nid, oid) order_id, CASE WHEN act IN ('inserted','updated') THEN nv ELSE ov END AS version, CASE WHEN act IN ('inserted','updated') THEN nr ELSE orr END AS row, CASE WHEN act IN ('inserted','updated') THEN nt ELSE ot END event_type, CASE WHEN act IN ('inserted','updated') THEN nval ELSE oval END AS value, CAST(CASE WHEN act IN ('inserted','updated') THEN 2 ELSE 1 END AS BIGINT) ingest_seq FROM m"),
    "versioned_upsert_actions": (lambda s, d: _merge(s, d)[1], f"WITH {MERGE} SELECT nid order_id, act AS action FROM m WHERE act IS NOT NULL"),
    "ledger_decisions": (_ledger, "SELECT CAST(o_orderkey AS VARCHAR) request_key, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE CAST(o_orderkey % 10 AS VARCHAR) END payload_hash, CASE WHEN o_orderkey % 3 = 0 THEN 'process' WHEN o_orderkey % 7 = 0 THEN 'conflict' WHEN o_orderkey % 2 = 0 THEN 'skip' ELSE 'retry' END decision FROM orders"),
    "stable_ids": (_stable_ids, "SELECT o_orderkey, sha256('req|' || o_orderkey || '|file|' || o_custkey) AS id FROM orders"),
    "payload_hashes": (_payload_hashes, """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}') AS hash FROM customer"""),
    "newest_orders": (_newest, f"WITH {ORDERS} SELECT {FLAT_SQL} FROM od ORDER BY k % 97 DESC, order_id DESC LIMIT 40"),
    "orders_containing_item_sku_docs": (_named("orders_containing_item_sku", sku="10"), f"WITH {ORDERS}, {ITEMS} SELECT {FLAT_SQL} FROM od WHERE order_id IN (SELECT order_id FROM it WHERE sku = '10') ORDER BY order_date DESC, order_id LIMIT 50"),
    "top_products_docs": (lambda s, d: C.top_products(orders_doc(s, d)), f"WITH {ITEMS} SELECT sku, name AS product_name, {PRODUCT_SQL} FROM it GROUP BY sku, name ORDER BY total_revenue DESC, sku, product_name LIMIT 10"),
    "replay_safe_append": (_append_new, "SELECT CAST(o_orderkey AS VARCHAR) _id FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0"),
    "payload_fingerprint": (_fingerprint, "SELECT count(*) n FROM orders"),
    "restrict_to_keys": (_restrict, f"WITH {ORDERS} SELECT {FLAT_SQL} FROM od WHERE customer_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')"),
    "sample_rows": (_sample, "SELECT o_orderkey source_row_number, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100"),
    "exact_row_numbers": (_numbers, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) + 1 AS row_number FROM orders"),
    "orders_as_json": (_json, """SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","segment":' || CASE WHEN c_custkey % 2 = 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || '}' AS json FROM customer"""),
    "nested_as_json": (_nested_json, NESTED_JSON),
    "table_counts": (_counts, "SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'lineitem', count(*) FROM lineitem"),
    "run_history": (_history, "SELECT CAST(event_id AS VARCHAR) run_id, event_type AS name, strftime(ts, '%Y-%m-%d %H:%M:%S') started_at FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY started_at DESC, run_id LIMIT 30"),
    "layout_updated": (_layout_updated, f"WITH {ORDERS} SELECT {FLAT_SQL} FROM (SELECT * REPLACE (CASE WHEN k % 10 = 0 THEN 'NATION_1' ELSE city END AS city) FROM od) WHERE city = 'NATION_1'"),
    "layout_lookup": (_layout, f"WITH {ORDERS}, {ITEMS} SELECT {FLAT_SQL} FROM od WHERE order_id IN (SELECT order_id FROM it WHERE sku = '1')"),
}
