"""Named queries and reports over validated orders, with typed parameters and defaults. Nothing here runs a job."""

from __future__ import annotations

import decimal
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dictionaries import DELIVERED
from ..functions.rules import period_of
from ..operators.keys import latest_per_key, restrict_to_keys, top_k


def sum0(c: Column | str) -> Column:
    """A sum that is 0 for no rows, as double."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def mean(c: str, digits: int = 2) -> Column:
    return F.bround(F.avg(c), digits).cast("double")


# queries ---------------------------------------------------------------------------------------------------------


def at_least(df: DataFrame, column: str, value: float) -> Column:
    """value as the least literal of the column's own type that isn't below it, so that the comparison reaches the scan."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType):
        return F.lit(float(value))
    exact = decimal.Decimal(str(value)).quantize(decimal.Decimal(1).scaleb(-kind.scale), rounding=decimal.ROUND_CEILING)
    return F.lit(exact).cast(kind)


def filter_orders(df: DataFrame, min_amount: float | None = None, sku: str | None = None, **equal: str | None) -> DataFrame:
    """Rows with all the given values; a condition whose value is None or empty isn't applied."""
    for k, v in equal.items():
        df = df.where(F.col(k) == F.lit(v)) if v else df
    df = df.where(F.col("total_amount") >= at_least(df, "total_amount", min_amount)) if min_amount is not None else df
    return df.where(F.exists("items_json", lambda x: x["sku"] == F.lit(sku))) if sku is not None else df


def newest(df: DataFrame, limit: int) -> DataFrame:
    return top_k(df, [F.desc("order_date")], limit, "order_id")


def orders_by_customer(orders: DataFrame, customer_id: str = "عميل-1", limit: int = 50) -> DataFrame:
    return newest(filter_orders(orders, customer_id=customer_id), limit)


def orders_by_city_and_status(orders: DataFrame, city: str = "صنعاء", status: str = "قيد الانتظار", limit: int = 50) -> DataFrame:
    return newest(filter_orders(orders, city=city, status=status), limit)


def high_value_orders(orders: DataFrame, min_amount: float = 500000.0, limit: int = 50) -> DataFrame:
    return top_k(filter_orders(orders, min_amount=min_amount), [F.desc("total_amount")], limit, "order_id")


def orders_by_payment_status(orders: DataFrame, payment_status: str = "بانتظار الدفع", payment_method: str | None = None, limit: int = 50) -> DataFrame:
    return newest(filter_orders(orders, payment_status=payment_status, payment_method=payment_method), limit)


def orders_containing_item_sku(orders: DataFrame, sku: str = "SKU-1010", limit: int = 50) -> DataFrame:
    return newest(filter_orders(orders, sku=sku), limit)


def orders_with_sku(orders: DataFrame, items: DataFrame, sku: str = "SKU-1010", limit: int = 50) -> DataFrame:
    """orders_containing_item_sku() where items are a table of their own: its rows with the sku, then the orders of these."""
    return newest(restrict_to_keys(orders, items.where(F.col("sku") == F.lit(sku)), "order_id"), limit)


# reports ---------------------------------------------------------------------------------------------------------


def sales_by_city(orders: DataFrame, limit: int = 20, delivered: str = DELIVERED) -> DataFrame:
    by = orders.groupBy("city").agg(sum0("total_amount").alias("total_revenue"), F.count("*").alias("order_count"), mean("total_amount").alias("avg_order_value"), F.count_if(F.col("status") == delivered).alias("delivered_orders"))
    return top_k(by, [F.desc("total_revenue")], limit, "city")


def exploded_items(orders: DataFrame) -> DataFrame:
    """order_id, order_date and the item's fields, a row for each item; orders without items have none."""
    return orders.select("order_id", "order_date", F.explode("items_json").alias("item")).select("order_id", "order_date", "item.*")


def _products(items: DataFrame, *by: str) -> DataFrame:
    named = F.min_by("name", F.struct("order_id", "name")).alias("product_name")
    return items.groupBy(*by).agg(named, sum0("qty").alias("total_units_sold"), sum0("total").alias("total_revenue"), F.count("*").alias("orders_count"), mean("unit_price").alias("avg_unit_price"))


def top_products(orders: DataFrame, limit: int = 10) -> DataFrame:
    """By sku and name; orders_count counts items."""
    return top_products_of(exploded_items(orders), limit)


def top_products_of(items: DataFrame, limit: int = 10) -> DataFrame:
    """top_products() from rows (order_id, sku, name, qty, unit_price, total) of single items, where a source has these."""
    return top_k(_products(items, "sku", "name").drop("name"), [F.desc("total_revenue")], limit, "sku", "product_name")


def top_customers(orders: DataFrame, limit: int = 10) -> DataFrame:
    cities = F.array_sort(F.collect_set(F.coalesce("city", F.lit("")))).alias("cities_active")
    by = orders.groupBy("customer_id").agg(F.min_by("customer_name", "order_id").alias("customer_name"), sum0("total_amount").alias("total_spent"), F.count("*").alias("orders_count"), mean("total_amount").alias("avg_order_value"), cities)
    return top_k(by, [F.desc("total_spent")], limit, "customer_id")


def sales_by_period(orders: DataFrame) -> DataFrame:
    by = orders.groupBy(period_of(F.col("order_date"), 7).alias("period"))
    return by.agg(sum0("total_amount").alias("total_revenue"), F.count("*").alias("order_count"), mean("total_amount").alias("avg_order_value"), sum0("delivery_cost").alias("total_delivery_fees")).orderBy("period")


def orders_by_status(orders: DataFrame) -> DataFrame:
    methods = F.array_sort(F.collect_set(F.coalesce("payment_method", F.lit("")))).alias("payment_methods_used")
    return orders.groupBy("status").agg(F.count("*").alias("count"), sum0("total_amount").alias("cumulative_value"), methods).orderBy(F.desc("count"), "status")


def error_counts(classified: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = classified.where(F.col("run_id") == run_id) if run_id else classified
    return rows.select(F.explode("error_codes").alias("error_code")).groupBy("error_code").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "error_code")


def status_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("quality_status").agg(F.count("*").alias("count")).orderBy("quality_status")


def latest_versions(orders: DataFrame, version_field: str = "version", *tie_break: str) -> DataFrame:
    return latest_per_key(orders, "order_id", version_field, *tie_break).orderBy("order_id")


def run_summary(classified: DataFrame, run_id: str | None = None) -> DataFrame:
    rows = classified.where(F.col("run_id") == run_id) if run_id else classified
    return rows.agg(F.count("*").alias("raw_loaded"), F.count_if(F.col("quality_status") == "quarantined").alias("quarantine_count"))


def run_metrics(classified: DataFrame) -> DataFrame:
    """raw, valid, corrected, quarantined and whether they add up."""
    n = lambda s: F.count_if(F.col("quality_status") == s)
    m = classified.agg(F.count("*").alias("raw"), n("valid").alias("valid"), n("corrected").alias("corrected"), n("quarantined").alias("quarantined"))
    return m.withColumn("consistent", F.col("raw") == F.col("valid") + F.col("corrected") + F.col("quarantined"))


#: How rows are written that are read a few times and whole: dictionaries and statistics cost as much as the writing itself, and nobody skips anything by them.
PASSING = {"parquet.enable.dictionary": "false", "parquet.column.statistics.enabled": "false", "compression": "lz4_raw"}


def counted_write(classified: DataFrame, path: str) -> dict[str, int]:
    """Writes classified rows and gives raw, valid, corrected, quarantined and surplus (rows with surplus columns), observed while they are written."""
    seen = Observation()
    status = lambda s: F.count_if(F.col("quality_status") == s).alias(s)
    surplus = F.count("surplus_text") if "surplus_text" in classified.columns else F.lit(0).cast("long")
    counted = classified.observe(seen, F.count(F.lit(1)).alias("raw"), status("valid"), status("corrected"), status("quarantined"), surplus.alias("surplus"))
    counted.write.mode("overwrite").options(**PASSING).parquet(path)
    return seen.get


def counts_of(path: str, spark: SparkSession) -> dict[str, int]:
    """What counted_write() gave, from the rows it wrote."""
    rows = spark.read.parquet(path)
    surplus = F.count("surplus_text") if "surplus_text" in rows.columns else F.lit(0).cast("long")
    return run_metrics(rows).drop("consistent").crossJoin(rows.agg(surplus.alias("surplus"))).first().asDict()


def metrics_row(spark: SparkSession, counts: dict[str, int], run_id: str, name: str) -> DataFrame:
    """run_metrics() from counts, with run_id, name and started_at."""
    raw, valid, corrected, quarantined = (counts[k] for k in ("raw", "valid", "corrected", "quarantined"))
    row = (raw, valid, corrected, quarantined, raw == valid + corrected + quarantined, run_id, name)
    return spark.createDataFrame([row], "raw long, valid long, corrected long, quarantined long, consistent boolean, run_id string, name string").withColumn("started_at", F.current_timestamp())


def max_error_counts(runs: DataFrame) -> DataFrame:
    """error_code and its highest count in any run, from rows (run_id, error_code, count)."""
    return runs.groupBy("error_code").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "error_code")


def sales_snapshot(orders: DataFrame, cities: int = 5, delivered: str = DELIVERED) -> DataFrame:
    """One row: orders over all statuses, revenue of the top cities, and how many statuses and cities these are."""
    by_status = orders_by_status(orders).agg(sum0("count").cast("long").alias("total_orders"), F.count("*").alias("statuses"))
    by_city = sales_by_city(orders, cities, delivered).agg(sum0("total_revenue").alias("top_cities_revenue"), F.count("*").alias("cities"))
    return by_status.join(by_city)  # one row each


CATALOG: dict[str, tuple[Callable, dict[str, type]]] = {
    "orders_by_customer": (orders_by_customer, {"customer_id": str, "limit": int}),
    "orders_by_city_and_status": (orders_by_city_and_status, {"city": str, "status": str, "limit": int}),
    "high_value_orders": (high_value_orders, {"min_amount": float, "limit": int}),
    "orders_by_payment_status": (orders_by_payment_status, {"payment_status": str, "payment_method": str, "limit": int}),
    "orders_containing_item_sku": (orders_containing_item_sku, {"sku": str, "limit": int}),
    "sales_by_city": (sales_by_city, {"limit": int}),
    "top_products": (top_products, {"limit": int}),
    "top_customers": (top_customers, {"limit": int}),
    "sales_by_period": (sales_by_period, {}),
    "orders_by_status": (orders_by_status, {}),
}


def run_named(orders: DataFrame, name: str, **params) -> DataFrame:
    """The query or report `name` with parameters brought to their types; unknown names raise ValueError."""
    if name not in CATALOG:
        raise ValueError(f"unknown query: {name}")
    build, kinds = CATALOG[name]
    if odd := set(params) - set(kinds):
        raise ValueError(f"unknown parameters of {name}: {sorted(odd)}")
    return build(orders, **{k: kinds[k](v) for k, v in params.items() if v is not None})
