"""Orders in the engine's layout from the given tables, and dirty text made from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.keys import flag_duplicates

MONEY = "decimal(18,2)"
DELIVERED = "F"  #: the given tables' status that stands for delivered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out evenly over all cores by its rows: rules cost far more than reading or a shuffle of what they read.

    The number of a scan's splits tells nothing: a Parquet file is split by bytes, but each row group is read whole by one of its splits, and the others stay empty.
    """
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *df.columns)


def order_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without their items."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # nation: 25 rows
    k = F.col("o_orderkey")
    return rows.select(
        k.cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("city"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("payment_method"),
        F.when(k % 3 == 0, "paid").when(k % 3 == 1, "pending").otherwise("unpaid").alias("payment_status"),
        ((k % 4) * 500).cast(MONEY).alias("delivery_cost"), F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    )


def item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, line and the item's fields, a row for each line whose order and part there are."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    rows = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").join(orders, "l_orderkey", "left_semi").join(p, F.col("l_partkey") == F.col("p_partkey"))
    qty, price = F.col("l_quantity").cast(MONEY), F.col("p_retailprice").cast(MONEY)
    return rows.select(
        F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("sku"), F.col("p_name").alias("name"),
        qty.alias("qty"), price.alias("unit_price"), F.round(qty * price, 2).cast(MONEY).alias("total"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id and items_json, the order's items in the order of their lines."""
    item = F.struct("sku", "name", "qty", "unit_price", "total")
    # an order has a few lines; the list is as long as the order
    by = item_rows(spark, sf_dir).groupBy("order_id").agg(F.sort_array(F.collect_list(F.struct("line", item.alias("item")))).alias("l"))
    return by.select("order_id", F.transform("l", lambda x: x["item"]).alias("items_json"))


def raw_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id and sku of each line, by the scan of lines alone."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_partkey").cast("string").alias("sku"))


def orders_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their items; items_json is null where an order has none."""
    return order_heads(spark, sf_dir).join(items(spark, sf_dir), "order_id", "left")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders as text, with faults that the order key decides; its SQL twin tells what each must become."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    qty, price = k % 5 + 1, k % 100 + 10
    arabic = lambda x: F.translate(x.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    date = (
        F.when(k % 17 == 0, "31/02/2025").when(k % 5 == 0, F.date_format(d, "dd/MM/yyyy")).when(k % 5 == 1, F.date_format(d, "yyyy-MM-dd"))
        .when(k % 5 == 2, (F.unix_date(d.cast("date")).cast("long") * 86400000).cast("string")).when(k % 5 == 3, F.date_format(d, "dd-MM-yyyy 15:30:45")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    )
    total = qty * price + F.when(k % 3 == 0, 1000).otherwise(1500)
    right = F.when(k % 3 == 0, qty * price).otherwise(qty * price + 1500)
    return o.select(
        F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("طلب "), (k + 200000).cast("string"))).alias("order_id"), date.alias("order_date"),
        F.when(k % 2 == 0, " مؤكد ").otherwise("Confirmed").alias("status"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("عميل-"), c.cast("string"))).alias("customer_id"),
        F.concat(F.lit("Dr. Name "), c.cast("string")).alias("customer_name"), F.concat(F.lit("+967 7"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("customer_phone"),
        F.when(k % 19 == 0, "bad").otherwise(F.concat(F.lit("u"), k.cast("string"), F.lit("@@mail..com"))).alias("customer_email"), F.when(k % 2 == 0, "صنعا").otherwise("عدن").alias("city"),
        F.lit("التحرير").alias("district"), F.lit("normal").alias("delivery_type"), F.when(k % 3 == 0, "").otherwise("١٥٠٠ ريال").alias("delivery_cost"), F.lit("cash").alias("payment_method"),
        F.lit("paid").alias("payment_status"), F.lit("").alias("payment_amount"), F.lit("ريال يمني").alias("currency"),
        F.when(k % 29 == 0, "-7").when(k % 23 == 0, F.concat(F.lit("-"), right.cast("string"))).otherwise(arabic(total)).alias("total_amount"),
        F.when(k % 31 == 0, "[]").when(k % 37 == 0, '{"sku":"x"}').otherwise(F.concat(F.lit('[{"sku":"S'), (k % 50).cast("string"), F.lit('","name":"n","qty":"'), arabic(qty), F.lit('","unit_price":"'), price.cast("string"), F.lit('","total":"0"}]'))).alias("items_json"),
        k.alias("source_row_number"),
    )


def mixed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixed_rows() with is_duplicate."""
    return flag_duplicates(mixed_rows(spark, sf_dir))


def mixed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw orders as text in four currencies, with two items each, fractional quantities, unknown prices and repeated order ids, all decided
    by the order key."""
    o = spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    number = (k - k % 2 + 200000).cast("string")
    qty = (((k % 8) * 125 + 1000).cast("decimal(10,0)") / 1000).cast("decimal(10,3)")
    price = ((k % 50) * 10 + 15).cast("decimal(10,0)") / 10
    known = F.round(qty * price, 2) + F.when(k % 5 == 0, 4000).otherwise(6) + F.when(k % 3 == 2, 10).otherwise(0)
    other = F.when(k % 5 == 0, "ألفين").when(k % 5 == 1, "n/a").otherwise("3")
    items = F.concat(F.lit('[{"sku":"a","name":"x","qty":'), qty.cast("string"), F.lit(',"unit_price":"'), price.cast("decimal(10,1)").cast("string"), F.lit('","color":"red"},{"sku":"b","qty":"٢","unit_price":"'), other, F.lit('"}]'))
    return o.select(
        F.when(k % 11 == 0, "").when(k % 5 == 2, F.concat(F.lit("طلب "), number)).otherwise(F.concat(F.lit("طلب-"), number)).alias("order_id"), F.date_format(d, "dd/MM/yyyy").alias("order_date"),
        F.lit("new").alias("status"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("عميل "), c.cast("string"))).alias("customer_id"), F.concat(F.lit("Dr. N"), c.cast("string")).alias("customer_name"),
        F.concat(F.lit("+967 7"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("customer_phone"), F.concat(F.lit("u"), k.cast("string"), F.lit("@@x.com")).alias("customer_email"),
        F.lit(" عدن").alias("city"), F.lit("المعلا").alias("district"), F.when(k % 3 == 0, "express").when(k % 3 == 1, "instant").otherwise("normal").alias("delivery_type"),
        F.when(k % 3 == 2, "10").otherwise("").alias("delivery_cost"), F.lit("cash").alias("payment_method"), F.lit("paid").alias("payment_status"), F.when(k % 2 == 0, "").otherwise("5").alias("payment_amount"),
        F.when(k % 4 == 0, "usd").when(k % 4 == 1, "SAR").when(k % 4 == 2, "ريال").otherwise("eur").alias("currency"),
        F.when(k % 7 == 1, "").when((k % 7 == 0) & (k % 4 >= 2), F.concat(F.lit("-"), known.cast("decimal(18,2)").cast("string"))).otherwise("1").alias("total_amount"), items.alias("items_json"),
        k.alias("source_row_number"),
    )
