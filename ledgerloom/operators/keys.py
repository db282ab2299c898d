"""Operators on keys: duplicates, latest versions, resuming, merging by version, replay-safe appends, fingerprints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import as_long, strip


def trimmed_key(key: str) -> Column:
    return strip(F.coalesce(F.col(key), F.lit("")))


def first_rows(df: DataFrame, key: str, order: tuple[str, ...], within: tuple[str, ...] = ()) -> DataFrame:
    """_key (trimmed, not blank), the columns of within, _first (struct of `order` of the first row) and _n, the number of rows, of each key. Only these columns are read, and
    a key of any number of rows sends one from each task."""
    rows = df.select(*within, trimmed_key(key).alias("_key"), F.struct(*order).alias("_at")).where("_key != ''")
    return rows.groupBy(*within, "_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))


def behind_first(df: DataFrame, firsts: DataFrame, key: str, order: tuple[str, ...], within: tuple[str, ...] = (), seen: Column | None = None) -> DataFrame:
    """df and is_duplicate: whether firsts (_key, within, _first) has an earlier row for its key, or `seen` holds there."""
    known = firsts.select(*(F.col(c).alias(f"_{c}") for c in within), "_key", "_first", (F.lit(False) if seen is None else seen).alias("_seen"))
    on = (trimmed_key(key) == F.col("_key")) & functools.reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in within], F.lit(True))
    later = F.coalesce(F.col("_seen") | (F.struct(*order) > F.col("_first")), F.lit(False))
    return df.join(known, on, "left").withColumn("is_duplicate", later).select(*df.drop("is_duplicate").columns, "is_duplicate")


def flag_duplicates(df: DataFrame, key: str = "order_id", order: tuple[str, ...] = ("source_row_number",), within: tuple[str, ...] = ()) -> DataFrame:
    """df and is_duplicate: whether an earlier row (by `order`, in the same group of `within`) has the same trimmed key.

    Blank keys are never duplicates, nor are rows that share a key's first place. df is read twice, the first time by its keys alone; only keys of several rows are
    joined to it, so that no key's rows have to meet in one task.
    """
    return behind_first(df, first_rows(df, key, order, within).where("_n > 1"), key, order, within)


def after_row(flagged: DataFrame, row: int) -> DataFrame:
    """What a run that stopped after `row` still has to do; duplicates were judged over all rows before."""
    return flagged.where(F.col("source_row_number") > row)


def latest_per_key(df: DataFrame, key: str, version: str, *tie_break: str) -> DataFrame:
    """The row of each key with the highest version (null lowest), then the highest tie_break columns. A key's rows are compared where they lie first, so that
    a key of any number of rows sends one from each task."""
    order = [x for c in (version, *tie_break) for x in (F.col(c).isNotNull(), F.col(c))]
    row = F.struct(*df.columns)
    best = df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def _outcome(current: DataFrame, incoming: DataFrame, key: str, version: str, tie_break: tuple[str, ...], how: str = "full_outer", latest: bool = False) -> tuple[DataFrame, list[str], Column]:
    """Current rows (c) and the latest incoming ones (i) side by side with _action, the columns beside the key, and whether the incoming row is taken. how left: incoming
    has one row for each key already and is broadcast; keys that are new are left out."""
    columns = [c for c in incoming.columns if c not in (key, "ingest_seq")]
    payload = [c for c in columns if c != version and c not in tie_break]
    new = F.broadcast(incoming) if how == "left" else incoming if latest else latest_per_key(incoming, key, version, *tie_break)
    both = current.alias("c").join(new.alias("i"), F.col(f"c.{key}") == F.col(f"i.{key}"), how)
    cv, iv = as_long(F.col(f"c.{version}").cast("string")), as_long(F.col(f"i.{version}").cast("string"))
    same = functools.reduce(Column.__and__, [F.col(f"c.{c}").eqNullSafe(F.col(f"i.{c}")) for c in payload], F.lit(True))
    action = (
        F.when(F.col(f"i.{key}").isNull(), F.lit(None))
        .when(F.col(f"c.{key}").isNull(), "inserted")
        .when(cv.isNotNull() & (iv.isNull() | (iv <= cv)), "unchanged")
        .when(same, "unchanged")
        .otherwise("updated")
    )
    return both.withColumn("_action", action), columns, F.coalesce(F.col("_action").isin("inserted", "updated"), F.lit(False))


def merge_orders(current: DataFrame, incoming: DataFrame, key: str = "order_id", version: str = "version", tie_break: tuple[str, ...] = (), ingest_seq: int = 0) -> tuple[DataFrame, DataFrame]:
    """The snapshot after a version-protected upsert, and (key, action) of each incoming key.

    Several incoming rows of a key count as their latest. A key that isn't there is inserted. An incoming row without a
    version never replaces one with a version, nor does a version that isn't newer; otherwise it updates unless all
    columns but the version and `ingest_seq` are equal. Written rows get the number `ingest_seq`.
    """
    both, columns, takes = _outcome(current, incoming, key, version, tie_break)
    seq = F.col("c.ingest_seq") if "ingest_seq" in current.columns else F.lit(0)
    pick = lambda c: F.when(takes, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
    snapshot = both.select(F.coalesce(F.col(f"i.{key}"), F.col(f"c.{key}")).alias(key), *(pick(c) for c in columns), F.when(takes, F.lit(ingest_seq)).otherwise(seq).cast("long").alias("ingest_seq"))
    actions = both.where(F.col("_action").isNotNull()).select(F.col(f"i.{key}").alias(key), F.col("_action").alias("action"))
    return snapshot, actions


def merged(current: DataFrame, incoming: DataFrame, key: str = "order_id", version: str = "version", tie_break: tuple[str, ...] = (), few: bool = False, latest: bool = False) -> DataFrame:
    """The snapshot of merge_orders() in one pass with _action (null for keys that don't come in) and _old, the row before of an updated key;
    ingest_seq is null where the incoming row was taken.

    latest: incoming has one row for each key already. few: so it has, and is proven to be small. It is broadcast then, and current rows stay where they lie; which keys are new is found
    by another scan of current's keys alone.
    """

    def rows(both: DataFrame, columns: list[str], takes: Column) -> DataFrame:
        pick = lambda c: F.when(takes, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c)
        old = F.when(F.col("_action") == "updated", F.struct(*(F.col(f"c.{c}").alias(c) for c in (key, *columns)))).alias("_old")
        return both.select(F.coalesce(F.col(f"i.{key}"), F.col(f"c.{key}")).alias(key), *(pick(c) for c in columns), F.when(~takes, F.col("c.ingest_seq")).cast("long").alias("ingest_seq"), "_action", old)

    if not few:
        return rows(*_outcome(current, incoming, key, version, tie_break, latest=latest))
    there = rows(*_outcome(current, incoming, key, version, tie_break, "left"))
    known = current.select(F.col(key).alias("_known")).join(F.broadcast(incoming.select(F.col(key).alias("_key"))), F.col("_known") == F.col("_key"), "left_semi")
    new = incoming.join(known, F.col(key) == F.col("_known"), "left_anti").select(*(c for c in there.columns if c not in ("ingest_seq", "_action", "_old")))
    return there.unionByName(new.withColumns({"ingest_seq": F.lit(None).cast("long"), "_action": F.lit("inserted"), "_old": F.lit(None).cast(there.schema["_old"].dataType)}))


def inserted(incoming: DataFrame, key: str = "order_id") -> DataFrame:
    """What merged() gives for incoming rows, one for each key, where no current row has such a key."""
    columns = [key, *(c for c in incoming.columns if c not in (key, "ingest_seq"))]
    none = F.when(F.lit(False), F.struct(*columns))
    return incoming.select(*columns, F.lit(None).cast("long").alias("ingest_seq"), F.lit("inserted").alias("_action"), none.alias("_old"))


def ledger_decision(ledger: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (request_key, payload_hash) with decision: process, skip, retry or conflict."""
    known = ledger.select("request_key", F.col("payload_hash").alias("_hash"), F.col("status").alias("_status"))
    decision = (
        F.when(F.col("_hash").isNull(), "process")
        .when(F.col("_hash") != F.col("payload_hash"), "conflict")
        .when(F.col("_status") == "completed", "skip")
        .otherwise("retry")
    )
    return requests.join(known, "request_key", "left").withColumn("decision", decision).drop("_hash", "_status")


def append_new(existing: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key isn't there yet, each key once."""
    return df.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def named_hash(df: DataFrame, *cols: str) -> Column:
    """64-bit hash of a row's fields and their names, whatever the order of columns."""
    return F.xxhash64(*(x for c in sorted(cols or df.columns) for x in (F.lit(c), F.col(c))))


def payload_hash(df: DataFrame, *without: str) -> Column:
    """SHA-256 of a row's canonical JSON: fields in the order of their names, nulls included, those of `without` left out."""
    return F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns) if c not in without)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame, *cols: str) -> DataFrame:
    """One row (n, xor, sum) that depends on the rows of df alone (fields and names), not on their order or partitions."""
    h = named_hash(df, *cols)
    return df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum"))


def restrict_to_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return df.join(keys.select(on).distinct(), on, "left_semi")


def replace_keys(view: DataFrame, fresh: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """view with the rows of `keys` replaced by those of fresh; a key without fresh rows goes."""
    return view.join(keys.select(on).distinct(), on, "left_anti").unionByName(fresh)


def top_k(df: DataFrame, order: list[Column], n: int, *tie_break: str) -> DataFrame:
    return df.orderBy(*order, *tie_break).limit(n)
