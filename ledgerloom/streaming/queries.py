"""Streaming queries run to the end of what is there; each equals a batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.classify import FIELDS
from ..operators.keys import latest_per_key
from ..plans.adapter import mixed_rows, table
from ..plans.queries_mixed import MIXED, MIXED_ERRORS, MIXED_ID
from ..plans.scratch import scratch
from ..sources.buckets import BucketTable
from . import ingest as I
from .loads import SeenKeys, StreamLoad
from .polls import Poller


def _daily(s, d):
    """Daily sums of the events, kept by a stateful aggregation that writes each micro-batch's changed days."""
    at, schema = scratch(s, "daily"), table(s, d, "events").schema
    events = I.file_stream(s, schema, d, "events.parquet").select("ts", F.col("value").cast("decimal(18,6)").alias("value"))
    query = I.daily_stream(events, "ts", "value").writeStream.outputMode("update").foreachBatch(lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{at}/out")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    if not query.awaitTermination(600):
        query.stop()
        raise TimeoutError("daily stream")
    out = s.read.parquet(f"{at}/out")
    return latest_per_key(out, "day", "batch").select("day", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def _upsert(s, d):
    """Events of a folder merged by user, version event_id; a second run over the same checkpoint adds nothing."""
    at, schema = scratch(s, "upsert"), table(s, d, "events").schema
    state = BucketTable(s, f"{at}/table", buckets=8)
    for _ in range(2):
        new = I.file_stream(s, schema, d, "events.parquet").select(F.col("user_id").cast("string").alias("order_id"), F.col("event_id").alias("version"), "event_type", "value")
        I.upsert_stream(new, f"{at}/state", state, "version")
    return state.read().select("order_id", "version", "event_type", "value")


def _decisions(s, d):
    """Days of events as source files, against a state that knows some of them."""
    rows = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("source_key"), F.col("event_id").alias("version"), "value")
    first = I.source_decisions(rows, s.createDataFrame([], "source_key string, content_hash string, last_version long"))
    day = F.dayofmonth(F.col("source_key").cast("date"))
    state = first.where(day % 3 != 0).select("source_key", F.when(day % 3 == 1, F.col("content_hash")).otherwise("other").alias("content_hash"), F.when(day % 2 == 0, F.col("max_version")).otherwise(0).alias("last_version"))
    return I.source_decisions(rows, state).select("source_key", "max_version", "decision")


def _marked(s, d):
    """The state after the decided days were processed; days that weren't keep what they had."""
    rows = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("source_key"), F.col("event_id").alias("version"), "value")
    day = F.dayofmonth(F.col("source_key").cast("date"))
    now = I.source_decisions(rows, s.createDataFrame([], "source_key string, content_hash string, last_version long"))
    state = now.where(day % 3 != 0).select("source_key", F.when(day % 3 == 1, F.col("content_hash")).otherwise("other").alias("content_hash"), F.when(day % 2 == 0, F.col("max_version") + 5).otherwise(0).alias("last_version"))
    after = I.mark_success(state, I.source_decisions(rows, state))
    known = now.select("source_key", F.col("content_hash").alias("now"))
    return after.join(known, "source_key").select("source_key", (F.col("content_hash") == F.col("now")).alias("current"), "last_version")


class _Broken(Exception):
    """What stands for a lost driver."""


def _stream_load(s, d):
    """Mixed orders in three drops of CSV files, a batch for each, of which the second breaks off twice, behind its merge and behind its quarantine."""
    at = scratch(s, "stream-load")
    k = F.col("source_row_number")
    load = StreamLoad(s, f"{at}/w", f"{at}/in")
    for drop in range(3):
        rows = mixed_rows(s, d).where(k % 3 == drop).repartitionByRange(k).sortWithinPartitions(k).select(*FIELDS)
        rows.write.option("header", True).option("escape", '"').csv(f"{at}/in/{drop}")
        for broken in ("_held", "_measured") if drop == 1 else ():
            def fail(*_):
                raise _Broken
            setattr(load, broken, fail)
            try:
                load.run(f"{at}/state")
            except Exception as e:  # the stream's own exception, around ours
                if "_Broken" not in str(e):
                    raise
            delattr(load, broken)
        load.run(f"{at}/state")
    held = s.read.parquet(load.w.path("quarantine"))
    mail = F.regexp_extract("customer_email", "^u([0-9]+)@", 1).cast("long")
    runs = s.read.parquet(load.w.path("run_metrics")).agg(F.sum("raw").alias("raw"), F.count("*").alias("batches")).first()
    return held.select(mail.alias("k"), F.array_join("error_codes", ",").alias("errors")).withColumns({"raw": F.lit(runs["raw"]), "batches": F.lit(runs["batches"]), "orders": F.lit(load.w.orders.read().count())})


def _stream_duplicates(s, d):
    """Events as five batches, users as keys, against the keys of earlier batches; the third batch comes twice."""
    at, out = scratch(s, "seen"), None
    seen = SeenKeys(s, f"{at}/keys", 16)
    e = table(s, d, "events").select(F.when(F.col("event_id") % 11 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("user_id").cast("string"))).alias("order_id"), F.col("event_id").alias("source_row_number"))
    for n in (0, 1, 2, 2, 3, 4):
        rows = e.where((F.col("source_row_number") * 7 + F.floor(F.col("source_row_number") / 3)) % 5 == n)
        flagged = seen.flag(rows, "order_id", ("source_row_number",), n, f"{at}/work{n}")
        flagged.write.mode("overwrite").parquet(f"{at}/out/n={n}")
        seen.mark(n, f"{at}/work{n}")
    return s.read.parquet(f"{at}/out").select("order_id", "source_row_number", "is_duplicate")


class _Interleaved(BucketTable):
    """A table whose merge lets another one commit after it has read and before it commits."""

    other = None

    def _committed(self, *a):
        other, self.other = self.other, None
        if other:
            other()
        return super()._committed(*a)


def _merge_conflict(s, d):
    """Two merges at a time, twice: of the same users, of which the first must run again, and of users that share no bucket."""
    at = scratch(s, "conflict")
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("order_id"), F.col("event_id").alias("version"), "event_type", "value")
    one, two = _Interleaved(s, f"{at}/t", buckets=8), BucketTable(s, f"{at}/t", buckets=8)
    part = lambda n: e.where(F.col("version") % 5 == n)
    one.merge(part(0))
    one.other = lambda: two.merge(part(1))
    one.merge(part(2))
    low = F.pmod(F.xxhash64("order_id"), F.lit(8)) < 4
    one.other = lambda: two.merge(part(3).where(low))
    one.merge(part(3).where(~low))
    return one.read().select("order_id", "version", "event_type", "value").withColumn("states", F.lit(one.state()[0]))


def _differences(s, d):
    """What differs between users' newest events without a fifth of them and with it, where every tenth user has all."""
    at = scratch(s, "differences")
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("order_id"), F.col("event_id").alias("version"), "event_type", "value")
    one, two = BucketTable(s, f"{at}/a", buckets=8), BucketTable(s, f"{at}/b", buckets=8)
    old = e.where("version % 5 > 0 and cast(order_id as long) % 7 > 0")
    one.merge(old)
    two.merge(old)
    few = F.col("order_id").cast("long") % 10 == 3
    two.merge(e.where(few))
    one.merge(e.where(few & (F.col("version") % 5 > 0)))
    return one.differences(two)


def _polls(s, d):
    """Users' events as twelve sources, polled three times. Before the second time a quarter stays as it is, one is written again, one loses its newest events, and one gets
    newer ones; before the third nothing changes."""
    at = scratch(s, "polls")
    e = table(s, d, "events").select("user_id", "event_id", "value")

    def write(rows, i):
        rows.where(F.col("user_id") % 12 == i).select(F.col("event_id").alias("version"), "value").write.mode("overwrite").option("header", True).csv(f"{at}/in/{i:02d}")

    read = lambda paths: s.read.schema("version long, value double").option("header", True).csv(paths).select("version", "value", F.col("_metadata.file_path").alias("_path"))
    poller, loaded = Poller(s, f"{at}/state", f"{at}/in", read, by_folder=True), []
    for i in range(12):
        write(e, i)
    for n in range(3):
        decided = poller.run(loaded.extend)
        decided.select(F.lit(n).alias("poll"), F.right("source_key", F.lit(2)).cast("int").alias("source"), "opened", "decision", "max_version").write.parquet(f"{at}/out/{n}")
        if n == 0:
            changed = {1: e, 2: e.where("event_id % 10 < 9"), 3: e.withColumn("event_id", F.col("event_id") + 1_000_000_000)}
            for i in range(12):
                if i % 4:
                    write(changed[i % 4], i)
    return s.read.option("recursiveFileLookup", True).parquet(f"{at}/out")


POLLS = """WITH v AS (SELECT CAST(user_id % 12 AS INT) source, max(event_id) m, max(event_id) FILTER (WHERE event_id % 10 < 9) AS less FROM events GROUP BY 1), p AS (SELECT unnest([0, 1, 2]) AS poll)
 SELECT CAST(poll AS INT) AS poll, source, poll = 0 OR (poll = 1 AND source % 4 <> 0) OR (poll = 2 AND source % 4 = 2) AS opened,
 CASE WHEN poll = 0 OR (poll = 1 AND source % 4 = 3) THEN 'process' WHEN source % 4 = 2 THEN 'not_newer' ELSE 'unchanged' END AS decision,
 CASE WHEN poll = 0 THEN m WHEN source % 4 = 2 THEN less WHEN source % 4 = 3 THEN m + 1000000000 ELSE m END max_version FROM v, p"""
STREAM_MIXED = MIXED.replace("ORDER BY k)", "ORDER BY k % 3, k)")
DIFFERENCES = """WITH e AS (SELECT *, user_id % 7 > 0 AND event_id % 5 > 0 AS old, user_id % 10 = 3 AS few FROM events),
 a AS (SELECT user_id, max(event_id) v FROM e WHERE old OR (few AND event_id % 5 > 0) GROUP BY 1), b AS (SELECT user_id, max(event_id) v FROM e WHERE old OR few GROUP BY 1)
 SELECT CAST(coalesce(a.user_id, b.user_id) AS VARCHAR) order_id, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'missing' ELSE 'changed' END kind FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.v IS DISTINCT FROM b.v"""
Q = {
    "table_differences": (_differences, DIFFERENCES),
    "poll_decisions": (_polls, POLLS),
    "stream_load": (_stream_load, f"WITH {STREAM_MIXED} SELECT k, {MIXED_ERRORS} AS errors, (SELECT count(*) FROM m) raw, CAST(3 AS BIGINT) batches, (SELECT count(DISTINCT {MIXED_ID}) FROM m WHERE n = 0) orders FROM m WHERE n > 0"),
    "stream_duplicates": (_stream_duplicates, "SELECT CASE WHEN event_id % 11 = 0 THEN ' ' ELSE ' ' || user_id END order_id, event_id source_row_number, event_id % 11 <> 0 AND row_number() OVER (PARTITION BY CASE WHEN event_id % 11 = 0 THEN 'b' ELSE CAST(user_id AS VARCHAR) END ORDER BY (event_id * 7 + event_id // 3) % 5, event_id) > 1 is_duplicate FROM events"),
    "merge_conflict": (_merge_conflict, "SELECT CAST(user_id AS VARCHAR) order_id, event_id AS version, event_type, value, CAST(5 AS INT) states FROM events WHERE event_id % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "mark_success": (_marked, "SELECT source_key, NOT (dd % 3 = 2 AND dd % 2 = 0) AS current, CASE WHEN dd % 3 = 0 THEN v WHEN dd % 2 = 0 THEN v + 5 WHEN dd % 3 = 1 THEN 0 ELSE v END last_version FROM (SELECT strftime(ts, '%Y-%m-%d') source_key, day(min(ts)) dd, max(event_id) v FROM events GROUP BY 1)"),
    "stream_daily_sales": (_daily, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) n, round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) total FROM events GROUP BY 1"),
    "stream_versioned_upsert": (_upsert, "SELECT CAST(user_id AS VARCHAR) order_id, event_id AS version, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "source_decisions": (_decisions, "SELECT source_key, v max_version, CASE WHEN dd % 3 = 0 THEN 'process' WHEN dd % 3 = 1 THEN 'unchanged' WHEN dd % 2 = 0 THEN 'not_newer' ELSE 'process' END AS decision FROM (SELECT strftime(ts, '%Y-%m-%d') source_key, day(min(ts)) dd, max(event_id) v FROM events GROUP BY 1)"),
}
