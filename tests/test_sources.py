"""CSV by header, surplus columns, row numbers, replay-safe ids, the bucket table, and loads that broke off."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.classify import FIELDS
from ledgerloom.plans import jobs
from ledgerloom.sources import orders as S
from ledgerloom.sources.buckets import BucketTable, Conflict
from ledgerloom.sources.commits import CommitLog
from ledgerloom.sources.layout import RangeLayout
from ledgerloom.streaming.loads import StreamLoad
from ledgerloom.streaming.polls import Poller


def write(path, *lines, bom=False):
    path.mkdir(exist_ok=True)
    (path / f"f{len(list(path.iterdir()))}.csv").write_bytes((b"\xef\xbb\xbf" if bom else b"") + "".join(x + "\n" for x in lines).encode())
    return str(path)


def test_csv_goes_by_header_names(spark, tmp_path):
    at = write(tmp_path / "a", "customer_id,note,order_id,items_json", 'c1,n,o1,"[{""sku"":""a,b""}]"', "c2,n", "c3,n,o3,[],more", 'c4,n,o4,"[]",', "c5,n,o5,", bom=True)
    got = {r.customer_id: r for r in S.read_orders_csv(spark, at).collect()}
    assert set(S.read_orders_csv(spark, at).columns) == {*FIELDS, "has_surplus", "surplus_text", "source_file"}
    assert (got["c1"].order_id, got["c1"].items_json, got["c1"].has_surplus, got["c1"].city) == ("o1", '[{"sku":"a,b"}]', False, None)
    assert (got["c2"].order_id, got["c2"].has_surplus) == (None, False)
    assert (got["c3"].order_id, got["c3"].has_surplus, got["c3"].surplus_text) == ("o3", True, "c3,n,o3,[],more")
    assert (got["c4"].has_surplus, got["c5"].has_surplus) == (True, False)


def test_csv_without_a_header_is_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        S.read_orders_csv(spark, write(tmp_path / "a", "o1,2024-01-01,new"))
    with pytest.raises(ValueError):
        S.read_orders_csv(spark, write(tmp_path / "b"))
    mixed = write(tmp_path / "c", "order_id,city", "o1,x")
    write(tmp_path / "c", "city,order_id", "y,o2")
    with pytest.raises(Exception, match="header"):
        S.read_orders_csv(spark, mixed).collect()


def test_row_numbers_of_far_ranges(spark):
    at = [0, 409_600_001, 409_700_001, 2**33 + 5, 2**33 + 6, 5 * 2**33]
    got = S.exact_row_numbers(spark.createDataFrame([(x,) for x in at[::-1]], "source_row_number long")).collect()
    assert [r.row_number for r in sorted(got)] == [2, 3, 4, 5, 6, 7]


def test_ids_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"o{i % 7},c{i % 3}" for i in range(40)]
    at = write(tmp_path / "a", "order_id,customer_id", *lines)
    ids = []
    for size in ("64", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = S.with_ids(S.stamp_lineage(S.read_orders_csv(spark, at), "r1"), "r1").select("_id", "order_id", "customer_id")
        ids.append(sorted(map(tuple, rows.collect())))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids[0] == ids[1] and len({x[0] for x in ids[0]}) == 40


def test_json_of_any_type(spark):
    import datetime
    from decimal import Decimal as D

    kind = "a decimal(10,2), d date, t timestamp, n timestamp_ntz, b binary, s string, f double, ok boolean, l array<struct<x:decimal(5,1),y:array<binary>>>, m map<int,array<date>>"
    day, at = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3, 450)
    rows = [(D("5.00"), day, at, at.replace(microsecond=0), b"\xff\x00", 'q"\n\u0001', 1.5, True, [(D("1.5"), [b"x", None, b"\xc3"]), None, (None, None), (D("-3.0"), [])], {1: [day, None], 2: None}), tuple([None] * 10)]
    got = [json.loads(r.json) for r in S.to_json_rows(spark.createDataFrame(rows, kind)).collect()]
    assert got[0] == {"a": 5, "d": "2024-02-29", "t": "2024-02-29T01:02:03.000450", "n": "2024-02-29T01:02:03", "b": "ff00", "s": 'q"\n\u0001', "f": 1.5, "ok": True, "l": [{"x": 1.5, "y": ["x", None, "c3"]}, None, {"x": None, "y": None}, {"x": -3, "y": []}], "m": {"1": ["2024-02-29", None], "2": None}}
    assert isinstance(got[0]["a"], int) and isinstance(got[0]["l"][3]["x"], int) and got[1] == dict.fromkeys(got[0])
    assert [json.loads(r.json) for r in S.to_json_rows(spark.createDataFrame([], kind)).collect()] == []


def test_unchanged_sources_are_not_opened_and_one_poller_loads(spark, tmp_path):
    box, opened, loaded = tmp_path / "in", [], []
    write(box, "version,v", "1,a")
    write(box, "version,v", "5,b")
    read = lambda paths: opened.append(len(paths)) or spark.read.schema("version long, v string").option("header", True).csv(paths).select("*", F.col("_metadata.file_path").alias("_path"))
    poller = lambda **k: Poller(spark, str(tmp_path / "state"), str(box), read, **k)
    with pytest.raises(ZeroDivisionError):  # a load that breaks off isn't remembered
        poller(lease_s=-1).run(lambda paths: 1 / 0)
    one = poller()
    assert {r.decision for r in one.run(loaded.extend).collect()} == {"process"} and len(loaded) == 2
    assert {r.decision for r in one.run(loaded.extend).collect()} == {"unchanged"} and len(loaded) == 2 and opened == [2, 2]
    (box / "f1.csv").write_text("version,v\n6,b\n7,c\n")
    two, seen = poller(), []
    assert sorted(r.decision for r in one.run(lambda p: seen.extend(r.decision for r in two.run(loaded.extend).collect()) or loaded.extend(p)).collect()) == ["process", "unchanged"]
    assert sorted(seen) == ["claimed", "unchanged"] and len(loaded) == 3
    assert {r.source_key.rpartition("/")[2]: r.last_version for r in one.state().collect()} == {"f0.csv": 1, "f1.csv": 7}


def test_bucket_table_rewrites_touched_buckets(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), buckets=16)
    rows = lambda *x: spark.createDataFrame(list(x), "order_id string, version long, v string")
    assert t.read() is None and t.merge(rows()) == {}
    assert t.merge(rows(*((f"k{i}", 1, "a") for i in range(200)))) == {"inserted": 200}
    before = t.state()[1]
    assert t.merge(rows(("k5", 2, "b"), ("k6", 0, "c"))) == {"updated": 1, "unchanged": 1}
    seq, after = t.state()
    assert seq == 2 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert t.merge(rows(("k5", 2, "z"))) == {"unchanged": 1} and t.state()[0] == 2
    got = {r.order_id: (r.version, r.v, r.ingest_seq) for r in t.read().collect()}
    assert len(got) == 200 and got["k5"] == (2, "b", 2) and got["k6"] == (1, "a", 1)
    assert {r.v for r in t.read(1).collect()} == {"a"}


def test_one_writer_wins_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.numbers() == []
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: [log.put(n, {"writer": i}) for n in range(1, 6)], range(8)))
    assert [sum(w[n] for w in won) for n in range(5)] == [1] * 5 and log.numbers() == [1, 2, 3, 4, 5]
    assert all(won[log.read(n)["writer"]][n - 1] for n in range(1, 6))
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


class Interleaved(BucketTable):
    """Lets another merge commit behind what it has read."""

    others = ()

    def _committed(self, *a):
        if self.others:
            first, *self.others = self.others
            first()
        return super()._committed(*a)


def test_merges_at_a_time_lose_nothing(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "order_id string, version long, v string")
    one, two = Interleaved(spark, str(tmp_path / "t"), buckets=4), BucketTable(spark, str(tmp_path / "t"), buckets=4)
    one.merge(rows(*((f"k{i}", 1, "a") for i in range(40))))
    at = {f"k{i}": spark.range(1).select(F.pmod(F.xxhash64(F.lit(f"k{i}")), F.lit(4))).first()[0] for i in range(40)}
    same = [k for k in at if at[k] == at["k0"]]
    other = next(k for k in at if at[k] != at["k0"])
    # the same bucket: the later one runs again, and the newer version stays
    one.others = [lambda: two.merge(rows((same[0], 3, "two"), (same[1], 2, "two")))]
    assert one.merge(rows((same[0], 2, "one"), (same[2], 2, "one"))) == {"unchanged": 1, "updated": 1}
    # another bucket: what was written is taken as it is, with the next number
    before = len(list((tmp_path / "t" / "data").iterdir()))
    one.others = [lambda: two.merge(rows((other, 2, "two")))]
    assert one.merge(rows((same[3], 2, "one"))) == {"updated": 1}
    assert len(list((tmp_path / "t" / "data").iterdir())) == before + 2
    got = {r.order_id: (r.version, r.v, r.ingest_seq) for r in one.read().collect()}
    assert len(got) == 40
    assert [got[k] for k in (same[0], same[1], same[2], other, same[3])] == [(3, "two", 2), (2, "two", 2), (2, "one", 3), (2, "two", 4), (2, "one", 5)]
    changes = sorted((r.seq, r.action, r.old.v, r.new.v, r.new.order_id) for r in one.changes(1).collect())
    assert changes == sorted([(2, "updated", "a", "two", same[0]), (2, "updated", "a", "two", same[1]), (3, "updated", "a", "one", same[2]), (4, "updated", "a", "two", other), (5, "updated", "a", "one", same[3])])
    # always in the way
    one.tries, one.others = 3, [lambda: two.merge(rows((same[0], two.state()[0] + 10, f"x{two.state()[0]}")))] * 3
    with pytest.raises(Conflict):
        one.merge(rows((same[0], 99, "one")))


def test_few_incoming_rows_move_alone(spark, tmp_path, monkeypatch):
    import random

    from ledgerloom.operators.keys import merged
    from ledgerloom.sources import buckets as B

    r, schema = random.Random(9), "order_id string, version long, v string"
    rows = lambda n, v: spark.createDataFrame([(f"k{r.randrange(90)}", r.choice([None, v, v + 1]), r.choice("ab")) for _ in range(n)], schema)
    batches = [rows(60, v).cache() for v in range(1, 5)]
    tables = []
    for few in (200_000, 0):
        monkeypatch.setattr(B, "FEW_ROWS", few)
        t = BucketTable(spark, str(tmp_path / f"t{few}"), buckets=4)
        counts = [t.merge(b, tie_break=("v",)) for b in batches]
        tables.append((counts, sorted(map(str, t.read().collect())), t.commit()["prints"], sorted(map(str, t.changes(1).collect()))))
    assert tables[0] == tables[1]
    t.read().write.parquet(f"{tmp_path}/current")
    batches[0].dropDuplicates(["order_id"]).write.parquet(f"{tmp_path}/new")
    plan = merged(spark.read.parquet(f"{tmp_path}/current"), spark.read.parquet(f"{tmp_path}/new"), few=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan


def test_differences_are_found_by_fingerprints(spark, tmp_path):
    import random

    r = random.Random(4)
    rows = lambda x: spark.createDataFrame(x, "order_id string, version long, v array<string>")
    one, two = (BucketTable(spark, str(tmp_path / n), buckets=8) for n in "ab")
    assert one.differences(two) is None
    data = [(f"k{i}", 1, [f"v{i}", None]) for i in range(60)]
    one.merge(rows(data))
    for k in range(3):  # the same rows in another order and several merges
        two.merge(rows([x for i, x in enumerate(data) if i % 3 == k]))
    assert one.commit()["prints"] == two.commit()["prints"] and one.differences(two) is None
    change = [(f"k{i}", 2, ["new"]) for i in r.sample(range(60), 3)] + [("n1", 1, None)]
    two.merge(rows(change))
    assert {(x.order_id, x.kind) for x in one.differences(two).collect()} == {(k, "added" if k == "n1" else "changed") for k, _, _ in change}
    assert {(x.order_id, x.kind) for x in two.differences(one).collect()} == {(k, "missing" if k == "n1" else "changed") for k, _, _ in change}
    unlike = {b for b, x in two.commit()["prints"].items() if x != one.commit()["prints"].get(b)}
    assert 1 <= len(unlike) <= 4 and all(any(f"_bucket={b}/" in f for b in unlike) for f in one.differences(two).inputFiles())
    one.merge(rows(change))
    assert one.differences(two) is None and one.differences(one, 1) is not None
    # a fingerprint moved on is that of all rows
    fresh = BucketTable(spark, str(tmp_path / "c"), buckets=8)
    fresh.merge(two.read().drop("ingest_seq"))
    assert fresh.commit()["prints"] == two.commit()["prints"]


def test_a_layout_rewrites_the_ranges_of_what_changed(spark, tmp_path):
    import random

    r = random.Random(6)
    schema = "order_id string, version long, city string, status string, v int"
    t, layout = BucketTable(spark, str(tmp_path / "t"), buckets=4), RangeLayout(spark, str(tmp_path / "l"), ranges=8)
    row = lambda i, version: (f"o{i}", version, r.choice([None, *"abcdefghij"]), r.choice(["new", "sent", "done"]), r.randint(0, 99))
    t.merge(spark.createDataFrame([row(i, 1) for i in range(400)], schema))
    folders = layout.build(t.read(), t.state()[0])
    assert 4 <= folders <= 8
    for k in range(3):
        t.merge(spark.createDataFrame([row(r.randrange(410), 2 + k)], schema))
        t.merge(spark.createDataFrame([row(r.randrange(410), 2 + k)], schema))
        before = layout.commit()["folders"]
        n = layout.update(t.changes(layout.commit()["seq"]), t.state()[0])
        assert 1 <= n <= 4 and sum(before.get(i) != f for i, f in layout.commit()["folders"].items()) <= n
        whole = t.read().drop("ingest_seq")
        for equal in ({"city": "c"}, {"city": "j", "status": "sent"}, {"city": "zz"}, {}):
            want = whole
            for c, v in equal.items():
                want = want.where(F.col(c) == v)
            got = layout.read(**equal)
            assert sorted(map(str, got.select(*whole.columns).collect())) == sorted(map(str, want.collect()))
        assert len(layout.read(city="c", status="new").inputFiles()) < len(layout.read().inputFiles()) / 2


def test_named_merges_are_done_once_and_old_states_go(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "order_id string, version long, v string")
    t = BucketTable(spark, str(tmp_path / "t"), buckets=2)
    assert t.merge(rows(("a", 1, "x")), by="r1") == {"inserted": 1} == t.merge(rows(("a", 5, "y")), by="r1")
    for n in range(2, 7):
        t.merge(rows(("a", n, f"v{n}")))
    assert t.expire(keep=2) == 0  # all too young
    assert t.expire(keep=2, older_than_s=-1) == 4 and t.log.numbers() == [5, 6]
    assert t.read().first().v == "v6" and t.read(5).first().v == "v5"
    with pytest.raises(ValueError):
        t.read(3)
    assert t.merge(rows(("b", 1, "z"))) == {"inserted": 1} and t.state()[0] == 7


def test_a_stream_that_breaks_off_equals_a_load(spark, tmp_path):
    header, box = "order_id,customer_id,customer_email,order_date,total_amount,items_json", tmp_path / "in"
    item = '"[{""sku"":""a"",""qty"":1,""unit_price"":5}]"'
    drops = [[f"طلب-{i % 5},عميل-1,u{i}@b.c,2024-01-0{1 + i % 9},1005,{item}" for i in range(k, k + 4)] for k in (0, 3, 6)]
    whole = write(tmp_path / "all", header, *(x for d in drops for x in d))
    jobs.full_load(spark, str(tmp_path / "batch"), whole, "r")
    load = StreamLoad(spark, str(tmp_path / "stream"), str(box))
    for n, d in enumerate(drops):
        write(box, header, *d)
        if n == 1:
            for step in ("_merged", "_held"):  # lost behind a step and before its record
                real = getattr(load, step)
                setattr(load, step, lambda *a: real(*a) and 1 / 0 or 1 / 0)
                with pytest.raises(Exception, match="ZeroDivisionError"):
                    load.run(str(tmp_path / "state"))
                delattr(load, step)
        assert load.run(str(tmp_path / "state")) == 1
    assert load.run(str(tmp_path / "state")) == 0
    held = [sorted((r.order_id, r.customer_email, *r.error_codes) for r in spark.read.parquet(f"{tmp_path}/{x}/quarantine").collect()) for x in ("batch", "stream")]
    orders = [sorted((r.order_id, r.customer_email, r.order_date) for r in jobs.Warehouse(spark, f"{tmp_path}/{x}").orders.read().collect()) for x in ("batch", "stream")]
    assert held[0] == held[1] and len(held[0]) == 7 and orders[0] == orders[1] and len(orders[0]) == 5
    metrics = spark.read.parquet(f"{tmp_path}/stream/run_metrics").agg(F.sum("raw"), F.sum("quarantined"), F.count("*")).first()
    assert tuple(metrics) == (12, 7, 3)


def test_load_goes_on_behind_what_it_had_finished(spark, tmp_path, monkeypatch):
    at = write(tmp_path / "in", "order_id,customer_id,customer_email", "طلب-1,عميل-1,a@b.c", "طلب-2,عميل-2,a@b.c,more", "طلب-1,عميل-1,a@b.c")
    calls = []
    real, classify = S.append_quarantine, jobs.classify
    monkeypatch.setattr(S, "append_quarantine", lambda *a: 1 / 0)
    monkeypatch.setattr(jobs, "classify", lambda *a, **k: calls.append(1) or classify(*a, **k))
    with pytest.raises(ZeroDivisionError):
        jobs.full_load(spark, str(tmp_path / "w"), at, "r1")
    monkeypatch.setattr(S, "append_quarantine", real)
    done = jobs.full_load(spark, str(tmp_path / "w"), at, "r1")
    assert (done["decision"], done["raw"], done["quarantined"], done["surplus"], len(calls)) == ("retry", 3, 3, 1, 1)
    held = spark.read.parquet(f"{tmp_path}/w/quarantine")
    assert held.count() == 3 and [r.surplus_text for r in held.where(F.col("surplus_text").isNotNull()).collect()] == ["طلب-2,عميل-2,a@b.c,more"]
    rows = sorted(r.source_row_number for r in spark.read.parquet(f"{tmp_path}/w/raw").collect())
    part = jobs.full_load(spark, str(tmp_path / "w2"), at, "r1", after_row=rows[1])
    assert part["raw"] == 1 and "DUPLICATE_ORDER_ID" in spark.read.parquet(f"{tmp_path}/w2/quarantine").first().error_codes


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    # a file of many splits whose rows are all in one row group, which one task reads
    import pyarrow as pa
    import pyarrow.parquet as pq

    from ledgerloom.plans.adapter import spread

    pq.write_table(pa.table({"id": list(range(100_000))}), f"{tmp_path}/t.parquet", row_group_size=100_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = spark.read.parquet(f"{tmp_path}/t.parquet")
        assert rows.rdd.getNumPartitions() > 8 and max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) == 100_000
        got = [r["count"] for r in spread(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(got) == 100_000 and len(got) >= 8 and max(got) < 2 * 100_000 / len(got)


def test_several_tasks_write_a_range_or_a_bucket(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").cast("string").alias("order_id"), F.lit("c").alias("city"), F.lit("s").alias("status"), F.lit(1).cast("long").alias("version"), F.lit("x" * 2000).alias("pad"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are put together again
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        layout = RangeLayout(spark, f"{tmp_path}/l", ranges=2)
        layout.build(rows, 1)
        table = BucketTable(spark, f"{tmp_path}/t", buckets=1)
        table.merge(rows.withColumn("pad", F.repeat(F.lit("y"), 20_000)))  # too much to be broadcast
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    folders = [f"{tmp_path}/l/{f}" for f in layout.commit()["folders"].values()], [f"{tmp_path}/t/{f}" for f, _ in table.commit()["buckets"].values()]
    for some in folders:
        assert len(spark.read.parquet(*some).inputFiles()) > 2
    assert layout.read(city="c").count() == table.read().count() == 4000


def test_lookup_layout_makes_its_orders_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(300).select(F.col("id").cast("string").alias("order_id"), (F.col("id") % 3).cast("string").alias("city"), F.lit("s").alias("status"), F.lit("2020-01-01").alias("order_date"), F.lit("c").alias("customer_id"), F.array(F.struct(F.lit("a").alias("sku"))).alias("items_json"))
    jobs.write_lookup_layout(rows.mapInArrow(count, rows.schema), str(tmp_path))
    assert seen.value == 300
    assert jobs.orders_by_sku(spark, str(tmp_path), "a").count() == 300 and not [x for x in tmp_path.iterdir() if x.name.startswith("held")]


def test_refresh_of_products_puts_items_together_once(spark):
    from ledgerloom.plans import queries_orders

    for name in ("mv_refresh_products", "mv_affected_keys"):
        plan = queries_orders.Q[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
