"""Loads, replays, deltas and view refreshes over folders; merges that don't depend on the order of arrival."""

import csv
import decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.classify import FIELDS
from ledgerloom.operators.keys import ledger_decision, merge_orders
from ledgerloom.plans import catalog, jobs, views
from test_classify import BASE


def write_csv(path, rows, version=False):
    path.mkdir()
    with open(path / "o.csv", "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow([*FIELDS, *(["version"] if version else [])])
        for r in rows:
            w.writerow([(BASE | r)[c] for c in FIELDS] + ([r["version"]] if version else []))
    return str(path)


def test_load_replay_delta_and_refresh(spark, tmp_path):
    root = str(tmp_path / "w")
    full = write_csv(tmp_path / "full", [{"order_id": f"طلب-{i}"} for i in (1, 2, 3, 3)] + [{"order_id": "طلب-4", "order_date": "31/02/2025"}])
    first = jobs.full_load(spark, root, full, "r1", stamp_version=True)
    assert (first["raw"], first["corrected"], first["quarantined"], first["consistent"]) == (5, 3, 2, True)
    assert (first["inserted"], first["updated"], first["unchanged"]) == (3, 0, 0)
    assert jobs.full_load(spark, root, full, "r1", stamp_version=True)["decision"] == "skip"
    again = jobs.full_load(spark, root, full, "r2", stamp_version=True)
    assert (again["inserted"], again["updated"], again["unchanged"]) == (0, 0, 3)
    assert jobs.refresh_job(spark, root) == "success"
    assert jobs.refresh_job(spark, root) == "up_to_date"
    delta = write_csv(tmp_path / "delta", [{"order_id": "طلب-1", "status": "delivered", "order_date": "01/03/2025", "version": "2"}, {"order_id": "طلب-9", "version": "1"}, {"order_id": "طلب-2", "city": "عدن", "version": "0"}], True)
    done = jobs.delta_load(spark, root, delta, "d1")
    assert (done["inserted"], done["updated"], done["unchanged"]) == (1, 1, 1)
    assert jobs.refresh_job(spark, root) == "incremental"
    w = jobs.Warehouse(spark, root)
    orders = w.orders.read()
    for name, build in (("mv_daily", views.daily_sales), ("mv_products", views.product_sales)):
        assert sorted(map(tuple, w.view(name).select(*build(orders).columns).collect())) == sorted(map(tuple, build(orders).collect()))
    assert {r["order_id"]: r["city"] for r in orders.collect()}["طلب-2"] == "تعز"
    assert jobs.snapshot_job(spark, root).first()["total_orders"] == 4
    assert jobs.read_view(w, "mv_daily", 1).count() == 1
    with pytest.raises(ValueError):
        jobs.read_view(w, "nope", 1)
    with pytest.raises(ValueError):
        jobs.full_load(spark, root, delta, "r1")


def test_views_follow_the_feed_alone(spark, tmp_path):
    import random

    w, r, n = jobs.Warehouse(spark, str(tmp_path)), random.Random(3), 0
    schema = "order_id string, version long, order_date string, status string, total_amount decimal(18,2), items_json array<struct<sku:string,name:string,qty:decimal(20,8),unit_price:decimal(24,8),total:decimal(18,2)>>"
    D = decimal.Decimal

    def order(i, version):
        items = [(r.choice([None, "a", "b", "c"]), r.choice(["n1", "n2", None]), D(r.randint(1, 9)), r.choice([None, D("1.005"), D(7)]), D(r.randint(1, 99)) / 100) for _ in range(r.randint(0, 3))]
        return (f"o{i}", version, r.choice([None, "2024-01-0" + str(r.randint(1, 4))]), r.choice(["تم التسليم", "x"]), r.choice([None, D(r.randint(-500, 5000)) / 100]), items or None)

    for step in range(6):
        for _ in range(r.randint(1, 2)):
            w.orders.merge(spark.createDataFrame([order(i, step) for i in r.sample(range(30), 12)], schema))
        assert jobs.refresh_job(spark, w.root) == ("incremental" if step else "success") and jobs.refresh_job(spark, w.root) == "up_to_date"
        for name, build in (("mv_daily", views.daily_sales), ("mv_products", views.product_sales)):
            whole = build(w.orders.read())
            assert sorted(map(str, w.view(name).select(*whole.columns).collect())) == sorted(map(str, whole.collect())), (step, name)
    # what a refresh reads
    w.orders.merge(spark.createDataFrame([order(99, 9)], schema))
    seq = w.views.read(w.views.numbers()[-1])["seq"]
    feed = w.orders.changes(seq)
    plan = views.move_daily(spark.read.parquet(w.path(w.views.read(w.views.numbers()[-1])["daily"])), feed)._jdf.queryExecution().optimizedPlan().toString()
    touched = w.orders.commit()
    assert len(touched["touched"]) == 1 and set(feed.inputFiles()) == {f for f in w.orders.read().inputFiles() if touched["buckets"][str(touched["touched"][0])][0] in f}
    assert "total_amount" in plan and jobs.refresh_job(spark, w.root) == "incremental"
    # a feed that is gone
    w.orders.merge(spark.createDataFrame([order(98, 9)], schema))
    w.orders.merge(spark.createDataFrame([order(97, 9)], schema))
    w.orders.expire(keep=1, older_than_s=-1)
    assert jobs.refresh_job(spark, w.root) == "success" and jobs.refresh_job(spark, w.root, force=True) == "success"


def test_merge_does_not_depend_on_order(spark):
    schema = "order_id string, version long, row long, v string"
    none = spark.createDataFrame([], schema + ", ingest_seq long")
    rows = [("a", 2, 1, "x"), ("a", 3, 2, "y"), ("a", None, 3, "z"), ("b", None, 4, "p"), ("b", 1, 5, "q")]
    for order in (rows, rows[::-1]):
        snapshot, actions = merge_orders(none, spark.createDataFrame(order, schema), tie_break=("row",), ingest_seq=7)
        assert sorted((r.order_id, r.version, r.v, r.ingest_seq) for r in snapshot.collect()) == [("a", 3, "y", 7), ("b", 1, "q", 7)]
        assert {r.action for r in actions.collect()} == {"inserted"}
    assert merge_orders(none, spark.createDataFrame([], schema))[0].count() == 0


def test_ledger(spark):
    ledger = spark.createDataFrame([("a", "1", "completed"), ("b", "1", "processing")], "request_key string, payload_hash string, status string")
    requests = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")], "request_key string, payload_hash string")
    got = {(r.request_key, r.payload_hash): r.decision for r in ledger_decision(ledger, requests).collect()}
    assert got == {("a", "1"): "skip", ("a", "2"): "conflict", ("b", "1"): "retry", ("c", "1"): "process"}


def test_lookups_read_what_they_need(spark, tmp_path):
    from ledgerloom.plans.adapter import orders_doc

    orders = orders_doc(spark, "/root/testdata/sf0.001")
    jobs.write_lookup_layout(orders, str(tmp_path))
    found = jobs.orders_by_sku(spark, str(tmp_path), "7")
    assert "EqualTo(sku,7)" in found._jdf.queryExecution().executedPlan().toString()
    skus = [r.skus for r in spark.read.parquet(f"{tmp_path}/by_sku").groupBy(F.input_file_name()).agg(F.struct(F.min("sku").alias("a"), F.max("sku").alias("b")).alias("skus")).orderBy("skus").collect()]
    assert all(x.b <= y.a for x, y in zip(skus, skus[1:]))  # a file holds a range: row group statistics rule out all others
    want = orders.where(F.exists("items_json", lambda x: x["sku"] == "7")).select("order_id")
    assert sorted(r.order_id for r in found.collect()) == sorted(r.order_id for r in want.collect())
    high = catalog.filter_orders(spark.read.parquet(f"{tmp_path}/by_city"), min_amount=200000.005)
    assert "GreaterThanOrEqual(total_amount,200000.01)" in high._jdf.queryExecution().executedPlan().toString()


def test_a_merge_ranks_its_rows_once(spark):
    from ledgerloom.operators import keys

    schema = "order_id string, version long, v string"
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema)
    current = spark.createDataFrame([("a", 0, "w", 1)], schema + ", ingest_seq long")
    again = keys.merged(current, rows)
    once = keys.merged(current, rows, latest=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))
    assert "max_by" in again._jdf.queryExecution().optimizedPlan().toString() and "max_by" not in once._jdf.queryExecution().optimizedPlan().toString()


def test_merges_of_many_rows_make_no_json_of_them(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import buckets

    monkeypatch.setattr(buckets, "FEW_ROWS", 1)
    monkeypatch.setattr(buckets.F, "to_json", lambda *_: pytest.fail("rows were written as JSON"))
    table = buckets.BucketTable(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 2, "z")], "order_id string, version long, v string")
    assert table.merge(rows) == {"inserted": 2} and table.merge(rows) == {"unchanged": 2}
    assert sorted((r.order_id, r.v) for r in table.read().collect()) == [("a", "z"), ("b", "y")]


def test_a_merge_of_single_rows_writes_them_once(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import buckets

    schema = "order_id string, version long, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema).write.parquet(str(tmp_path / "rows"))
    spark.createDataFrame([("a", 2, "z"), ("a", 3, "w"), ("c", 1, "q")], schema).write.parquet(str(tmp_path / "more"))
    table, ranked = buckets.BucketTable(spark, str(tmp_path / "t")), []
    monkeypatch.setattr(buckets, "latest_per_key", lambda *a, real=buckets.latest_per_key: ranked.append(a) or real(*a))
    assert table.merge(spark.read.parquet(str(tmp_path / "rows")), stays=True) == {"inserted": 2} and not ranked
    assert table.merge(spark.read.parquet(str(tmp_path / "more")), stays=True) == {"inserted": 1, "updated": 1} and len(ranked) == 1
    assert sorted((r.order_id, r.v) for r in table.read().collect()) == [("a", "w"), ("b", "y"), ("c", "q")]
    whole = buckets.BucketTable(spark, str(tmp_path / "whole"))
    whole.merge(table.read().drop("ingest_seq"))
    assert whole.commit()["prints"] == table.commit()["prints"]


def test_quarantine_compares_no_whole_rows(spark, tmp_path, monkeypatch):
    from ledgerloom.sources import orders as S

    rows = [("r", "f", i, (str(i // 3),)) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id string, source_file string, source_row_number long, raw_record struct<order_id:string>")
    df.where("source_row_number % 3 = 0").write.parquet(str(tmp_path / "single"))
    df.write.parquet(str(tmp_path / "rows"))
    single = S.with_ids(spark.read.parquet(str(tmp_path / "single")), "k")
    assert "Window" not in single._jdf.queryExecution().optimizedPlan().toString()
    ids = []
    for most in (S.FEW_ALIKE, 3):
        monkeypatch.setattr(S, "FEW_ALIKE", most)
        found = S.with_ids(spark.read.parquet(str(tmp_path / "rows")), "k").collect()
        ids.append({r.source_row_number: r["_id"] for r in found})
        assert len(found) == 30 and len(set(ids[-1].values())) == 30
    assert ids[0] == ids[1] and {r.source_row_number: r["_id"] for r in single.collect()}.items() <= ids[0].items()
    for _ in range(2):
        S.append_quarantine(spark, df, str(tmp_path / "q"), "k")
    assert spark.read.parquet(str(tmp_path / "q")).count() == 30
