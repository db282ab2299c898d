"""Orders laid out by ranges of lookup columns, kept up to date from a change feed range by range."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .commits import CommitLog, share_of


class RangeLayout:
    """Rows in ranges of some text columns, each range a folder of its own, sorted. A commit holds the least key of each range and its folder: a lookup reads the folders
    alone that may hold what it asks for, and an update rewrites those alone that changed rows fall in or leave. Nulls count as empty text."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...] = ("city", "status"), key: str = "order_id", ranges: int = 32):
        self.spark, self.path, self.columns, self.key, self.ranges = spark, path.rstrip("/"), columns, key, ranges
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _at(self, within: str = "") -> Column:
        return F.array(*(F.coalesce(F.col(f"{within}{c}").cast("string"), F.lit("")) for c in self.columns))

    def _number(self, bounds: list[list[str]], within: str = "") -> Column:
        """The range of a row: how many ranges' least keys, but the first, aren't above its own."""
        if len(bounds) < 2:
            return F.lit(0)
        known = F.array(*(F.array(*map(F.lit, b)) for b in bounds[1:]))
        return F.size(F.filter(known, lambda b: b <= self._at(within)))

    def commit(self) -> dict:
        have = self.log.numbers()
        return self.log.read(have[-1]) if have else {"seq": 0, "bounds": [], "folders": {}}

    def _write(self, rows: DataFrame, bounds: list[list[str]]) -> str:
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("_range", self._number(bounds))
        placed.repartition("_range", share_of(self.spark, self.key, max(1, len(bounds)))).sortWithinPartitions("_range", *self.columns, self.key).write.partitionBy("_range").parquet(f"{self.path}/{name}")
        return name

    def _put(self, seq: int, bounds: list[list[str]], folders: dict[str, str]) -> None:
        have = self.log.numbers()
        if not self.log.put((have[-1] if have else 0) + 1, {"seq": seq, "bounds": bounds, "folders": folders}):
            raise RuntimeError("another writer changed the layout at the same time")

    def build(self, rows: DataFrame, seq: int) -> int:
        """Lays out all rows of the table's state seq in ranges of about as many rows each; gives the number of folders written."""
        keys = rows.select(self._at().alias("k")).repartitionByRange(self.ranges, "k")
        least = keys.groupBy(F.spark_partition_id().alias("p")).agg(F.min("k").alias("k")).collect()  # as many as there are ranges
        bounds = sorted({tuple(r["k"]) for r in least})
        name = self._write(rows, [list(b) for b in bounds])
        self._put(seq, [list(b) for b in bounds], {str(i): f"{name}/_range={i}" for i in range(len(bounds))})
        return len(bounds)

    def update(self, changes: DataFrame, seq: int) -> int:
        """Takes the feed (old, new) up to state seq in; gives the number of folders rewritten. Of several changes of one key the feed's last (by its seq) stays."""
        now = self.commit()
        bounds = now["bounds"]
        last = changes.groupBy(F.col(f"new.{self.key}").alias("_key")).agg(F.max_by("new", "seq").alias("new"), F.min_by("old", "seq").alias("old"))
        numbers = last.select(F.explode(F.array(F.when(F.col("old").isNotNull(), self._number(bounds, "old.")), self._number(bounds, "new."))).alias("n"))
        touched = sorted(r["n"] for r in numbers.where("n is not null").distinct().collect())  # as many as there are ranges at most
        if not touched:
            return 0
        new = last.select("new.*")
        there = [f"{self.path}/{now['folders'][str(i)]}" for i in touched if str(i) in now["folders"]]
        kept = self.spark.read.parquet(*there).select(*new.columns).join(last.select("_key"), F.col(self.key) == F.col("_key"), "left_anti") if there else new.limit(0)
        name = self._write(kept.unionByName(new), bounds)
        written = {str(r["_range"]) for r in self.spark.read.parquet(f"{self.path}/{name}").select("_range").distinct().collect()}
        folders = {i: f for i, f in now["folders"].items() if int(i) not in touched} | {str(i): f"{name}/_range={i}" for i in touched if str(i) in written}
        self._put(seq, bounds, folders)
        return len(touched)

    def read(self, **equal: str) -> DataFrame:
        """The rows with the given values of the first columns; folders of other ranges aren't read."""
        now = self.commit()
        bounds, folders = now["bounds"], now["folders"]
        prefix = []
        for c in self.columns:
            if c not in equal:
                break
            prefix.append(equal[c])
        n = len(prefix)
        reach = [i for i in range(len(bounds)) if (i == 0 or bounds[i][:n] <= prefix) and (i + 1 == len(bounds) or bounds[i + 1][:n] >= prefix)]
        paths = [f"{self.path}/{folders[str(i)]}" for i in reach if str(i) in folders]
        rows = self.spark.read.parquet(*(paths or [f"{self.path}/{f}" for f in folders.values()][:1]))
        for c, v in equal.items():
            rows = rows.where(F.col(c) == v)
        return rows
