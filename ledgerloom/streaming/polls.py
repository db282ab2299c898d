"""Polling of source files: size and time from the listing decide first, contents only where these differ; what was loaded is remembered after success."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.commits import CommitLog
from .ingest import mark_success, source_decisions

STATE = "source_key string, content_hash string, last_version long, size long, modified timestamp"


class Poller:
    """Sources below a folder, each a file or, with by_folder, a folder of files; their state lies below root.

    rows_of(paths) reads files as rows with a version and _path, the file that each comes from. State is a table whose newest version a commit names, put there after
    the sources have been loaded: what broke off is found again by the next poll. A load first claims what it is about to do; a claim ends when it is done or after
    lease_s, so that of two pollers at a time one loads.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str, rows_of: Callable[[list[str]], DataFrame], version: str = "version", by_folder: bool = False, pattern: str = "*.csv", lease_s: float = 300):
        self.spark, self.root, self.folder, self.rows_of = spark, root.rstrip("/"), folder, rows_of
        self.version, self.by_folder, self.pattern, self.lease_s = version, by_folder, pattern, lease_s
        self.log = CommitLog(spark, f"{self.root}/commits")

    def _source(self, path) -> F.Column:
        return F.regexp_replace(path, "/[^/]*$", "") if self.by_folder else path

    def state(self) -> DataFrame:
        have = self.log.numbers()
        return self.spark.read.schema(STATE).parquet(f"{self.root}/{self.log.read(have[-1])['state']}") if have else self.spark.createDataFrame([], STATE)

    def listing(self) -> DataFrame:
        """source_key, size, modified and paths of each source, by the listing alone."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", self.pattern).option("recursiveFileLookup", True).load(self.folder).select("path", "length", "modificationTime")
        by = files.groupBy(self._source(F.col("path")).alias("source_key"))
        return by.agg(F.sum("length").alias("size"), F.max("modificationTime").alias("modified"), F.array_sort(F.collect_list("path")).alias("paths"))

    def poll(self) -> DataFrame:
        """source_key, size, modified, opened, content_hash, max_version and decision of each source: unchanged, not_newer or process (see source_decisions()).

        Only sources whose size or time isn't that of the state are opened; their names go to the driver.
        """
        state, listed = self.state(), self.listing()
        known = state.select("source_key", F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("content_hash").alias("_hash"), F.col("last_version").alias("_last"))
        both = listed.join(known, "source_key", "left").withColumn("opened", ~F.coalesce((F.col("size") == F.col("_size")) & (F.col("modified") == F.col("_modified")), F.lit(False)))
        at = f"{self.root}/work/{uuid.uuid4().hex}"
        both.write.parquet(f"{at}/listed")
        both = self.spark.read.parquet(f"{at}/listed")
        paths = [p for r in both.where("opened").select("paths").collect() for p in r["paths"]]
        same = both.where("not opened").select("source_key", "size", "modified", "opened", F.col("_hash").alias("content_hash"), F.col("_last").alias("max_version"), F.lit("unchanged").alias("decision"))
        if not paths:
            return same
        rows = self.rows_of(paths).withColumn("source_key", self._source(F.col("_path"))).drop("_path")
        decided = source_decisions(rows, state, self.version)
        empty = F.coalesce("decision", F.lit("process"))  # a source without rows
        read = both.where("opened").join(decided, "source_key", "left").select("source_key", "size", "modified", "opened", "content_hash", "max_version", empty.alias("decision"))
        read.write.parquet(f"{at}/decided")
        return same.unionByName(self.spark.read.parquet(f"{at}/decided"))

    def _claimed(self, name: str) -> int | None:
        """The number of the claim on a set of sources, None where another one holds."""
        claims = CommitLog(self.spark, f"{self.root}/claims/{name}")
        have = claims.numbers()
        if have and claims.read(have[-1])["until"] > time.time():
            return None
        n = (have[-1] if have else 0) + 1
        return n if claims.put(n, {"until": time.time() + self.lease_s}) else None

    def run(self, load: Callable[[list[str]], object]) -> DataFrame:
        """Polls, loads the paths of sources that are to be processed, and remembers them and the new size and time of unchanged ones; gives the poll's decisions.

        Where another poller's claim on the same contents holds, their decision is claimed and nothing is loaded or remembered.
        """
        decided = self.poll()
        todo = decided.where("decision = 'process'")
        mark = todo.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("source_key", "content_hash", "size")), F.lit(0)).alias("x")).first()
        if mark["n"]:
            if self._claimed(f"{mark['n']}-{mark['x']:x}") is None:
                return decided.withColumn("decision", F.when(F.col("decision") == "process", "claimed").otherwise(F.col("decision")))
            listed = self.listing().join(todo.select("source_key"), "source_key", "left_semi")
            load([p for r in listed.select("paths").collect() for p in r["paths"]])
        state = self.state()
        seen = decided.where("decision != 'not_newer'").select("source_key", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
        new = mark_success(state, decided).join(state.select("source_key", "size", "modified"), "source_key", "left").join(seen, "source_key", "left")
        new = new.select("source_key", "content_hash", "last_version", F.coalesce("_size", "size").alias("size"), F.coalesce("_modified", "modified").alias("modified"))
        name = f"state/{uuid.uuid4().hex}"
        new.write.parquet(f"{self.root}/{name}")
        have = self.log.numbers()
        if not self.log.put((have[-1] if have else 0) + 1, {"state": name}):
            raise RuntimeError("another poller remembered its sources at the same time; poll again")
        return decided
