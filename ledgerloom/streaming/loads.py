"""Orders as a stream of CSV files: each micro-batch is classified once and goes into several tables, each exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.classify import classify, split_by_status
from ..operators.keys import behind_first, first_rows
from ..plans import catalog, jobs
from ..sources import orders as S
from ..sources.commits import CommitLog
from .ingest import run_available

FILES = "path string, modificationTime timestamp, length long, content binary"  #: what Spark lists of files; contents aren't read


class SeenKeys:
    """The keys that batches have brought, each with the first batch alone: a later batch finds its duplicates without reading earlier rows.

    A batch's new keys lie in a folder of their own, sorted by bucket, so that a batch reads of all others the row groups of its own buckets. Marking a batch
    again replaces what it marked before.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _earlier(self, number: int) -> DataFrame:
        try:
            return self.spark.read.parquet(self.path).where(F.col("batch") < number).select("_key", "bucket")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
            return self.spark.createDataFrame([], "_key string, bucket int")

    def flag(self, rows: DataFrame, key: str, order: tuple[str, ...], number: int, work: str) -> DataFrame:
        """rows and is_duplicate: whether a row of an earlier batch or an earlier row of this one (by `order`) has the same trimmed key. What is known of the batch's keys is written to `work`."""
        firsts = first_rows(rows, key, order).withColumn("bucket", F.pmod(F.xxhash64("_key"), F.lit(self.buckets)).cast("int"))
        firsts.write.mode("overwrite").parquet(f"{work}/firsts")
        firsts = self.spark.read.parquet(f"{work}/firsts")
        own = [r["bucket"] for r in firsts.select("bucket").distinct().collect()]  # as many as there are buckets at most
        known = self._earlier(number).where(F.col("bucket").isin(own)).select(F.col("_key").alias("_known")).distinct()
        marked = firsts.join(known, F.col("_key") == F.col("_known"), "left").withColumn("_seen", F.col("_known").isNotNull()).drop("_known")
        marked.write.mode("overwrite").parquet(f"{work}/keys")
        marked = self.spark.read.parquet(f"{work}/keys")
        return behind_first(rows, marked.where("_seen or _n > 1"), key, order, seen=F.col("_seen"))

    def mark(self, number: int, work: str) -> None:
        """Adds the new keys of the batch that flag() has seen."""
        new = self.spark.read.parquet(f"{work}/keys").where("not _seen").select("_key", "bucket")
        new.repartitionByRange("bucket").sortWithinPartitions("bucket").write.mode("overwrite").parquet(f"{self.path}/batch={number}")


class StreamLoad:
    """A stream of CSV files below `folder` into the warehouse at root: orders, quarantine, run metrics.

    A batch takes four steps, each recorded in the batch's own log when it is done: classified rows are written, the good ones merged, the bad ones added to
    the quarantine, and its metrics appended. A batch that broke off goes on behind its last step, and each step changes nothing if it had been done
    without being recorded: a merge knows the batch by its commit, quarantined rows have ids that depend on what they hold, metrics go by batch.
    Files are known by name: Spark lists the folder, and a file that was taken isn't opened again. Duplicates are judged over all batches.
    """

    STEPS = ("classified", "merged", "quarantined", "measured")

    def __init__(self, spark: SparkSession, root: str, folder: str, name: str = "stream", version_field: str | None = None, find_duplicates: bool = True, files_per_batch: int = 1000):
        self.spark, self.w, self.folder, self.name = spark, jobs.Warehouse(spark, root), folder.rstrip("/"), name
        self.version_field, self.find_duplicates, self.files = version_field, find_duplicates, files_per_batch
        self.keys = SeenKeys(spark, self.w.path(f"streams/{name}/keys"))

    def _classified(self, paths: list[str], number: int, work: str) -> dict:
        rows = S.stamp_lineage(S.read_orders_csv(self.spark, paths, self.version_field), f"{self.name}-{number}")
        rows = self.keys.flag(rows, "order_id", ("source_file", "source_row_number"), number, work) if self.find_duplicates else rows
        done = classify(rows.drop("raw_record"))
        version = F.expr(f"try_cast({self.version_field} as bigint)") if self.version_field else F.lit(None).cast("long")
        done = done.withColumn("version", version)
        counts = catalog.counted_write(done.drop(*({self.version_field} - {None, "version"})), f"{work}/classified")
        if self.find_duplicates:
            self.keys.mark(number, work)
        return counts

    def batch(self, files: DataFrame, number: int) -> None:
        """Does what is left to do of a batch of files (path, ...)."""
        run, work = f"{self.name}-{number}", self.w.path(f"work/{self.name}-{number}")
        log = CommitLog(self.spark, self.w.path(f"streams/{self.name}/batches/{number:08d}"))
        steps: list[Callable[[], dict]] = [lambda: self._first(files, number, work), lambda: self._merged(work, run), lambda: self._held(work, run), lambda: self._measured(log, run)]
        have = log.numbers()
        for k, (step, name) in enumerate(zip(steps, self.STEPS), 1):
            if k not in have:
                log.put(k, {"step": name, **step()})

    def _first(self, files: DataFrame, number: int, work: str) -> dict:
        paths = sorted(r["path"] for r in files.select("path").collect())  # files_per_batch names at most
        return {"files": len(paths), "counts": self._classified(paths, number, work)}

    def _merged(self, work: str, run: str) -> dict:
        good, _ = split_by_status(self.spark.read.parquet(f"{work}/classified"))
        return self.w.orders.merge(jobs.business_columns(good), tie_break=("source_row_number",), by=run, stays=True)

    def _held(self, work: str, run: str) -> dict:
        _, bad = split_by_status(self.spark.read.parquet(f"{work}/classified"))
        S.append_quarantine(self.spark, bad, self.w.path("quarantine"), run)
        return {}

    def _measured(self, log: CommitLog, run: str) -> dict:
        counts = log.read(1)["counts"]  # observed while the rows were written
        S.append_run_metrics(catalog.metrics_row(self.spark, counts, run, self.name), self.w.path("run_metrics"))
        return counts

    def run(self, checkpoint: str, timeout_s: int = 3600) -> int:
        """Takes the files that are there and new since the checkpoint, and what is left of a batch that broke off; gives the number of batches."""
        done = []

        def each(files: DataFrame, number: int) -> None:
            self.batch(files, number)
            done.append(number)

        listed = self.spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).option("maxFilesPerTrigger", self.files).load(self.folder)
        run_available(listed.select("path", "modificationTime", "length"), checkpoint, each, timeout_s)
        return len(done)
