"""What several operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by Spark's reader alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4 (null ids: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame, shuffles_go: bool = False) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir. Where that is unset (local tests) one is made in the
    machine's temporary folder, which only a local session can use. Partitions beyond four for each core (or an eighth of the
    shuffle's, if that is more) are written together: each file costs its writer a process, as Spark sets permissions.
    shuffles_go: the files of its shuffles, which nothing reads any more, are deleted at once; else they stay until the driver's garbage is collected.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    files = max(4 * context.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    before = spark.conf.get(SHUFFLES_GO, None)
    if shuffles_go:
        spark.conf.set(SHUFFLES_GO, "true")
    try:
        return df.coalesce(files).checkpoint(eager=True)
    finally:
        if shuffles_go:
            spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def apart(df: DataFrame, *names: str) -> list[str]:
    """names, each with as many underscores behind it as it takes for df to have no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def pieces(batches, most: int = 8 << 20):
    """Arrow batches of at most about `most` bytes, so that what a task holds doesn't depend on Arrow's row count."""
    for batch in batches:
        rows = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small(df: DataFrame, most_rows: int) -> tuple[DataFrame, bool]:
    """df behind a broadcast hint if a count proves that it has at most most_rows rows, else as it is.

    The caller passes a df that is cheap to count (checkpointed), with rows of bounded width.
    """
    fits = df.limit(most_rows + 1).count() <= most_rows
    return (F.broadcast(df) if fits else df), fits
