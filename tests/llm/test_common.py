"""What several operators share."""

from pyspark.sql import functions as F

from ledgerloom.llm import common


def test_a_checkpoint_may_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    shuffles = lambda: {str(files().apply(i).getName()) for i in range(files().size()) if files().apply(i).getName().startswith("shuffle_")}
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count")
    before = shuffles()
    done = common.checkpointed(rows, shuffles_go=True)
    assert not shuffles() - before
    assert spark.conf.get(common.SHUFFLES_GO, None) is None
    assert done.count() == 100 and rows.count() == 100
