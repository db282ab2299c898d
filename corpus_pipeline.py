"""A training-data pipeline over documents in five stages, each written as Parquet and read again by the next.

1. toxicity: documents whose score reaches the rejection threshold go.
2. near duplicates: of each class of texts linked by similarity one document stays.
3. benchmark decontamination: documents in which a benchmark item occurs go.
4. personal data: valid values become pseudonyms of the same format.
5. mixing: each document is repeated as often as the mix takes it, with a copy number.

Every stage but the last returns the columns of documents; n_chars follows the text. The stages are judged on what
the stage before kept.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mixing, near, pii, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that score toxicity.THRESHOLD or more; learned from labels of documents that aren't held out.
    Null and empty texts score lowest and stay; rows may repeat. With no labels nothing goes."""
    net = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, net, [*COLUMNS[:1], *COLUMNS[2:], "text"])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, the one with the least doc_id, of each class of texts that links join (near.classes()).
    Null texts count as empty ones; all empty texts are one class, as are texts of white space that are equal."""
    return near.one_of_each(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those in which a benchmark item occurs (decontaminate.matches()). Each row is judged by its own text, whatever its id, which may be
    null or repeat; null and empty texts stay."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with pseudonyms for personal values (pii.pseudonymise(), with the session's key) and n_chars of the new text;
    null texts stay null, with null for n_chars."""
    return pii.pseudonymise(docs, key=pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes: the columns of documents and copy, from 1; one row for each copy. Documents
    without words, null texts among them, have nothing to take and go; a null source is one of its own."""
    return mixing.mixed(docs).select(*COLUMNS, "copy")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", drop_benchmark),
    ("personal data", hide_personal),
    ("mixing sources", mix),
]

#: The stages learn a network, compare signatures and draw; SQL can't express them. Tests check each by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages return is written below the session's spark.checkpoint.dir; a stage's folder is
    deleted as soon as the next one is written, so that at most two copies of the corpus are kept at a time and one
    stays, which the returned DataFrame reads. Columns that documents has beside COLUMNS don't enter."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpus-pipeline-")
    docs, at = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            _delete(spark, f"{at}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that run() has written, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
