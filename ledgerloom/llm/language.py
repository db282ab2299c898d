"""Language identification by compression: a text is encoded with each language's zstandard dictionary, and the
language whose dictionary makes it smallest wins.

A dictionary is raw content: pieces of documents of that language, drawn by a hash of their ids. The draw is bounded
(PIECES pieces of PIECE characters for each language, MOST for all), whatever the size of the table, and the dictionaries are the
only thing sent to the executors. Dictionaries and texts are lower-cased letters with one space for anything else, so
that capitals, digits and marks don't hide the words. Texts are cut into chunks that are compressed on their own, so that what a long
text says itself doesn't take the dictionary's place; the sizes of all chunks of the whole text are added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import checkpointed, held_out, table

PIECES = 256  #: pieces of text in a dictionary
PIECE = 1000  #: characters of a piece
MOST = 128_000  #: pieces of all languages together; with more languages than MOST / PIECES each has fewer pieces, one at least
CHUNK = 1024  #: bytes compressed at a time
LEVEL = 5
MARGIN = 0.01  #: a best size less than this share below the second best is rejected


def letters(text: Column) -> Column:
    """text lower-cased, with one space for each run of other characters than letters."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


def learn(docs: DataFrame, pieces: int = PIECES, piece: int = PIECE, most: int = MOST) -> dict[str, bytes]:
    """The dictionary of each language, from rows (doc_id, text, lang) with a lang.

    Each of `pieces` hash buckets of a language gives, of its documents with a letter, the one with the least hash among
    those of at least 200 characters, or among the shorter ones where it has no such, and of it `piece` characters from
    a place that the hash picks. So every language with a letter in some document has a dictionary. Languages come by their number of documents, then in code-point order.
    Where `most` pieces don't suffice for all languages each has fewer.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "doc_id", F.xxhash64("doc_id").alias("h"), "text")
    bucket = F.pmod("h", F.lit(pieces))
    start = (F.pmod(F.shiftrightunsigned("h", 16), F.greatest(F.lit(1), F.length("text") - piece)) + 1).cast("int")
    first = F.min(F.struct((F.length("text") < 200).alias("short"), "h"))
    least = rows.groupBy("lang", bucket.alias("b")).agg(first.alias("first"), F.count("*").alias("n"))
    found = least.select("lang", "first.h", "n").limit(most + 1).collect()
    if len(found) > most:  # many languages: buckets are joined until all have room
        least = checkpointed(least)
        languages, share = least.select("lang").distinct().count(), pieces
        while share > 1 and languages * share > most:
            share = -(-share // 2)
        joined = least.groupBy("lang", F.pmod("b", F.lit(share)).alias("b")).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        found = joined.select("lang", "first.h", "n").collect()  # `most` rows, or one for each language
    picked = [(r["lang"], r["h"]) for r in found]
    if not picked:
        return {}
    # at most `most` rows, or one for each language, sent to all executors
    wanted = F.broadcast(docs.sparkSession.createDataFrame(picked, "lang string, h long"))
    chosen = rows.join(wanted, ["lang", "h"]).select("lang", "h", letters(F.substring("text", start, F.lit(piece))).alias("t")).distinct()
    out: dict[str, list[bytes]] = {}
    seen: dict[str, int] = {}
    for r in found:
        seen[r["lang"]] = seen.get(r["lang"], 0) + r["n"]
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"], r["t"])):
        out.setdefault(r["lang"], []).append(r["t"].encode())
    return {k: b" ".join(v) for k, v in sorted(out.items(), key=lambda x: (-seen[x[0]], x[0]))}


def chunks(data: bytes) -> list[bytes]:
    """data in chunks of CHUNK bytes; a last one of under a quarter goes with the one before."""
    n = max(1, (len(data) + CHUNK - CHUNK // 4) // CHUNK)
    return [data[i * CHUNK : (i + 1) * CHUNK if i < n - 1 else len(data)] for i in range(n)]


def sizes_of(data: bytes, compressors: list) -> np.ndarray:
    """Bytes of data compressed with each compressor."""
    parts = chunks(data)
    return np.array([sum(len(c.compress(x)) for x in parts) for c in compressors], float)


def compressors_of(model: dict[str, bytes]) -> list:
    out = []
    for content in model.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def classify(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """doc_id, best, margin, score, lang for each row of docs.

    best is the language with the smallest encoding (on ties the one that comes first in the model, where the one with
    the most training documents comes first), margin the share by
    which it lies below the second smallest, score 1 - 2 ** -(1 + 100 * margin) (0.5 for a tie, towards 1), lang is
    best or null where the margin is narrower than `margin`. Null texts and texts without a letter have `und` for
    best, null for lang and margin and score 0, as has every text if the model is empty. Ids may repeat; other
    columns are ignored.
    """
    if not model:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit("und").alias("best"), F.lit(None).cast("double").alias("margin"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("lang"))
    spark = docs.sparkSession
    shared, names = spark.sparkContext.broadcast(model), list(model)

    def run(batches):
        tools = compressors_of(shared.value)
        for batch in common.pieces(batches):
            best, gap = [], []
            for x in batch.column("data").to_pylist():
                if x is None:
                    best.append("und")
                    gap.append(None)
                    continue
                s = sizes_of(x, tools)
                k = int(s.argmin())
                second = np.delete(s, k).min() if len(s) > 1 else s[k] * 2
                best.append(names[k])
                gap.append(float(1 - s[k] / second))
            yield pa.record_batch([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(gap, pa.float64())], ["doc_id", "best", "margin"])

    data = F.when(F.col(text_col).rlike(r"\p{L}"), letters(F.col(text_col)).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, best string, margin double")
    score = F.coalesce(1 - F.pow(F.lit(2.0), -(1 + 100 * F.col("margin"))), F.lit(0.0))
    return found.select("*", score.alias("score"), F.when(F.col("margin") >= margin, F.col("best")).alias("lang"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; learned from those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    found = classify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("best").alias("lang_pred"), "score", F.col("lang").isNull().alias("rejected"))
