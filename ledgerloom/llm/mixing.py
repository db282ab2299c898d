"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each document of a source gets the same expected number of copies (target / source size). Whole copies are given
outright; the fractional parts are settled by duels. A duel pairs two documents and moves words from one to the
other until one of the two has a probability of 0 or 1; which way the words move is drawn so that neither
document's expectation changes. The words of a pair never change in sum.

The duels run as a reduction tree: documents fall into blocks by a hash within their source and size class, each
block is folded to one residual document, the residuals fall into wider blocks, and so on until a source is one
block. A block has BLOCK documents on average at any input size, so no task ever holds a source. In a source's last
block, which also has about RESERVE documents that sat out the tree, the largest document is settled first: it is
drawn up or down once and trades with the smaller ones in turn until its probability is 0 or 1, then the next largest, and so on.
What a source is short of or above its target at the end is the rounding of the smallest documents left over.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, small, table

BLOCK = 48
#: Size classes for each doubling of the size: documents of a block differ by 9 % at most.
CLASSES = 8
#: Documents of a source, on average, that join its last block alone, so that a large residual finds partners there.
RESERVE = 128
SEED = 17
WEIGHTS = (5.0, 2.0, 1.0)
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words in a text: runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """rows with, for each of sums, its total over all rows that come before in a total order.

    Rows are sorted in ranges; a range's totals (one row each) are added up, and then the rows inside the range. No task sees all rows.
    """
    ranged = checkpointed(rows.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*(F.sum(x).alias(f"_all_{k}") for k, x in sums.items()))
    totals = totals.select("_range", *(F.coalesce(F.sum(f"_all_{k}").over(earlier), F.lit(0)).alias(f"_to_{k}") for k in sums))
    inside = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumns({k: F.coalesce(F.sum(x).over(inside), F.lit(0)) for k, x in sums.items()})
    met = local.join(F.broadcast(totals), "_range")  # one row for each shuffle partition
    return met.select(*rows.columns, *((F.col(k) + F.col(f"_to_{k}")).alias(k) for k in sums))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes, whose rows are (source, source_size, others), with the target of each source.

    The sources in code-point order (null last) weigh `weights`, repeating, and share `share` times all sizes by
    weight. A target stops at `most` times its source's size; the excess is shared again by weight among the
    others until none is above. In closed form: with sources sorted by limit / weight, the first k are at their
    limits, k being the least number for which the rest's level exceeds no limit.
    """
    by_name = _before(sizes, [F.col("source").asc_nulls_last()], _rank=F.lit(1))
    kind = (F.col("_rank") % len(weights)).cast("int")
    weighed = by_name.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), kind + 1)).withColumn("_most", F.col("source_size") * F.lit(float(most))).drop("_rank")
    ratio = F.col("_most") / F.col("_w")
    by_level = checkpointed(_before(weighed, [ratio, F.col("source").asc_nulls_last()], _capped=F.col("_most"), _heavy=F.col("_w")))
    total, weight = by_level.agg(F.sum("source_size"), F.sum("_w")).first()
    level = (F.lit(float((total or 0) * share)) - F.col("_capped")) / (F.lit(float(weight or 1)) - F.col("_heavy"))
    free = F.when(level * F.col("_w") <= F.col("_most"), F.struct(ratio.alias("at"), level.alias("level")))
    found = by_level.agg(F.min(free).alias("first")).first()["first"]
    target = F.col("_most") if found is None else F.least(F.col("_most"), F.lit(found["level"]) * F.col("_w"))
    return by_level.select(*sizes.columns, target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 (exclusive) that depends on parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _fold(units: Column, salt: Column) -> Column:
    """One residual and the finished units of an array of units, in the array's order.

    A unit is struct(s double, key long, p double, row struct); finished ones have p 0.0 or 1.0. The state holds
    the unit that still has a fraction, and what is finished.
    """

    def duel(state: Column, b: Column) -> Column:
        a = state["rest"]
        up = F.least(a["s"] * (1 - a["p"]), b["s"] * b["p"])  # words that can go from b to a
        down = F.least(a["s"] * a["p"], b["s"] * (1 - b["p"]))  # from a to b
        moved = F.when(_uniform(a["key"], b["key"], salt) * (up + down) < down, up).otherwise(-down)
        new_a = _unit(a["s"], a["key"], _settled(a["p"] + moved / a["s"]), a["row"])
        new_b = _unit(b["s"], b["key"], _settled(b["p"] - moved / b["s"]), b["row"])
        a_done = new_a["p"].isin(0.0, 1.0)
        rest, done = F.when(a_done, new_b).otherwise(new_a), F.when(a_done, new_a).otherwise(new_b)
        return F.struct(rest.alias("rest"), F.concat(state["done"], F.array(done)).alias("done"))

    start = F.struct(F.element_at(units, 1).alias("rest"), F.slice(units, 1, 0).alias("done"))
    return F.aggregate(F.slice(units, 2, F.size(units)), start, duel)


def _settle(units: Column, salt: Column) -> Column:
    """units, sorted with the largest first, with all fractions settled.

    One after the other is drawn up to 1 (with its probability p) or down to 0. Going up it takes of each smaller
    unit b the share c * (1 - p) of b's words, going down it gives it c * p, c being the largest share that leaves b's
    probability within 0 and 1 either way, until it is settled: so nobody's expectation changes, nor the sum of words. Where
    the smaller ones together can't trade enough a fraction stays; what fractions are left at the end are drawn one by one.
    """

    def turn(u: Column, i: Column) -> Column:
        a = F.element_at(u, i)
        p, up = a["p"], _uniform(a["key"], salt) < a["p"]

        def trade(state: Column, b: Column) -> Column:
            words = F.least(state["need"], b["s"] * F.least(b["p"] / (1 - p), (1 - b["p"]) / p))
            share = words / b["s"]
            new = _settled(b["p"] + F.when(up, -share * (1 - p)).otherwise(share * p))
            return F.struct((state["need"] - words).alias("need"), F.concat(state["done"], F.array(_unit(b["s"], b["key"], new, b["row"]))).alias("done"))

        traded = F.aggregate(F.slice(u, i + 1, F.size(u)), F.struct(a["s"].alias("need"), F.slice(u, 1, 0).alias("done")), trade, lambda s: F.array(s))

        def put(s: Column) -> Column:
            part = 1 - s["need"] / a["s"]
            new_p = _settled(p + F.when(up, part * (1 - p)).otherwise(-part * p))
            return F.concat(F.slice(u, F.lit(1), i - 1), F.array(_unit(a["s"], a["key"], new_p, a["row"])), s["done"])

        return F.when(p.isin(0.0, 1.0), u).otherwise(F.element_at(F.transform(traded, put), 1))

    done = F.aggregate(F.sequence(F.lit(1), F.size(units)), units, turn)
    return F.transform(done, lambda x: x.withField("p", F.when(x["p"].isin(0.0, 1.0), x["p"]).otherwise((_uniform(x["key"], salt, F.lit("rest")) < x["p"]).cast("double"))))


def _unit(s: Column, key: Column, p: Column, row: Column) -> Column:
    return F.struct(s.alias("s"), key.alias("key"), p.alias("p"), row.alias("row"))


def _settled(p: Column) -> Column:
    """p, with what floating point leaves beside 0 and 1 taken as 0 and 1."""
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def _decided(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, share=1.5, most=2.0, seed=SEED) -> DataFrame:
    """doc_id, source, _text (a hash), size, source_size, target, _n and _copies of each distinct row of docs: how
    many rows are alike, and how many copies the mix takes of them together."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col), F.lit(seed)).alias("_text"))
    keys = checkpointed(rows.groupBy("doc_id", "source", "size", "_text").agg(F.count("*").alias("_n")))
    sizes = keys.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sizes, weights, share, most)
    per_doc = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets, _ = small(checkpointed(targets.withColumn("_each", per_doc).withColumnRenamed("source", "_source")), 100_000)
    known = keys.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    expected = F.when(F.col("size") > 0, F.col("_n") * F.col("_each")).otherwise(0.0)
    whole = F.floor(expected + 1e-9)
    key = F.xxhash64("doc_id", "source", "size", "_text", F.lit(seed))
    row = F.struct("doc_id", "source", "_text", "size", "source_size", "target", "_n", whole.alias("_whole"))
    unit = _unit(F.col("size").cast("double"), key, _settled(expected - whole), row)

    blocks = max(1, math.ceil(keys.count() / BLOCK))
    apart = F.pmod(F.xxhash64(key, F.lit("reserve")), F.ceil(F.col("_rows") / RESERVE)) == 0
    units = known.select("source", F.floor(F.log2(F.greatest("size", F.lit(1))) * CLASSES).alias("_class"), F.pmod(key, F.lit(blocks)).alias("_block"), unit.alias("unit"), apart.alias("_apart"))
    settled = F.col("unit.p").isin(0.0, 1.0)
    done = [units.where(settled).select("unit")]
    units = units.where(~settled)
    level, depth = units.where("not _apart"), 0
    largest_first = F.sort_array(F.collect_list(F.struct((-F.col("unit.s")).alias("o"), "unit.key", "unit")))
    while True:
        by = ["source", "_class", "_block"]
        fold = _fold(F.transform("m", lambda x: x["unit"]), F.lit(seed * 1000 + depth))
        folded = level.groupBy(*by).agg(largest_first.alias("m")).select(*by, fold.alias("f"))
        folded = checkpointed(folded)  # the next level and the result both read it
        done.append(folded.select(F.explode("f.done").alias("unit")))
        level = folded.select("source", "_class", "_block", F.col("f.rest").alias("unit"))
        depth += 1
        if blocks == 1:
            break
        blocks = math.ceil(blocks / BLOCK)
        level = level.withColumn("_block", F.pmod(F.col("_block"), F.lit(blocks)))
    last = level.select("source", "unit").unionByName(units.where("_apart").select("source", "unit"))
    last = last.groupBy("source").agg(largest_first.alias("m")).select(F.explode(_settle(F.transform("m", lambda x: x["unit"]), F.lit(seed * 1000 + depth))).alias("unit"))
    done.append(last)
    out = functools.reduce(DataFrame.unionByName, done).select("unit.row.*", (F.col("unit.row._whole") + F.col("unit.p").cast("long")).alias("_copies"))
    return out.drop("_whole")


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies for each row of docs.

    size is the number of words; targets come from source_targets; copies is the number of times that the mix
    takes the row and taken is copies * size. copies is target / source_size rounded down or up, so taken never
    exceeds `most` times the size. Equal inputs give equal results whatever the partitions. Named arguments:
    id_col, text_col, source_col, weights, share, most, seed.

    Null text has size 0 and like every empty text is never taken (0 copies). Null source is a source of its own,
    the last in order. Rows that are equal in id, source and text are one unit with a multiplicity, whose copies
    are dealt out evenly; null ids are allowed. An empty table gives an empty result; other columns are ignored.
    """
    dealt = _decided(docs, **how).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    copies = F.floor(F.col("_copies") / F.col("_n")) + (F.col("_i") <= F.col("_copies") % F.col("_n")).cast("long")
    return dealt.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed(docs: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """The rows of docs (doc_id, text, source and any others) that the mix takes, each as often as it takes it, with
    `copy` counted from 1; a column copy of docs is replaced. Arguments and cases are those of mix(); of rows equal
    in doc_id, source and text one stands for all. Other columns, whatever their names, pass.
    """
    decided = _decided(docs, seed=seed, **how).select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_text").alias("_h"), "_n", "_copies")
    kept = [c for c in docs.columns if c.lower() != "copy"]
    # what docs has beside doc_id, text and source travels in one struct, so that no name can clash
    rows = docs.select("doc_id", "source", F.xxhash64("text", F.lit(seed)).alias("_hash"), F.struct(*kept).alias("_row"))
    if not decided.where("_n > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", "source", "_hash"])
    same = (F.col("_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    met = rows.join(decided.where("_copies > 0"), same)
    return met.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy")).select("_row.*", "copy")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: doc_id, size, source_size, target, taken, copies."""
    return mix(table(spark, sf_dir, "documents"))
