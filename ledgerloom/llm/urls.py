"""URL filtering: explicit host and path rules, and association rules of URL tokens mined by FP-growth.

Urls that an explicit rule decides are the labelled ones. Tokens that these have always together (those of one host, or
of one long path) are alike: one of them stands for all, or n of them would give 2 ** n token sets with the same rules.
A token whose labelled urls all have one verdict is a rule that no set with it can beat, and leaves. Of the others those are
mined on that improve some pair: FP-growth over these tokens and verdicts gives rules {tokens} -> verdict, kept by support and confidence. Sets that tell
without such a pair are too many to list (2 ** n on templates); an exact search adds the best of all of them for each set of tokens that is asked for. Every other url
gets the verdict of its best rule, found by an inverted index from token to rule.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, small, table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
SUPPORT = 0.01  #: least share of the labelled urls that have a rule's tokens and verdict
CONFIDENCE = 0.8  #: least share of the urls with a rule's tokens that have its verdict
IMPROVEMENT = 0.05  #: by so much a pair's confidence must be above that of both its tokens for these to be mined in sets
DEFAULT = "allow"  #: of urls that no rule fits
BROADCAST_SETS = 50_000
LISTED = 14  #: of so many tokens the search lists all sets; of more it finds the same rule by branch and bound
BROADCAST_INDEX = 200_000  #: most pairs of token and rule (16 bytes and a token) that are broadcast


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    found = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits host and path (null if none does).

    A rule like example.net/en/ fits its host and all subdomains if the path starts with its path (/en/).
    """
    found = None
    for rule, verdict in sorted(rules, key=lambda x: (-len(x[0]), x[0])):
        name, _, below = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + below)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url: each suffix of its host, its first host label, path segments with digits
    replaced by #, and parameter names."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, n - i + 1, i), ".")))
    first = F.array(F.concat(F.lit("first:"), F.element_at(labels, 1)))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(suffixes, first, segments, names))


def leaders(labelled: DataFrame, support: float = SUPPORT) -> DataFrame:
    """token and leader of each token that at least the share `support` of the rows (tokens, verdict) have: the least of all tokens that
    exactly the same rows have. Rows are told apart by two hashes of what they hold, summed up by token."""
    row = labelled.select("tokens", F.xxhash64(F.array_sort("tokens"), "verdict").alias("h"))
    least = labelled.count() * support
    by = row.select(F.explode("tokens").alias("token"), "h").groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("h", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    frequent = by.where(F.col("n") >= least)
    return frequent.join(frequent.groupBy("n", "a", "b").agg(F.min("token").alias("leader")), ["n", "a", "b"]).select("token", "leader")


def single_rules(labelled: DataFrame) -> DataFrame:
    """token, verdict, n (urls with both) and all (urls with the token) from rows (tokens, verdict, w), each of which stands for w urls."""
    by = labelled.select(F.explode("tokens").alias("token"), "verdict", "w").groupBy("token", "verdict").agg(F.sum("w").alias("n"))
    return by.join(by.groupBy("token").agg(F.sum("n").alias("all")), "token")


def productive(labelled: DataFrame, singles: DataFrame, least: float, improvement: float = IMPROVEMENT) -> DataFrame:
    """The tokens of pairs that at least `least` urls have with a verdict, and whose confidence is above that of both tokens by `improvement`.

    Tokens that go together without telling more, as those of a template of which each url lacks another one, are in no such pair; k of them would give 2 ** k sets.
    Rows are distinct sets of frequent tokens, each of which some share of all urls has.
    """
    pairs = labelled.select("verdict", "w", "tokens", F.posexplode("tokens").alias("i", "a")).select("verdict", "w", "a", F.explode(F.slice("tokens", F.col("i") + 2, F.size("tokens"))).alias("b"))
    by = pairs.groupBy("a", "b", "verdict").agg(F.sum("w").alias("n"))
    by = by.join(by.groupBy("a", "b").agg(F.sum("n").alias("all")), ["a", "b"]).where(F.col("n") >= least)
    alone = lambda t: singles.select(F.col("token").alias(t), "verdict", (F.col("n") / F.col("all")).alias(f"c_{t}"))
    better = by.join(alone("a"), ["a", "verdict"]).join(alone("b"), ["b", "verdict"]).where(F.col("n") / F.col("all") >= F.greatest("c_a", "c_b") + improvement)
    return better.select(F.explode(F.array("a", "b")).alias("token")).distinct()


def fewest(held: int, lacked: Iterable[int]) -> tuple[int, ...]:
    """The fewest bits of held, then the lowest, of which every mask in lacked lacks one (one bit at least)."""
    gaps = sorted({held & ~m for m in lacked}, key=int.bit_count)
    gaps = [g for i, g in enumerate(gaps) if not any(h & g == h for h in gaps[:i])] or [held]
    bits = lambda g: [i for i in range(g.bit_length()) if g >> i & 1]
    forced = sum(g for g in gaps if g.bit_count() == 1)
    best: list[tuple[int, tuple[int, ...]]] = []

    def cover(taken: int, left: list[int]) -> None:
        apart, seen = 0, 0  # gaps without a common bit need one each
        for g in left:
            if not g & seen:
                apart, seen = apart + 1, seen | g
        if best and taken.bit_count() + apart > best[0][0]:
            return
        if not left:
            best[:] = [min([*best, (taken.bit_count(), tuple(bits(taken)))])]
            return
        for i in bits(left[0]):
            cover(taken | 1 << i, [g for g in left if not g >> i & 1])

    cover(forced, [g for g in gaps if not g & forced])
    return best[0][1]


def listed(own: Counter, others: Counter, n: int, least: float, confidence: float) -> list[tuple[float, int, int, int]]:
    """(-confidence, -weight of own rows, number of bits, mask) of the masks of n bits with the highest confidence and then weight, from all that there are."""
    have, all_ = np.zeros(1 << n, "int64"), np.zeros(1 << n, "int64")
    for rows, sums in ((own, (have, all_)), (others, (all_,))):
        for m, w in rows.items():
            for x in sums:
                x[m] += w
    for x in (have, all_):  # of each mask the weight of the rows that have all its bits
        for i in range(n):
            by = x.reshape(-1, 2, 1 << i)
            by[:, 0] += by[:, 1]
    share = have / np.maximum(all_, 1)
    good = np.flatnonzero((have >= max(least, 1)) & (share >= confidence))
    good = good[good > 0]
    good = good[share[good] == share[good].max()] if len(good) else good
    good = good[have[good] == have[good].max()] if len(good) else good
    return [(-float(share[m]), -int(have[m]), int(m).bit_count(), int(m)) for m in good]


def searched(own: Counter, others: Counter, n: int, least: float, confidence: float) -> list[tuple[float, int, int, int]]:
    """As listed(), for any number of bits, by branch and bound: which rows of own does a mask keep? Rows kept leave the bits they share, and with these keep all rows
    that have them. Each row of the others that isn't kept yet is laid to one row of own that would keep it too; with the cheapest of these, the last in part, no mask does better."""
    full, best, rate, mark = (1 << n) - 1, [], Fraction(0), 0  # the best so far, with their confidence and weight
    least = Fraction(max(least, 1))
    stack = [(full, list(own.items()), list(others.items()), 0, 0, ())]  # bits left, rows open, kept weights, rows dropped
    while stack:
        bits, open_, against, got, cost, dropped = stack.pop()
        if any(m & bits == bits for m in dropped):
            continue  # kept after all: another branch has it
        got, open_ = got + sum(w for m, w in open_ if m & bits == bits), [x for x in open_ if x[0] & bits != bits]
        cost, against = cost + sum(w for m, w in against if m & bits == bits), [x for x in against if x[0] & bits != bits]
        if not bits:
            continue
        if got >= least and got / (got + cost) >= confidence:
            rank = (-got / (got + cost), -got)
            if not best or rank <= best[0][:2]:
                few = sum(1 << i for i in fewest(bits, (m for m in {**own, **others} if m & bits != bits)))
                best = [(*rank, few.bit_count(), few), *(x for x in best if x[:2] == rank)]
                rate, mark = Fraction(got, got + cost), got
        order = {m: i for i, (m, _) in enumerate(sorted(open_, key=lambda x: (-(x[0] & bits).bit_count(), -x[1])))}
        laid = Counter()
        for m, w in against:
            keeper = m if m in order else next((q for q in order if m & bits & q == q & bits), None)
            if keeper is not None:
                laid[keeper] += w
        cheapest = sorted(((Fraction(laid[m], w), w, m) for m, w in open_), key=lambda x: (x[0], -x[1]))
        if got + sum(w for _, w, _ in cheapest) < least:
            continue
        # the highest confidence, then the highest weight with that of the best so far
        g, c = Fraction(got), Fraction(cost)
        for ratio, w, _ in cheapest:
            if g >= least and (g and ratio * g >= c):
                break
            take = w if g and ratio * g < c else min(w, max(least - g, 0))
            g, c = g + take, c + ratio * take
        if float(g / (g + c)) < confidence:
            continue
        if best and g / (g + c) < rate:
            continue
        if best and g / (g + c) == rate:
            r, h = 1 / rate - 1, Fraction(got)
            room = r * got - cost
            for ratio, w, _ in cheapest:
                over = (ratio - r) * w
                part = min(Fraction(1), room / over) if over > 0 else 1
                h, room = h + w * part, room - over * part
                if part < 1:
                    break
            if h < mark:
                continue
        if cheapest:
            m = cheapest[0][2]
            rest = [x for x in open_ if x[0] != m]
            stack.append((bits, rest, against, got, cost, (*dropped, m)))
            stack.append((bits & m, open_, against, got, cost, dropped))
    return best


def best_set(asked: list[str], rows: Iterable[tuple[list[str], str, int]], least: float, confidence: float) -> tuple[list[str], str, int, int] | None:
    """tokens, verdict, weight with both and weight with the tokens of the best rule of some of the tokens asked for: of all sets of these, the one with the highest
    confidence, then support, then the fewest tokens, then these in order. None where none meets `least` and `confidence`. rows: what labelled rows share with asked.
    """
    asked = sorted(asked)
    bit, by, all_ = {t: 1 << i for i, t in enumerate(asked)}, {}, Counter()
    for tokens, verdict, w in rows:
        m = sum(bit[t] for t in tokens)
        by.setdefault(verdict, Counter())[m] += int(w)
        all_[m] += int(w)
    found = []
    for verdict, own in by.items():
        for c, w, k, m in (listed if len(asked) <= LISTED else searched)(own, all_ - own, len(asked), least, confidence):
            found.append((c, w, k, [t for t in asked if m & bit[t]], verdict))
    if not found:
        return None
    _, w, _, tokens, verdict = min(found)
    mask = sum(bit[t] for t in tokens)
    return tokens, verdict, -w, sum(n for m, n in all_.items() if m & mask == mask)


def best_sets(rows: DataFrame, sets: DataFrame, least: float, confidence: float) -> DataFrame:
    """tokens, verdict, n (urls with both) and all (urls with the tokens) of the best_set() of each array in sets' only column, from rows (tokens, verdict, w)."""
    asked = sets.toDF("asked").where(F.size("asked") > 1).select(F.array_sort("asked").alias("asked")).distinct()
    met = asked.select("asked", F.explode("asked").alias("t")).join(rows.select("tokens", "verdict", "w", F.explode("tokens").alias("t")), "t")
    met = met.select("asked", "t", F.array_intersect("asked", "tokens").alias("common"), "verdict", "w").where(F.col("t") == F.element_at("common", 1))  # a pair is met at its first token
    met = met.groupBy("asked", "common", "verdict").agg(F.sum("w").alias("w"))

    def found(group: pd.DataFrame) -> pd.DataFrame:
        rule = best_set(list(group["asked"].iloc[0]), zip(group["common"], group["verdict"], group["w"]), least, confidence)
        return pd.DataFrame([rule] if rule else [], columns=["tokens", "verdict", "n", "all"])

    return met.groupBy("asked").applyInPandas(found, "tokens array<string>, verdict string, n long, all long").distinct()


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, improvement: float = IMPROVEMENT, sets: DataFrame | None = None) -> DataFrame:
    """Rules (rule_id, tokens, verdict, confidence, support) from rows (tokens, verdict), tokens being sorted.

    All tokens of a rule's share of the rows give a rule alone. Sets are mined by FP-growth over tokens with several verdicts that are productive(). What these leave out is
    searched for by best_sets(): for each array of tokens in the only column of `sets` (by default the rows' own) the best rule of all is among those given.
    """
    rows = checkpointed(labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("w")))
    total = rows.agg(F.sum("w")).first()[0] or 0
    least = total * support
    singles = checkpointed(single_rules(rows))
    alone = singles.where((F.col("n") >= least) & (F.col("n") / F.col("all") >= confidence))
    as_rules = lambda df, tokens: df.select(tokens.alias("tokens"), "verdict", (F.col("n") / F.col("all")).alias("confidence"), (F.col("n") / F.lit(total)).alias("support"))
    rules = as_rules(alone, F.array("token"))
    # the number of frequent tokens is at most that of a url's on average / support
    mixed = [r["token"] for r in singles.where((F.col("all") >= least) & (F.col("n") < F.col("all"))).select("token").distinct().collect()]
    if mixed:
        among = lambda c: F.array_intersect(c, F.array(*map(F.lit, sorted(mixed))))
        some = checkpointed(rows.select(among("tokens").alias("tokens"), "verdict", "w").groupBy("tokens", "verdict").agg(F.sum("w").alias("w")))
        telling = sorted(r["token"] for r in productive(some, singles, least, improvement).collect())
        if telling:
            kept = F.array_intersect("tokens", F.array(*map(F.lit, telling)))
            items = labelled.select(F.concat(kept, F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
            found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items).associationRules
            found = found.where(F.element_at("consequent", 1).startswith("verdict=") & ~F.exists("antecedent", lambda x: x.startswith("verdict=")) & (F.size("antecedent") > 1))
            rules = rules.unionByName(found.select(F.sort_array("antecedent").alias("tokens"), F.substring_index(F.element_at("consequent", 1), "verdict=", -1).alias("verdict"), "confidence", "support"))
        asked = some.select("tokens") if sets is None else sets.toDF("tokens").select(among("tokens").alias("tokens"))
        rules = rules.unionByName(as_rules(best_sets(some, asked, least, confidence), F.col("tokens"))).dropDuplicates(["tokens", "verdict"])
    return rules.select(F.xxhash64("tokens", "verdict").alias("rule_id"), "*")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence of each row (page_id, url).

    verdict is the longest explicit rule's, or else that of the mined rule with the highest confidence (then support,
    then the fewest tokens, then these in code-point order) whose tokens the url all has, or else `default`. A url has a token if it has one that
    is alike in all labelled urls. mined is that rule's tokens joined by spaces, null where none decided. Null and
    malformed urls have empty host and path and get `default`; urls may have any length. With no labelled url nothing is mined.
    Rows may repeat; other columns are ignored.
    """
    rows = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    known = explicit(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", known["rule"].alias("rule"), known["verdict"].alias("given"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    labelled = rows.where("given is not null").select("tokens", F.col("given").alias("verdict"))
    no_rule = rows.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(default)).alias("verdict"), F.lit(None).cast("string").alias("mined"), F.lit(None).cast("double").alias("confidence"))
    # there are at most a labelled url's mean number of tokens / support of the frequent ones
    alike = {r["token"]: r["leader"] for r in leaders(labelled, support).collect()}
    if not alike:
        return no_rule
    leader = F.map_from_arrays(F.array(*map(F.lit, sorted(alike))), F.array(*(F.lit(alike[k]) for k in sorted(alike))))
    frequent = F.array_intersect("tokens", F.array(*map(F.lit, sorted(alike))))
    rows = rows.withColumn("set", F.array_sort(F.array_distinct(F.transform(frequent, lambda x: F.element_at(leader, x))))).drop("tokens")
    sets = rows.where("given is null and size(set) > 0").select("set").distinct()
    mined = checkpointed(mine(rows.where("given is not null").select(F.col("set").alias("tokens"), F.col("given").alias("verdict")), support, confidence, sets=sets))
    index, _ = small(mined.select(F.explode("tokens").alias("token"), "rule_id", F.size("tokens").alias("n")), BROADCAST_INDEX)
    hits = sets.select("set", F.explode("set").alias("token")).join(index, "token")
    full = hits.groupBy("set", "rule_id").agg((F.count("*") == F.first("n")).alias("whole")).where("whole").select("set", "rule_id")
    full = full.join(mined.select("rule_id", "tokens", "verdict", "confidence", "support", F.array_join("tokens", " ").alias("mined")), "rule_id")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("k"), "mined", "verdict")).alias("best")
    decided, _ = small(checkpointed(full.groupBy("set").agg(best)), BROADCAST_SETS)
    joined = rows.join(decided, "set", "left")
    decides = F.col("given").isNull() & F.col("best").isNotNull()
    return joined.select("page_id", "host", "path", "rule", F.coalesce("given", "best.verdict", F.lit(default)).alias("verdict"), F.when(decides, F.col("best.mined")).alias("mined"), F.when(decides, -F.col("best.c")).alias("confidence"))


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: page_id, host, path, rule, verdict, mined, confidence."""
    return judge(table(spark, sf_dir, "pages"))
