"""Similarity join of texts on word 5-grams (Jaccard similarity at least 0.8), with Bayesian candidate pruning.

1. Equal texts are one text; one document stands for it.
2. Every text gets a MinHash signature. Texts that agree in a band of it are candidates. Bands with the same texts count
   once.
3. The candidates of a band are compared, in block pairs where there are many: MinHash values are compared step by
   step, and a pair is dropped as soon as the posterior probability of reaching the threshold falls below TOLERANCE. A task
   gives a spanning set of the pairs that are left. Their connected components are the groups: texts that merely share
   a band, as boilerplate makes them, don't chain.
4. Groups are cut into blocks of about BLOCK bytes; every two blocks of a group meet in one task, so that a text is sent once for each BLOCK of its group. The pairs that pass the same
   comparison there are verified on the exact sets of 5-grams. A task gives the number of links of each text and a
   spanning set of them, never the pairs.
5. The connected components of the links are the classes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, checkpointed, pieces, small, table

N = 5  #: words of an n-gram
THRESHOLD = 0.8
BANDS, ROWS = 32, 5  #: a pair at the threshold shares no band with probability (1 - 0.8 ** 5) ** 32, 3e-6
STEP = 32  #: MinHash values compared at a time
TOLERANCE = 1e-6
BLOCK = 6 << 20  #: bytes of a block, signatures and sets of 5-grams
SIGNED = 2 << 20  #: bytes of a block of candidates, with their signatures alone
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


def shingles(texts: list[str | None], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of words of all texts, one text after the other, and where each text's start.

    Words are separated by white space. A text of fewer than n words has one n-gram, all its words; one without
    words has none.
    """
    lists = [x.split() if x else [] for x in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = np.array([w for x in lists for w in x], object)
    codes, distinct = pd.factorize(flat) if len(flat) else (np.zeros(0, np.int64), flat)
    h = pd.util.hash_array(np.asarray(distinct, object), categorize=False)[codes] if len(flat) else np.zeros(0, np.uint64)
    number = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    starts = np.concatenate([[0], np.cumsum(number)])
    first = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], number) + np.repeat(first[:-1], number)
    last = np.repeat(first[1:], number)
    out = np.full(len(place), np.uint64(n))
    for k in range(n):
        at = place + k
        inside = at < last
        out = np.where(inside, (out ^ h[np.minimum(at, len(h) - 1)]) * _MIX + np.uint64(k), out) if len(place) else out
    return _mixed(out), starts


_A = np.random.default_rng(11).integers(1 << 31, size=BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = np.random.default_rng(12).integers(1 << 32, size=BANDS * ROWS, dtype=np.uint32)


def signatures(texts: list[str | None]) -> np.ndarray:
    """MinHash signatures, a row of BANDS * ROWS numbers for each text (all ones for one without words)."""
    h, starts = shingles(texts)
    sig = np.full((len(texts), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    low, high = h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint32)
    some = np.flatnonzero(starts[1:] > starts[:-1])
    at = 0
    while at < len(some):  # slices that fit the processor's cache
        end = at + max(1, int((starts[some[at:] + 1] <= starts[some[at]] + 60_000).sum()))
        part = some[at:end]
        a, b = starts[part[0]], starts[part[-1] + 1]
        lo, hi, cut = low[a:b], high[a:b], starts[part] - a
        for k in range(BANDS * ROWS):
            x = lo * _A[k] + _B[k]
            x ^= x >> np.uint32(15)
            x = (x ^ hi) * _A[-1 - k]
            sig[part, k] = np.minimum.reduceat(x, cut)
        at = end
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of signatures; that of equal rows in different bands differs."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xA24BAED4963EE407)
    for r in range(ROWS):
        key = _mixed(key + s[:, :, r] * _MIX)
    return key.view(np.int64)


def least_agreeing(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(compared, agreeing): after so many values compared, pairs in which fewer agree are dropped.

    With a uniform prior of the similarity, the posterior after m of n agree is Beta(m + 1, n - m + 1), which exceeds
    the threshold t with the probability that a binomial variable of n + 1 draws with chance t is at most m.
    """
    out = []
    for n in range(step, BANDS * ROWS + 1, step):
        total, m = 0.0, 0
        while (total := total + comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def links_between(sig_a, sets_a, sig_b, sets_b, same: bool, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of the pairs of two blocks whose sets of n-grams are similar enough; same: one block with itself.

    The exact step counts common n-grams of a text with all that were not dropped, by an index of block b.
    """
    cuts = least_agreeing(threshold)
    size_b = np.array([len(x) for x in sets_b], np.int64)
    all_b = np.concatenate(sets_b) if len(sets_b) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets_b)), size_b)
    order = np.argsort(all_b, kind="stable")
    sorted_b, owner_b = all_b[order], owner[order]
    left, right = [], []
    for i, (s, x) in enumerate(zip(sig_a, sets_a)):
        if not len(x):
            continue
        alive = np.arange(i + 1, len(sig_b)) if same else np.arange(len(sig_b))
        size = size_b[alive]
        alive = alive[(size >= threshold * len(x)) & (size * threshold <= len(x)) & (size > 0)]
        agree, done = np.zeros(len(alive), np.int64), 0
        for n, least in cuts:
            if not len(alive):
                break
            agree = agree + (sig_b[alive, done:n] == s[done:n]).sum(1)
            alive, agree, done = alive[agree >= least], agree[agree >= least], n
        if not len(alive):
            continue
        lo, hi = np.searchsorted(sorted_b, x, "left"), np.searchsorted(sorted_b, x, "right")
        n = hi - lo
        hits = owner_b[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        common = np.bincount(hits, minlength=len(sets_b))[alive]
        good = alive[common >= threshold * (len(x) + size_b[alive] - common) - 1e-9]
        left.append(np.full(len(good), i))
        right.append(good)
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component), for the nodes of edges (a, b).

    Alternating stars: every node links its larger neighbours to its least neighbour, then its smaller ones, until
    nothing changes; rounds grow with the logarithm of the longest path. Each round is written to the checkpoint folder.
    Raises if the last of most_rounds still changed something.
    """
    both = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = checkpointed(both), None
    for _ in range(most_rounds):
        around = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
        # large star: neighbours above x go to the least of x and its neighbours
        large = now.join(least, now["b"] == least["x"]).select(now["a"], F.col("m").alias("b")).where("a != b").distinct()
        small_least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(small_least.withColumnRenamed("a", "x"), large["a"] == F.col("x"))
        nxt = star.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        now = checkpointed(nxt)
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(got) == mark:
            break
        mark = tuple(got)
    else:
        raise RuntimeError(f"components not found after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, _key (doc_id, or a hash of the text where that is null) and the hashes _h1 and _h2 of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), h1).alias("_key"), h1.alias("_h1"), h2.alias("_h2"))


def _signed(docs: DataFrame) -> DataFrame:
    """The keys of rows with 16 bits of each MinHash value, null for a text without words, and about how many bytes the text's signature and set of n-grams have."""

    def sign(batches):
        for batch in pieces(batches, 2 << 20):
            sig = signatures(batch.column("text").to_pylist())
            few = [None if (r == 0xFFFFFFFF).all() else r.astype(np.uint16).tobytes() for r in sig]
            yield pa.record_batch([*(batch.column(c) for c in ("_key", "named", "_h1", "_h2", "bytes")), pa.array(few, pa.binary())], ["_key", "named", "_h1", "_h2", "bytes", "sig"])

    size = (4 * BANDS * ROWS + 2 * F.length("text")).cast("long")  # a word and its n-gram's 8 bytes: mostly more than four characters
    rows = docs.select("_key", F.col("doc_id").isNotNull().alias("named"), "_h1", "_h2", F.coalesce(size, F.lit(0)).cast("long").alias("bytes"), "text")
    return rows.mapInArrow(sign, "_key long, named boolean, _h1 long, _h2 long, bytes long, sig binary")


def _banded(texts: DataFrame) -> DataFrame:
    """tid and key of each band of each text."""

    def bands(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
            yield pa.record_batch([pa.array(np.repeat(batch.column("tid").to_numpy(), BANDS)), pa.array(bands_of(sig).ravel())], ["tid", "key"])

    return texts.where("sig is not null").select("tid", "sig").mapInArrow(bands, "tid long, key long")


def _distinct_groups(bands: DataFrame) -> DataFrame:
    """key and n, the number of its texts, of each band with several texts; of bands with the same texts one."""
    by = bands.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y"))
    return by.where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n")


def candidate_groups(bands: DataFrame) -> DataFrame:
    """key, total (bytes of all signatures) and tid of the groups of texts within which all pairs that share a band meet."""
    groups = checkpointed(_distinct_groups(bands))
    return bands.join(groups, "key").select("key", (F.col("n") * (2 * BANDS * ROWS)).alias("total"), "tid")


def _dealt(members: DataFrame, group: str, block: int, what: list[str]) -> DataFrame:
    """Rows (group, total, tid, what) once for each pair (i, j) of blocks of their group that their own block is in, sorted by these; a group of `total` bytes has
    a block for each `block` bytes."""
    blocks = F.ceil(F.col("total") / block)
    placed = members.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("tid"), blocks)})
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select(F.col(group).alias("root"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "tid", *what)
    return met.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")


def _by_pair(batches, what: list[str]):
    """(i, j, rows (block, tid, what)) of each pair of blocks of a group, from sorted batches of _dealt(); rows that repeat once."""
    now, rows = None, []

    def done():
        return now and len(rows) > 1 and (*now[1:], list({r[1]: r for r in rows}.values()))

    for batch in batches:
        cols = [batch.column(c) for c in ("root", "i", "j", "block", "tid", *what)]
        root, i, j = (c.to_numpy() for c in cols[:3])
        change = np.flatnonzero((root[1:] != root[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *change], [*change, len(root)]):
            if (here := (int(root[a]), int(i[a]), int(j[a]))) != now:
                if found := done():
                    yield found
                now, rows = here, []
            rows += zip(*(c.slice(a, b - a).to_pylist() for c in cols[3:]))
    if found := done():
        yield found


PEERS = "tid long, peer long"


def _plausible(batches):
    """tid and peer: a spanning set of the pairs of candidates that the posterior leaves. Texts that are connected already
    aren't compared again."""
    cuts = least_agreeing()
    for i, j, rows in _by_pair(batches, ["sig"]):
        rows.sort(key=lambda r: (r[0], r[1]))
        ids = np.array([r[1] for r in rows], np.int64)
        sig = np.stack([np.frombuffer(r[2], np.uint16) for r in rows])
        own = sum(r[0] == i for r in rows)  # the first block's texts come first
        label = np.arange(len(ids))
        for x in range(len(ids) if i == j else own):
            alive = np.arange(x + 1 if i == j else own, len(ids))
            alive = alive[label[alive] != label[x]]
            agree, at = np.zeros(len(alive), np.int64), 0
            for n, least in cuts:
                if not len(alive):
                    break
                agree = agree + (sig[alive, at:n] == sig[x, at:n]).sum(1)
                alive, agree, at = alive[agree >= least], agree[agree >= least], n
            if len(alive):
                joined = np.unique(label[np.append(alive, x)])
                label[np.isin(label, joined)] = joined[0]
        linked = np.flatnonzero(label != np.arange(len(ids)))
        if len(linked):
            yield pa.record_batch([pa.array(ids[linked]), pa.array(ids[label[linked]])], ["tid", "peer"])


LINKS = "tid long, n long, peer long"


def _verified(batches):
    """tid, n and peer: how many links each text of a pair of blocks has inside, and a spanning set of them."""
    for i, j, rows in _by_pair(batches, ["sig", "grams"]):
        ids = np.array([r[1] for r in rows], np.int64)
        sig = np.stack([np.frombuffer(r[2], np.uint32) for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        if i == j:
            left, right = links_between(sig, sets, sig, sets, True)
        else:
            a = np.flatnonzero([r[0] == i for r in rows])
            b = np.flatnonzero([r[0] == j for r in rows])
            left, right = links_between(sig[a], [sets[k] for k in a], sig[b], [sets[k] for k in b], False)
            left, right = a[left], b[right]
        if not len(left):
            continue
        n = np.bincount(left, minlength=len(ids)) + np.bincount(right, minlength=len(ids))
        label, before = ids.copy(), None
        while before is None or (label != before).any():
            before = label.copy()
            np.minimum.at(label, left, before[right])
            np.minimum.at(label, right, before[left])
        on = n > 0
        yield pa.record_batch([pa.array(ids[on]), pa.array(n[on]), pa.array(label[on])], ["tid", "n", "peer"])


def _with_grams(rows: DataFrame) -> DataFrame:
    """Rows (tid, root, total, text) with the signature and the set of n-grams in place of the text."""

    def run(batches):
        for batch in pieces(batches, 2 << 20):
            texts = batch.column("text").to_pylist()
            h, starts = shingles(texts)
            sig = pa.array([r.tobytes() for r in signatures(texts)], pa.binary())
            grams = pa.array([np.unique(h[a:b]).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())
            yield pa.record_batch([*(batch.column(c) for c in ("tid", "root", "total")), sig, grams], ["tid", "root", "total", "sig", "grams"])

    return rows.select("tid", "root", "total", "text").mapInArrow(run, "tid long, root long, total long, sig binary, grams binary")


def _classed(rows: DataFrame) -> DataFrame:
    """_h1, _h2, text_id, class_id, n_links and leads (whether it is the one of its class that stays) of each text of keyed() rows."""
    texts = _signed(rows).groupBy("_h1", "_h2").agg(F.coalesce(F.min(F.when(F.col("named"), F.col("_key"))), F.col("_h1")).alias("text_id"), F.first("sig").alias("sig"), F.first("bytes").alias("bytes"))
    texts = checkpointed(texts).withColumn("tid", F.monotonically_increasing_id())  # of a written table: the same each time
    members = candidate_groups(_banded(texts)).join(texts.select("tid", "sig"), "tid")
    peers = checkpointed(_dealt(members, "key", SIGNED, ["sig"]).mapInArrow(_plausible, PEERS))
    groups = components(peers.select(F.col("tid").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "tid")
    groups = groups.join(texts.drop("sig"), "tid")
    sizes = groups.groupBy("root").agg(F.sum("bytes").alias("total"))
    inside = groups.join(sizes, "root").select("tid", "root", "total", "text_id", F.col("_h1").alias("_a"), F.col("_h2").alias("_b"))
    inside, _ = small(checkpointed(inside), 500_000)  # 48 bytes a row
    # of equal texts the row with the least id alone
    whole = rows.join(inside, (F.col("_key") == F.col("text_id")) & (F.col("_h1") == F.col("_a")) & (F.col("_h2") == F.col("_b")))
    links = checkpointed(_dealt(_with_grams(whole), "root", BLOCK, ["sig", "grams"]).mapInArrow(_verified, LINKS))
    counts = links.groupBy("tid").agg(F.sum("n").alias("n_links"))
    found = components(links.select(F.col("tid").alias("a"), F.col("peer").alias("b"))).withColumnRenamed("node", "tid")
    known = texts.drop("sig", "bytes").join(counts, "tid", "left").join(found, "tid", "left")
    linked = known.where("root is not null")
    first = linked.groupBy("root").agg(F.min(F.struct("text_id", "tid")).alias("lead")).select("root", "lead")
    linked = linked.join(first, "root").select("_h1", "_h2", "text_id", F.col("lead.text_id").alias("class_id"), "n_links", (F.col("lead.tid") == F.col("tid")).alias("leads"))
    alone = known.where("root is null").select("_h1", "_h2", "text_id", F.col("text_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("leads"))
    return linked.unionByName(alone)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, class_id, n_links for each row of docs.

    text_id is the least doc_id of the rows with the same text, class_id the least text_id of all texts connected
    with it by links, n_links the number of other texts with a Jaccard similarity of at least THRESHOLD.

    Null texts count as empty; empty ones (and those without words) are linked to nothing, equal ones still share a
    text_id. Texts of fewer than 5 words are compared by all their words in order. Rows may repeat, and an id may come with
    several texts, each of which is a text of its own; where all ids of a text are null, a hash of the text stands for them.
    Other columns are ignored; an empty table gives no row.
    """
    rows = keyed(docs)
    known = _classed(rows).drop("leads")
    return rows.select("doc_id", "_h1", "_h2").join(known, ["_h1", "_h2"]).select("doc_id", "text_id", "class_id", "n_links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class (that of the least doc_id), all columns as they are, whatever their names.

    Of rows that repeat an id and text one stays, and a row of a null id only if no row of an equal text has one. The rest is as for classes().
    """
    k, a, b, gone_k, gone_a, gone_b = apart(docs, "_key", "_h1", "_h2", "_gone_key", "_gone_h1", "_gone_h2")
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2 = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    rows = docs.select("*", F.coalesce(F.col("doc_id").cast("long"), h1).alias(k), h1.alias(a), h2.alias(b))
    plain = keyed(docs)
    texts = checkpointed(_classed(plain).select("_h1", "_h2", "text_id", "leads"))
    met = plain.select("doc_id", "_key", "_h1", "_h2").groupBy("_key", "_h1", "_h2").agg(F.count("*").alias("n")).join(texts, ["_h1", "_h2"])
    stays = F.col("leads") & (F.col("_key") == F.col("text_id"))
    judged = checkpointed(met.select("_key", "_h1", "_h2", stays.alias("stays"), (F.col("n") > 1).alias("repeats")).where("not stays or repeats"))
    gone, _ = small(judged.where("not stays").select(F.col("_key").alias(gone_k), F.col("_h1").alias(gone_a), F.col("_h2").alias(gone_b)), 1_000_000)
    kept = rows.join(gone, (F.col(k) == F.col(gone_k)) & (F.col(a) == F.col(gone_a)) & (F.col(b) == F.col(gone_b)), "left_anti")
    if not judged.where("stays and repeats").isEmpty():
        kept = kept.dropDuplicates([k, a, b])
    return kept.drop(k, a, b)


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text_id, class_id, n_links of every document."""
    return classes(table(spark, sf_dir, "documents"))
