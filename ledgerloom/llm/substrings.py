"""Exact removal of repeated byte strings by bucket-pointer refinement, as a suffix array is sorted.

A position's first bucket is its Q-gram. Positions that share a bucket are sorted on pairs (bucket of the position, bucket
at the offset reached), every new bucket gets a pointer to one of its positions as its identifier, and these identifiers are
what the next round sorts on; positions alone in their bucket are settled and leave. This goes on until LENGTH bytes are told apart:

1. Not all positions are sorted, but in every window of LENGTH bytes the Q-gram with the least name, its anchor; windows in a
   row with one anchor are a unit. Equal windows have equal anchors, so a unit whose anchor is alone in its bucket repeats
   nothing. Equal units are one bucket: all but the first of it are repeated as a whole.
2. Of units that differ in an anchor's bucket, two strings are refined: the one that ends and the one that starts with the
   anchor, by the Q-gram before or after it, in rounds from Q to HALF bytes. Every window holds one of the two.
3. The windows that hold a string which still shares its bucket are sorted on its pointer, their place around it and the
   buckets of their other Q-grams, LENGTH bytes in all. Those that share a bucket are equal.

Names of Q-grams have 64 bits; if two coincide, buckets are merged and told apart later. Units and windows are named by
128 bits, a chain of Q-grams' names, and compared with others of the same anchor or pointer alone. Bytes aren't compared.

Spark sorts and numbers buckets; numpy computes names within documents. Of each Arrow batch one row of a bucket takes part,
whatever the round, and what the batch shows of the others (that they are repeated, or not alone) needs no more: a bucket
that holds a third of all rows meets as one row for each batch, in groups that spill.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, pieces, small, table
from .near import _mixed, keyed

LENGTH, Q, HALF = 100, 20, 60
_SPAN = LENGTH - Q  #: the last offset of a Q-gram in a window
_SEGMENT = 1 << 22  #: windows of a document handled at a time
_POS = np.uint64((1 << 24) - 1)
_T = np.random.default_rng(21).integers(1 << 64, size=256, dtype=np.uint64)
_C = np.random.default_rng(22).integers(1 << 62, size=8, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def grams(b: np.ndarray) -> np.ndarray:
    """Identifiers of the Q-grams of bytes b, by doubling: 2, 4, 8, 16 bytes, then 16 and 4."""
    i, four = _T[b], None
    for k, n in enumerate((1, 2, 4, 8)):
        i = i[:-n] * _C[k] + i[n:]
        if n == 2:
            four = i
    return _mixed(i[: len(b) - Q + 1] * _C[4] + four[16 : 16 + len(b) - Q + 1])


def units(g: np.ndarray) -> tuple[np.ndarray, ...]:
    """First and last window of each unit, the name of its anchor, and the unit's two names."""
    low = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    n = 1
    while 2 * n <= _SPAN + 1:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    rest = _SPAN + 1 - n
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & _POS).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    anchor = at[first]
    u = v = (anchor - first).astype(np.uint64) * _C[5] + (last - first).astype(np.uint64)
    end = last + _SPAN
    for k in range(0, 2 * _SPAN + 1, Q):
        x = g[np.minimum(first + k, end)]
        u, v = u * _C[6] + x, v * _C[7] + x
    return first, last, g[anchor], _mixed(u), _mixed(v ^ _C[5])


def window_names(g: np.ndarray, at: np.ndarray, own: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of the windows that start at `at` and hold a string with the pointer `own` at `place`."""
    start = own.view(np.uint64) * _C[4] + place.astype(np.uint64)
    a, b = start, start
    for k in range(0, LENGTH, Q):
        x = g[at + k]
        a, b = a * _C[6] + x, b * _C[7] + x
    return _mixed(a), _mixed(b ^ _C[5])


def _segments(data: bytes):
    """Start and bytes of the parts of a document, which share LENGTH - 1 bytes so that each window is in one."""
    for at in range(0, len(data) - LENGTH + 1, _SEGMENT):
        yield at, np.frombuffer(data, np.uint8)[at : at + _SEGMENT + LENGTH - 1]


def _first_seen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each pair of names is the first of its kind, in order."""
    order = np.lexsort((b, a))  # stable
    x, y = a[order], b[order]
    seen = np.zeros(len(a), bool)
    seen[order[np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])])]] = True
    return seen


def _at(start: np.ndarray, more: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """A start, the number of further windows and a flag as one number."""
    return start << 9 | more << 1 | flag


def _in_order(batch):
    """Keys and data of a batch, least key first, and their rows; a key that repeats counts once."""
    keys, order = np.unique(batch.column("_key").to_numpy(), return_index=True)
    data = batch.column("data")
    return keys, [data[i].as_py() for i in order], order


_UNIT = "a long, b long, c long, _key long, at long, kind int"  # at: start, further windows, whether it is known to be repeated
_PLAIN, _SPLIT, _MARK = 0, 1, 2  # kinds: a unit; one whose anchor other units of the batch have; a row that stands for these


def _unit_rows(batches):
    """A row for each unit: its anchor's name, its two names, its document and place. Units that the batch shows to share an anchor
    are marked so, and one more row tells other batches."""
    for batch in pieces(batches, 8 << 20):
        keys, data, _ = _in_order(batch)
        found = []
        for n, x in enumerate(data):
            for start, part in _segments(x):
                first, last, anchor, b, c = units(grams(part))
                found.append((anchor, b, c, np.full(len(first), n), first + start, last - first))
        if found:
            a, b, c, owner, start, more = (np.concatenate(x) for x in zip(*found))
            known = ~_first_seen(b, c)
            key, at = keys[owner], _at(start, more, known)
            b, c = np.where(known, key, b.view(np.int64)), np.where(known, at, c.view(np.int64))  # a bucket apart
            fresh = np.flatnonzero(~known)
            _, one, place, count = np.unique(a[fresh], return_index=True, return_inverse=True, return_counts=True)
            kind = np.full(len(a), _PLAIN)
            kind[fresh[count[place] > 1]] = _SPLIT
            m = fresh[one[count > 1]]  # rows to stand for others, in buckets apart
            cols = (np.append(a, a[m]).view(np.int64), np.append(b, key[m]), np.append(c, ~at[m]), np.append(key, key[m]), np.append(at, at[m]))
            yield pa.record_batch([*map(pa.array, cols), pa.array(np.append(kind, np.full(len(m), _MARK)), pa.int32())], ["a", "b", "c", "_key", "at", "kind"])


def _open_parts(batches, what: list[str]):
    """Batches as (keys, [(number of the document, start of the part, its Q-grams, the places in it of what is open, their `what`)])."""
    for batch in pieces(batches, 8 << 20):
        keys, data, order = _in_order(batch)
        spans, found = batch.column("open"), []
        for n, x in enumerate(data):
            open_ = spans[int(order[n])].values  # structs
            mine = [open_.field(c).to_numpy() for c in ("at", *what)]
            once = np.unique(mine[0] << 1 | (mine[1] if what else 0), return_index=True)[1]  # a text's row may come twice
            mine = [m[once] for m in mine]
            for start, part in _segments(x):
                lo = mine[0] >> 9
                here = (lo >= start) & (lo < start + _SEGMENT)
                if here.any():
                    found.append((n, start, grams(part), *(m[here] for m in mine)))
        yield keys, found


def _anchors(g: np.ndarray, start: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window and anchor of units: the anchor has the least name of all that its windows hold."""
    lo = (at >> 9) - start
    hi = lo + ((at >> 1) & 255)
    low = (g & ~_POS) | np.arange(len(g), dtype=np.uint64)
    return lo, hi, np.array([int(low[i : j + 1].min() & _POS) for i, j in zip(hi, np.minimum(lo + _SPAN, len(g) - 1))], np.int64)


_STRING = "own long, l1 long, l2 long, _key long, at long, side int, twice boolean, apart long"


def _string_rows(batches):
    """The string before (side 0) and after (side 1) the anchor of each open unit: the anchor's name, and the names of the
    Q-grams next to it and next but one. twice: the batch has it twice; apart isn't 0 for all but the first of these."""
    for keys, parts in _open_parts(batches, []):
        out = []
        for n, start, g, at in parts:
            lo, hi, anchor = _anchors(g, start, at)
            split = anchor - (HALF - Q)  # windows that start here or before hold the string before
            for side, some, step in ((0, lo <= split, -Q), (1, hi > split, Q)):
                x = anchor[some]
                out.append((g[x], g[x + step], g[x + 2 * step], np.full(len(x), n), at[some], np.full(len(x), side)))
        if out and sum(len(x[0]) for x in out):
            own, l1, l2, owner, at, side = (np.concatenate(x) for x in zip(*out))
            both = _mixed((own * _C[4] + l1) * _C[6] + l2) ^ side.astype(np.uint64)
            _, first, place, count = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
            later = np.ones(len(own), bool)
            later[first] = False
            apart = np.where(later, _mixed(keys[owner].view(np.uint64) * _C[4] + at.view(np.uint64)).view(np.int64) | 1, 0)
            cols = [*(x.view(np.int64) for x in (own, l1, l2)), keys[owner], at, side.astype(np.int32), count[place] > 1, apart]
            yield pa.record_batch([pa.array(x) for x in cols], [x.split(" ")[0] for x in _STRING.split(", ")])


_WINDOW = "a long, b long, _key long, at long"


def _window_rows(batches):
    """A row for each window that holds an open string: its two names, its document and place."""
    for keys, parts in _open_parts(batches, ["side", "own"]):
        out = []
        for n, start, g, at, side, own in parts:
            lo, hi, anchor = _anchors(g, start, at)
            split = anchor - (HALF - Q)
            first, last = np.where(side == 0, lo, np.maximum(lo, split + 1)), np.where(side == 0, np.minimum(hi, split), hi)
            begin = np.where(side == 0, split, anchor)  # of the string
            count = last - first + 1
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            w = np.repeat(first, count) + nth
            a, b = window_names(g, w, np.repeat(own, count), np.repeat(begin, count) - w)
            out.append((a, b, np.full(len(w), n), w + start))
        if out and sum(len(x[0]) for x in out):
            a, b, owner, w = (np.concatenate(x) for x in zip(*out))
            known, key = ~_first_seen(a, b), keys[owner]
            at = _at(w, np.zeros_like(w), known)
            a, b = np.where(known, key, a.view(np.int64)), np.where(known, at, b.view(np.int64))  # a bucket apart
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(key), pa.array(at)], ["a", "b", "_key", "at"])


def _with_buckets(rows: DataFrame, by: list[str], **sums: Column) -> DataFrame:
    """rows with sums over their bucket (rows alike in `by`). Whatever its size in the data, a bucket has one row here of each Arrow
    batch (8 MB of text); the others of a batch come with names that set them apart."""
    bucket = Window.partitionBy(*by)
    return rows.withColumns({name: x.over(bucket) for name, x in sums.items()})


def refined(strings: DataFrame) -> DataFrame:
    """Rows (own, _key, at, side) of the strings that still share their bucket after rounds over l1 and l2.

    A round sorts on (own, name at the offset reached); own becomes the name of that pair, and who is alone leaves.
    """
    for later in ("l1", "l2"):
        by = ["own", later, "side", "apart"]
        bucket = _with_buckets(strings, by, n=F.count("*"), many=F.max("twice")).where("n > 1 or many or apart != 0")
        strings = bucket.select(F.xxhash64("own", later).alias("own"), "l2", "_key", "at", "side", "twice", "apart")
    return strings.select("own", "_key", "at", "side")


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches):
    """Digests of what stays of each document without the spans in `cut`."""
    for batch in pieces(batches, 8 << 20):
        out = []
        for x, spans in zip(batch.column("data").to_pylist(), batch.column("cut").to_pylist()):
            if not spans:
                out.append((len(x), 0, 0, hashlib.sha256(x).hexdigest()))
                continue
            s = np.sort(np.array(spans, np.int64))
            a, b = s >> 9, (s >> 9) + (s >> 1 & 255) + LENGTH
            reach = np.maximum.accumulate(b)
            new = np.flatnonzero(np.concatenate([[True], a[1:] > reach[:-1]]))
            starts, ends = a[new], reach[np.concatenate([new[1:] - 1, [len(a) - 1]])]
            kept = b"".join(x[i:j] for i, j in zip([0, *ends], [*starts, len(x)]))
            out.append((len(x), len(x) - len(kept), len(starts), hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([batch.column("doc_id"), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", *(x.split(" ")[0] for x in DIGEST.split(", "))])


def repeated_spans(texts: DataFrame) -> DataFrame:
    """_key and cut, the repeated runs of windows (start << 9 | further windows << 1 | 0 or 1), from rows (_key, doc_id, data)
    of distinct texts. A window is repeated if it occurs with a smaller key, or earlier with the same."""
    known = F.col("at").bitwiseAND(1) == 1
    rows = texts.select("_key", "data").where(F.octet_length("data") >= LENGTH).mapInArrow(_unit_rows, _UNIT)
    seen = _with_buckets(rows, ["b", "c"], first=F.min("_key")).withColumn("repeated", known | (F.col("first") < F.col("_key")))
    apart = F.when(F.col("repeated") | (F.col("kind") == _SPLIT), F.xxhash64("_key", "at").bitwiseOR(1)).otherwise(0)
    seen = seen.select("a", apart.alias("apart"), "_key", "at", "repeated", "kind")
    buckets = _with_buckets(seen, ["a", "apart"], n=F.count("*"), most=F.max("kind")).where(F.col("kind") != _MARK)
    judged = checkpointed(buckets.where((F.col("n") > 1) | (F.col("apart") != 0) | (F.col("most") == _MARK)).select("_key", "at", "repeated"), shuffles_go=True)  # two shuffles of all units, together over twice the input

    unsettled = judged.where("not repeated").groupBy("_key").agg(F.collect_list(F.struct("at")).alias("open"))
    # all joins with texts read the same columns, so that one shuffle of them serves all
    strings = refined(texts.join(unsettled, "_key").select("_key", "doc_id", "data", "open").mapInArrow(_string_rows, _STRING))
    still = strings.groupBy("_key").agg(F.collect_list(F.struct("at", "side", "own")).alias("open"))
    windows = texts.join(still, "_key").select("_key", "doc_id", "data", "open").mapInArrow(_window_rows, _WINDOW)
    again = _with_buckets(windows, ["a", "b"], first=F.min("_key")).where(known | (F.col("first") < F.col("_key"))).select("_key", "at")
    return judged.where("repeated").select("_key", "at").unionByName(again).groupBy("_key").agg(F.collect_list("at").alias("cut"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of keyed() with a _key that is another for another text. Where no id has several texts it stays as it is, else all documents
    are numbered in the order of id and text hash."""
    several = rows.groupBy("_key").agg((F.min("_h1") != F.max("_h1")).alias("x"), (F.min("_h2") != F.max("_h2")).alias("y")).where("x or y")
    if several.isEmpty():
        return rows
    order = checkpointed(rows.select("_key", "_h1", "_h2").distinct().orderBy("_key", "_h1", "_h2"))
    number = order.select(F.col("_key").alias("_k"), "_h1", "_h2", F.monotonically_increasing_id().alias("_n"))  # of a written table: the same each time
    met = rows.join(checkpointed(number), ["_h1", "_h2"]).where("_key = _k")
    return met.withColumn("_key", F.col("_n")).drop("_k", "_n")


def removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Removed is each byte covered by a string of LENGTH bytes that also starts earlier: in a document with a smaller
    id, or in the same one. Strings are judged on the input, overlaps count, matches never cross documents.

    Null texts count as empty; texts under LENGTH bytes lose nothing. Rows that repeat a doc_id and text count as
    one document and have the same result; other texts of one id are documents of their own, in the order of a hash of the
    text; rows with a null doc_id come in the order of that hash. Other columns are ignored; an empty table gives no row.
    """
    rows = _numbered(keyed(docs)).select("doc_id", "_key", "_h1", "_h2", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    least = rows.groupBy("_h1", "_h2").agg(F.min("_key").alias("first"), F.max("_key").alias("last")).where("first < last")
    # every text's rows but those of its least key: whole copies
    copies = checkpointed(rows.select("_key", "_h1", "_h2").join(least, ["_h1", "_h2"]).where("_key > first").select(F.col("_key").alias("_copy")).distinct())
    copies, _ = small(copies, 1_000_000)  # 8 bytes a row
    firsts = rows.join(copies, F.col("_key") == F.col("_copy"), "left_anti").select("_key", "doc_id", "data")
    kept = firsts.join(repeated_spans(firsts), "_key", "left").select("_key", "doc_id", "data", "cut")
    kept = kept.mapInArrow(_cut, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
    n = F.octet_length("data").cast("long")
    gone = n >= LENGTH
    whole = rows.join(copies, F.col("_key") == F.col("_copy"), "left_semi").select(
        "doc_id", n.alias("n_bytes"), F.when(gone, n).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"),
        F.sha2(F.when(gone, F.lit(b"")).otherwise(F.col("data")), 256).alias("kept_sha256"),
    )
    return kept.unionByName(whole)


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    return removed(table(spark, sf_dir, "documents"))
