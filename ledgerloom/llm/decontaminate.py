"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with k = floor(RATE * m) edits. Cut into k + 1 pieces, one of them must occur
unchanged. The pieces of all items are found in one pass over a text (a multi-pattern automaton); places where a piece
occurs are verified with Myers' bit-parallel edit distance, where enough pieces half as long are near that a match is possible.
Items of fewer than SHORTEST characters must occur unchanged and as whole words; the same automaton finds them.

The items are the stated query set, sent to the executors in blocks of about BLOCK_CHARS characters, one after the
other; documents are read once for each block and never shuffled.
"""

from __future__ import annotations

import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, checkpointed, pieces, table

RATE = 0.1  #: edits allowed for each character of an item
SHORTEST = 20  #: shorter items are too unspecific for edits: they occur verbatim, as whole words
BLOCK_CHARS = 16_000_000  #: characters of items that executors hold at a time


def normal(text: str) -> str:
    """Lower-cased, each run of white space one space, trimmed."""
    return " ".join(text.lower().split())


def cut_up(item: str, k: int) -> list[tuple[int, str]]:
    """Offsets and texts of k + 1 pieces of about equal length that make up the item."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _in_word(c: str) -> bool:
    """Whether c is a letter, mark, digit or _ of a script that puts spaces between words."""
    if "\u0e00" <= c <= "\u0eff" or "\u1000" <= c <= "\u109f" or "\u1780" <= c <= "\u17ff" or "\u2e80" <= c <= "\u9fff" or c >= "\U00020000":
        return False
    return c == "_" or unicodedata.category(c)[0] in "LMN"


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether text[a:b], which isn't empty, neither starts nor ends inside a word."""
    cuts = [i for i in (a, b) if 0 < i < len(text)]
    return not any(_in_word(text[i - 1]) and _in_word(text[i]) for i in cuts)


class Pattern:
    """An item with its budget, small pieces and bit masks."""

    def __init__(self, item_id, text: str, rate: float = RATE, shortest: int = SHORTEST):
        self.item_id, self.text, self.m = item_id, text, len(text)
        self.short = self.m < shortest
        self.k = 0 if self.short else int(rate * self.m)
        self.parts = [p for _, p in cut_up(text, 2 * self.k + 1)]
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def may_match(self, part: str) -> bool:
        """False only if no substring of part is within k edits: each edit spoils one of the 2 k + 2 small pieces at most."""
        missing = 0
        for p in self.parts:
            if p not in part:
                missing += 1
                if missing > self.k:
                    return False
        return True

    def distance(self, part: str) -> tuple[int, int]:
        """Least edit distance of a substring of part to the item, and where the first such substring ends."""
        full, top = (1 << self.m) - 1, 1 << (self.m - 1)
        up, down, score, best, end = full, 0, self.m, self.m, 0
        masks = self.masks
        for j, c in enumerate(part, 1):
            eq = masks.get(c, 0)
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            right, left = down | (full & ~(d | up)), d & up
            if right & top:
                score += 1
            elif left & top:
                score -= 1
            right = right << 1 & full
            up = (left << 1 & full) | (full & ~(d | right))
            down = right & d
            if score < best:
                best, end = score, j
        return best, end


class Matcher:
    """All patterns and the automaton of their pieces."""

    def __init__(self, items: list[tuple], rate: float = RATE, shortest: int = SHORTEST):
        self.patterns = [Pattern(i, t, rate, shortest) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, p in enumerate(self.patterns):
            for at, piece in cut_up(p.text, p.k):
                where.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple]:
        """(item_id, edits, end in the normalised text) of every item found, its best occurrence."""
        if not text or not self.patterns:
            return []
        text = normal(text)
        starts: dict[int, set[int]] = {}
        verbatim: dict[int, int] = {}
        for end, (n, places) in self.automaton.iter(text):
            for p, at in places:
                if not self.patterns[p].short:
                    starts.setdefault(p, set()).add(end + 1 - n - at)
                elif p not in verbatim and whole_words(text, end + 1 - n, end + 1):
                    verbatim[p] = end + 1
        out = [(self.patterns[p].item_id, 0, end) for p, end in verbatim.items()]
        for p, found in starts.items():
            pattern, best, done = self.patterns[p], None, None
            for s in sorted(found):
                if done is not None and s + pattern.m + 2 * pattern.k <= done:
                    continue  # inside what has been looked at
                a, b = max(0, s - pattern.k), s + pattern.m + 3 * pattern.k
                part, done = text[a:b], b
                if pattern.may_match(part):
                    edits, end = pattern.distance(part)
                    if edits <= pattern.k and (best is None or edits < best[1]):
                        best = (pattern.item_id, edits, a + end)
            if best:
                out.append(best)
        return out


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, shortest: int = SHORTEST, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, edits, end_at: each pair of a document and an item that occurs in it.

    An item occurs where a substring of the document is within floor(rate * m) edits of it, m being its length; both
    lower-cased with white space collapsed. edits is the fewest of the verified places, end_at where the first of them
    ends. Items under `shortest` characters occur where they stand unchanged as whole words (scripts without spaces: anywhere),
    with edits 0. Null and empty texts and items match nothing. Repeated documents give
    repeated rows, repeated items (same id and text) count once; other columns are ignored. Documents of a null
    doc_id are matched too. Empty tables give no row.
    """
    items = items.select("item_id", "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    kind_doc, kind_item = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind_doc}, item_id {kind_item}, edits int, end_at long"
    context, out = docs.sparkSession.sparkContext, None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        found = [(r["item_id"], normal(r["text"])) for r in block.collect()]
        found = sorted(((i, t) for i, t in found if t), key=lambda x: (x[0] is None, x[0], x[1]))
        shared = context.broadcast(found)
        part = docs.select("doc_id", "text").mapInArrow(_runner(shared, rate, shortest, schema), schema)
        if blocks > 1:  # a block is done with, on the driver and everywhere, before the next one is fetched
            part = checkpointed(part)
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def _runner(shared, rate: float, shortest: int, schema: str):
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches):
        matcher = Matcher(shared.value, rate, shortest)
        for batch in pieces(batches, 4 << 20):
            rows = [(n, *m) for n, text in enumerate(batch.column("text").to_pylist()) for m in matcher.matches(text)]
            if rows:
                n, item, edits, end = zip(*rows)
                yield pa.record_batch([batch.column("doc_id").take(pa.array(n)), pa.array(item), pa.array(edits, pa.int32()), pa.array(end, pa.int64())], names)

    return run


def without_matches(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs in which no item, long or short, occurs (see matches()).

    Each row stays or goes by its own text, whatever its id: ids may be null or repeat with other texts. Rows with null texts stay. Texts are told apart by
    128 bits of hashes; those of contaminated texts are joined as an anti join, which Spark broadcasts where their size allows. Columns pass whatever their names.
    """
    a, b = apart(docs, "_bad_a", "_bad_b")
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    judged = docs.select(F.struct(h[0].alias("a"), h[1].alias("b")).alias("doc_id"), "text")
    bad = checkpointed(matches(judged, items, rate).select(F.col("doc_id.a").alias(a), F.col("doc_id.b").alias(b)).distinct())
    return docs.join(bad, (h[0] == F.col(a)) & (h[1] == F.col(b)), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, edits, end_at of every benchmark item in every document."""
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
