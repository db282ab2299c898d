"""Repair of conversations at the least cost, by a shortest path over runs of equal symbols.

A conversation is valid if its roles' initials are (s?(ua)+)?. Rows become symbols (initial and fault). Equal symbols in a row are one run, which is
advanced through binary powers of the symbol's min-plus matrix over the four states that a prefix can be in; then choices are unrolled.

1. Equal rows are counted first, and texts that a conversation repeats at several turns are looked up by hash.
2. Rows are dealt out by ranges of (conversation, turn, text), so that a long conversation lies in several partitions. Each partition cuts what it has of a
   conversation into pieces of bounded size. A conversation that is one piece inside a partition is repaired there.
3. Of all others each piece gives its min-plus matrix and counts. From their products follows what each piece's end is worth; with that, pieces tell side by side
   where they lead to from each state; then each knows where it starts and is unrolled.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, pieces, small, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3  #: costs; that of a truncated row is for leaving it in
PIECE_ROWS, PIECE_BYTES = 8192, 4 << 20  #: a piece of a conversation ends where it has so many rows or characters
START, SYSTEM, USER, ASSISTANT = range(4)  # what stands at the end of a prefix
GONE = 8  # the symbol of a row that must be deleted; others are 2 * initial (s, u, a, another) + whether it's truncated
_FAR = 1 << 50
_ALONE = [[0 if q == r else _FAR for r in range(4)] for q in range(4)]
_SPACE = " \t\n\x0b\x0c\r"
Matrix = list[list[int]]


def after(q: int) -> int:
    """The only state that a user's or an assistant's turn leads to."""
    return ASSISTANT if q == USER else USER


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return [[min(x + y for x, y in zip(row, col)) for col in zip(*b)] for row in a]


def applied(a: Matrix, v) -> tuple[int, ...]:
    return tuple(min(x + y for x, y in zip(row, v)) for row in a)


def kept(code: int, q: int) -> int | None:
    """Where a row of this symbol leads to if it is kept as it is."""
    initial = code // 2
    if code == GONE or initial == 3:
        return None
    if initial == 0:
        return SYSTEM if q == START else None
    return after(q) if (after(q) == USER) == (initial == 1) else None


def _inserts() -> Matrix:
    one = [[0 if q == r else INSERT if r == after(q) else _FAR for r in range(4)] for q in range(4)]
    return times(one, times(one, one))  # more than two never pay


_ANY = _inserts()
END = applied(_ANY, (0, _FAR, _FAR, 0))  #: what each state costs where no row is left


def _matrix(code: int) -> Matrix:
    """Of one row of the symbol, with inserts before it."""
    rows = [row[:] for row in _ALONE]
    for q in range(4):
        rows[q][q] = DELETE
        if code != GONE:
            add = TRUNCATED if code % 2 else 0
            rows[q][after(q)] = min(rows[q][after(q)], REROLE + add)
            if (to := kept(code, q)) is not None:
                rows[q][to] = min(rows[q][to], add)
    return times(_ANY, rows)


_POWERS = [[_matrix(code)] for code in range(GONE + 1)]


def power_bits(code: int, n: int):
    """The cached powers of a symbol's matrix whose product is its n-th power."""
    k, powers = 0, _POWERS[code]
    while n >> k:
        if k == len(powers):
            powers.append(times(powers[-1], powers[-1]))
        if n >> k & 1:
            yield powers[k]
        k += 1


def product(runs) -> Matrix:
    """The min-plus matrix of runs (symbol, how many)."""
    out = _ALONE
    for code, n in runs:
        for m in power_bits(code, n):
            out = times(out, m)
    return out


def worth(runs, end) -> list[tuple[int, ...]]:
    """What each state costs from before each run on, and behind the last one (end)."""
    out = [tuple(end)]
    for code, n in reversed(runs):
        v = out[-1]
        for m in power_bits(code, n):  # powers of one matrix commute
            v = applied(m, v)
        out.append(v)
    return out[::-1]


_CHOICES: dict[tuple, tuple] = {}


def choices(code: int, then: tuple[int, ...]) -> tuple:
    """For each state before a row, the edits up to and with that row, the ASCII-least of those at the least cost, and the state behind it."""
    low = min(then)
    key = (code, *(v - low for v in then))
    if key not in _CHOICES:
        here, out, add = applied(_POWERS[code][0], then), [], TRUNCATED if code % 2 and code != GONE else 0
        for q in range(4):
            edits = ""
            while True:
                left, to = here[q], after(q)
                if DELETE + then[q] == left:
                    edits, to = edits + "D", q
                elif INSERT + here[to] == left:
                    edits, q = edits + "I", to
                    continue
                elif (same := kept(code, q)) is not None and add + then[same] == left:
                    edits, to = edits + "K", same
                else:
                    edits += "R"
                break
            out.append((edits, to))
        _CHOICES[key] = tuple(out)
    return _CHOICES[key]


def unrolled(runs, end, q: int, last: bool) -> tuple[list[str], int]:
    """The edits of each row of the runs from state q on, the run of deleted rows in one, and the state behind. last: nothing follows, so that missing turns are added."""
    values, out = worth(runs, end), []
    for (code, n), then in zip(runs, values[1:]):
        if code == GONE:
            out.append("D" * n)  # D comes first and is due anyway
            continue
        inner = [then]
        for _ in range(n - 1):
            inner.append(applied(_POWERS[code][0], inner[-1]))
        for v in reversed(inner):
            edits, q = choices(code, v)[q]
            out.append(edits)
    if last:
        tail = ""
        while q not in (START, ASSISTANT):
            tail, q = tail + "I", after(q)
        out.append(tail)
    return out, q


class Piece:
    """Rows (turn, role, text, copies, code, blank, later) of one conversation that follow one another, and their counts."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.runs: list[list[int]] = []
        self.bytes = self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None

    def _run(self, code: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == code:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([code, n])

    def add(self, turn, role: str, text: str, copies: int, code: int, blank: bool, later: bool) -> None:
        if not copies:
            return
        initial = role[:1]
        if self.n:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first = initial
        self.illegal += copies - 1
        self.last, self.n, self.bytes = initial, self.n + copies, self.bytes + len(text)
        if turn is not None:
            self.turns += turn != self.high or self.low is None
            self.low, self.high = turn if self.low is None else self.low, turn
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - 1 + later
        self.truncated += not blank and not later and code % 2
        self._run(code, 1)
        self._run(GONE, copies - 1)
        self.rows.append((turn, role, text, copies, code))

    def counts(self) -> tuple:
        return self.n, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, self.first, self.last


COUNTS = ("n", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")


def totals(parts: list[tuple]) -> tuple[int, int, int, int, int]:
    """gaps, blank, duplicate, truncated and illegal of a conversation from the counts of its pieces in order."""
    blank = duplicate = truncated = illegal = turns = 0
    low = high = before = None
    for n, b, d, t, i, k, lo, hi, first, last in parts:
        if not n:
            continue
        blank, duplicate, truncated, illegal = blank + b, duplicate + d, truncated + t, illegal + i
        if before is not None:
            illegal += before + first not in ("su", "ua", "au")
        before = last
        if lo is not None:
            turns += k - (high == lo)
            low, high = lo if low is None else low, hi
    return high - low + 1 - turns if low is not None else 0, blank, duplicate, truncated, illegal


def mended(rows: list[tuple], runs, end, q: int, last: bool) -> tuple[str, list[tuple]]:
    """The audit of a piece and its repaired turns (edit, turn, role, text)."""
    edits, _ = unrolled(runs, end, q, last)
    audit, out, at = "".join(edits), [], 0
    for turn, role, text, copies, code in rows:
        while True:
            e, at = audit[at], at + 1
            if e == "D":
                break
            to = SYSTEM if e == "K" and code // 2 == 0 else after(q)
            name = role if e == "K" else "user" if to == USER else "assistant"
            q = to
            out.append((e, None, name, "") if e == "I" else (e, turn, name, text))
            if e != "I":
                break
        at += copies - 1
    for e in audit[at:]:
        q = after(q)
        out.append((e, None, "user" if q == USER else "assistant", ""))
    return audit, out


ID = "conv_id"
_TURN = pa.struct([("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("copies", pa.int64()), ("code", pa.int32())])
_KINDS = [pa.int32(), pa.int64(), pa.bool_(), *[pa.int64()] * 8, pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.string(), pa.list_(_TURN)]
_NAMES = ["part", "piece", "whole", *COUNTS, "runs", "matrix", "cost", "audit", "rows"]
_SCHEMA = "part int, piece long, whole boolean, " + ", ".join(f"{c} {'string' if c in ('first', 'last') else 'long'}" for c in COUNTS) + ", runs array<long>, matrix array<long>, cost long, audit string, rows array<struct<edit:string,turn:long,role:string,text:string,copies:long,code:int>>"


def _cut(batches, most_rows: int, most_bytes: int):
    """Pieces from sorted rows: whole conversations repaired, of others (the first and the last of a partition, and long ones) what step 3 needs."""
    number, ready, size = 0, [], 0
    piece, part, name, kind, open_ended = None, None, None, None, True  # open_ended: the conversation may have more pieces than this one

    def done(whole: bool):
        nonlocal number, size
        cost = audit = runs = matrix = None
        if whole:
            audit, turns = mended(piece.rows, piece.runs, END, START, True)
            cost, turns = worth(piece.runs, END)[0][START], [(*t, 1, None) for t in turns]
        else:
            turns = [(None, *r) for r in piece.rows]
            runs, matrix = [x for run in piece.runs for x in run], [x for row in product(piece.runs) for x in row]
        ready.append((name, part, number, whole, *piece.counts(), runs, matrix, cost, audit, turns))
        number, size = number + 1, size + piece.bytes + 200 * len(piece.rows) + 400

    def batch_of():
        nonlocal size
        cols = [pa.array([r[0] for r in ready], kind), *(pa.array([r[i + 1] for r in ready], k) for i, k in enumerate(_KINDS))]
        ready.clear()
        size = 0
        return pa.record_batch(cols, [ID, *_NAMES])

    for batch in pieces(batches, 2 << 20):
        kind = batch.schema.field(ID).type
        for row in zip(*(batch.column(c).to_pylist() for c in (ID, "turn", "role", "text", "copies", "code", "blank", "later", "part"))):
            if piece is None:
                piece, part = Piece(), row[8]
            elif row[0] != name:
                done(not open_ended)
                piece, open_ended = Piece(), False
            elif len(piece.rows) >= most_rows or piece.bytes >= most_bytes:
                done(False)
                piece, open_ended = Piece(), True
            name = row[0]
            piece.add(*row[1:8])
            if size > 8 << 20:
                yield batch_of()
    if piece is not None:
        done(False)  # it may go on in the next partition
    if ready:
        yield batch_of()


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PLAN = "part int, piece long, nth long, pieces long, " + ", ".join(f"{c} long" for c in REPORT) + ", end array<long>"


def _planned(batches):
    """What each piece's end is worth, and the conversation's counts, from the pieces of each conversation in order."""
    for batch in pieces(batches):
        out = []
        for parts in batch.column("parts").to_pylist():
            ends, at = [], END
            matrices = [[p["matrix"][i : i + 4] for i in range(0, 16, 4)] for p in parts]
            for m in reversed(matrices):
                ends.append(at)
                at = applied(m, at)
            report = (*totals([tuple(p[c] for c in COUNTS) for p in parts]), at[START])
            out += [(p["part"], p["piece"], k, len(parts), *report, list(e)) for k, (p, e) in enumerate(zip(parts, reversed(ends)))]
        kinds = (pa.int32(), *[pa.int64()] * 9, pa.list_(pa.int64()))
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [x.strip().split(" ")[0] for x in _PLAN.split(",")])


def _led(batches):
    """Where each piece leads to from each state."""
    for batch in pieces(batches):
        exits = [[unrolled(list(zip(r[::2], r[1::2])), e, q, False)[1] for q in range(4)] for r, e in zip(batch.column("runs").to_pylist(), batch.column("end").to_pylist())]
        yield pa.record_batch([*(batch.column(c) for c in (ID, "part", "piece", "nth")), pa.array(exits, pa.list_(pa.int64()))], [ID, "part", "piece", "nth", "exits"])


def _entered(batches):
    """The state that each piece starts from."""
    for batch in pieces(batches):
        out = []
        for parts in batch.column("parts").to_pylist():
            q = START
            for p in parts:
                out.append((p["part"], p["piece"], q))
                q = p["exits"][q]
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int32()))], ["part", "piece", "entry"])


def _turned(batches):
    for batch in pieces(batches):
        found = []
        for rows, runs, end, q, nth, n in zip(*(batch.column(c).to_pylist() for c in ("rows", "runs", "end", "entry", "nth", "pieces"))):
            found.append(mended([(r["turn"], r["role"], r["text"], r["copies"], r["code"]) for r in rows], list(zip(runs[::2], runs[1::2])), end, q, nth == n - 1))
        turns = pa.array([[(*t, 1, None) for t in turns] for _, turns in found], pa.list_(_TURN))
        yield pa.record_batch([*(batch.column(c) for c in (ID, "nth", "pieces", *REPORT)), pa.array([a for a, _ in found], pa.string()), turns], [ID, "nth", "pieces", *REPORT, "audit", "rows"])


def symbols(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text), how many copies of each there are, the symbol of the first one, and whether it is blank or a later turn's copy."""
    counted = rows.groupBy(ID, "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))
    h1, h2 = F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "role", "text")
    seen = rows.where("copies > 0").groupBy(F.col(ID).alias("_id"), h1.alias("_h1"), h2.alias("_h2")).agg(F.min(order).alias("_first"), F.max(order).alias("_last")).where("_first != _last").drop("_last")
    repeated, _ = small(checkpointed(seen), 300_000)
    same = F.col(ID).eqNullSafe(F.col("_id")) & (h1 == F.col("_h1")) & (h2 == F.col("_h2"))
    last = F.right(F.rtrim("text", F.lit(_SPACE)), F.lit(1))
    initial = F.substring("role", 1, 1)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    later = F.coalesce(order > F.col("_first"), F.lit(False))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 2 + F.when(last.isin(".", "!", "?"), 0).otherwise(1)
    marked = counted.join(repeated, same, "left").withColumns({"blank": F.coalesce(blank, F.lit(True)), "later": later})
    return marked.select(ID, "turn", "role", "text", "copies", "blank", "later", F.when(F.col("blank") | F.col("later"), GONE).otherwise(kind).cast("int").alias("code"))


def repair(conversations: DataFrame, copies: str | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Each conversation's counts, its cheapest edits and its repaired turns, in pieces.

    Takes rows (conv_id, turn, role, text), each counted as often as the column `copies` says (0: it names its conversation alone). Gives conv_id, nth (of `pieces`, from 0),
    gaps, blank, duplicate, truncated, illegal and cost of the whole conversation, audit (the edits' initials of the piece) and turns (edit, turn, role, text: the
    piece's turns that are kept K, given another role R or inserted I). Nearly all conversations are one piece.

    Rows of a conversation go by turn, nulls first, then by role and text. Null roles and texts are one space; a null conv_id is a conversation of
    its own. A role whose initial is none of s, u, a, or that is empty, can't be kept. Rows may repeat, texts may have any length, and a conversation any number of turns;
    pieces have at most piece_rows rows and about piece_bytes characters of text. Other columns are ignored; an empty table gives no row.
    """
    times_ = F.lit(1) if copies is None else F.col(copies)
    rows = conversations.select(ID, F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), times_.cast("long").alias("copies"))
    marked = symbols(rows)
    kind = marked.schema[ID].dataType.simpleString()
    # beginnings of role and text order rows as the whole ones do
    dealt = marked.repartitionByRange(ID, "turn", F.substring("role", 1, 8), F.substring("text", 1, 24)).sortWithinPartitions(ID, "turn", "role", "text")
    # a task that writes the checkpoint may run several of these partitions: each row has the number of its own
    made = checkpointed(dealt.select(ID, "turn", "role", "text", "copies", "code", "blank", "later", F.spark_partition_id().alias("part")).mapInArrow(lambda b: _cut(b, piece_rows, piece_bytes), f"{ID} {kind}, {_SCHEMA}"))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    whole = made.where("whole").select(ID, F.lit(0).cast("long").alias("nth"), F.lit(1).cast("long").alias("pieces"), gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "rows")
    cut = made.where("not whole")
    ordered = F.sort_array(F.collect_list(F.struct("part", "piece", "matrix", *COUNTS))).alias("parts")  # some 200 bytes for each piece
    plan = checkpointed(cut.groupBy(ID).agg(ordered).select("parts").mapInArrow(_planned, _PLAN))
    led = cut.select(ID, "part", "piece", "runs").join(plan.select("part", "piece", "nth", "end"), ["part", "piece"]).select(ID, "part", "piece", "nth", "runs", "end").mapInArrow(_led, f"{ID} {kind}, part int, piece long, nth long, exits array<long>")
    entries = led.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct("nth", "part", "piece", "exits"))).alias("parts")).select("parts").mapInArrow(_entered, "part int, piece long, entry int")
    plan = plan.join(entries, ["part", "piece"])
    turned = cut.select(ID, "part", "piece", "runs", "rows").join(plan, ["part", "piece"]).select(ID, "nth", "pieces", *REPORT, "rows", "runs", "end", "entry")
    schema = f"{ID} {kind}, nth long, pieces long, " + ", ".join(f"{c} long" for c in REPORT) + f", audit string, rows {made.schema['rows'].dataType.simpleString()}"
    both = whole.unionByName(turned.mapInArrow(_turned, schema))
    turns = F.transform("rows", lambda r: F.struct(r["edit"].alias("edit"), r["turn"].alias("turn"), r["role"].alias("role"), r["text"].alias("text")))
    return both.select(ID, "nth", "pieces", *REPORT, "audit", turns.alias("turns"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) with faults by crc32 of conv_id:turn modulo 20: 0 drops a row (0 copies), 1 empties its text, 2 takes its .!? away,
    3 repeats it, 4 sets its role to user. Nulls count as one space. A dropped row stays without content, so that its conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(ID), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select(ID, "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault"))
    gone = F.col("fault") == 0
    text = F.when(gone | (F.col("fault") == 1), "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(gone, "").when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select(ID, F.when(~gone, F.col("turn")).alias("turn"), role.alias("role"), text.alias("text"), F.when(gone, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def _hashed(batches):
    """Pieces of a conversation after one another: its audit and the hash of its turns, of which no more than a batch is held."""
    name, now, audit, sha, kind, names = None, None, [], None, None, [ID, *REPORT, "audit", "repaired_sha256"]

    def done():
        cols = [pa.array([name], kind), *(pa.array([x], pa.int64()) for x in now), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])]
        return pa.record_batch(cols, names)

    for batch in pieces(batches):
        kind = batch.schema.field(ID).type
        for conv, nth, part, body, *report in zip(*(batch.column(c).to_pylist() for c in (ID, "nth", "audit", "body", *REPORT))):
            if nth == 0:
                if now:
                    yield done()
                name, now, audit, sha, some = conv, report, [], hashlib.sha256(), False
            audit.append(part)
            if body is not None:
                sha.update(("\n" if some else "").encode() + body.encode())
                some = True
    if now:
        yield done()


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, the counts, audit and repaired_sha256 (of role:text of the repaired turns, joined by line feeds) of each conversation of repair().

    A hash goes over its text from the first byte to the last: the pieces of a conversation of several pass through one task, one after the other.
    """
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    rows = repaired.select(ID, "nth", "pieces", *REPORT, "audit", F.when(F.size("turns") > 0, body).alias("body"))
    one = rows.where("pieces = 1").select(ID, *REPORT, "audit", F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256"))
    more = rows.where("pieces > 1").repartition(ID).sortWithinPartitions(ID, "nth")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in one.schema)
    return one.unionByName(more.select(ID, "nth", *REPORT, "audit", "body").mapInArrow(_hashed, schema))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after damage."""
    return digests(repair(damaged(table(spark, sf_dir, "conversations")), "copies"))
