"""Static range asymmetric numeral system: blocks of symbols coded in interleaved lanes under one frequency table.

A block is coded on its own. Its lanes share one stream of 32-bit words; every EVERY symbols it keeps a checkpoint (the lanes'
states, the place in the stream, a checksum of the symbols up to the next one), so that its segments can be decoded side by side
and any symbol is at most EVERY symbols behind a place to start from. Many blocks, and many segments, are one numpy operation each step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SCALE = 20  #: frequencies add up to 2 ** SCALE
LANES = 32
BLOCK = 1 << 16  #: symbols of a block at most
EVERY = 1 << 14  #: symbols between checkpoints
LOW = np.uint64(1 << 31)  #: states are at least this and below 2 ** 63
_MAGIC = b"ANS1"
_HEAD = struct.Struct("<4sHHIII")  # magic, lanes, scale, symbols, checkpoints, words
_WORD, _SCALE, _SLOTS, _ROOM = np.uint64(32), np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(63 - SCALE)


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2 ** SCALE, at least 1 where a count isn't 0; of all zeros, all for the first symbol."""
    counts = np.asarray(counts, np.float64)
    if not len(counts) or len(counts) > 1 << SCALE:
        raise ValueError(f"a table takes 1 to {1 << SCALE} symbols")
    if not counts.sum():
        counts = np.r_[1.0, np.zeros(len(counts) - 1)]
    used = counts > 0
    share = counts / counts.sum() * ((1 << SCALE) - used.sum())
    freq = np.floor(share).astype(np.int64) + used
    rest = (1 << SCALE) - int(freq.sum())
    most = np.argsort(np.floor(share) - share, kind="stable")[:rest]  # largest remainders first
    freq[most] += 1
    return freq.astype(np.uint32)


class Table:
    """What coding needs of the frequencies."""

    def __init__(self, freq: np.ndarray):
        freq = np.asarray(freq, np.uint64)
        if int(freq.sum()) != 1 << SCALE:
            raise ValueError("frequencies must add up to 2 ** SCALE")
        self.freq = freq
        self.below = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq)), freq.astype(np.int64))


def checksum(symbols: np.ndarray) -> int:
    """crc32 of the symbols as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(symbols, "<u4"))


def encode(blocks: np.ndarray, n: int, table: Table) -> list[bytes]:
    """A record for each row of blocks, n symbols each. Symbols must have a frequency."""
    count, steps = len(blocks), -(-n // LANES)
    filler = int(table.freq.argmax())
    padded = np.full((count, steps * LANES), filler, np.int64)
    padded[:, :n] = blocks[:, :n]
    there = np.flatnonzero(np.bincount(padded.ravel()))
    if len(there) and (there[-1] >= len(table.freq) or not table.freq[there].all()):
        raise ValueError("a symbol has no frequency")
    grid = np.ascontiguousarray(padded.reshape(count, steps, LANES).transpose(1, 0, 2))
    x = np.full((count, LANES), LOW)
    apart = EVERY // LANES
    states = np.zeros((-(-steps // apart), count, LANES), np.uint64)
    full, low = np.zeros((steps, count, LANES), bool), np.zeros((steps, count, LANES), np.uint32)
    for t in range(steps - 1, -1, -1):
        f, emits = table.freq.take(grid[t], mode="clip"), full[t]
        np.greater_equal(x >> _ROOM, f, out=emits)
        low[t] = x
        np.right_shift(x, _WORD, out=x, where=emits)
        q = x // f
        x = (q << _SCALE) + (x - q * f) + table.below.take(grid[t], mode="clip")
        if t % apart == 0:
            states[t // apart] = x
    stream = low.transpose(1, 0, 2)[full.transpose(1, 0, 2)]  # by block, step and lane
    emitted = full.sum(2)
    total, marks = emitted.sum(0), len(states)
    at = np.concatenate([[0], np.cumsum(total)])
    before = np.concatenate([np.zeros((1, count), np.int64), np.cumsum(emitted, 0)])[: steps : apart]
    out = []
    for b in range(count):
        sums = [checksum(blocks[b, i : min(n, i + EVERY)]) for i in range(0, n, EVERY)]
        body = b"".join((_HEAD.pack(_MAGIC, LANES, SCALE, n, marks, int(total[b])), before[:, b].astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), np.ascontiguousarray(states[:, b]).astype("<u8").tobytes(), stream[at[b] : at[b + 1]].astype("<u4").tobytes()))
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


class Record:
    """A block's record, taken apart; raises ValueError where its bytes don't add up."""

    def __init__(self, data: bytes):
        if len(data) < _HEAD.size + 4 or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
            raise ValueError("a block's bytes don't fit its checksum")
        magic, lanes, scale, self.n, marks, words = _HEAD.unpack_from(data)
        if magic != _MAGIC or lanes != LANES or scale != SCALE:
            raise ValueError("not a block of this format")
        at = _HEAD.size
        self.before = np.frombuffer(data, "<u4", marks, at).astype(np.int64)
        self.sums = np.frombuffer(data, "<u4", marks, at + 4 * marks)
        self.states = np.frombuffer(data, "<u8", marks * LANES, at + 8 * marks).reshape(marks, LANES)
        self.words = np.frombuffer(data, "<u4", words, at + (8 + 8 * LANES) * marks)

    def segments(self) -> list[tuple[int, int]]:
        """First symbol and number of symbols of each segment."""
        return [(i, min(EVERY, self.n - i)) for i in range(0, self.n, EVERY)]


def decode(records: list[Record], table: Table, wanted: list[list[int]] | None = None) -> list[np.ndarray]:
    """The symbols of each record, or of its wanted segments alone, one after the other. Segments of the same length are decoded together."""
    parts: dict[int, list[tuple[int, int, int]]] = {}
    out: list[dict[int, np.ndarray]] = [{} for _ in records]
    for r, record in enumerate(records):
        for k, (_, n) in enumerate(record.segments()):
            if wanted is None or k in wanted[r]:
                parts.setdefault(n, []).append((r, k, n))
    for n, some in parts.items():
        for a in range(0, len(some), 256):
            group = some[a : a + 256]
            grid = _run([records[r] for r, _, _ in group], [k for _, k, _ in group], -(-n // LANES), table)[:, :n]
            for (r, k, _), symbols in zip(group, grid):
                if checksum(symbols) != records[r].sums[k]:
                    raise ValueError("a segment's symbols don't fit their checksum")
                out[r][k] = symbols
    return [np.concatenate([x[k] for k in sorted(x)]) if x else np.zeros(0, np.uint32) for x in out]


def _run(records: list[Record], segments: list[int], steps: int, table: Table) -> np.ndarray:
    starts = np.array([r.before[k] for r, k in zip(records, segments)])
    ends = [len(r.words) if k + 1 == len(r.before) else r.before[k + 1] for r, k in zip(records, segments)]
    words = np.concatenate([r.words[a:b] for r, a, b in zip(records, starts, ends)] + [np.zeros(1, np.uint32)]).astype(np.uint64)
    at = np.concatenate([[0], np.cumsum(np.array(ends) - starts)])[:-1]
    x = np.stack([r.states[k] for r, k in zip(records, segments)]).astype(np.uint64)
    out = np.empty((len(records), steps, LANES), np.uint32)
    at = at[:, None] - 1
    for t in range(steps):
        slot = x & _SLOTS
        s = table.symbol.take(slot.view(np.int64), mode="clip")
        out[:, t] = s
        x = table.freq.take(s, mode="clip") * (x >> _SCALE) + slot - table.below.take(s, mode="clip")
        short = x < LOW
        place = at + np.cumsum(short, 1)
        at = place[:, -1:]
        np.bitwise_or(x << _WORD, words.take(place, mode="clip"), out=x, where=short)
    return out.reshape(len(records), -1)


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """crc32 of pieces one after the other, from (crc32, bytes) of each."""
    whole = 0
    for crc, size in parts:
        whole = _shifted(whole, size) ^ crc
    return whole


def _times(matrix: list[int], vector: int) -> int:
    out, i = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _byte_zero() -> list[int]:
    """The linear map of a crc32 that one zero byte more makes."""
    one = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        one = [_times(one, c) for c in one]
    return one


_POWERS = [_byte_zero()]


def _shifted(crc: int, size: int) -> int:
    k = 0
    while size:
        if k == len(_POWERS):
            _POWERS.append([_times(_POWERS[-1], c) for c in _POWERS[-1]])
        if size & 1:
            crc = _times(_POWERS[k], crc)
        size >>= 1
        k += 1
    return crc
