"""MPEG audio columns: frames found by resynchronising on headers, tags, variable-bitrate tables, checksums,
exact durations and frame seek offsets; and a writer that stores any bytes as the ancillary data of such a stream.

One row is one stream, read and written inside Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

# Fixed values of the format, in the order of its bitrate index 0 to 15 (kbit/s; 0: free or not allowed).
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, 0),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 0),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 0),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, 0),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, 0),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}  # by version bits: 1, 2, 2.5

PAYLOAD = 576  #: payload bytes of a written frame
_FRAME = 672  #: bytes of a written frame: layer III, 48 kHz, 224 kbit/s
_SIDE = 17  #: bytes of side information of a mono MPEG-1 layer III frame
_BODY = 4 + 2 + _SIDE
_HEADER = bytes((0xFF, 0xFA, 0xC4, 0xC0))  # MPEG-1 layer III with checksum, 224 kbit/s, 48 kHz, mono


def _header(word: int) -> tuple[int, int, int, int, int, int, int, int] | None:
    """(version bits, layer, has checksum, kbit/s, sample rate, frame bytes, samples, channels) of a header word."""
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    rate, index = word >> 10 & 3, word >> 12 & 15
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate == 3 or word & 3 == 2:
        return None
    first = version == 3
    kbps = KBPS[1 if first else 2, layer][index]
    if not kbps:
        return None
    hz, pad = RATES[version][rate], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    return version, layer, 1 - (word >> 16 & 1), kbps, hz, size, samples, 1 if word >> 6 & 3 == 3 else 2


def _crc_table() -> np.ndarray:
    """Of the checksum with polynomial 0x8005, most significant bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


_CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksums of the rows of a matrix of bytes, column by column."""
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = (c << 8 & 0xFFFF) ^ _CRC[(c >> 8) ^ rows[:, k]]
    return c


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def write(payload: bytes, n_bytes: int) -> bytes:
    """payload (a positive multiple of PAYLOAD bytes) as an MPEG-1 layer III stream of silent frames.

    ID3v2 tag with the unpadded length, a frame with a Xing table, a frame for each PAYLOAD bytes with the bytes
    as its ancillary data, ID3v1 tag. Every frame has a checksum.
    """
    n = len(payload) // PAYLOAD
    frames = np.zeros((n + 1, _FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, np.uint8)
    c = int(crc16(frames[:1, [2, 3, *range(6, _BODY)]])[0])  # alike in all: side information of silence is zero
    frames[:, 4], frames[:, 5] = c >> 8, c & 255
    frames[1:, _BODY : _BODY + PAYLOAD] = np.frombuffer(payload, np.uint8).reshape(n, PAYLOAD)
    size = (n + 1) * _FRAME
    toc = bytes(((_FRAME + k * n // 100 * _FRAME) * 256 // size) for k in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    frames[0, _BODY : _BODY + len(xing)] = np.frombuffer(xing, np.uint8)
    text = b"\x00n_bytes\x00" + str(n_bytes).encode()
    tag = b"TXXX" + len(text).to_bytes(4, "big") + b"\x00\x00" + text
    length = bytes(len(tag) >> s & 127 for s in (21, 14, 7, 0))
    return b"ID3\x03\x00\x00" + length + tag + frames.tobytes() + b"TAG" + bytes(125)


def _tags(b: bytes) -> tuple[int, int, dict[str, str]]:
    """Where audio starts and ends, and the text frames of an ID3v2 tag (user-defined ones by description)."""
    start, end, found = 0, len(b), {}
    if b[:3] == b"ID3" and len(b) >= 10:
        start = min(end, 10 + _synchsafe(b[6:10]) + (10 if b[5] & 16 else 0))
        at, v = 10, b[3]
        while at + 10 <= start and b[at] and v >= 3:
            size = _synchsafe(b[at + 4 : at + 8]) if v == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            name, body = b[at : at + 4].decode("latin-1"), b[at + 10 : min(at + 10 + size, start)]
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
                head, _, rest = text.partition("\0")
                found[head if name == "TXXX" else name] = rest if name == "TXXX" else head
            at += 10 + size
    if end - start >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
    return start, end, found


def read(b: bytes) -> dict:
    """What a stream holds: hz, channels, kbps (of frames, mean), samples, offsets of the audio frames, vbr (the
    table's kind, frames, bytes and seek points), crc_ok, crc_bad, junk (bytes outside frames), tags.

    A frame counts where its header is valid and either it follows a frame directly or another header of the same
    version, layer and rate, or the end, follows it. Other bytes are skipped up to the next such place. Layer III
    checksums are verified; those of other layers are left unverified.
    """
    at, end, tags = _tags(b)
    known: dict[int, tuple | None] = {}

    def header(i: int):
        w = int.from_bytes(b[i : i + 4], "big")
        if w not in known:
            known[w] = _header(w) if i + 4 <= end else None
        return known[w]

    offsets, heads, junk, synced, kind = [], [], 0, False, None
    while at + 4 <= end:
        h = header(at)
        ok = h is not None and at + h[5] <= end and (kind is None or kind == (h[0], h[1], h[4]))
        if ok and not synced:
            after = at + h[5]
            nxt = header(after) if after + 4 <= end else None
            ok = after == end or (nxt is not None and (nxt[0], nxt[1], nxt[4]) == (h[0], h[1], h[4]))
        if ok:
            offsets.append(at)
            heads.append(h)
            kind, synced = (h[0], h[1], h[4]), True
            at += h[5]
        else:
            synced, i = False, b.find(b"\xff", at + 1, end)
            junk += (i if i >= 0 else end) - at
            at = i if i >= 0 else end
    junk += max(0, end - at)
    vbr = None
    if offsets:
        v, layer, crc, *_, channels = heads[0]
        side = (32, 17)[channels == 1] if v == 3 else (17, 9)[channels == 1]
        vbr = _table(b[offsets[0] : offsets[0] + heads[0][5]], 4 + 2 * crc + side)
        if vbr:
            offsets, heads = offsets[1:], heads[1:]
    good, bad = _verify(b, offsets, heads)
    return {
        "hz": kind[2] if kind else 0, "channels": heads[0][7] if heads else 0, "samples": sum(h[6] for h in heads),
        "kbps": round(sum(h[3] for h in heads) / len(heads)) if heads else 0, "offsets": offsets, "vbr": vbr,
        "crc_ok": good, "crc_bad": bad, "junk": junk, "tags": tags, "heads": heads,
    }


def _table(frame: bytes, at: int) -> dict | None:
    """The variable-bitrate table of a first frame, if it has one: Xing and Info at `at`, VBRI at 36."""
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        out = {"kind": "xing", "frames": None, "bytes": None, "points": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], at = int.from_bytes(frame[at : at + 4], "big"), at + 4
        if flags & 4 and out["bytes"]:
            out["points"] = [x * out["bytes"] // 256 for x in frame[at : at + 100]]
        return out
    if frame[36:40] == b"VBRI":
        entries, scale, width = (int.from_bytes(frame[i : i + 2], "big") for i in (54, 56, 58))
        steps = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "vbri", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big"), "points": np.cumsum([0, *steps])[:-1].tolist()}
    return None


def _verify(b: bytes, offsets: list[int], heads: list[tuple]) -> tuple[int, int]:
    """Layer III frames with a checksum that holds, and with one that doesn't."""
    data, good, total = np.frombuffer(b, np.uint8), 0, 0
    kinds = {}
    for o, h in zip(offsets, heads):
        if h[2] and h[1] == 3:
            kinds.setdefault((32, 17)[h[7] == 1] if h[0] == 3 else (17, 9)[h[7] == 1], []).append(o)
    for side, at in kinds.items():
        at = np.array(at)
        at = at[at + 6 + side <= len(b)]
        rows = data[at[:, None] + np.r_[2, 3, 6 : 6 + side]]
        good += int((crc16(rows) == (data[at + 4].astype(np.uint32) << 8 | data[at + 5])).sum())
        total += len(at)
    return good, total - good


def stored_bytes(b: bytes, offsets: list[int]) -> bytes:
    """The bytes that write() put into frames at these offsets."""
    at = np.array(offsets)
    return np.frombuffer(b, np.uint8)[at[:, None] + np.arange(_BODY, _BODY + PAYLOAD)].tobytes()


def store_as_audio(docs: DataFrame, id_col: str = "doc_id", data_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each row's bytes as an MPEG stream (see write()), padded with bytes 255 to a positive
    multiple of PAYLOAD. Null data counts as empty. Ids may repeat or be null; other columns are ignored."""
    data = F.coalesce(F.col(data_col).cast("binary"), F.lit(b""))

    def run(batches):
        for batch in pieces(batches):
            raw = batch.column("data").to_pylist()
            media = [write(x + b"\xff" * (-len(x) % PAYLOAD or PAYLOAD * (not x)), len(x)) for x in raw]
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("doc_id"), data.alias("data"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


INDEX = "hz int, channels int, kbps int, frames long, samples long, duration_s double, vbr string, vbr_frames long, seek_points array<long>, offsets array<long>, crc_ok long, crc_bad long, junk_bytes long, tags map<string,string>"


def audio_index(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The id with what read() finds in each stream, offsets of all frames included; duration is samples / hz.

    Null or empty media, and bytes without frames, give a row with 0 frames and duration 0.
    """

    def run(batches):
        for batch in pieces(batches):
            found = [read(x or b"") for x in batch.column("media").to_pylist()]
            rows = [[f["hz"], f["channels"], f["kbps"], len(f["offsets"]), f["samples"], f["samples"] / f["hz"] if f["hz"] else 0.0, f["vbr"] and f["vbr"]["kind"], f["vbr"] and f["vbr"]["frames"], f["vbr"] and f["vbr"]["points"], f["offsets"], f["crc_ok"], f["crc_bad"], f["junk"], list(f["tags"].items())] for f in found]
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.string()))
            cols = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch.column("id"), *cols], [id_col, *(x.split(" ")[0] for x in INDEX.split(", "))])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, {INDEX}")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_back(media: DataFrame) -> DataFrame:
    """Digests of the payloads read back from rows (doc_id, n_bytes, media) of store_as_audio()."""

    def run(batches):
        for batch in pieces(batches):
            out = []
            for n, b in zip(batch.column("n_bytes").to_pylist(), batch.column("media").to_pylist()):
                f = read(b)
                p = stored_bytes(b, f["offsets"])
                if f["tags"].get("n_bytes") != str(n) or f["crc_bad"] or f["junk"] or f["vbr"]["frames"] != len(f["offsets"]):
                    raise ValueError("a stored stream doesn't read back as it was written")
                feature = f"mpeg1-layer3 {f['hz']} Hz {f['channels']} ch {f['kbps']} kbit/s frames={len(f['offsets'])} samples={f['samples']} duration_s={f['samples']}/{f['hz']} checksums={f['crc_ok']} first={f['offsets'][0]} last={f['offsets'][-1]} table={f['vbr']['kind']}:{len(f['vbr']['points'])}"
                out.append((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), *cols], ["doc_id", *(x.split(" ")[0] for x in DIGEST.split(", "))])

    return media.mapInArrow(run, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, {DIGEST}")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text stored as an MPEG stream and read back: doc_id and the columns of DIGEST."""
    return read_back(store_as_audio(table(spark, sf_dir, "documents")))
