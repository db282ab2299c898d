"""Token ids of documents in one order, stored in blocks of a static range asymmetric numeral system (see rans) and read back.

1. Documents are dealt out by ranges of (doc_id, hash of the text) and sorted, so that one hot id or one long run of equal ids is split.
2. Each range, a shard, is tokenised and its ids are written with their place in the shard.
3. Ids are counted over all documents; the counts become one shared frequency table.
4. Each run of a shard is cut into blocks, coded on their own: rows of Parquet with a record, the documents in it and where it starts.
5. Reading decodes blocks in any order and anywhere. Pieces of a document that several blocks hold are joined by its number;
   only the totals of shards (a row for each file) go to the driver.
"""

from __future__ import annotations

import functools
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rans
from .common import checkpointed, pieces, table

TOGETHER = 64  #: blocks that are coded in one go
END = 0  #: the id behind each document
KNOWN = 250_000  #: words whose ids a process keeps, twice: as many as it met last and as many before
LONG = 64  #: characters; longer words of other scripts or signs aren't kept
TOLD = 1 << 14  #: words that the library gets in one text
#: Classes of bytes: Latin letters, digits, other ASCII signs, space, other ASCII white space, apostrophe, parts of other characters, and
#: what is or may be white space elsewhere in Unicode.
_L, _N, _P, _S, _W, _A, _U, _X = range(8)


def _class_of_bytes() -> np.ndarray:
    kinds = np.full(256, _U, np.uint8)
    kinds[:128] = _P
    for b in range(128):
        if chr(b).isalnum():
            kinds[b] = _L if chr(b).isalpha() else _N
    kinds[[32, 39]] = _S, _A
    kinds[[9, 10, 13]] = _W
    kinds[[11, 12, 28, 29, 30, 31]] = _X
    kinds[0xC3:0xC9] = _L  # U+00C0 to U+023F, see _classes
    return kinds


def _cuts_of_pairs() -> np.ndarray:
    """For two neighbours' classes (8 * first + second): 1 if the second begins a unit whatever is around them, 2 if the first does, 3 if both do.

    The units are those of the pattern of a ByteLevel pre-tokenizer. They end where white space begins. The last of several white characters
    is a unit's first, as a space or alone. Letters, digits and signs are units of their own, but letters behind an apostrophe may belong to it.
    """
    cuts = np.zeros((8, 8), np.uint8)
    for first in (_L, _N, _P, _A, _U):
        cuts[first, [_S, _W]] = 1
        cuts[_S, first], cuts[_W, first] = 2, 3
    for first in (_L, _N, _P):
        cuts[first, [x for x in (_L, _N, _P) if x != first]] = 1
    cuts[[_L, _N], _A] = 1
    return cuts.ravel()


_CLASS, _CUTS = _class_of_bytes(), _cuts_of_pairs()


def _classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte of UTF-8."""
    kinds = _CLASS[data]
    wide = np.flatnonzero(data >= 0xC2)  # where characters beyond ASCII begin
    lead = data[wide]
    latin = wide[(lead >= 0xC3) & (lead <= 0xC8)]
    kinds[latin + 1] = _L
    signs = latin[(data[latin] == 0xC3) & (data[latin + 1] | 0x20 == 0xB7)]  # the signs of multiplication and division
    kinds[signs] = kinds[signs + 1] = _U
    two = wide[lead == 0xC2]
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]
    kinds[two] = kinds[two + 1] = _X
    three = wide[(lead >= 0xE1) & (lead <= 0xE3)]
    a, b, c = data[three], data[three + 1], data[three + 2]
    general = (a == 0xE2) & ((b == 0x81) | ((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))))
    three = three[general | ((a == 0xE1) & ((b == 0x9A) | (b == 0xA0))) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
    for k in range(3):
        kinds[three + k] = _X
    return kinds


def _bytes_of(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins, and behind them the end; and the bytes of all."""
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return bounds - bounds[0], np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of whole texts by a byte-level BPE of the tokenizers library, word by word.

    Such a tokenizer takes texts apart by a pattern first. Where a unit of it begins whatever is around, texts are cut; each distinct word
    between two cuts is tokenised once and its ids are kept. Words that are one unit go to the model in one text, spelled as its vocabulary
    has it; others (an apostrophe, other scripts) through the whole tokenizer. So do texts with a special token's own string,
    and all texts if the tokenizer is of another kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.letters = np.arange(256, dtype="<u4")  # how such a vocabulary spells bytes
        self.letters[hidden] = np.arange(256, 256 + len(hidden))
        model, vocab = made["model"], made["model"].get("vocab")
        self.cuts = (
            (made.get("pre_tokenizer") or {}) | {"trim_offsets": True} == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and model.get("type") == "BPE"
            and not any(made.get(x) for x in ("normalizer", "truncation", "padding"))
            and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
            and all(chr(c) in vocab for c in self.letters.tolist())
        )
        self.special = [t["content"] for t in made.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        if self.cuts:
            self.letters[255] = 10  # no byte of UTF-8; a line feed isn't spelled as itself
            self.units = Tokenizer(self.whole.model)
            self.units.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
            self.length = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each id
            self.length[list(vocab.values())] = [len(x) for x in vocab]

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def raw_units(self, words: pa.LargeStringArray) -> list[bytes]:
        """The ids of words that are one unit each."""
        found = []
        for at in range(0, len(words), TOLD):
            bounds, data = _bytes_of(words.slice(at, TOLD))
            spelled = self.letters[np.insert(data, bounds[1:-1], 255)].tobytes().decode("utf-32-le")
            ids = np.array(self.units.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, np.int64)
            behind = np.cumsum(self.length[ids])
            last = np.searchsorted(behind, bounds[1:])
            if len(behind) == 0 or behind[-1] != bounds[-1] or (behind[last] != bounds[1:]).any():
                raise ValueError("the ids of words don't fit their bytes")
            raw, ends = ids.astype(self.kind).tobytes(), [0, *((last + 1) * self.kind.itemsize).tolist()]
            found += [raw[a:b] for a, b in zip(ends, ends[1:])]
        return found

    def learn(self, words: pa.LargeStringArray, names: list[str]) -> list[bytes]:
        """The ids of distinct words, which are kept by their names but for long ones of several units."""
        if not len(words):
            return []
        bounds, data = _bytes_of(words)
        several = np.logical_or.reduceat(_classes(data) >= _A, bounds[:-1])
        raw = np.empty(len(words), object)
        raw[~several] = self.raw_units(words.filter(pa.array(~several)))
        hard = np.flatnonzero(several).tolist()
        for i, ids in zip(hard, self.raw([names[i] for i in hard])):
            raw[i] = ids
        raw, keep = raw.tolist(), ~several
        keep[[i for i in hard if len(names[i]) <= LONG]] = True
        self.known.update((w, x) for w, x, k in zip(names, raw, keep.tolist()) if k)
        return raw

    def of(self, distinct: pa.LargeStringArray) -> list[bytes]:
        """The ids of distinct words; when too many are kept, those that weren't met again go."""
        if len(self.known) > KNOWN:
            self.known, self.older = {}, self.known
        words = distinct.to_numpy(zero_copy_only=False).tolist()
        raw, missing = list(map(self.known.get, words)), []
        for i, found in enumerate(raw):
            if found is None:
                if (found := self.older.get(words[i])) is None:
                    missing.append(i)
                else:
                    raw[i] = self.known[words[i]] = found
        for i, found in zip(missing, self.learn(distinct.take(pa.array(missing, pa.int64())), [words[i] for i in missing])):
            raw[i] = found
        return raw

    def ids(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as bytes of self.kind (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = np.full(len(texts), not self.cuts)
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        alone = np.flatnonzero(odd).tolist()
        bounds, data = _bytes_of(pc.if_else(pa.array(odd), "", texts) if alone else texts)
        result = [b""] * len(texts)
        if len(data):
            kinds = _classes(data)
            pairs = _CUTS[kinds[:-1] << 3 | kinds[1:]]
            inner = bounds[(bounds > 0) & (bounds < len(data))]
            pairs[inner - 1] = 0  # two texts
            cut = np.zeros(len(data), bool)
            cut[:-1] = pairs >> 1
            cut[1:] |= (pairs & 1).view(bool)
            cut[0] = cut[inner] = True
            starts = np.flatnonzero(cut)
            words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)).dictionary_encode()
            raw, codes = self.of(words.dictionary), words.indices.to_numpy()
            size = np.fromiter(map(len, raw), np.int64, len(raw)) // self.kind.itemsize
            flat, begin = np.frombuffer(b"".join(raw), self.kind), np.cumsum(size) - size
            n = size[codes]
            ends = np.concatenate([[0], np.cumsum(n)])
            out = flat[np.repeat(begin[codes] - ends[:-1], n) + np.arange(ends[-1])]
            at = ends[np.searchsorted(starts, bounds)].tolist()
            result = [out[a:b].tobytes() for a, b in zip(at, at[1:])]
        for i in alone:
            result[i] = self.raw([texts[i].as_py()])[0]
        return result


@functools.lru_cache(1)
def words_of(path: str) -> Words:
    """The words that this process knows; it keeps them from task to task."""
    return Words(path)


def _tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, shard, at (ids before it in its shard), n and ids of sorted documents; each partition is a shard.

    The last row of a shard (at -1) isn't a document: it has the shard's counts by id, so that counting reads these alone.
    """

    def run(batches):
        words, shard, at, counts = words_of(path), TaskContext.get().partitionId(), 0, np.zeros(0, np.int64)
        tail, kind = np.array([end], words.kind).tobytes(), None
        names = ["doc_id", "shard", "at", "n", "ids"]
        for batch in pieces(batches, 6 << 20):
            ids = [x + tail for x in words.ids(batch.column("text"))]
            n = np.array([len(x) for x in ids], np.int64) // words.kind.itemsize
            before = at + np.cumsum(n) - n
            at, kind = at + int(n.sum()), batch.column("doc_id").type
            counts = _added(counts, np.bincount(np.frombuffer(b"".join(ids), words.kind)))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.full(len(n), shard), pa.int32()), pa.array(before), pa.array(n), pa.array(ids, pa.binary())], names)
        if at:
            yield pa.record_batch([pa.nulls(1, kind), pa.array([shard], pa.int32()), pa.array([-1], pa.int64()), pa.array([len(counts)], pa.int64()), pa.array([counts.astype("<i8").tobytes()])], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shard int, at long, n long, ids binary")


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sum of two arrays, the shorter one filled up with zeros."""
    if len(a) < len(b):
        a, b = b.astype(np.int64), a
    a[: len(b)] += b
    return a


def _counted(batches):
    for batch in batches:
        for x in batch.column("ids").to_pylist():
            counts = np.frombuffer(x, "<i8")
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(some), pa.array(counts[some])], ["id", "n"])


BLOCKS = "shard int, at long, n int, record binary, docs array<struct<doc_id:{kind},n:int>>, head long, closes boolean"


def _blocks(batches, freq: np.ndarray, kind: pa.DataType):
    """Rows of BLOCKS from rows (doc_id, shard, at, n, ids, width), which come in runs of a shard."""
    coder = rans.Table(freq)
    names = [x.split(" ")[0] for x in BLOCKS.split(", ")]
    docs_kind = pa.list_(pa.struct([("doc_id", kind), ("n", pa.int32())]))
    held, size, run = [], 0, None  # pieces (doc_id, ids, where their document starts, whether they end it) and the place behind them

    def flush(every: bool):
        """The held ids as blocks, whole ones alone unless every."""
        nonlocal held, size
        shard, end = run
        at, flat = end - size, np.concatenate([x for _, x, _, _ in held])
        whole = size // rans.BLOCK
        records = rans.encode(flat[: whole * rans.BLOCK].reshape(whole, rans.BLOCK), rans.BLOCK, coder) if whole else []
        if every and size % rans.BLOCK:
            records += rans.encode(flat[None, whole * rans.BLOCK :], size % rans.BLOCK, coder)
        rows, left = [], held[::-1]
        for record in records:
            n, inside = 0, []
            while left and n < rans.BLOCK:
                doc, x, start, ends = left.pop()
                if len(x) > rans.BLOCK - n:
                    left.append((doc, x[rans.BLOCK - n :], start, ends))
                    x, ends = x[: rans.BLOCK - n], False
                inside.append((doc, len(x), start, ends))
                n += len(x)
            rows.append((shard, at, n, record, [{"doc_id": d, "n": k} for d, k, _, _ in inside], inside[0][2], inside[-1][3]))
            at, size = at + n, size - n
        held = left[::-1]
        if rows:
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), docs_kind, pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    for batch in pieces(batches):
        cols = [batch.column(c).to_pylist() for c in ("doc_id", "shard", "at", "n", "ids", "width")]
        for doc, shard, at, n, ids, width in zip(*cols):
            if run is not None and run != (shard, at):
                yield from flush(True)
            held.append((doc, np.frombuffer(ids, f"<u{width}"), at, True))
            size, run = size + n, (shard, at + n)
            if size >= TOGETHER * rans.BLOCK:
                yield from flush(False)
    if size:
        yield from flush(True)


def folder_for(spark: SparkSession) -> str:
    """A new folder below the session's spark.checkpoint.dir (unset in local tests: the machine's temporary folder)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tokens-")
    return f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex}"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END) -> None:
    """Writes the ids of every text of docs (doc_id, text), `end` behind each, below folder: blocks (BLOCKS) and table (id, n, freq).

    Documents are in ascending order of doc_id, nulls first; equal ids by a hash of the text. Null texts are empty: `end` alone. Rows
    may repeat; an empty table has no blocks. Other columns are ignored. Special tokens' own strings in a text become those tokens, as
    the tokenizer's file has it. Texts of any length: a document may go over many blocks.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path()
    order = [F.col("doc_id"), F.col("tie")]
    sorted_docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(*order).sortWithinPartitions(*order)
    _tokenised(sorted_docs, path, end).write.option("compression", "zstd").parquet(f"{folder}/ids")
    rows = spark.read.parquet(f"{folder}/ids")
    ids = rows.where("at >= 0").withColumn("width", (F.length("ids") / F.col("n")).cast("int"))
    # a row for each id of the vocabulary at most
    counts = rows.where("at = -1").select("ids").mapInArrow(_counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.array(sorted((r["id"], r["n"]) for r in counts), np.int64).reshape(-1, 2)
    dense = np.bincount(counts[:, 0], counts[:, 1]) if len(counts) else np.ones(1)
    freq = rans.quantised(dense)
    rows = [(i, int(n), int(freq[i])) for i, n in counts.tolist()] or [(0, 0, int(freq[0]))]
    spark.createDataFrame(rows, "id int, n long, freq int").coalesce(1).write.parquet(f"{folder}/table")
    kind = pa.schema([pa.field("x", _arrow_kind(docs))]).field("x").type
    ids.mapInArrow(lambda batches: _blocks(batches, freq, kind), BLOCKS.format(kind=docs.schema["doc_id"].dataType.simpleString())).write.parquet(f"{folder}/blocks")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/ids")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _arrow_kind(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def _table(spark: SparkSession, folder: str) -> np.ndarray:
    """Frequencies by id, from a table with a row for each id of the vocabulary at most."""
    rows = spark.read.parquet(f"{folder}/table").select("id", "freq").collect()
    freq = np.zeros(max(r["id"] for r in rows) + 1, np.uint32)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def _pieces(spark: SparkSession, folder: str, what: str, kind: str, of) -> DataFrame:
    """doc_id, start (of the document), at (of the piece), n, whole and `what`, made by of() from ids, of each piece of a document that a block holds."""
    blocks, freq = spark.read.parquet(f"{folder}/blocks"), _table(spark, folder)
    totals = sorted((r["shard"], r["n"]) for r in blocks.groupBy("shard").agg(F.sum("n").alias("n")).collect())  # a row for each file that tokenising wrote
    base = dict(zip((s for s, _ in totals), np.cumsum([0, *(n for _, n in totals)]).tolist()))
    doc = blocks.schema["docs"].dataType.elementType["doc_id"].dataType.simpleString()
    arrow = {"long": pa.int64(), "array<int>": pa.list_(pa.int32())}[kind]

    def run(batches):
        coder = rans.Table(freq)
        for batch in pieces(batches, 4 << 20):
            decoded = rans.decode([rans.Record(x) for x in batch.column("record").to_pylist()], coder)
            docs = pc.list_flatten(batch.column("docs"))
            lengths = docs.field("n").to_numpy().astype(np.int64)
            first = np.concatenate([[0], np.cumsum(pc.list_value_length(batch.column("docs")).to_numpy())])
            places, starts, values = [], [], []
            for b, (ids, shard, at, head) in enumerate(zip(decoded, *(batch.column(c).to_pylist() for c in ("shard", "at", "head")))):
                n = lengths[first[b] : first[b + 1]]
                ends = np.cumsum(n)
                if len(ids) != ends[-1]:
                    raise ValueError("a block's documents don't fit its ids")
                places.append(base[shard] + at + ends - n)
                starts.append(np.r_[base[shard] + head, places[-1][1:]])
                values += [of(ids[e - k : e]) for e, k in zip(ends.tolist(), n.tolist())]
            places, starts, ended = np.concatenate(places), np.concatenate(starts), np.ones(len(lengths), bool)
            ended[first[1:] - 1] &= batch.column("closes").to_numpy(zero_copy_only=False)
            yield pa.record_batch([docs.field("doc_id"), pa.array(starts), pa.array(places), pa.array(lengths), pa.array((starts == places) & ended), pa.array(values, arrow)], ["doc_id", "start", "at", "n", "whole", what])

    return blocks.select("shard", "at", "head", "docs", "closes", "record").mapInArrow(run, f"doc_id {doc}, start long, at long, n long, whole boolean, {what} {kind}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, at, n, whole and ids of every piece of a document that a block holds.

    start is the number of ids of all documents before, at that of all pieces before; whole says that the piece is all of its document.
    """
    return _pieces(spark, folder, "ids", "array<int>", lambda x: x)


def _joined(batches):
    for batch in batches:
        crc = [rans.crc_joined([(p["crc"], 4 * p["n"]) for p in x]) for x in batch.column("parts").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document of write_tokens(), from its files alone.

    Checksums of pieces of a document are joined, so that its blocks can be decoded apart.
    """
    found = checkpointed(_pieces(spark, folder, "crc", "long", rans.checksum))
    whole = found.where("whole").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # a document has a part for each block, of 65 536 ids, that it lies in
    parts = found.where("not whole").groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"))
    return whole.unionByName(parts.mapInArrow(_joined, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in whole.schema)))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files that its ids were written to."""
    folder = folder_for(spark)
    write_tokens(table(spark, sf_dir, "documents"), folder)
    return digests(spark, folder)
