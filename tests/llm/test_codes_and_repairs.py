"""Operators 11 to 13 against exact round trips, brute force, and numpy."""

import functools
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import conversations as C  # noqa: E402
from ledgerloom.llm import rans, tokens  # noqa: E402
from ledgerloom.llm import whitening as W  # noqa: E402


# 11: blocks of ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=400), st.integers(1, 5))
def test_any_symbols_come_back_from_blocks(some, blocks):
    rows = np.array([some] * blocks)
    table = rans.Table(rans.quantised(np.bincount(rows.ravel())))
    back = rans.decode([rans.Record(r) for r in rans.encode(rows, len(some), table)], table)
    assert [x.tolist() for x in back] == [some] * blocks


def test_segments_are_decoded_from_their_checkpoints_and_damage_is_seen():
    r = np.random.default_rng(1)
    ids = np.minimum(r.zipf(1.4, 3 * rans.BLOCK), 5000)
    table = rans.Table(rans.quantised(np.bincount(ids)))
    records = rans.encode(ids.reshape(3, -1), rans.BLOCK, table) + rans.encode(ids[None, :40_000], 40_000, table)
    for b, n in ((1, rans.BLOCK), (3, 40_000)):
        one = rans.Record(records[b])
        for k, (a, size) in enumerate(one.segments()):
            assert (rans.decode([one], table, [[k]])[0] == (ids.reshape(3, -1)[b] if b < 3 else ids[:40_000])[a : a + size]).all()
    p = np.bincount(ids) / len(ids)
    bits = -(p[p > 0] * np.log2(p[p > 0])).sum()
    assert sum(map(len, records[:3])) * 8 < len(ids) * (bits + 0.2)  # close to the entropy
    broken = bytearray(records[0])
    broken[len(broken) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.Record(bytes(broken))
    with pytest.raises(ValueError):  # another table of frequencies
        rans.decode([rans.Record(records[0])], rans.Table(rans.quantised(np.bincount(ids)[::-1])))
    with pytest.raises(ValueError):
        rans.encode(np.full((1, 3), 5001), 3, rans.Table(rans.quantised(np.r_[np.bincount(ids), 0])))


def test_checksums_of_pieces_join():
    r = random.Random(2)
    for _ in range(20):
        parts = [r.randbytes(r.choice([0, 1, 7, 5000])) for _ in range(r.randint(1, 5))]
        assert rans.crc_joined([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


ODD_TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a   b ", "a\n b", "a \n b", "a\n\nb  \n", "it's they'll WE'RE 'tis", "x, y. z! w? v; u:", "été, über. naïve", "12 3.5 a1 b2,",
    "　你好 世界", " a  b", "tab\tb \tc", "<|endoftext|> a <|endoftext|>", "é á, ", "\x1c a\x1c b", "  a  b", "\U0001f600 a\U0001f600, b", "İstanbul ǅ, ɐx", "word,, word.. word?!", "\x00 \x00a", "\x85 b\x85 c", "a,b c,d", "ª º µ, × ÷", "x one.\nTwo, x\ny z!\nÉtion; a\n\nb c.\n d\n e, f\ng\nh",
]


def whole_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokens.tokenizer_path()).encode_batch(texts, add_special_tokens=False)]


def test_words_give_the_same_ids_as_whole_texts():
    words = tokens.Words(tokens.tokenizer_path())
    r = random.Random(3)
    bits = ["a", "Word", "the", " ", "  ", "\n", "\t", ".", ",", "'s", "'", "12", "é", "你", " ", "　", "!", "?", "-", "́", "\U0001f600", "\x1f", "​"]
    texts = ODD_TEXTS + ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.ids(pa.array(texts))] == whole_ids(texts)
    assert words.ids(pa.array(["a b", None])) == [words.ids(pa.array(["a b"]))[0], b""] and words.ids(pa.array([], pa.string())) == []


def test_a_full_memory_of_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN", 10)
    monkeypatch.setattr(tokens, "LONG", 5)
    words = tokens.Words(tokens.tokenizer_path())
    texts = [f"one{i} two{i}, three four{i % 3}.\n five" for i in range(50)]
    assert [np.frombuffer(x, words.kind).tolist() for t in texts for x in words.ids(pa.array([t]))] == whole_ids(texts)


def test_a_word_is_tokenised_once_whatever_marks_and_lines_are_around():
    words = tokens.Words(tokens.tokenizer_path())
    some = [f"{a}{b}{c}" for a in ("ra", "thé", "Wör") for b in ("ti", "hein", "ço") for c in ("n", "ly", "ñe")]
    texts = [" ".join(f"{x}{mark} ({x}){mark}\n{y}={i}{mark}\n\n{y}" for i, mark in enumerate((".", ",", "%%%", "?!"))) for x in some for y in some]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.ids(pa.array(texts))] == whole_ids(texts)
    assert len(words.known) <= 2 * len(some) + 40  # with and without a space; marks, digits and line feeds


def test_cuts_are_where_units_begin_whatever_the_characters():
    words = tokens.Words(tokens.tokenizer_path())
    around = [*range(0x80, 0x500), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0x3001, 0xFEFF, 0xFFFF, 0x1F600]
    texts = [f"a{c}b{c} {c}1{c}\n{c}.{c}'s  {c}\t\n{c}{c} x" for c in map(chr, around)] + [f"{c}{d}" for c in map(chr, range(128)) for d in "a1. \n'é你"]
    texts += ["".join(x) for x in itertools.product(["a", "7", ".", " ", "\n", "'", "s", "é", "你", "×", "\xa0"], repeat=4)]
    assert [np.frombuffer(x, words.kind).tolist() for x in words.ids(pa.array(texts))] == whole_ids(texts)
    part = pa.array(["left out", *texts[:50], None, "left out"]).slice(1, 51)
    assert [np.frombuffer(x, words.kind).tolist() for x in words.ids(part)] == whole_ids([*texts[:50], ""])


def test_documents_are_read_back_from_their_blocks(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(90_000))  # over several blocks
    texts = [*ODD_TEXTS, None, long, "after", "same", "same"]
    ids = [*range(len(texts) - 2), 7, 7]
    docs = [(i, t, "x", 1) for i, t in zip(ids, texts)] + [(None, "of no id", "x", 1), (-5, "least", "x", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, tie string, start int").repartition(3)
    folder = str(tmp_path / "tokens")
    tokens.write_tokens(df, folder)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.digests(spark, folder).collect())
    assert [d for _, d, _, _ in got] == [None, *sorted(i for i, *_ in docs if i is not None)]
    by = {}
    for i, t, *_ in docs:
        by.setdefault(i, []).append(t or "")
    at = 0
    for start, doc, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in {(len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for x in whole_ids(by[doc])}
    pieces = {}
    for r in sorted(tokens.read_tokens(spark, folder).collect(), key=lambda r: r.at):
        pieces.setdefault(r.start, []).extend(r.ids)
    assert sorted(pieces) == [g[0] for g in got] and pieces[next(g[0] for g in got if g[1] == texts.index(long))] == whole_ids([long])[0] + [0]
    assert spark.read.parquet(folder + "/blocks").where("n > 0").count() > 3
    none = str(tmp_path / "none")
    tokens.write_tokens(df.limit(0), none)
    assert tokens.digests(spark, none).count() == 0 and tokens.read_tokens(spark, none).count() == 0


# 12: conversations


def plain_report(rows):
    """What op12 gives of rows (turn, role, text) in order, by trying every edit with memory, strings and all."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, faults = set(), []
    for _, role, text in rows:
        core = [c for c in text if not (c == " " or "\t" <= c <= "\r")]
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    @functools.cache
    def best(i, before, inserted):
        options = [(0, "", ())] if i == len(rows) and before in ("", "a") else []
        turn = "a" if before == "u" else "u"
        name = {"u": "user", "a": "assistant"}[turn]
        if inserted < 3 and (c := best(i, turn, inserted + 1)):
            options.append((3 + c[0], "I" + c[1], (name + ":", *c[2])))
        if i < len(rows):
            _, role, text = rows[i]
            if c := best(i + 1, before, 0):
                options.append((4 + c[0], "D" + c[1], c[2]))
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                if (role[:1] == turn or (role[:1] == "s" and not before)) and (c := best(i + 1, role[:1], 0)):
                    options.append((more + c[0], "K" + c[1], (f"{role}:{text}", *c[2])))
                if c := best(i + 1, turn, 0):
                    options.append((3 + more + c[0], "R" + c[1], (f"{name}:{text}", *c[2])))
        return min(options, default=None)

    for i in range(len(rows), -1, -1):
        for before in ("", "s", "u", "a"):
            best(i, before, 0)
    cost, audit, out = best(0, "", 0)
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def plain_reports(rows):
    after, out = plain_damage(rows), {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in after if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        out[conv] = plain_report(tuple(mine))
    return out


def test_powers_and_choices_agree_with_trying_everything():
    r = random.Random(4)
    for _ in range(300):
        rows = tuple((i, r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["", "a.", "b", f"{i}.", f"{i}"])) for i in range(r.randint(0, 12)))
        piece, seen = C.Piece(), set()
        for turn, role, text in rows:
            blank, later = not text, (role, text) in seen
            kind = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            piece.add(turn, role, text, 1, C.GONE if blank or later else 2 * kind + (text[-1] not in ".!?"), blank, later)
            seen.add((role, text))
        audit, turns = C.mended(piece.rows, piece.runs, C.END, C.START, True)
        got = (*C.totals([piece.counts()]), C.worth(piece.runs, C.END)[0][C.START], audit, hashlib.sha256("\n".join(f"{role}:{text}" for _, _, role, text in turns).encode()).hexdigest())
        assert got == plain_report(rows)
        assert C.applied(C.product(piece.runs), C.END) == C.worth(piece.runs, C.END)[0]


@pytest.fixture(scope="module")
def talks():
    r, rows = random.Random(5), [(100, 2, "user", "all gone"), (101, None, None, None), (102, 3, "system", "alone.")]
    for conv in [None, *range(25)]:
        for i in range(r.choice([1, 2, 5, 30, 90]) if conv != 3 else 400):
            role = r.choice(["user", "assistant", "system", "user", "assistant", None, "tool", "", "supervisor"])
            rows.append((conv, r.choice([None, i, i, i, i // 2]), role, r.choice([None, "", " \n", "ok", "ok.", "a. ", "b?\t", f"c{i}.", f"d{i}"])))
    return rows + [(5, 7, "user", "said a thousand times")] * 1000


def test_repairs_are_those_of_brute_force_however_conversations_are_cut(spark, talks):
    expected = plain_reports(talks)
    df = spark.createDataFrame([(*r, "x", 1) for r in talks], "conv_id long, turn long, role string, text string, part string, cost int").repartition(5)
    for most in (C.PIECE_ROWS, 7, 1):
        got = C.digests(C.repair(C.damaged(df), "copies", most)).collect()
        assert len(got) == len(expected) and {r[0]: tuple(r)[1:] for r in got} == expected
    assert C.digests(C.repair(df.limit(0))).count() == 0
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # more partitions than files of a checkpoint
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        got = C.digests(C.repair(C.damaged(df), "copies", 7)).collect()
        assert len(got) == len(expected) and {r[0]: tuple(r)[1:] for r in got} == expected
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repaired_turns_are_valid(spark, talks):
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")
    for r in C.repair(df).where("pieces = 1").collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in r.turns))
        assert [t.edit for t in r.turns] == [e for e in r.audit if e != "D"]
        assert all(t.text == "" and t.turn is None for t in r.turns if t.edit == "I")


# 13: whitening


def test_bit_planes_give_exact_products():
    r = np.random.default_rng(6)
    for high in (2, 500, 1 << 20, 1 << 61):
        x = r.integers(-high, high, (777, 5))
        x[:, 2] = 7
        o = x.astype(object)
        sums, products = W.cross_products(x)
        whole = o.T @ o
        assert sums == list(o.sum(0)) and all(products[i][j - i] == whole[i, j] for i in range(5) for j in range(i, 5))
    assert all(sum(v << 40 * k for k, v in enumerate(W._limbs(n))) == n for n in (0, -1, 5, 1 << 130, -(1 << 150)))


def plain_whitening(vectors):
    fit = [v for _, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array(fit)).astype(np.int64) + 1_000_000
    centred = (len(x) * x.astype(object) - x.astype(object).sum(0))
    v = np.cov((x - 1_000_000).T, bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    return (centred**2).sum(1), ((x - 1_000_000) - (x - 1_000_000).mean(0)) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_is_numpys(spark):
    r = np.random.default_rng(7)
    mix = r.normal(size=(40, 40)) * np.exp(-np.arange(40) / 8)
    vectors = [(i, (r.normal(size=40) @ mix + 5).tolist()) for i in range(900)]
    bad = [(1000, None), (1001, [None] * 40), (1002, [float("nan")] + [0.0] * 39), (1003, [float("-inf")] + [0.0] * 39), (1004, [1.0, 2.0]), (1005, [])]
    again = [(3, vectors[3][1]), (None, vectors[4][1])]
    rows = [(i, v, "x") for i, v in vectors + bad + again]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string").repartition(4)
    got = W.whiten(df).toPandas()
    deviation, whitened, explained = plain_whitening(vectors + again)
    assert len(got) == 902 * 32 and (got.n == 902).all() and got.identity_error.iloc[0] < 1e-9
    first = got[got.vec_id == 17].sort_values("component")
    assert (first.deviation == deviation[17]).all() and np.allclose(np.abs(first.whitened), np.abs(whitened[17]), atol=1e-8) and np.allclose(first.explained, explained)
    a = got.drop_duplicates(["vec_id", "component"]).dropna().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign(a[0] * whitened[0])
    assert np.allclose(a * signs, whitened[:900], atol=1e-8)
    assert got.vec_id.isna().sum() == 32 and (got.vec_id == 3).sum() == 64


def test_whitening_of_little_or_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, []), (2, [])]):
        assert W.whiten(spark.createDataFrame(rows, schema)).count() == 0
    # one of two dimensions is constant: one component
    got = W.whiten(spark.createDataFrame([(i, [float(i), 3.0]) for i in range(10)], schema)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    # deviations beyond 64 bits are null, the rest still right
    far = W.whiten(spark.createDataFrame([(i, [i * 1e15, float(i % 3)]) for i in range(50)], schema.replace("float", "double"))).collect()
    assert len(far) in (50, 100) and any(r.deviation is None for r in far)
