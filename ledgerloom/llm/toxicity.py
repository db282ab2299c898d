"""Toxicity of whole texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A token's input is the sum of a word vector (words of the vocabulary alone) and the vectors of its character
n-grams, so that unseen forms of a toxic stem still count. Two gated recurrent layers read a window of WINDOW
tokens in either direction, attention pools their states, and a logistic output gives the window's logit. The windows
of a text overlap by half and cover all of it; the text's logit is a calibrated function of the highest.

The network is fitted on the driver on a bounded sample (SAMPLE documents of each label, PIECE characters of each at
most, drawn by a hash of the id; of toxic documents longer than that a piece may not show what was marked, so they are
passed over while there are enough shorter ones). Its calibration weights the sampled texts by what share of their label they are, so that
scores keep their meaning as the table grows. Scoring runs over all texts inside Arrow batches with the weights broadcast.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, held_out, pieces, table

SAMPLE = 1500  #: labelled documents of each class that the network is fitted on, at most
PIECE = 20_000  #: characters of such a document, at most
ENOUGH = 100  #: toxic documents not longer than PIECE, for longer ones to be passed over
WINDOW = 24  #: tokens of a window; windows start every WINDOW / 2
WORDS, GRAMS = 8192, 16384  #: most words and character n-grams with a vector
DIM, HIDDEN = 6, 8
EPOCHS, UPDATES = 6, 300  #: epochs, and more of them until there were as many updates
TELLING = 12.0  #: least chi-square of a word or n-gram with the label for it to have a vector
DECAY = 0.02  #: of word and n-gram vectors in an update, times the learning rate
THRESHOLD = 0.3
_TOKEN = re.compile(r"\w+")
_BITS = 20  #: of the table that finds n-grams; each entry is checked against the n-gram itself


def tokens(text: str | None) -> list[str]:
    """All runs of word characters, lower-cased."""
    return _TOKEN.findall(text.lower()) if text else []


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the 3-, 4- and 5-character runs of each word with marked ends, and the words' numbers."""
    text = "".join(f"\x02{w}\x03" for w in words)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(code):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = np.cumsum(code == 2) - 1
    h, out, at = code.copy(), [], []
    for n in range(2, 6):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n > 2:
            inside = word[: len(h)] == word[n - 1 :]
            g = h[inside] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(n)
            out.append(g ^ g >> np.uint64(32))
            at.append(word[: len(h)][inside])
    return np.concatenate(out), np.concatenate(at)


class Inputs:
    """The vocabulary of words and n-grams, and the sparse features of words."""

    def __init__(self, words: list[str], grams: np.ndarray):
        self.words = {w: i for i, w in enumerate(words)}
        self.grams = grams
        self.slot = np.full(1 << _BITS, -1, np.int32)
        for i, g in enumerate(grams):  # a later n-gram in the same slot is left out
            k = int(g) >> (64 - _BITS)
            if self.slot[k] < 0:
                self.slot[k] = i

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words (-1: none), and pairs (word's place, n-gram's number)."""
        ids = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        codes, at = gram_codes(words)
        found = self.slot[(codes >> np.uint64(64 - _BITS)).astype(np.int64)]
        hit = found >= 0
        hit[hit] = self.grams[found[hit]] == codes[hit]
        return ids, at[hit], found[hit]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Weights by name, forward and backward passes over windows of token numbers."""

    def __init__(self, inputs: Inputs, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape, scale=0.3: (r.standard_normal(shape) * scale).astype(np.float32)
        self.inputs = inputs
        self.w = {"word": f(len(inputs.words), DIM, scale=0.05), "gram": f(len(inputs.grams), DIM, scale=0.05), "v": f(2 * HIDDEN), "o": f(2 * HIDDEN), "ob": np.full(1, -1.0, np.float32)}
        for d in "fb":
            self.w |= {f"W{d}": f(DIM, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.scale = (1.0, 0.0)  # of the calibration: slope, offset

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and their features."""
        feats = self.inputs.of(words)
        return self.embed(len(words), *feats), feats

    def embed(self, n: int, ids: np.ndarray, at: np.ndarray, grams: np.ndarray) -> np.ndarray:
        x = np.zeros((n, DIM), np.float32)
        if len(self.inputs.words):
            x[ids >= 0] = self.w["word"][ids[ids >= 0]]
        for k in range(DIM):
            x[:, k] += np.bincount(at, self.w["gram"][grams, k], n) if len(at) else 0
        return x

    def _run(self, p: np.ndarray, u: np.ndarray, order, keep: list | None):
        """States of one direction over inputs p (windows, steps, 3 * HIDDEN)."""
        n, h = len(p), np.zeros((len(p), HIDDEN), np.float32)
        states = np.empty((p.shape[1], n, HIDDEN), np.float32)
        for t in order:
            x = p[:, t]
            g = h @ u
            zr = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
            c = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
            new = c + z * (h - c)
            if keep is not None:
                keep.append((t, h, z, r, gn, c))
            states[t] = h = new
        return states

    def forward(self, pf: np.ndarray, pb: np.ndarray, idx: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows of token numbers idx (0: padding) with projected inputs by token number."""
        kf, kb = ([], []) if keep is not None else (None, None)
        steps = idx.shape[1]
        s = np.concatenate([self._run(pf[idx], self.w["Uf"], range(steps), kf), self._run(pb[idx], self.w["Ub"], range(steps - 1, -1, -1), kb)], 2)
        e = s @ self.w["v"]
        e[idx.T == 0] = -1e9
        e -= e.max(0)
        a = np.exp(e)
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, s)
        if keep is not None:
            keep |= {"f": kf, "b": kb, "s": s, "a": a, "pooled": pooled}
        return pooled @ self.w["o"] + self.w["ob"]

    def backward(self, idx: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        """Gradients of the weights, and of the projected inputs of either direction by place."""
        g = {k: np.zeros_like(x) for k, x in self.w.items() if k not in ("word", "gram")}
        s, a = keep["s"], keep["a"]
        g["o"], g["ob"] = keep["pooled"].T @ dlogit, dlogit.sum(keepdims=True)
        dp = dlogit[:, None] * self.w["o"]
        da = np.einsum("nh,tnh->tn", dp, s)
        de = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tn,tnh->h", de, s)
        ds = a[:, :, None] * dp + de[:, :, None] * self.w["v"]
        outs = []
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dh = self.w["U" + d], np.zeros((len(idx), HIDDEN), np.float32)
            dx = np.zeros((len(idx), idx.shape[1], 3 * HIDDEN), np.float32)
            for t, h, z, r, gn, c in reversed(keep[d]):
                dh = dh + ds[t][:, part]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                dx[:, t] = np.concatenate([dz, dr, dc], 1)
                dg = np.concatenate([dz, dr, dc * r], 1)
                g["U" + d] += h.T @ dg
                dh = dh * z + dg @ u.T
            g["b" + d] = dx.sum((0, 1))
            outs.append(dx)
        return g, *outs

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of both directions by token number from vectors by token number (0: padding)."""
        pf, pb = x @ self.w["Wf"] + self.w["bf"], x @ self.w["Wb"] + self.w["bb"]
        return pf, pb

    def logits(self, texts: list[str | None], block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Logits of all windows of texts; the text of each; the windows' token numbers; the distinct tokens."""
        idx, owner, distinct = windows(texts)
        return self.logits_of(idx, self.vectors(distinct)[0], block), owner, idx, distinct

    def logits_of(self, idx: np.ndarray, x: np.ndarray, block: int = 4096) -> np.ndarray:
        pf, pb = self.projected(np.concatenate([np.zeros((1, DIM), np.float32), x]))
        out = [self.forward(pf, pb, idx[i : i + block]) for i in range(0, len(idx), block)]
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of texts, 0 to 1; that of a text without tokens is of one window of padding."""
        logit, owner, _, _ = self.logits(texts)
        top = np.full(len(texts), -20.0)
        np.maximum.at(top, owner, logit)
        return _sigmoid(self.scale[0] * top + self.scale[1])


def windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Token numbers (from 1; 0: padding) of all windows, the text of each, and the distinct tokens."""
    lists = [tokens(x) for x in texts]
    counts = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    codes, distinct = pd.factorize(np.array(flat, object)) if flat else (np.zeros(0, np.int64), [])
    half = WINDOW // 2
    number = np.where(counts > 0, np.maximum(1, -(-(counts - half) // half)), 0)
    owner = np.repeat(np.arange(len(texts)), number)
    first = np.concatenate([[0], np.cumsum(counts)])
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)
    place = nth[:, None] * half + np.arange(WINDOW)
    inside = place < counts[owner][:, None]
    padded = np.concatenate([codes + 1, [0]])
    idx = padded[np.where(inside, first[owner][:, None] + place, len(codes))]
    return idx, owner, list(distinct)


def _telling(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray, dict[str, float], dict[int, float]]:
    """Words and n-grams that tell the labels apart, the most telling first, and their weights of evidence."""
    n = np.array([max(1, (labels == k).sum()) for k in (0, 1)], float)
    by_word: dict[str, np.ndarray] = {}
    codes, marks = [], []
    for text, label in zip(texts, labels):
        distinct = sorted(set(tokens(text)))
        for w in distinct:
            by_word.setdefault(w, np.zeros(2))[label] += 1
        g = np.unique(gram_codes(distinct)[0])
        codes.append(g)
        marks.append(np.full(len(g), label))
    g, at = np.unique(np.concatenate(codes), return_inverse=True)
    by_gram = np.bincount(at * 2 + np.concatenate(marks), minlength=2 * len(g)).reshape(-1, 2)

    def evidence(c: np.ndarray) -> np.ndarray:
        share = (c + 0.5) / (n + 1)
        return np.log(share[:, 1] / share[:, 0]) * np.sqrt(np.minimum(c.sum(1), 20) / 20)

    def telling(c: np.ndarray) -> np.ndarray:
        share = n[1] / n.sum()
        mean = c.sum(1) * share
        return (c[:, 1] - mean) ** 2 / np.maximum(mean * (1 - share), 1e-9)

    names = [w for w, c in by_word.items() if c.sum() >= 3]
    counts = np.array([by_word[w] for w in names]).reshape(-1, 2)
    we, wt = evidence(counts), telling(counts)
    order = [i for i in sorted(range(len(names)), key=lambda i: (-wt[i], names[i])) if wt[i] >= TELLING][:WORDS]
    ge, gt = evidence(by_gram), np.where(by_gram.sum(1) >= 3, telling(by_gram), 0.0)
    gorder = np.lexsort((g, -gt))[:GRAMS]
    gorder = gorder[gt[gorder] >= TELLING]
    return [names[i] for i in order], g[gorder], {names[i]: we[i] for i in order}, ge[gorder]


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 5, weights: list[float] | None = None) -> Network:
    """A network fitted on labelled texts, each standing for as many documents as its weight says (none given: equally many).

    The first dimension of the vectors starts as the evidence of the word or n-gram. Each epoch takes of every toxic
    text its highest window, and of every other text its highest and some drawn ones. At the end the highest
    logits are calibrated by weighted logistic regression. With one label only, all scores are that of no evidence.
    """
    y = np.array(labels, int)
    names, grams, we, ge = _telling(texts, y) if len(texts) else ([], np.zeros(0, np.uint64), {}, np.zeros(0))
    net = Network(Inputs(names, grams), seed)
    if len(set(labels)) < 2:
        net.scale = (0.0, -3.0 if 1 not in labels else 0.0)
        return net
    net.w["word"][:, 0] = [we[w] / 4 for w in names]
    net.w["gram"][:, 0] = ge / 16
    r = np.random.default_rng(seed)
    idx, owner, distinct = windows(texts)
    ids, at, grams_of = net.inputs.of(distinct)
    order = np.argsort(at, kind="stable")
    at, grams_of = at[order], grams_of[order]
    first = np.searchsorted(at, np.arange(len(distinct) + 1))
    m = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.w.items()}
    step, y_of = 0, y[owner]
    evidence = net.embed(len(distinct), ids, at, grams_of)[:, 0]
    by_token = np.concatenate([[0], np.maximum(evidence, 0)])
    level = by_token[idx].max(1)
    epoch = 0
    while epoch < epochs or step < UPDATES:
        epoch += 1
        top = _highest(level, owner)
        drawn = np.flatnonzero((y_of == 0) & (r.random(len(owner)) < min(1, 4 * len(texts) / max(1, len(owner)))))
        chosen = r.permutation(np.unique(np.concatenate([top, drawn])))
        for start in range(0, len(chosen), 256):
            i = chosen[start : start + 256]
            used, local = np.unique(idx[i], return_inverse=True)
            local = local.reshape(idx[i].shape)
            local += used[0] != 0  # 0 stays the padding's
            used = used[used > 0] - 1
            n = first[used + 1] - first[used]
            gat = np.repeat(np.arange(len(used)), n)
            gnum = grams_of[np.arange(n.sum()) + np.repeat(first[used] - np.cumsum(n) + n, n)]
            wid = ids[used]
            x = np.concatenate([np.zeros((1, DIM), np.float32), net.embed(len(used), wid, gat, gnum)])
            keep: dict = {}
            logit = net.forward(*net.projected(x), local, keep)
            yy = y_of[i]
            weight = np.where(yy == 1, max(1.0, (yy == 0).sum() / max(1, yy.sum()) / 2), 1.0).astype(np.float32)
            g, df, db = net.backward(local, keep, ((_sigmoid(logit) - yy) * weight / len(i)).astype(np.float32))
            flat = local.ravel()
            dx = np.zeros_like(x)
            for d, dd in (("f", df.reshape(-1, 3 * HIDDEN)), ("b", db.reshape(-1, 3 * HIDDEN))):
                by = np.stack([np.bincount(flat, dd[:, k], len(x)) for k in range(3 * HIDDEN)], 1).astype(np.float32)
                g["W" + d] = x.T @ by
                dx += by @ net.w["W" + d].T
            dx = dx[1:]
            g["word"], g["gram"] = np.zeros_like(net.w["word"]), np.zeros_like(net.w["gram"])
            np.add.at(g["word"], wid[wid >= 0], dx[wid >= 0])
            for k in range(DIM):
                g["gram"][:, k] = np.bincount(gnum, dx[gat, k], len(grams)) if len(gat) else 0
            step += 1
            for k, (a, b) in m.items():  # Adam
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                rate = 0.003 if k in ("word", "gram") else 0.01
                if k in ("word", "gram"):
                    net.w[k] *= np.float32(1 - rate * DECAY)
                net.w[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        level = net.logits_of(idx, net.embed(len(distinct), ids, at, grams_of))
    top = np.full(len(texts), -20.0)
    np.maximum.at(top, owner, level)
    net.scale = _calibrate(np.clip(top, -20, 20), y, weights)
    return net


def _highest(level: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The place of the highest level of each owner."""
    order = np.lexsort((-level, owner))
    return order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])] if len(order) else order


def _calibrate(x: np.ndarray, y: np.ndarray, weights: list[float] | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic regression of y on x, pulled to 1 and 0: labels that x tells apart without a
    fault would have them grow without end. The pull is that against len(x) rows whatever the weights add up to. Half steps
    of Newton's method."""
    each = np.ones(len(x)) if weights is None else np.array(weights, float) * len(x) / np.sum(weights)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * x + b)
        w = each * p * (1 - p)
        g = np.array([(each * (p - y) * x).sum() + 20 * (a - 1), (each * (p - y)).sum() + 4 * b])
        h = np.array([[(w * x * x).sum() + 20, (w * x).sum()], [(w * x).sum(), w.sum() + 4]])
        da, db = np.linalg.solve(h, g)
        a, b = float(np.clip(a - da / 2, 0.3, 3)), float(np.clip(b - db / 2, -5, 5))
    return a, b


def draw(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, piece: int = PIECE) -> tuple[list[str], list[int], list[float]]:
    """Labelled texts, their labels, and the number of labelled ids that each of them stands for.

    Of either label all ids if there are at most `each` of them, else the `each` with the least hashes; of each text at
    most `piece` characters, from a place that the hash picks. Toxic texts longer than that are left out, and the others
    stand for them, if ENOUGH or half of the toxic ones are shorter. Rows with null ids, labels or texts are passed over;
    of rows that repeat an id with other texts the last piece in code-point order counts; an id of both labels is toxic.
    """
    h = F.xxhash64("doc_id")
    place = F.shiftrightunsigned("h", 1)  # 0 to 2 ** 63 - 1
    marked = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    count = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    wanted: dict = {}
    for label, n in sorted(count.items()):
        # of 1.2 times as many ids as are wanted, `each` at least are below the bound as good as always
        bound = min(2**63 - 1, 2**63 * (6 * each + 100) // (5 * n))
        low = marked.where(F.col("toxic") == label).withColumn("h", h).where(place <= bound).select("doc_id", place.alias("h"))
        least = sorted(low.collect(), key=lambda r: (r["h"], r["doc_id"]))[:each]
        wanted |= {r["doc_id"]: (label, n / len(least)) for r in least}
    if not wanted:
        return [], [], []
    start = (F.pmod(F.shiftrightunsigned(h, 16), F.greatest(F.lit(1), F.length("text") - piece)) + 1).cast("int")
    # at most 2 * each ids, sent to all executors
    ids = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in wanted], docs.select("doc_id").schema))
    rows = docs.where("text is not null").select("doc_id", F.substring("text", start, F.lit(piece)).alias("t"), (F.length("text") > piece).alias("cut")).join(ids, "doc_id")
    found = {r["doc_id"]: (r["t"], r["cut"]) for r in sorted(rows.collect(), key=lambda r: (r["doc_id"], r["t"]))}
    toxic = [i for i in found if wanted[i][0] == 1]
    whole = {i for i in toxic if not found[i][1]}
    times = 1.0
    if len(whole) >= min(ENOUGH, (len(toxic) + 1) / 2):
        times = len(toxic) / max(1, len(whole))
        found = {i: x for i, x in found.items() if wanted[i][0] == 0 or i in whole}
    ids = sorted(found)
    return [found[i][0] for i in ids], [wanted[i][0] for i in ids], [wanted[i][1] * (times if wanted[i][0] else 1.0) for i in ids]


def sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE, piece: int = PIECE) -> tuple[list[str], list[int]]:
    """The texts and labels of draw()."""
    return draw(docs, labels, each, piece)[:2]


def score(docs: DataFrame, net: Network, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns `keep` (none of them named score) of docs and score, over all windows of the whole text.

    Null and empty texts, and those without word characters, have the lowest score. Equal texts have
    equal scores up to the last bits of single precision; they are rounded to 5 digits. Other columns pass untouched.
    """
    keep = ["doc_id"] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(net)
    whole = apart(docs, "_text")[0]

    def run(batches):
        for batch in pieces(batches, 1 << 20):
            s = shared.value.score(batch.column(whole).to_pylist())
            cols = [batch.column(c) for c in keep] + [pa.array(np.round(s, 5), pa.float64())]
            yield pa.record_batch(cols, [*keep, "score"])

    rows = docs.select(*keep, F.col(text_col).alias(whole))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return rows.mapInArrow(run, ", ".join([*fields, "score double"]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from labels of those not held out. A document with
    a null id isn't held out and is scored like any other."""
    docs = table(spark, sf_dir, "documents")
    net = learned(docs, table(spark, sf_dir, "labels"))
    found = score(docs, net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def learned(docs: DataFrame, labels: DataFrame) -> Network:
    """The network fitted on a sample of the labelled documents that aren't held out."""
    texts, toxic, weights = draw(docs, labels.where(~held_out(F.col("doc_id"))))
    return fit(texts, toxic, weights=weights)
