"""Cases that once went wrong: comments longer than the article, contaminated rows that share an id with clean ones, many languages."""

import itertools
import math
import random
import re
import time

import numpy as np
import pytest

pytest.importorskip("ledgerloom.llm")
from ledgerloom.llm import decontaminate, html, language, toxicity, urls  # noqa: E402

WORDS = "river stone market garden winter letter harbour window bridge music teacher village paper mountain summer road station ticket planet forest".split()


def sentence(r, n=14):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(r, noise, article_tag="article", inside=True, sentences=5):
    """A page and its main text, written side by side: `noise` (tag, attributes, paragraphs) stands inside or behind the article."""
    body = [sentence(r) for _ in range(sentences)]
    extra = "".join(f"<{t} {a}>" + "".join(f"<p>{sentence(r, 30)}</p>" for _ in range(n)) + f"</{t}>" for t, a, n in noise)
    text = "".join(f"<p>{s}</p>" for s in body)
    main = f"<{article_tag} class='post'><h1>Title of it</h1>{text}{extra if inside else ''}</{article_tag}>{'' if inside else extra}"
    return f"<html><body class='has-sidebar single'><nav><a href='/'>Home</a></nav>{main}<footer>All rights</footer></body></html>", "\n\n".join(["Title of it", *body])


NOISE = [
    ("section", "id='comments'", 30), ("div", "class='site-ad-slot'", 2), ("div", "class='ad-unit'", 1), ("div", "class='related-posts'", 4), ("ul", "class='social-media-links'", 2), ("div", "class='comment-thread'", 20),
    ("div", "class='reader-comments'", 25), ("section", "class='user-comments'", 25), ("div", "id='disqus_thread'", 3), ("div", "class='newsletter-signup-box'", 1), ("div", "itemtype='https://schema.org/Comment'", 9), ("aside", "", 6), ("div", "class='advertisement top'", 2), ("div", "class='sidebar-widget-area'", 2),
]


@pytest.mark.parametrize("inside", [True, False])
@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_comments_and_adverts_are_left_out_however_long(spark, tag, inside):
    r = random.Random(8)
    made = [page(r, [n], tag, inside) for n in NOISE] + [page(r, NOISE, tag, inside)]
    alone = [(i, f"http://h{i}.example/p", h) for i, (h, _) in enumerate(made)]
    together = [(100 + i, "http://one.example/p", h) for i, (h, _) in enumerate(made)]
    six = [(200 + k, "http://six.example/p", page(r, [NOISE[0]], tag, inside)) for k in range(6)]
    want = {i: t for i, (_, t) in enumerate(made)} | {100 + i: t for i, (_, t) in enumerate(made)} | {k: t for k, _, (_, t) in six}
    df = spark.createDataFrame(alone + together + [(k, u, h) for k, u, (h, _) in six], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html.extract(df).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_names_that_only_sound_like_something_else(spark):
    r = random.Random(9)
    kept = ["class='content-with-sidebar'", "class='no-comments'", "id='market-share'", "id='social-impact'", "id='related-work'", "class='category-social'", "class='ad-hoc-query'", "class='shareholder-report'", "class='adventure'"]
    rows, want = [], {}
    for i, a in enumerate(kept):
        body = [sentence(r) for _ in range(6)]
        rows.append((i, f"http://k{i}.example/x", f"<body><article><p>{body[0]}</p><section {a}>" + "".join(f"<p>{s}</p>" for s in body[1:]) + "</section></article></body>"))
        want[i] = "\n\n".join(body)
    # frames: a named element around the article, comments that are articles themselves, a page that is nothing else
    a, b, c = (sentence(r) for _ in range(3))
    rows += [(50, "http://f.example/", f"<body><div class='sidebar-left'><main><p>{a}</p></main></div></body>"), (51, "http://g.example/", f"<body><article><p>{a}</p></article><ol class='comment-list'><li><article><p>{b} {c} {b} {c}</p></article></ol></body>"), (52, "http://i.example/", f"<body><div class='widget sidebar'><p>{b}</p></div></body>"), (53, "http://j.example/", f"<body><div class='comments'><p>{c}</p></div></body>")]
    want |= {50: a, 51: a, 52: b, 53: c}
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v for k, v in got.items() if v != want[k]} == {}


def test_rows_are_judged_by_their_own_text(spark):
    item = "the quick onyx goblin jumps over the lazy dwarf near the old mill at noon"
    bad, clean = f"before {item} after", "nothing of the kind is said in here at all"
    rows = [(None, bad), (None, clean), (1, clean), (2, bad), (2, clean), (3, None), (None, None), (4, ""), (2, bad), (None, clean)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _bad_a int, item_id string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = decontaminate.without_matches(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, (r for r in rows if r[1] != bad)))


def test_equal_edits_and_ties(spark):
    # two places of one item with as many edits: the first one's end; two items alike but for their ids: both
    item = "a sentence that is long enough to be found with edits in it"
    one, two = item.replace("long", "lung"), item.replace("found", "fuund")
    docs = spark.createDataFrame([(1, f"{one} and then {two}"), (2, f"{two} and then {one}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, item), (7, item)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.edits, r.end_at) for r in decontaminate.matches(docs, items).collect())
    assert got == [(d, i, 1, len(item)) for d in (1, 2) for i in (7, 8)]


def test_any_number_of_languages(spark):
    r = random.Random(10)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows, n = [], 0
    for k in range(40):
        words = ["".join(r.choice(letters) for _ in range(6)) for _ in range(30)]
        for _ in range(6):
            rows.append((n, " ".join(r.choice(words) for _ in range(80)), f"l{k:02}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for most in (language.MOST, 100, 3):  # six pieces, two, one for each
        model = language.learn(docs, pieces=8, piece=400, most=most)
        assert len(model) == 40 and (most > 100 or all(len(v) <= 2 * 401 for v in model.values()))
        got = language.classify(docs, model)
        right = got.join(docs.withColumnRenamed("lang", "own"), "doc_id").where("best = own").count()
        assert right >= 0.95 * len(rows)


def all_rules(labelled, tokens, support, confidence):
    """The best verdict for a set of tokens, by trying every set of them against every labelled row, as a plain definition has it."""
    best = None
    for n in range(1, len(tokens) + 1):
        for some in itertools.combinations(sorted(tokens), n):
            have = [v for t, v in labelled if set(some) <= t]
            for v in sorted(set(have)):
                if have.count(v) >= support * len(labelled) and have.count(v) / len(have) >= confidence:
                    rank = (-have.count(v) / len(have), -have.count(v), n, some)
                    best = min(best or (rank, v), (rank, v))
    return best[1] if best else urls.DEFAULT


def test_mined_rules_are_the_best_of_all(spark):
    # rules of one token, and of two that tell only together
    r, rows = random.Random(12), []
    for i in range(400):
        t = {x for x in "abcdef" if r.random() < 0.4}
        both = {"a", "b"} <= t
        rows.append((t, "block" if (both and r.random() < 0.95) or "f" in t or r.random() < 0.25 else "allow"))
    labelled = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, verdict string")
    rules = urls.mine(labelled, 0.01, 0.8).collect()
    got = 0
    for n in range(1, 5):
        for some in itertools.combinations("abcdef", n):
            fit = [((-x.confidence, -x.support, len(x.tokens), x.tokens), x.verdict) for x in rules if set(x.tokens) <= set(some)]
            got += (min(fit)[1] if fit else urls.DEFAULT) == all_rules(rows, some, 0.01, 0.8)
    assert got >= 0.95 * 56  # sets that improve on no pair by IMPROVEMENT aren't mined


def test_sets_that_tell_only_in_threes_are_found(spark):
    # the verdict is the parity of three tokens: none and no pair of them tells anything
    rows = [({x for j, x in enumerate("abc") if i >> j & 1} | ({"d"} if i % 5 == 0 else set()), "block" if (i & 7).bit_count() % 2 else "allow") for i in range(400)]
    labelled = spark.createDataFrame([(sorted(t), v) for t, v in rows], "tokens array<string>, verdict string")
    asked = [some for n in range(1, 5) for some in itertools.combinations("abcd", n)]
    rules = urls.mine(labelled, 0.01, 0.8, sets=spark.createDataFrame([(list(x),) for x in asked], "t array<string>")).collect()
    assert len({(tuple(x.tokens), x.verdict) for x in rules}) == len(rules)
    assert [(x.verdict, x.confidence, x.support) for x in rules if x.tokens == ["a", "b", "c"]] == [("block", 1.0, 0.125)]
    for some in asked:
        fit = [((-x.confidence, -x.support, len(x.tokens), x.tokens), x.verdict) for x in rules if set(x.tokens) <= set(some)]
        assert (min(fit)[1] if fit else urls.DEFAULT) == all_rules(rows, some, 0.01, 0.8)
    assert any(x.tokens == ["a", "b", "c"] for x in urls.mine(labelled, 0.01, 0.8).collect())  # as a labelled row has them


@pytest.mark.parametrize("most", [0, 14])
def test_the_search_for_sets_is_exact(monkeypatch, most):
    monkeypatch.setattr(urls, "LISTED", most)  # 0: by branch and bound alone
    r = random.Random(3)
    for _ in range(150):
        k, tell = r.randrange(2, 8), r.random()
        rows = []
        for _ in range(r.randrange(5, 60)):
            t = {x for x in "abcdefg"[:k] if r.random() < 0.7}
            rows.append((t, "block" if (len(t) % 2 and r.random() < tell) or r.random() < 0.2 else "allow"))
        support, confidence = r.choice([0.01, 0.1, 0.3]), r.choice([0.4, 0.8, 1.0])
        want = None
        for n in range(1, k + 1):
            for some in itertools.combinations("abcdefg"[:k], n):
                have = [v for t, v in rows if set(some) <= t]
                for v in set(have):
                    if have.count(v) >= support * len(rows) and have.count(v) / len(have) >= confidence:
                        new = ((-have.count(v) / len(have), -have.count(v), n, list(some)), v, have.count(v), len(have))
                        want = min(want or new, new)
        got = urls.best_set(list("abcdefg"[:k]), [(sorted(t), v, 1) for t, v in rows if t], support * len(rows), confidence)
        assert got == (want and (want[0][3], *want[1:]))


@pytest.mark.parametrize("noise", [0, 0.1, 0.5])
def test_the_search_for_sets_ends_on_templates(noise):
    # each row lacks another one of 40 tokens, and by which one it lacks has its verdict
    r, names = random.Random(5), [f"t{i:02}" for i in range(40)]
    rows = [([t for t in names if t != names[i % 40]], "allow" if (i % 2 == 0) ^ (r.random() < noise) else "block", 1) for i in range(800)]
    began = time.time()
    rule = urls.best_set(names, rows, 8, 0.8)
    assert time.time() - began < 20
    assert noise or rule == (names[::2], "block", 400, 400)  # as many allow without the others; the first in order stays
    assert noise == 0.5 or rule[2] / rule[3] >= 0.8


@pytest.mark.parametrize("mixed", [False, True])
def test_tokens_that_nearly_go_together(spark, mixed):
    # each url lacks another one of k segments; with `mixed` both verdicts have them, and the last segment tells
    def made(k):
        out = []
        for i in range(11 * k):
            parts = [f"part{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(k) if j != i % k]
            good = i // k % 2 == 0 or not mixed
            out.append(f"http://example.{'net/en' if good else 'com/de'}/{'/'.join(parts)}/{'fine' if good else 'foul'}")
        return out

    for k in (10, 40):
        labelled = made(k)
        asked = [f"http://x.info/partaa/partab/{'foul' if mixed else 'other'}", "http://x.info/partac/fine", "http://x.info/none"]
        df = spark.createDataFrame(list(enumerate(labelled + asked)), "page_id long, url string")
        began = time.time()
        got = {x.page_id: x.verdict for x in urls.judge(df).collect()}
        assert time.time() - began < 60
        assert [got[len(labelled) + i] for i in range(3)] == ["block" if mixed else "allow", "allow", urls.DEFAULT]


def plain_score(net, text):
    """The score of a text by loops over windows, tokens and numbers, from the definition of the network alone."""
    mask = (1 << 64) - 1
    word_of, gram_of = {w: i for i, w in enumerate(net.inputs.words)}, {int(g): i for i, g in enumerate(net.inputs.grams)}
    w = {k: np.asarray(v, float) for k, v in net.w.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))

    def vector(token):
        out = w["word"][word_of[token]].copy() if token in word_of else np.zeros(toxicity.DIM)
        marked = [2, *map(ord, token), 3]
        for n in (3, 4, 5):
            for a in range(len(marked) - n + 1):
                h = marked[a]
                for c in marked[a + 1 : a + n]:
                    h = (h * 0x9E3779B97F4A7C15 + c) & mask
                g = (h * 0xD6E8FEB86659FD93 + n) & mask
                g ^= g >> 32
                if g in gram_of:
                    out += w["gram"][gram_of[g]]
        return out

    def states(xs, d):
        h, out = [0.0] * toxicity.HIDDEN, []
        for x in xs:
            p, new = x @ w["W" + d] + w["b" + d], []
            g = [sum(h[k] * w["U" + d][k][j] for k in range(toxicity.HIDDEN)) for j in range(3 * toxicity.HIDDEN)]
            for j in range(toxicity.HIDDEN):
                z, r = sigmoid(p[j] + g[j]), sigmoid(p[toxicity.HIDDEN + j] + g[toxicity.HIDDEN + j])
                c = math.tanh(p[2 * toxicity.HIDDEN + j] + r * g[2 * toxicity.HIDDEN + j])
                new.append(z * h[j] + (1 - z) * c)
            h = new
            out.append(h)
        return out

    def logit(window):
        xs = [vector(t) for t in window] + [np.zeros(toxicity.DIM)] * (toxicity.WINDOW - len(window))
        both = [f + b for f, b in zip(states(xs, "f"), states(xs[::-1], "b")[::-1])]
        e = [math.exp(sum(a * b for a, b in zip(s, w["v"]))) for s in both[: len(window)]]
        return sum(x / sum(e) * sum(a * b for a, b in zip(s, w["o"])) for x, s in zip(e, both)) + w["ob"][0]

    tokens, step = re.findall(r"\w+", text.lower()), toxicity.WINDOW // 2
    starts = range(0, max(1, len(tokens) - step), step) if tokens else []
    top = max((logit(tokens[a : a + toxicity.WINDOW]) for a in starts), default=-20.0)
    return sigmoid(net.scale[0] * top + net.scale[1])


def test_toxicity_scores_are_those_of_plain_loops(spark):
    r = random.Random(13)
    texts = [" ".join(r.choice(WORDS) + ("" if r.random() < 0.8 else "s") for _ in range(r.randint(1, 90))) for _ in range(60)]
    labels = [int(i % 3 == 0) for i in range(60)]
    texts = [t + (" you grobnak " + r.choice(WORDS) if y else "") for t, y in zip(texts, labels)]
    net = toxicity.fit(texts, labels)
    assert len(net.inputs.words) and len(net.inputs.grams)
    odd = [*texts[:25], "", "   ", "grobnaks", "Zürich GROBNAK!! " * 20, "x" * 300, "one two three", " ".join(["word"] * 24), " ".join(["word"] * 25), " ".join(["grobnak"] * 36 + ["end"]), None]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {x.doc_id: x.score for x in toxicity.score(df, net).collect()}
    assert {i: got[i] for i, t in enumerate(odd)} == {i: pytest.approx(plain_score(net, t or ""), abs=2e-4) for i, t in enumerate(odd)}
