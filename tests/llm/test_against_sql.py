"""Queries of the training-data operators against their SQL, and language and personal data against plain versions."""

import random

import pytest

pytest.importorskip("ledgerloom.llm")
import oracle  # noqa: E402
import regex  # noqa: E402
import zstandard  # noqa: E402
from ledgerloom.llm import language, pii, registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_query(spark, name):
    oracle.compare(spark, oracle.connect(SF), registry.queries()[name], registry.oracle_sql()[name], SF)


def test_language_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.learn(docs)
    tools = {}
    for lang, content in model.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tools[lang] = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
    got = {r.doc_id: r.best for r in language.classify(docs, model).collect()}
    for r in docs.collect():
        text = regex.sub(r"[^\p{L}]+", " ", (r.text or "").lower()).encode()
        if not text.strip():
            assert got[r.doc_id] == "und"
            continue
        cuts = list(range(0, len(text), 1024))
        if len(cuts) > 1 and len(text) - cuts[-1] < 256:
            cuts.pop()
        chunks = [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]
        size = {lang: sum(len(c.compress(x)) for x in chunks) for lang, c in tools.items()}
        assert got[r.doc_id] == min(size, key=lambda x: (size[x], list(model).index(x)))


def test_pii_finds_exactly_what_was_planted(spark):
    r = random.Random(12)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))

    def check_digit(head):
        total = 0
        for i, d in enumerate(reversed(head)):
            d = int(d) * (2 if i % 2 == 0 else 1)
            total += d - 9 if d > 9 else d
        return str(-total % 10)

    def card(good):
        head = "4" + digits(14)
        last = check_digit(head)
        whole = head + (last if good else str((int(last) + 1) % 10))
        return r.choice([whole, " ".join(whole[i : i + 4] for i in (0, 4, 8, 12))])

    made = {
        "email": lambda: f"u{digits(3)}.x@{r.choice('abc')}{digits(2)}.example.org", "ip": lambda: ".".join(str(r.randrange(256)) for _ in range(4)), "phone": lambda: f"+1 ({digits(3)}) 555-{digits(4)}",
        "iso_date": lambda: f"20{r.randrange(10, 30)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", "day_date": lambda: f"{r.randrange(1, 29):02}/{r.randrange(1, 13):02}/19{digits(2)}",
        "ssn": lambda: f"{r.randrange(1, 600):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}", "card": lambda: card(True), "secret": lambda: "a1" + "".join(r.choice("0123456789abcdef") for _ in range(38)),
    }
    bad = [lambda: card(False), lambda: "2023-02-30", lambda: "31/04/1999", lambda: "300.1.2.3", lambda: "666-12-1234", lambda: "x@y", lambda: digits(9), lambda: "fedcba" * 6, lambda: "1.5 and 12-3"]
    data, planted = [], {}
    for i in range(300):
        parts, planted[i] = [], []
        for _ in range(r.randint(0, 9)):
            kind = r.choice([*made, None])
            value = made[kind]() if kind else r.choice(bad)()
            if kind:
                planted[i].append((kind, value))
            parts += [r.choice(["see", "von", "le 3e", "(n. 4)", "été:"]), r.choice(["{}", "<{}>", "({})", "{}, ", '"{}"']).format(value)]
        data.append((i, " ".join(parts)))
    for x in pii.pseudonymise(spark.createDataFrame(data, "doc_id long, text string")).collect():
        assert [(p.kind, p.value) for p in x.pii] == planted[x.doc_id]
        text, at = data[x.doc_id][1], 0
        for p in x.pii:  # what stands between the values is as it was
            k = text.index(p.value, at)
            at = k + len(p.value)
        rest, new = text, x.text
        for p in x.pii:
            a, b = rest.split(p.value, 1)
            assert new.startswith(a + p.pseudonym)
            rest, new = b, new[len(a) + len(p.pseudonym) :]
        assert rest == new
