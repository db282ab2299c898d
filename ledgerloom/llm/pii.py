"""Format-preserving pseudonyms of personal data by keyed Feistel networks, in DataFrame operations only.

Found are e-mail addresses, telephone numbers, payment card numbers (with a valid check digit), social security
numbers, IPv4 addresses, calendar dates and hexadecimal secrets. Each valid value is permuted within its own format:
the permutation depends on the key and the format alone, so that equal values get equal pseudonyms in all documents
and different values different ones. Round functions are SHA-256 of key, format, round and the other half.

Characters permute within their kind (digit, lower-case letter, capital) with all other characters in place; card
numbers keep a valid check digit; social security numbers, addresses and dates (of the 400 years from 1800) are
numbered, and the number is permuted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import apart, table

KEY = "ledgerloom"  #: who knows the key can undo the pseudonyms: set KEY_SETTING to a secret one
KEY_SETTING = "spark.ledgerloom.pseudonymKey"
ROUNDS = 8

_EDGE, _END = r"(?<![\p{L}\p{N}@])(?<![\p{N}][.\-/])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KINDS = {
    # at most 126 labels, as a domain of 253 characters can have: an unbounded group is matched by recursion
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}+\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?)(?:\([0-9]{2,4}\)[ .\-]?|[0-9]{2,4}[ .\-])[0-9]{3,4}[ .\-]?[0-9]{4}" + _END + r"|(?<![\p{L}\p{N}])\([0-9]{3}\) ?[0-9]{3}[.\-][0-9]{4}" + _END + "|" + _EDGE + r"[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}" + _END,
    "ip": _EDGE + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}])(?!\.[0-9])",
    "iso_date": _EDGE + r"(?:1[89]|2[01])[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])" + r"(?!\p{N})(?!-[0-9])",
    "day_date": _EDGE + r"(?:0[1-9]|[12][0-9]|3[01])([/.])(?:0[1-9]|1[0-2])\1(?:1[89]|2[01])[0-9]{2}" + _END,
    "ssn": _EDGE + r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}" + r"(?![\p{L}\p{N}])(?!-[0-9])",
    "card": _EDGE + r"[0-9](?:[ \-]?[0-9]){12,18}" + r"(?![\p{L}\p{N}])(?![.\-][0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Fa-f0-9]{0,127}[0-9])[A-Fa-f0-9]{32,128}(?![A-Za-z0-9])",
}
#: All kinds; the only group inside is renumbered by the name it has here.
ANY = "|".join(f"(?:{p})" for p in KINDS.values()).replace("([/.])", "(?<sep>[/.])").replace(r"\1", r"\k<sep>")

#: What every value of ANY contains; a text without it needs no dearer search.
SOME = r"@|[0-9][0-9 ().\-/]{6}|[A-Fa-f0-9]{32}"


def _number(hexadecimal: Column, most: int) -> Column:
    """15 hexadecimal digits as a number below most."""
    return F.pmod(F.conv(F.substring(hexadecimal, 1, 15), 16, 10).cast("long"), F.lit(most))


def feistel(a: Column, b: Column, most_a: int, most_b: int, key: str, kind: str) -> Column:
    """struct(a, b): a permutation of the pairs of numbers below most_a and most_b."""

    def step(s: Column, i: Column) -> Column:
        left = i % 2 == 0
        other = F.when(left, s["b"]).otherwise(s["a"])
        pad = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other.cast("string")), 256)
        new_a = F.when(left, F.pmod(s["a"] + _number(pad, most_a), F.lit(most_a))).otherwise(s["a"])
        new_b = F.when(left, s["b"]).otherwise(F.pmod(s["b"] + _number(pad, most_b), F.lit(most_b)))
        return F.struct(new_a.alias("a"), new_b.alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _code(c: Column) -> Column:
    return F.ascii(c)


def characters(value: Column, key: str, kind: str) -> Column:
    """value with digits, lower-case and upper-case ASCII letters permuted within their kind, by a Feistel network
    whose halves are the first and the second half of the characters; the round function adds to each character of
    one half a number that depends on the whole other half. Hexadecimal letters stay hexadecimal if kind is `secret`."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    letters = 6 if kind == "secret" else 26
    least = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65)
    wide = lambda c: F.when(c.between("0", "9"), 10).otherwise(letters)
    cells = F.transform(chars, lambda c: F.struct(c.alias("c"), F.coalesce(least(c), F.lit(-1)).alias("least"), wide(c).alias("wide")))
    half = F.floor(F.size(chars) / 2).cast("int")
    shape = F.array_join(F.transform(cells, lambda x: F.when(x["least"] == -1, x["c"]).when(x["least"] == 48, "0").when(x["least"] == 97, "a").otherwise("A")), "")

    # a pad of 8 hexadecimal digits for each character of a half: as many digests as that takes
    digests = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil((F.size(chars) - half) / 16).cast("int")))

    def step(s: Column, i: Column) -> Column:
        # even steps make the pad from one half, odd steps apply it to the other
        side = F.floor(i / 2) % 2
        text = F.array_join(F.transform(s["cells"], lambda x: x["c"]), "")
        other = F.when(side == 0, F.substring(text, half + 1, F.size(chars))).otherwise(F.substring(text, F.lit(1), half))
        made = F.array_join(F.transform(digests, lambda d: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), shape, i.cast("string"), d.cast("string"), other), 512)), "")

        def moved(x: Column, j: Column) -> Column:
            inside = F.when(side == 0, j < half).otherwise(j >= half) & (x["least"] >= 0)
            nth = F.when(side == 0, j).otherwise(j - half)
            by = F.conv(F.substring(s["pad"], nth * 8 + 1, F.lit(8)), 16, 10).cast("long")
            new = F.char((x["least"] + F.pmod(_code(x["c"]) - x["least"] + by, x["wide"])).cast("int"))
            return F.struct(F.when(inside, new).otherwise(x["c"]).alias("c"), x["least"].alias("least"), x["wide"].alias("wide"))

        even = i % 2 == 0
        cells_now = F.when(even, s["cells"]).otherwise(F.transform(s["cells"], moved))
        return F.struct(cells_now.alias("cells"), F.when(even, made).otherwise(s["pad"]).alias("pad"))

    start = F.struct(cells.alias("cells"), F.lit("").alias("pad"))
    done = F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), start, step)
    return F.array_join(F.transform(done["cells"], lambda x: x["c"]), "")


def check_sum(digits: Column) -> Column:
    """Sum of Luhn's formula over a string of digits, the last one not doubled."""
    n = F.length(digits)
    worth = lambda d, double: F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: worth(F.substring(digits, i, F.lit(1)).cast("int"), (n - i) % 2 == 1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def valid_card(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.when(F.length(digits).between(13, 19), (check_sum(digits) % 10 == 0) & ~digits.rlike("^(.)\\1*$")).otherwise(F.lit(False))


def card(value: Column, key: str) -> Column:
    """A card number with the digits before the last permuted and the check digit made valid again."""
    head = characters(F.regexp_replace(value, r"[0-9]$", ""), key, "card")
    digits = F.regexp_replace(head, "[^0-9]", "")
    return F.concat(head, F.pmod(-check_sum(F.concat(digits, F.lit("0"))), F.lit(10)).cast("string"))


def ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    pair = lambda i: F.element_at(octets, i) * 256 + F.element_at(octets, i + 1)
    p = feistel(pair(1), pair(3), 65536, 65536, key, "ip")
    return F.concat_ws(".", *(x.cast("string") for h in (p["a"], p["b"]) for x in (F.floor(h / 256), h % 256)))


def ssn(value: Column, key: str) -> Column:
    """Area (001 to 899 without 666), group (01 to 99) and serial (0001 to 9999) as one number."""
    part = lambda i, n: F.substring(value, i, n).cast("long")
    area = part(1, 3) - 1 - F.when(part(1, 3) > 666, 1).otherwise(0)
    p = feistel(area * 99 + part(5, 2) - 1, part(8, 4) - 1, 898 * 99, 9999, key, "ssn")
    new = F.floor(p["a"] / 99) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    return F.format_string("%03d-%02d-%04d", new, p["a"] % 99 + 1, p["b"] + 1)


_EPOCH = "1800-01-01"  #: 400 years from here are 146097 days, 189 times 773


def _day(day: Column, key: str) -> Column:
    n = F.datediff(day, F.lit(_EPOCH).cast("date"))
    p = feistel(F.floor(n / 773), n % 773, 189, 773, key, "date")
    return F.date_add(F.lit(_EPOCH).cast("date"), (p["a"] * 773 + p["b"]).cast("int"))


def iso_date(value: Column) -> Column:
    return F.try_to_date(value, "yyyy-MM-dd")


def day_date(value: Column) -> Column:
    return F.try_to_date(F.regexp_replace(value, "[.]", "/"), "dd/MM/yyyy")


def kind_of(value: Column) -> Column:
    """The kind of a value that ANY found, null if it isn't valid."""
    whole = {k: value.rlike(f"^(?:{p})$") for k, p in KINDS.items()}
    valid = {"card": valid_card(value), "iso_date": iso_date(value).isNotNull(), "day_date": day_date(value).isNotNull()}
    out = None
    for k, found in whole.items():
        ok = found & valid[k] if k in valid else found
        out = F.when(ok, F.lit(k)) if out is None else out.when(ok, F.lit(k))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of a kind (see KINDS); the value itself where kind is null."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    below = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    return (
        F.when(kind == "email", F.concat(characters(local, key, "email"), F.lit("@"), characters(below, key, "domain"), top))
        .when(kind == "phone", F.concat(F.regexp_extract(value, r"^(\+[0-9]{1,3}(?![0-9]))?", 0), characters(F.regexp_replace(value, r"^\+[0-9]{1,3}(?![0-9])", ""), key, "phone")))
        .when(kind == "ip", ip(value, key))
        .when(kind == "iso_date", F.date_format(_day(iso_date(value), key), "yyyy-MM-dd"))
        .when(kind == "day_date", F.date_format(_day(day_date(value), key), "dd/MM/yyyy"))
        .when(kind == "ssn", ssn(value, key))
        .when(kind == "card", card(value, key))
        .when(kind == "secret", characters(value, key, "secret"))
        .otherwise(value)
    )


def session_key(spark: SparkSession) -> str:
    """The session's secret key (KEY_SETTING); the public default where that isn't set."""
    return spark.conf.get(KEY_SETTING, KEY)


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """docs with text_col's valid personal values replaced by their pseudonyms, and pii, an array of
    struct(kind, value, pseudonym) in the order of the text.

    Numbers that aren't valid (card numbers with a wrong check digit, impossible dates, octets over 255) stay. Of a domain of over 126 labels, more than
    any that exists has, the first 126 are permuted and the rest stays. Local part and domain of an address are permuted apart; its last label
    stays. Null texts stay null with an empty array, empty ones empty. Texts may have any length. Rows may repeat; a column
    pii of docs is replaced, other columns pass untouched whatever their names.
    """
    text = F.col(text_col)
    v, k, f = apart(docs, "_values", "_kinds", "_found")
    values = F.when(text.rlike(SOME), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = docs.withColumn(v, values)
    kinds = F.transform(v, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value")))
    rows = rows.withColumn(k, kinds)
    found = F.transform(k, lambda x: F.struct(x["kind"].alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["kind"], key).alias("pseudonym")))
    rows = rows.withColumn(f, found)
    between = F.split(text, ANY, -1)
    put = F.zip_with(between, F.concat(F.transform(f, lambda x: x["pseudonym"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    rows = rows.withColumn(text_col, F.when(F.exists(f, lambda x: x["kind"].isNotNull()), F.array_join(put, "")).otherwise(text))
    kept = F.filter(f, lambda x: x["kind"].isNotNull())
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    return rows.withColumn("pii", F.coalesce(kept, none)).drop(v, k, f)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_values, kinds (each once, in order) of every document."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=session_key(spark))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("pii", lambda x: x["kind"]))), ",")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_values"), kinds.alias("kinds"))
