"""Rule and classification queries: dirty text made from keys, whose clean value SQL knows from the key."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators.classify import AMOUNTS, classify, constraint_violations, split_by_status
from ..sources import orders as S
from . import catalog as C
from .adapter import dirty_orders, spread, table
from .scratch import scratch



def _k():
    return F.col("o_orderkey")


ARABIC = functools.partial(lambda x: F.translate(x.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩"))


def _of(**cols):
    return lambda s, d: table(s, d, "orders").select("o_orderkey", *(v().alias(k) for k, v in cols.items()))


def _pick(values, *more):
    """The value that the key picks."""
    return F.element_at(F.array(*map(F.lit, values)), (_k() % len(values) + 1).cast("int"))


def _case(values):
    return f"CASE o_orderkey % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


NUMBERS = lambda: F.when(_k() % 6 == 0, F.concat(ARABIC(_k()), F.lit(" ريال يمني"))).when(_k() % 6 == 1, F.concat(F.lit("USD "), _k().cast("string"))).when(_k() % 6 == 2, F.concat(F.format_number(_k(), 0), F.lit("٫٥"))).when(_k() % 6 == 3, "NaN").when(_k() % 6 == 4, " ").otherwise(F.concat(F.lit("-"), _k().cast("string"), F.lit("$")))
PHONES = lambda: F.concat(_pick(["+967 7", "009677", "09677"[2:] + "", "07", "7"]), F.lpad((_k() % 100000000).cast("string"), 8, "0"))
EMAILS = lambda: F.concat(F.lit("u"), _k().cast("string"), _pick(["@@gamil.com.", "@yahoo..co", "@Outlok.com", "@ex.org", "@nodot", " x@a.b"]))
DAY = lambda: F.date_add(F.lit("2000-01-01").cast("date"), (_k() % 9000).cast("int"))


#: Layouts of the day (21:05:06) that the key picks, and what SQL makes of the day: 'd' its ISO text, 'x' nothing, 'm' the text with day and month swapped where
#: both may be months, else what follows the ISO text.
DATE_KINDS = (
    ("yyyy-MM-dd", "d"), ("d/M/yyyy", "d"), ("dd.MM.yyyy", "d"), ("epoch", "d"), ("d MMM yyyy 10:11:12", "d"), ("31/02/yyyy", "x"), ("yyyy-MM-dd'T'01:02:03", "T01:02:03"),
    ("MMM d, yyyy", "d"), ("d/M/yy", "d"), ("yyyy-MM-dd h:mm a", "d"), ("EEEE d MMMM yyyy", "d"), ("d-MMM-yyyy", "d"), ("d.M.yyyy H:mm", "d"), ("yyyy-MM-dd HH:mm:ss'.5'", "d"),
    ("yyyy-MM-dd'T'HH:mm:ss'+03:00'", "T21:05:06+03:00"), ("M/d/yyyy", "m"), ("yyyy/dd/MM", "m"), ("EEE, d MMM yyyy HH:mm:ss 'GMT'", "d"), ("d'th of' MMMM yyyy 'at 9pm'", "d"), ("MMMM d yyyy", "d"),
    ("d MMM yy", "d"), ("yyyy MMM d", "d"), ("dMMMyyyy", "d"), ("yyyy-MM-dd'T'HH:mm'Z'", "T21:05:00+00:00"), ("yyyy-MM-dd'T'HH:mm:ss'.123456-0530'", "T21:05:06.123456-05:30"),
    ("d/M/yyyy HH:mm:ss '+03:00'", "d"), ("'12 am' d MMM yyyy", "d"), ("yyyy-MM-dd '25:00'", "x"), ("MMM yyyy", "x"), ("yyyy-d-MMM", "d"), ("d MMM ''yy", "d"),
)
DATE_SQL = "CASE o_orderkey % 31 " + " ".join(
    f"WHEN {i} THEN " + {"d": "iso", "x": "NULL", "m": "CASE WHEN day(day) > 12 THEN iso ELSE strftime(make_date(year(day), day(day), month(day)), '%Y-%m-%d') END"}.get(kind, f"iso || '{kind}'") for i, (_, kind) in enumerate(DATE_KINDS)
) + " END"


def _dates():
    at, out = DAY().cast("timestamp_ntz") + F.expr("interval '21:05:06' hour to second"), None
    for i, (layout, _) in enumerate(DATE_KINDS):
        text = (F.unix_date(DAY()).cast("long") * 86400).cast("string") if layout == "epoch" else F.date_format(at, layout)
        out = F.when(_k() % len(DATE_KINDS) == i, text) if out is None else out.when(_k() % len(DATE_KINDS) == i, text)
    return out


def _items(s, d):
    fractions = F.concat(F.lit('[{"sku":"c","qty":"0.'), F.lpad((_k() % 8 * 125).cast("string"), 3, "0"), F.lit('","unit_price":"'), (_k() % 50).cast("string"), F.lit('.015","size":{"w":'), (_k() % 3).cast("string"), F.lit('}}]'))
    text = (
        F.when(_k() % 7 == 6, fractions).when(_k() % 5 == 0, "[]").when(_k() % 5 == 1, '{"sku":"a"}').when(_k() % 5 == 2, F.concat(F.lit('[{"sku":"a","qty":"'), ARABIC(_k() % 9), F.lit('","unit_price":'), (_k() % 50).cast("string"), F.lit('},{"sku":"b","qty":2,"unit_price":"1.50"}]')))
        .when(_k() % 5 == 3, '[{"sku":"a","qty":"-1","unit_price":3},{"sku":"b","qty":"?","unit_price":3},{"x":1}]').otherwise("[{")
    )
    p = table(s, d, "orders").select("o_orderkey", R.parse_items(text, F.lit(1).cast(R.MONEY)).alias("p"))
    first = F.element_at("p.items", 1)
    return p.select("o_orderkey", F.col("p.total").cast("double").alias("total"), F.array_join("p.errors", ",").alias("errors"), F.coalesce(F.size("p.items"), F.lit(-1)).alias("n"), first["qty"].cast("double").alias("qty"), first["other"].alias("other"))


def _keys(s, d):
    order = F.when(_k() % 5 == 0, "").otherwise(F.concat(F.lit("طلب "), (_k() + 100000).cast("string")))
    customer = F.when(_k() % 4 == 0, "").otherwise(F.concat(F.lit("c-00"), (_k() % 977).cast("string")))
    return table(s, d, "orders").select("o_orderkey", R.infer_keys(order, customer).alias("k")).select("o_orderkey", "k.order_id", "k.customer_id")


def _text(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(R.clean_text(F.col("text"))).alias("clean"))


def classified(s, d, only=None):
    return classify(dirty_orders(s, d), only=only)


# what dirty_orders must become, by key arithmetic
BAD = """e AS (SELECT o_orderkey k, o_custkey c, o_orderdate d, o_orderkey % 5 + 1 AS q, o_orderkey % 100 + 10 AS p,
 CAST(o_orderkey % 11 = 0 AND o_orderkey % 13 = 0 AS INT) m1, CAST(o_orderkey % 19 = 0 AS INT) mail, CAST(o_orderkey % 17 = 0 AS INT) dat,
 CAST(o_orderkey % 31 = 0 AS INT) emp, CAST(o_orderkey % 31 <> 0 AND o_orderkey % 37 = 0 AS INT) cor, CAST(o_orderkey % 29 = 0 AND o_orderkey % 31 <> 0 AND o_orderkey % 37 <> 0 AS INT) neg FROM orders),
 b AS (SELECT *, 2 * m1 + mail + dat + emp + cor + 2 * neg AS n FROM e)"""
CODES = [("MISSING_ORDER_ID", "m1"), ("MISSING_CUSTOMER_ID", "m1"), ("INVALID_EMAIL", "mail"), ("INVALID_IMPOSSIBLE_DATE", "dat"), ("EMPTY_ITEMS", "emp"), ("CORRUPTED_ITEMS_JSON", "cor"), ("AMBIGUOUS_NEGATIVE_VALUE", "neg"), ("AMBIGUOUS_NEGATIVE_VALUE", "neg"), ("MULTIPLE_CONFLICTING_ERRORS", "CAST(n > 1 AS INT)")]
ERRORS = " UNION ALL ".join(f"SELECT k source_row_number, '{code}' error_code FROM b WHERE {flag} = 1" for code, flag in CODES)


def _status(s, d):
    c = classified(s, d, ("quality_status", "total_amount", "order_id", "order_date", "error_codes"))
    good = F.when(F.col("quality_status") != "quarantined", F.col("total_amount")).cast("double")
    return c.select("source_row_number", "quality_status", good.alias("total"), F.when(F.col("quality_status") != "quarantined", F.col("order_id")).alias("order_id"), F.when(F.col("quality_status") != "quarantined", F.col("order_date")).alias("order_date"), F.size("error_codes").alias("errors"))


def _errors(s, d):
    return classified(s, d, ("error_codes",)).select("source_row_number", F.explode("error_codes").alias("error_code"))


def _corrections(s, d):
    x = classified(s, d, ("corrections",)).select("source_row_number", F.explode("corrections").alias("c"))
    return x.where("c.rule_code in ('PHONE_REMOVE_SPACES_AND_COUNTRY_CODE', 'CURRENCY_TO_YER', 'STANDARDIZE_ORDER_ID', 'INFER_CUSTOMER_ID_FROM_ORDER_ID')").select("source_row_number", "c.field", "c.original_value", "c.corrected_value", "c.rule_code")


def _csv(s, d):
    """Dirty orders written as CSV, read back with lineage, kept raw and read again by run."""
    at = scratch(s, "csv")
    dirty_orders(s, d).drop("source_row_number").write.option("header", True).option("escape", '"').csv(f"{at}/in")
    raw = S.stamp_lineage(S.read_orders_csv(s, f"{at}/in"), "r1")
    S.append_raw(raw.drop("_corrupt"), f"{at}/raw")
    back = S.read_raw(s, f"{at}/raw", "r1")
    c = classify(back, only=("quality_status", "raw_record"))
    return c.groupBy("quality_status").agg(F.count("*").alias("count"), F.count("raw_record").alias("raw"))


def _violations(s, d):
    c = table(s, d, "orders").select("o_orderkey", F.when(_k() % 3 == 0, "").otherwise(_k().cast("string")).alias("order_id"), F.when(_k() % 5 == 0, F.lit(None)).otherwise("c").alias("customer_id"), F.when(_k() % 7 == 0, "odd").otherwise("valid").alias("quality_status"), F.when(_k() % 9 == 0, "12").alias("total_amount"))
    return constraint_violations(c).select("o_orderkey", "violation")


def _runs(s, d):
    runs = table(s, d, "events").groupBy((F.col("user_id") % 20).cast("string").alias("run_id"), F.col("event_type").alias("error_code")).agg(F.count("*").alias("count"))
    return C.max_error_counts(runs)


def _generated(s, d):
    """An order generated for each order key, classified. Of the generated errors a missing order id is inferred from the customer's,
    and a missing customer id from an order number of 100000 or more."""
    ids = table(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    return classify(spread(S.generate_orders(ids)), only=("quality_status",)).groupBy("quality_status").agg(F.count("*").alias("count"))


def _drawn(what, most):
    """SQL of what generate_orders draws for an order key."""
    n = S.DRAWS.index(what)
    return f"((o_orderkey % 1000003) * {7919 + 2 * n} + {(n + 1) * 104_729 * 42}) % 1000003 % {most}"


def _split(s, d):
    at = scratch(s, "split")
    classified(s, d, ("quality_status",)).write.parquet(at)  # classified once, read twice
    good, bad = split_by_status(s.read.parquet(at))
    return good.select("source_row_number", F.lit("validated").alias("part")).unionByName(bad.select("source_row_number", F.lit("quarantine").alias("part")))


def _negatives(s, d):
    """Amounts of the orders whose total had a wrong sign that was put right."""
    x = classified(s, d, ("quality_status", "corrections", *AMOUNTS)).where("quality_status != 'quarantined'").where(F.exists("corrections", lambda c: c["rule_code"] == "NEGATIVE_SIGN_TYPO_REPAIR"))
    return x.select("source_row_number", F.col("delivery_cost").cast("double").alias("delivery_cost"), F.col("payment_amount").cast("double").alias("payment_amount"), F.col("total_amount").cast("double").alias("total_amount"))


OK = "n = 0"
TOTAL = "CAST(q * p + CASE WHEN k % 3 = 0 THEN 1000 ELSE 1500 END AS DOUBLE)"
CITIES = ["صنعا", "الحديده", "اب", " عدن ", "x"]
CLEAN_CITIES = ["صنعاء", "الحديدة", "إب", "عدن", "x"]
WORDS = ["خمسة آلاف", "ألفين", "عشره الاف", "كثير"]
CURRENCIES = ["usd", " $", "سعودي", "ريال", "YER", "eur"]
NAMES = ["Dr. A", "السيد / ب", "Prof. X Y", "plain"]
SYN = ["cash", "Delivered", "خالص", "express", "نقدًا عند التسليم", "zzz"]
Q = {
    "rule_digits": (_of(digits=lambda: R.normalize_digits(F.concat(ARABIC(_k()), F.translate(_k().cast("string"), "0123456789", "۰۱۲۳۴۵۶۷۸۹")))), "SELECT o_orderkey, o_orderkey || '' || o_orderkey AS digits FROM orders"),
    "rule_text_clean": (_text, r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(trim(text, E' \n\t\r'), '[^\p{L}\p{N}_\s\-.,/@+()]', '', 'g'), '\s+', ' ', 'g'))) AS clean FROM documents"),
    "rule_city_dictionary": (_of(city=lambda: R.clean_city(_pick(CITIES))), f"SELECT o_orderkey, {_case(CLEAN_CITIES)} city FROM orders"),
    "rule_name_titles": (_of(name=lambda: R.clean_name(_pick(NAMES))), f"SELECT o_orderkey, {_case(['A', '/ ب', 'X Y', 'plain'])} AS name FROM orders"),
    "rule_number_parse": (_of(amount=lambda: R.parse_number(NUMBERS()).cast("double")), "SELECT o_orderkey, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey WHEN 2 THEN o_orderkey + 0.5 WHEN 5 THEN -o_orderkey END AS DOUBLE) amount FROM orders"),
    "rule_price_words": (_of(amount=lambda: R.parse_number(_pick(WORDS)).cast("double")), "SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN 5000 WHEN 1 THEN 2000 WHEN 2 THEN 10000 END AS DOUBLE) amount FROM orders"),
    "rule_currency": (_of(code=lambda: R.currency_code(_pick(CURRENCIES)), rate=lambda: R.currency_rate(_pick(CURRENCIES)).cast("double")), f"SELECT o_orderkey, {_case(['YER', 'YER', 'YER', 'YER', 'YER', 'EUR'])} code, CAST(CASE o_orderkey % 6 WHEN 0 THEN 530 WHEN 1 THEN 530 WHEN 2 THEN 140 ELSE 1 END AS DOUBLE) rate FROM orders"),
    "rule_phone": (_of(phone=lambda: R.normalize_phone(PHONES())), "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 2 THEN '677' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') ELSE '7' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') END phone FROM orders"),
    "rule_email": (_of(email=lambda: R.repair_email(EMAILS()), valid=lambda: R.is_valid_email(R.repair_email(EMAILS()))), f"SELECT o_orderkey, 'u' || o_orderkey || {_case(['@gmail.com', '@yahoo.com', '@outlook.com', '@ex.org', '@nodot', ' x@a.b'])} email, o_orderkey % 6 < 4 AS valid FROM orders"),
    "rule_date": (_of(day=lambda: R.normalize_date(_dates())), f"SELECT o_orderkey, {DATE_SQL} AS day FROM (SELECT o_orderkey, DATE '2000-01-01' + CAST(o_orderkey % 9000 AS INT) AS day, strftime(DATE '2000-01-01' + CAST(o_orderkey % 9000 AS INT), '%Y-%m-%d') iso FROM orders)"),
    "rule_items_json": (_items, """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 6 THEN CAST(round(CAST(o_orderkey % 8 * 125 * (o_orderkey % 50 * 1000 + 15) AS DECIMAL(18,0)) * CAST(0.000001 AS DECIMAL(7,6)), 2) AS DOUBLE) WHEN o_orderkey % 5 = 2 THEN CAST((o_orderkey % 9) * (o_orderkey % 50) + 3 AS DOUBLE) END total,
 CASE WHEN o_orderkey % 7 = 6 THEN '' ELSE CASE o_orderkey % 5 WHEN 0 THEN 'EMPTY_ITEMS' WHEN 2 THEN '' WHEN 3 THEN 'AMBIGUOUS_NEGATIVE_VALUE,UNKNOWN_PRICE,UNKNOWN_PRICE' ELSE 'CORRUPTED_ITEMS_JSON' END END errors,
 CAST(CASE WHEN o_orderkey % 7 = 6 THEN 1 WHEN o_orderkey % 5 = 2 THEN 2 ELSE -1 END AS INT) n, CAST(CASE WHEN o_orderkey % 7 = 6 THEN o_orderkey % 8 * 0.125 WHEN o_orderkey % 5 = 2 THEN o_orderkey % 9 END AS DOUBLE) qty,
 CASE WHEN o_orderkey % 7 = 6 THEN '{"size":"{\\"w\\":' || o_orderkey % 3 || '}"}' END other FROM orders"""),
    "rule_business_keys": (_keys, "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'طلب-' || (o_orderkey + 100000) WHEN o_orderkey % 4 <> 0 THEN 'طلب-' || (o_orderkey % 977 + 100000) ELSE '' END order_id, CASE WHEN o_orderkey % 4 <> 0 THEN 'عميل-' || (o_orderkey % 977) WHEN o_orderkey % 5 <> 0 THEN 'عميل-' || o_orderkey ELSE '' END customer_id FROM orders"),
    "rule_dictionary": (_of(value=lambda: R.synonym(R.clean_text(_pick(SYN)), _pick(SYN))), f"SELECT o_orderkey, {_case(['نقدًا عند التسليم', 'تم التسليم', 'تم الدفع', 'سريع', 'نقدًا عند التسليم', 'zzz'])} AS value FROM orders"),
    "rule_totals": (lambda s, d: classified(s, d, ("quality_status", "total_amount", "delivery_cost")).where("quality_status != 'quarantined'").select("source_row_number", F.col("total_amount").cast("double").alias("total_amount"), F.col("delivery_cost").cast("double").alias("delivery_cost")), f"WITH {BAD} SELECT k source_row_number, {TOTAL} total_amount, CAST(CASE WHEN k % 3 = 0 THEN 1000 ELSE 1500 END AS DOUBLE) delivery_cost FROM b WHERE {OK}"),
    "rule_negatives": (_negatives, f"WITH {BAD} SELECT k source_row_number, CAST(CASE WHEN k % 3 = 0 THEN 1000 ELSE 1500 END AS DOUBLE) delivery_cost, CAST(CASE WHEN k % 3 = 0 THEN q * p ELSE q * p + 1500 END AS DOUBLE) payment_amount, {TOTAL} total_amount FROM b WHERE {OK} AND k % 23 = 0 AND k % 29 <> 0"),
    "classify_orders": (_status, f"WITH {BAD} SELECT k source_row_number, CASE WHEN n > 0 THEN 'quarantined' ELSE 'corrected' END quality_status, CASE WHEN n = 0 THEN {TOTAL} END total, CASE WHEN n = 0 THEN 'طلب-' || CASE WHEN k % 11 = 0 THEN c + 100000 ELSE k + 200000 END END order_id, CASE WHEN n = 0 THEN strftime(d, '%Y-%m-%d') END order_date, CAST(n + CAST(n > 1 AS INT) AS INT) errors FROM b"),
    "classify_errors": (_errors, f"WITH {BAD} {ERRORS}"),
    "classify_corrections": (_corrections, f"""WITH {BAD} SELECT k source_row_number, 'customer_phone' field, '+967 7' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') original_value, '7' || lpad(CAST(k % 100000000 AS VARCHAR), 8, '0') corrected_value, 'PHONE_REMOVE_SPACES_AND_COUNTRY_CODE' rule_code FROM b
 UNION ALL SELECT k, 'currency', 'ريال يمني', 'YER', 'CURRENCY_TO_YER' FROM b UNION ALL SELECT k, 'order_id', 'طلب ' || (k + 200000), 'طلب-' || (k + 200000), 'STANDARDIZE_ORDER_ID' FROM b WHERE k % 11 <> 0
 UNION ALL SELECT k, 'customer_id', '', 'عميل-' || (k + 100000), 'INFER_CUSTOMER_ID_FROM_ORDER_ID' FROM b WHERE k % 13 = 0 AND k % 11 <> 0"""),
    "quality_error_counts": (lambda s, d: C.error_counts(classified(s, d, ("error_codes",))), f"WITH {BAD}, x AS ({ERRORS}) SELECT error_code, count(*) AS count FROM x GROUP BY 1"),
    "quality_status_counts": (lambda s, d: C.status_counts(classified(s, d, ("quality_status",))), f"WITH {BAD} SELECT CASE WHEN n > 0 THEN 'quarantined' ELSE 'corrected' END quality_status, count(*) AS count FROM b GROUP BY 1"),
    "run_metrics": (lambda s, d: C.run_metrics(classified(s, d, ("quality_status",))), f"WITH {BAD} SELECT count(*) raw, CAST(0 AS BIGINT) valid, count(*) FILTER (WHERE n = 0) corrected, count(*) FILTER (WHERE n > 0) quarantined, true AS consistent FROM b"),
    "run_summary": (lambda s, d: C.run_summary(classified(s, d, ("quality_status",))), f"WITH {BAD} SELECT count(*) raw_loaded, count(*) FILTER (WHERE n > 0) quarantine_count FROM b"),
    "split_by_status": (_split, f"WITH {BAD} SELECT k source_row_number, CASE WHEN n > 0 THEN 'quarantine' ELSE 'validated' END part FROM b"),
    "constraint_violations": (_violations, "SELECT o_orderkey, 'order_id is required' violation FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'customer_id is required' FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_orderkey, 'unknown quality_status' FROM orders WHERE o_orderkey % 7 = 0 UNION ALL SELECT o_orderkey, 'total_amount must be a number' FROM orders WHERE o_orderkey % 9 = 0"),
    "max_error_counts": (_runs, "SELECT error_code, max(n) AS count FROM (SELECT user_id % 20 r, event_type error_code, count(*) n FROM events GROUP BY 1, 2) GROUP BY 1"),
    "csv_scan_roundtrip": (_csv, f"WITH {BAD} SELECT CASE WHEN n > 0 THEN 'quarantined' ELSE 'corrected' END quality_status, count(*) AS count, count(*) AS raw FROM b GROUP BY 1"),
    "generated_orders": (_generated, f"SELECT CASE WHEN {_drawn('share', 100)} >= 90 AND ({_drawn('error', 5)} < 3 OR ({_drawn('error', 5)} = 4 AND o_orderkey < 100000)) THEN 'quarantined' ELSE 'corrected' END quality_status, count(*) AS count FROM orders GROUP BY 1"),
}
