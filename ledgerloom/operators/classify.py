"""Classification of raw orders: every rule in order, an audit trail of corrections, and valid, corrected or quarantined.

The rules run in groups; each group is a projection over the columns of the one before, so that no expression is
evaluated twice and none grows beyond what code generation takes.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..functions.dictionaries import PAID

FIELDS = ("order_id", "order_date", "status", "customer_id", "customer_name", "customer_phone", "customer_email", "city", "district", "delivery_type", "delivery_cost", "payment_method", "payment_status", "payment_amount", "currency", "total_amount", "items_json")
CLEANED = ("order_id", "customer_id", "customer_name", "city", "district", "delivery_type", "payment_method", "payment_status")
WORDS = ("status", "payment_status", "delivery_type", "payment_method")  #: fields that have synonyms
AMOUNTS = ("delivery_cost", "payment_amount", "total_amount")
#: What only turns text into a number.
CASTS = ("NUMBER_NORMALIZATION", "ITEMS_NUMERIC_NORMALIZATION")
DETAILS = {
    "MISSING_ORDER_ID": "Order id is missing and can't be inferred",
    "MISSING_CUSTOMER_ID": "Customer id is missing and can't be inferred",
    "DUPLICATE_ORDER_ID": "An earlier row of the run has the same order id",
    "SURPLUS_COLUMNS": "The row has more columns than its file's header",
    "INVALID_EMAIL": "E-mail address is invalid and can't be repaired",
    "INVALID_IMPOSSIBLE_DATE": "Order date is missing or impossible",
    "CORRUPTED_ITEMS_JSON": "Items are no JSON list of objects",
    "EMPTY_ITEMS": "Order has no items",
    "UNKNOWN_PRICE": "An amount, price or quantity is missing or isn't a number",
    "AMBIGUOUS_NEGATIVE_VALUE": "A negative amount has no clear meaning",
    "MULTIPLE_CONFLICTING_ERRORS": "Several errors at once",
}


def correction(field: str, before: Column, after: Column, rule: str | Column, when: Column | None = None, same_type: bool = False) -> tuple[Column, Column]:
    """Whether before and after differ (and `when` holds), and struct(field, original_value, corrected_value, rule_code). same_type: both have the same type, and needn't become text to compare."""
    code = F.lit(rule) if isinstance(rule, str) else rule
    old, new = before.cast("string"), after.cast("string")
    note = F.struct(F.lit(field).alias("field"), old.alias("original_value"), new.alias("corrected_value"), code.alias("rule_code"))
    differs = ~before.eqNullSafe(after) if same_type else ~old.eqNullSafe(new)
    return (differs if when is None else when & differs), note


def any_of(*cases: Column) -> Column:
    """Whether one of the cases holds (null is no); those behind it aren't looked at."""
    return F.coalesce(*(F.when(when, F.lit(True)) for when in cases), F.lit(False))


def classify(df: DataFrame, whole_titles: bool = False, compat_dayfirst: bool = False, only: tuple[str, ...] | None = None) -> DataFrame:
    """df (the columns FIELDS as text, optionally is_duplicate and has_surplus, and others, which pass) with cleaned and typed fields and

    quality_status, error_codes, error_details, corrections, materially_corrected, raw_record. Missing columns of FIELDS
    and null values count as blank. only: of what classification makes these columns alone, so that Spark leaves out what they don't need (error codes need no audit
    trail). Without the audit trail among them a row's first correction is all that is looked for, and that only where there is no error: the status needs no more.
    """
    # the JVM leaves methods of more than 8000 bytes of code uncompiled: where a stage's would be larger, Spark makes many small ones instead
    df.sparkSession.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    trail = only is None or bool({"corrections", "materially_corrected"} & set(only))
    listed = only is None or bool({"error_codes", "error_details"} & set(only))
    # the notes and when there is one; they are made from columns at the very end, since every step would carry them on
    notes: list[tuple[Column, Column]] = []

    # lists of codes, or whether there is any
    failed = lambda *cases: R.gathered("string", *(F.when(when, F.array(F.lit(code))) for when, code in cases)) if listed else any_of(*(when for when, _ in cases))
    made = ("is_duplicate", "has_surplus", "quality_status", "error_codes", "error_details", "corrections", "materially_corrected", "raw_record")
    others = [c for c in df.columns if c not in FIELDS and c not in made]
    given = {c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string") for c in FIELDS}
    is_dup = F.coalesce(F.col("is_duplicate"), F.lit(False)) if "is_duplicate" in df.columns else F.lit(False)
    surplus = F.coalesce(F.col("has_surplus"), F.lit(False)) if "has_surplus" in df.columns else F.lit(False)
    # what a step only passes on lies in structs, which are copied whole: a column of its own costs each of the many steps a read and a write, a long decimal a conversion too
    s = df.select(*([F.struct(*others).alias("_pass")] if others else []), F.struct(*(v.alias(c) for c, v in given.items())).alias("_given"), is_dup.alias("_dup"), surplus.alias("_surplus"))
    within: dict[str, str] = {}
    c = lambda name: R.text_of(F.col(f"_given.{name}")) if name in FIELDS else F.col(within.get(name, name))

    def bundled(s: DataFrame, name: str, columns: list[str]) -> DataFrame:
        """s with columns put together in a struct of that name, where c() finds them from then on."""
        within.update({x: f"{name}.{x}" for x in columns})
        return s.withColumn(name, F.struct(*columns)).drop(*columns)


    # texts that many patterns look at are columns, or each would make them again; each step has what all fields need of it
    places = [(i, f) for i in range(R.SHORT) for f in ("qty", "unit_price")]
    numbers = {f: R.NUMBER for f in AMOUNTS} | {f"{i}_{f}": R.ITEM_NUMBER for i, f in places}
    s = s.withColumns(
        {f"_t_{f}": (R.clean_city if f == "city" else R.clean_text)(c(f)) for f in CLEANED}
        | {"_day": R.date_text(c("order_date"), R.trimmed, R.ascii_digits), "_rate": R.currency_rate(c("currency"), R.trimmed), "_code": R.currency_code(c("currency"), R.trimmed), "_phone": R.normalize_phone(c("customer_phone")), "_bare": R.bare_email(c("customer_email"), R.trimmed)}
        | {"_raw": R.raw_items(c("items_json"))} | {f"_l_{f}": F.lower(R.trimmed(c(f))) for f in WORDS}
    )
    spoken = {f: R.by_length(c(f"_l_{f}"), R.SYNONYMS) for f in WORDS}
    words = {f: R.synonym(c(f"_t_{f}"), c(f), R.trimmed, spoken[f]) if f in CLEANED else R.synonym(c(f), None, R.trimmed, spoken[f]) for f in WORDS}
    s = s.withColumns(
        {"_o": R.key_number(c("_t_order_id")), "_c": R.key_number(c("_t_customer_id")), "_name": R.clean_name(c("_t_customer_name"), whole_titles, R.trimmed)}
        | {"_date": R.date_of(c("_day"), compat_dayfirst), "_mail": R.repaired(c("_bare"))} | {f"_d_{f}": v for f, v in words.items()}
        | {"_size": F.coalesce(F.size("_raw"), F.lit(-1))} | {f"_w_{i}_{f}": F.get("_raw", i)[f] for i, f in places}
    )
    mail_ok = R.is_valid_email(c("_mail"))
    s = s.withColumns({"_mail_ok": mail_ok, "_repaired": mail_ok & (c("_mail") != c("_bare")), "_k": R.infer_keys(*map(F.col, ("_t_order_id", "_t_customer_id", "_o", "_c")))} | {f"_g_{n}": R.ascii_digits(c(n) if n in AMOUNTS else R.text_of(c(f"_w_{n}"))) for n in numbers})
    s = bundled(s, "_texts", [*(f"_t_{f}" for f in CLEANED), *(f"_d_{f}" for f in words), "_name", "_date", "_mail", "_phone", "_code", *(f"_w_{i}_{f}" for i, f in places)])
    s = s.withColumns({f"_x_{n}": R.amount_text(c(f"_g_{n}"), R.trimmed, lambda x: x) for n in numbers})
    s = s.withColumns({f"_b_{n}": R.bare_amount(c(f"_g_{n}"), c(f"_x_{n}")) for n in numbers})
    s = s.withColumns({f"_p_{n}": R.amount(c(f"_g_{n}"), c(f"_x_{n}"), c(f"_b_{n}"), kind) for n, kind in numbers.items()} | {f"_word_{n}": R.is_word(c(f"_x_{n}")) for n in numbers} | {f"_blank_{f}": F.coalesce(c(f"_x_{f}") == "", F.lit(False)) for f in AMOUNTS})
    charged = {i: R.charged(c(f"_p_{i}_qty"), c(f"_p_{i}_unit_price"), c("_rate")) for i in range(R.SHORT)}
    s = s.withColumns({f"_a_{f}": (c(f"_p_{f}") * c("_rate")).try_cast(R.MONEY) for f in AMOUNTS} | {f"_{x}_{i}": v for i, both in charged.items() for x, v in zip("qu", both)})
    s = s.withColumns({f"_m_{i}": R.product(c(f"_q_{i}"), c(f"_u_{i}")) for i in range(R.SHORT)})
    s = bundled(s, "_numbers", [*(f"_p_{n}" for n in numbers), *(f"_word_{n}" for n in numbers), *(f"_{x}_{i}" for x in "qum" for i in range(R.SHORT))])

    # keys, name
    inferred = lambda f, other: F.when((c(f"_t_{f}") == "") & (c(f"_k.{f}") != ""), f"INFER_{f.upper()}_FROM_{other.upper()}").otherwise(f"STANDARDIZE_{f.upper()}")
    notes += [correction(f, c(f), c(f"_t_{f}"), "TEXT_NORMALIZATION") for f in CLEANED]
    notes += [correction("customer_id", c("_t_customer_id"), c("_k.customer_id"), inferred("customer_id", "order_id")), correction("order_id", c("_t_order_id"), c("_k.order_id"), inferred("order_id", "customer_id"))]
    notes += [correction("customer_name", c("_t_customer_name"), c("_name"), "NAME_REMOVE_TITLES")]
    first_errors = [(c("_k.order_id") == "", "MISSING_ORDER_ID"), (c("_k.customer_id") == "", "MISSING_CUSTOMER_ID"), (c("_dup") & (c("_k.order_id") != ""), "DUPLICATE_ORDER_ID"), (c("_surplus"), "SURPLUS_COLUMNS")]

    # currency, phone, e-mail, date
    how = F.when(c("_rate") > 1, "CURRENCY_CONVERSION_TO_YER").when(c("_code") == "YER", "CURRENCY_TO_YER").otherwise("CURRENCY_STANDARDIZE")
    notes += [correction("currency", c("currency"), c("_code"), how)]
    for f in AMOUNTS:
        parsed = F.when(c(f"_word_{f}"), "PRICE_KNOWN_WORD").otherwise("NUMBER_NORMALIZATION")
        # a number that was text always counts as changed
        number = F.struct(F.lit(f).alias("field"), c(f).alias("original_value"), R.plain_text(c(f"_p_{f}")).alias("corrected_value"), parsed.alias("rule_code"))
        notes += [(c(f"_p_{f}").isNotNull(), number), correction(f, c(f), c(f"_a_{f}"), "CURRENCY_VALUE_CONVERSION", (c("_rate") > 1) & c(f"_p_{f}").isNotNull())]
    phone = correction("customer_phone", c("customer_phone"), c("_phone"), "PHONE_REMOVE_SPACES_AND_COUNTRY_CODE")
    mail = correction("customer_email", c("customer_email"), c("_mail"), "EMAIL_REPEATED_SYMBOLS", c("_repaired"))
    notes += [phone, mail, correction("order_date", c("order_date"), c("_date"), "DATE_STANDARDIZE", c("_date").isNotNull())]
    second_errors = [(~c("_mail_ok"), "INVALID_EMAIL"), (c("_date").isNull(), "INVALID_IMPOSSIBLE_DATE")]

    # dictionary and items
    notes += [correction(f, c("status") if f == "status" else c(f"_t_{f}"), c(f"_d_{f}"), "DICTIONARY_STANDARDIZATION") for f in words]
    # of a short list each place has columns of its own; _each is there for longer ones alone
    s = s.withColumn("_each", F.when(c("_size") > R.SHORT, R.counted_items(c("_raw"), c("_rate"))))
    error = lambda i: R.item_error(F.get("_raw", i), c(f"_q_{i}"), c(f"_u_{i}"), c(f"_p_{i}_unit_price"), c(f"_p_{i}_qty").isNull() & (c("_rate") <= 1), c(f"_m_{i}"))
    s = s.withColumns({f"_f_{i}": F.when(c("_size") > i, error(i)) for i in range(R.SHORT)} | {"_n": R.item_count(c("items_json"), c("_size"))})
    found = F.when(c("_each").isNotNull(), R.item_errors(c("_each"))).when(c("_size") >= 0, R.gathered("string", *(F.when(c(f"_f_{i}").isNotNull(), F.array(f"_f_{i}")) for i in range(R.SHORT))))
    summed = functools.reduce(lambda t, i: (t + F.when(c("_size") > i, c(f"_m_{i}")).otherwise(0)).cast("decimal(28,2)"), range(R.SHORT), F.lit(0).cast("decimal(28,2)")).try_cast(R.MONEY)
    s = s.withColumn("_found", found)
    s = s.withColumn("_items", R.judged_items(c("_n"), c("_size") >= 0, c("_found"), F.when(c("_each").isNotNull(), R.item_total(c("_each"))).otherwise(summed)))
    # a list for who wants it; else it is made only where nothing else tells whether the row is a corrected one
    short = R.gathered(R.ITEM, *(F.when(c("_size") > i, F.array(R.item(F.get("_raw", i), c(f"_q_{i}"), c(f"_u_{i}"), c(f"_m_{i}")))) for i in range(R.SHORT)))
    items = F.when(c("_each").isNotNull(), R.item_list(c("_each"), c("_items.good"))).when(c("_items.good"), short)
    wants_list = only is None or trail or "items_json" in only
    s = s.withColumns({"_total": c("_items.total")} | ({"_list": items} if wants_list else {}))
    as_text = lambda items: F.when(c("_items.good") & (c("_rate") <= 1), F.to_json(items))
    for i in range(R.SHORT):
        named = lambda f, i=i: F.lit(f"items[{i}].{f}")
        notes += [(~(c("_size") > R.SHORT) & when, note) for when, note in R.notes_of_item(named, *(c(f"_w_{i}_{f}") for f in ("qty", "unit_price")), *(c(f"_p_{i}_{f}") for f in ("qty", "unit_price")), c(f"_u_{i}"), c("_rate"), *(c(f"_word_{i}_{f}") for f in ("qty", "unit_price")))]
    noted_before = len(notes)  # by so many notes those of a long list are preceded

    # totals
    near = lambda a, b: F.abs(a - b) <= F.lit(0.01).cast(R.MONEY)
    known = c("_total").isNotNull()
    # each step is a column that the next ones read more than once
    s = s.withColumn("_calc0", (c("_total") + F.coalesce(c("_a_delivery_cost"), F.lit(0))).cast(R.MONEY))
    s = s.withColumn("_flipped", known & (c("_a_total_amount") < 0) & near(F.abs(c("_a_total_amount")), c("_calc0")))
    low = F.lower(c("_d_delivery_type"))
    cost = F.when(low.contains("سريع") | low.contains("fast") | low.contains("express"), 2000).when(low.contains("فوري") | low.contains("instant"), 3000).otherwise(1000).cast(R.MONEY)
    s = s.withColumn("_delivery", F.when(known & c("_blank_delivery_cost"), cost).otherwise(c("_a_delivery_cost")))
    s = s.withColumns({"_calc": (c("_total") + F.coalesce(c("_delivery"), F.lit(0))).cast(R.MONEY), "_tot1": F.when(c("_flipped"), c("_calc0")).otherwise(c("_a_total_amount"))})
    pays = known & c("_blank_payment_amount") & (c("_d_payment_status") == PAID) & c("_tot1").isNotNull()
    s = s.withColumn("_payment", F.when(pays, c("_tot1")).otherwise(c("_a_payment_amount")))
    again = known & (c("_tot1") >= 0) & ~near(c("_tot1"), c("_calc"))
    s = s.withColumn("_tot2", F.when(again, c("_calc")).otherwise(c("_tot1")))
    if trail:
        notes += [correction("items_json", c("items_json"), c("_text"), "ITEMS_NUMERIC_NORMALIZATION", c("_text").isNotNull())]
    notes += [
        correction("total_amount", c("_a_total_amount"), c("_tot1"), "NEGATIVE_SIGN_TYPO_REPAIR", same_type=True),
        correction("delivery_cost", c("delivery_cost"), c("_delivery"), "INFER_DELIVERY_COST", known & c("_blank_delivery_cost")),
        correction("payment_amount", c("payment_amount"), c("_payment"), "INFER_PAYMENT_AMOUNT_FROM_TOTAL", pays),
        correction("total_amount", c("_tot1"), c("_tot2"), "TOTAL_RECALCULATE_FROM_ITEMS_AND_DELIVERY", same_type=True),
    ]
    last_errors = [
        (known & c("_tot1").isNull(), "UNKNOWN_PRICE"),
        (known & (c("_tot1") < 0), "AMBIGUOUS_NEGATIVE_VALUE"),
        (~c("_blank_delivery_cost") & c("_a_delivery_cost").isNull(), "UNKNOWN_PRICE"),
        (c("_delivery") < 0, "AMBIGUOUS_NEGATIVE_VALUE"),
        (c("_payment") < 0, "AMBIGUOUS_NEGATIVE_VALUE"),
    ]

    # outcome
    if listed:
        s = s.withColumn("_codes", F.concat(failed(*first_errors), failed(*second_errors), "_items.errors", failed(*last_errors)))
        codes = F.when(F.size("_codes") > 1, F.concat("_codes", F.array(F.lit("MULTIPLE_CONFLICTING_ERRORS")))).otherwise(c("_codes"))
        bad = F.size("_codes") > 0
    else:
        codes = F.array().cast("array<string>")  # not among what is wanted
        bad = any_of(failed(*first_errors), failed(*second_errors), F.size("_items.errors") > 0, failed(*last_errors))
    if trail:
        s = s.withColumns({"_text": as_text(c("_list")), "_long": F.when(c("_each").isNotNull(), R.item_notes(c("_each"), c("_rate")))})
        more = [F.size("_long") > 0]
    else:
        more = [c("_each").isNotNull() & R.items_changed(c("_each"), c("_rate")), c("items_json") != as_text(c("_list") if wants_list else items)]
    if only is None or "quality_status" in only:
        s = s.withColumn("_status", F.when(bad, "quarantined").when(any_of(*(when for when, _ in notes), *more), "corrected").otherwise("valid"))
    lists = [F.when(when, F.array(note)) for when, note in notes]
    corrections = R.gathered(R.NOTE, *lists[:noted_before], c("_long"), *lists[noted_before:]) if trail else None
    final = {
        "order_id": c("_k.order_id"), "order_date": F.coalesce(c("_date"), c("order_date")), "status": c("_d_status"), "customer_id": c("_k.customer_id"),
        "customer_name": c("_name"), "customer_phone": c("_phone"), "customer_email": F.when(c("_repaired"), c("_mail")).otherwise(c("customer_email")), "city": c("_t_city"), "district": c("_t_district"),
        "delivery_type": c("_d_delivery_type"), "delivery_cost": c("_delivery"), "payment_method": c("_d_payment_method"), "payment_status": c("_d_payment_status"),
        "payment_amount": c("_payment"), "currency": c("_code"), "total_amount": c("_tot2"), "items_json": items,
    }
    details = F.transform(codes, lambda x: F.struct(x.alias("code"), R.lookup(x, DETAILS).alias("detail")))
    outcome = final | {"quality_status": c("_status"), "error_codes": codes, "error_details": details}
    if trail:
        # all notes but those of a long list are judged without being made
        material = any_of(*(when & ~note["rule_code"].isin(*CASTS) for when, note in notes), F.exists("_long", lambda x: ~x["rule_code"].isin(*CASTS)))
        outcome |= {"corrections": corrections, "materially_corrected": material}
    outcome["raw_record"] = c("_given")
    # A filter on the outcome must not be pushed down: substituting it through all groups would multiply the expressions at
    # each. Spark pushes nothing on what a generator makes, and filters on the columns that merely pass go down to the scan.
    wanted = {k: v for k, v in outcome.items() if only is None or k in only}
    s = s.withColumn("_there", F.explode(F.array(F.lit(True))))
    return s.select(*(F.col("_pass").getField(x).alias(x) for x in others), *(F.when(c("_there"), v).alias(k) for k, v in wanted.items()))


def split_by_status(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The validated and the quarantined rows."""
    return df.where("quality_status != 'quarantined'"), df.where("quality_status = 'quarantined'")


TEXTS = (*(f for f in FIELDS if f not in (*AMOUNTS, "items_json")), "quality_status")
#: Types that columns of the validated table may have, and how they are called.
TYPES = {f: (T.StringType, "text") for f in TEXTS} | {f: (T.NumericType, "a number") for f in AMOUNTS}
TYPES |= {"items_json": (T.ArrayType, "a list"), "corrections": (T.ArrayType, "a list"), "raw_record": (T.StructType, "a record"), "source": (T.StructType, "a record")}


def constraint_violations(df: DataFrame) -> DataFrame:
    """Rows that break a rule of the validated table, with the rule: required keys, a status of validated rows, and types.

    Spark's columns have one type each, so that the check of types looks at the schema; it lists the rows that have a value of
    a wrong type. Null is allowed where a column isn't required, and columns that aren't there are.
    """
    required = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) == "", f"{k} is required") for k in ("order_id", "customer_id", "quality_status")]
    known = F.when(~F.col("quality_status").cast("string").isin("valid", "corrected"), "unknown quality_status")
    wrong = [F.when(F.col(f.name).isNotNull(), f"{f.name} must be {TYPES[f.name][1]}") for f in df.schema if f.name in TYPES and not isinstance(f.dataType, TYPES[f.name][0])]
    broken = F.array_compact(F.array(*required, known, *wrong))
    return df.withColumn("violation", F.explode(broken))
