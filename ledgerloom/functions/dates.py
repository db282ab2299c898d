"""Free-form dates as column expressions: a clock is cut out, what is left are three tokens, whose kinds decide which is day, month and year."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST = 80  #: characters of a date's text at most
PIVOT = 1976  #: two digits are a year from this one on, up to 99 years later
#: English names of months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m != "september" else "sept?(?:ember)?" for m in MONTHS) + ")"
_WEEKDAY = r"(?:mon|tue(?:s)?|wed(?:nes)?|thu(?:r|rs)?|fri|sat(?:ur)?|sun)(?:day)?"
#: A clock: hour, minute, second, fraction, a or p behind minutes, a or p behind the hour alone, a name of UTC, hours and minutes of an offset.
CLOCK = (
    r"(?:(?<![0-9a-z:.])|(?<=[0-9])t)([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2})(?:[.,]([0-9]{1,9}))?)?(?:\s?([ap])[.]?m\b[.]?)?|\s?([ap])[.]?m\b[.]?)"
    r"(?:\s?(z|utc|gmt)(?![a-z]))?(?:\s?([+-][0-9]{1,2})(?::?([0-9]{2}))?)?(?![0-9a-z:])"
)
_FILL = rf"\b{_WEEKDAY}\b|(?<=[0-9])(?:st|nd|rd|th)\b|\b(?:of|at|on|and|the)\b"
_APART = r"[\s,;./'\-]"
_SHAPE = rf"^{_APART}*(?:(?:[0-9]{{1,4}}+(?![0-9])|{_MONTH}(?![a-z])){_APART}*+){{3}}$"
#: By the kinds of the three tokens (Y: four digits, N: one or two, M: a month's name) the places of year, month and day. Of three short numbers
#: the first is the year where it is above 31.
ORDERS = {"YNN": (1, 2, 3), "NNY": (3, 2, 1), "NNN": (3, 2, 1), "MNY": (3, 1, 2), "NMY": (3, 2, 1), "YMN": (1, 2, 3), "YNM": (1, 3, 2), "MYN": (2, 1, 3), "NYM": (2, 3, 1), "NMN": (3, 2, 1), "MNN": (3, 1, 2)}
_YEAR_FIRST = {"NNN": (1, 2, 3), "NMN": (1, 2, 3)}


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda variable holds it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(token: Column) -> Column:
    months = F.expr("map(" + ", ".join(f"'{m[:3]}', {k}" for k, m in enumerate(MONTHS, 1)) + ")")
    return F.coalesce(token.try_cast("int"), F.try_element_at(months, F.substring(token, 1, 3)))


def _ymd(tokens: Column, swap_year_first: bool) -> Column:
    """struct(y, m, d) of three tokens, null where no order is known for their kinds."""
    kind = lambda x: F.when(x.rlike("^[a-z]"), "M").when(F.length(x) == 4, "Y").when(F.length(x) <= 2, "N").otherwise("?")

    def placed(kinds: Column) -> Column:
        first = F.coalesce(F.get(tokens, 0).try_cast("int"), F.lit(0))
        pick = lambda places: F.struct(*(F.get(tokens, p - 1).alias(n) for n, p in zip("ymd", places)))
        out = None
        for kinds_of, places in [*((k, p) for k, p in _YEAR_FIRST.items()), *ORDERS.items()]:
            here = (kinds == kinds_of) & (first > 31) if places is _YEAR_FIRST.get(kinds_of) else kinds == kinds_of
            out = F.when(here, pick(places)) if out is None else out.when(here, pick(places))
        return out

    def numbers(t: Column) -> Column:
        y, m, d = t["y"].try_cast("int"), _number(t["m"]), t["d"].try_cast("int")
        short = F.length(t["y"]) <= 2
        year = F.when(short, F.pmod(y - PIVOT % 100, F.lit(100)) + PIVOT).otherwise(y)
        year_first = (F.length(F.get(tokens, 0)) == 4) & t["m"].rlike("^[0-9]")
        swap = ((m > 12) & (d <= 12)) | (year_first & (m <= 12) & (d <= 12) if swap_year_first else F.lit(False))
        swap = swap & t["m"].rlike("^[0-9]")
        return F.struct(year.alias("y"), F.when(swap, d).otherwise(m).alias("m"), F.when(swap, m).otherwise(d).alias("d"))

    kinds = F.array_join(F.transform(tokens, kind), "")
    return bound(bound(kinds, placed), numbers)


def free_date(text: Column, swap_year_first: bool = False) -> Column:
    """ISO text of the date in `text` (of the moment, with its own offset, if a T stands between date and clock), null if there is none.

    Takes year, month and day in any order that ORDERS has, with months as numbers or English names, weekdays, ordinals, clocks of 12 and 24 hours, fractions and
    offsets. Ambiguous numbers are day first, or month and day behind a year (swap_year_first: day and month); a month above 12 is the day.
    """
    low = F.lower(text)
    part = lambda t, k: F.nullif(F.regexp_extract(t, CLOCK, k), F.lit(""))

    def parsed(t: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(t, CLOCK, " "), _FILL, " ")
        clock = F.struct(*(part(t, k).alias(n) for k, n in enumerate(("h", "mi", "s", "f", "half", "only", "utc", "off", "past"), 1)), t.rlike(r"[0-9]t[0-9]").alias("moment"))
        tokens = F.when(rest.rlike(_SHAPE), F.regexp_extract_all(rest, F.lit("([0-9]+|[a-z]+)"), F.lit(1)))
        return bound(F.struct(tokens.alias("tokens"), clock.alias("c")), lambda x: joined(bound(x["tokens"], lambda w: _ymd(w, swap_year_first)), x["c"]))

    def joined(ymd: Column, c: Column) -> Column:
        half, hour = F.coalesce(c["half"], c["only"]), F.coalesce(c["h"].try_cast("int"), F.lit(0))
        hour = F.when(half.isNull(), hour).when((hour < 1) | (hour > 12), F.lit(99)).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
        number = lambda f: F.coalesce(c[f].try_cast("int"), F.lit(0))
        at = bound(ymd, lambda v: F.try_make_timestamp_ntz(v["y"], v["m"], v["d"], hour, number("mi"), number("s").cast("decimal(16,6)")))
        fraction = F.rpad(F.substring(c["f"], 1, 6), 6, "0")
        offset = F.concat(F.substring(c["off"], 1, 1), F.lpad(F.substring(c["off"], 2, 2), 2, "0"), F.lit(":"), F.coalesce(c["past"], F.lit("00")))
        zone = F.coalesce(offset, F.when(c["utc"].isNotNull(), "+00:00"), F.lit(""))
        moment = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.coalesce(F.when(fraction != "000000", F.concat(F.lit("."), fraction)), F.lit("")), zone)
        return F.when(c["moment"], moment).otherwise(F.date_format(at, "yyyy-MM-dd"))

    return bound(F.when(F.length(text) <= LONGEST, low), parsed)
