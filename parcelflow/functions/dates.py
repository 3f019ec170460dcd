"""Dates of listings: parsing, timing classes, formats. Times have no zone; the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.functions.text import group, once
from parcelflow.functions.udf import fuzzy_date

#: The sites' date forms.
CHUNK = r"(?i)([A-Za-z]{3,9}\.?\s+\d{1,2}(?:,\s*\d{4})?\s+at\s+\d{1,2}(?::\d{2})?\s*[ap]m)"
NUMERIC = r"\d{1,2}/\d{1,2}/\d{4}\s+at\s+\d{1,2}:\d{2}\s*[AP]M"
_N = r"[+-]?\d+"
_DAY, _CLOCK, _HOUR = rf"{_N}, {_N}", rf" {_N}:{_N} [ap]m", rf" {_N} [ap]m"
#: Patterns in the order in which they are tried, after " at " and points are gone, with what every text of them looks like: a
#: parse that fails costs far more than the look.
PATTERNS = {
    "MMM d, yyyy h:mm a": f"[a-z]{{3,4}} {_DAY}{_CLOCK}", "MMM d, yyyy h a": f"[a-z]{{3,4}} {_DAY}{_HOUR}", "MMMM d, yyyy h:mm a": f"[a-z]{{3,}} {_DAY}{_CLOCK}", "MMMM d, yyyy h a": f"[a-z]{{3,}} {_DAY}{_HOUR}",
    "MMM d, yyyy": f"[a-z]{{3,4}} {_DAY}", "MMMM d, yyyy": f"[a-z]{{3,}} {_DAY}", "M/d/yyyy h:mm a": f"{_N}/{_N}/{_N}{_CLOCK}", "M/d/yyyy h a": f"{_N}/{_N}/{_N}{_HOUR}", "M/d/yyyy": f"{_N}/{_N}/{_N}",
    "yyyy-MM-dd'T'HH:mm:ss": rf"{_N}-\d+-\d+T\d+:\d+:\d+", "yyyy-MM-dd HH:mm:ss": rf"{_N}-\d+-\d+ \d+:\d+:\d+", "yyyy-MM-dd": rf"{_N}-\d+-\d+",
}


def tidy(c: Column) -> Column:
    x = F.replace(F.replace(c, F.lit(" at "), F.lit(" ")), F.lit("."), F.lit(""))
    x = F.regexp_replace(x, r"^(?i:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?i:day)?,?\s+", "")
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"\s+", " "), r"(?i)(\d)\s*([ap])m$", "$1 $2M")


def parse_auction_datetime(c: Column) -> Column:
    """A timestamp of the usual text forms; null where none fits."""
    x = F.regexp_replace(F.regexp_replace(tidy(c), r" p(?=M$)", " P"), r" a(?=M$)", " A")
    found = lambda x: F.coalesce(*(F.when(x.rlike(f"(?i)^{look}$"), F.try_to_timestamp(x, F.lit(p)).cast("timestamp_ntz")) for p, look in PATTERNS.items()))
    return once(x, found)


def auction_datetime(c: Column, as_of: str) -> Column:
    """parse_auction_datetime(), and a lenient parse with missing parts from as_of's midnight where no pattern fits."""
    found = parse_auction_datetime(c)
    left = F.when(found.isNull() & (F.trim(c) != ""), F.replace(F.replace(c, F.lit(" at "), F.lit(" ")), F.lit("."), F.lit("")))
    return F.coalesce(found, fuzzy_date(left, as_of[:10]))


def last_date_chunk(c: Column) -> Column:
    """The last date of a text that has several, else the text."""
    found = F.regexp_extract_all(c, F.lit(CHUNK), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), c)


def days_from(as_of: str, dt: Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit(as_of).cast("timestamp_ntz"), dt) / 86400


def classify_timing(dt: Column, as_of: str, window: int = 7) -> Column:
    days = days_from(as_of, dt)
    return F.when(dt.isNull(), "Unknown").when(days < 0, "Past").when(days <= window, "This Week").otherwise("Later")


def year_rollover(month: Column, day: Column, as_of: str, slack: int = 30) -> Column:
    """A date without a year in as_of's year, a year later if it is over slack days before as_of; February 29 becomes 28."""
    ref = F.lit(as_of).cast("timestamp_ntz")
    on = F.when((month == 2) & (day == 29), F.lit(28)).otherwise(day)
    dt = F.make_timestamp_ntz(F.year(ref), month, on, F.lit(0), F.lit(0), F.lit(0))
    return F.when(dt < ref - F.make_dt_interval(F.lit(slack)), F.make_timestamp_ntz(F.year(ref) + 1, month, on, F.lit(0), F.lit(0), F.lit(0))).otherwise(dt)


def labeled_date(c: Column, label: str) -> Column:
    return group(c, rf"(?i){label}\s*:\s*({NUMERIC})")


def block_status(text: Column, phrase: Column) -> Column:
    """struct(date_time, status): a new date beats a beginning, that an original date alone, that the phrase itself."""
    moved, begins, original = (labeled_date(text, x) for x in ("Postponed To", "Begins", "Original Date"))
    make = lambda d, s: F.struct(d.alias("date_time"), s.alias("block_status"))
    said = F.coalesce(F.nullif(F.lower(F.trim(phrase)), F.lit("")), F.lit("unknown"))
    return F.when(moved.isNotNull(), make(moved, F.lit("postponed"))).when(begins.isNotNull(), make(begins, F.lit("active"))).when(original.isNotNull(), make(F.lit(""), F.lit("postponed"))).otherwise(make(F.lit(""), said))


def short(dt: Column) -> Column:
    return F.coalesce(F.date_format(dt, "MMM d h:mm a"), F.lit("TBD"))


def date_only(c: Column) -> Column:
    """The date of an ISO local time, with T or a space, the raw text if it is none, a dash if it is blank."""
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(f"yyyy-MM-dd{t}HH:mm{x}")) for t in ("'T'", " ") for x in (":ss", ":ss.SSSSSS", "")))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(parsed, "yyyy-MM-dd"), c))


def report_time(c: Column) -> Column:
    """A stored ISO time in the short form; TBD if it is blank, the raw text if it is none."""
    parsed = F.coalesce(*(F.try_to_timestamp(c, F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd")))
    return F.when(F.coalesce(c, F.lit("")) == "", "TBD").otherwise(F.coalesce(F.date_format(parsed, "MMM d h:mm a"), c))


def day_header(dt: Column) -> Column:
    return F.coalesce(F.date_format(dt, "EEEE, MMMM d"), F.lit("Date TBD"))


def digest_time(dt: Column) -> Column:
    return F.coalesce(F.date_format(dt, "MM/dd 'at' h:mm a"), F.lit("TBD"))
