"""Status words: what is over, and their common forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses that leave the map, that make a link's side not live, and words of a terminal status.
OFF_MAP = ("sold back to mortgagee", "3rd party purchase", "sold", "canceled", "cancelled", "withdrawn", "bank buy back")
NOT_LIVE = ("sold back to mortgagee", "3rd party purchase", "canceled", "cancelled", "withdrawn")
TERMINAL = ("cancel", "sold", "third party", "3rd party")
DATELESS_TERMINAL = ("cancelled", "sold back to mortgagee", "3rd party purchase")


def off_map(c: Column) -> Column:
    return F.coalesce(c.isin(*OFF_MAP), F.lit(False))


def not_live(c: Column) -> Column:
    return F.coalesce(c.isin(*NOT_LIVE), F.lit(False))


def terminal(c: Column) -> Column:
    found = F.lit(False)
    for word in TERMINAL:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
    return found


#: (source, first words of the raw status, status); a source of None is any. The most letters that fit win.
STATUS_RULES: tuple[tuple[str | None, str, str], ...] = (
    (None, "cancel", "cancelled"), (None, "postponed", "postponed"),
    ("sullivan", "on", "active"),
    ("towne", "on_time", "active"), ("towne", "on time", "active"),
    ("patriot", "yellow", "postponed"), ("patriot", "red", "cancelled"), ("patriot", "", "active"),
    ("skypoint", "new date", "active"), ("skypoint", "sold", "sold"), ("skypoint", "cancel", "canceled"), ("skypoint", "", "active"),
)
#: (source, word of the raw status): rows that are left out before they are loaded.
SKIPPED = (("patriot", "red"),)
#: Sources whose first word must be the whole status.
WHOLE = ("sullivan",)


def normalize_status(c: Column, source: Column | None = None, rules: tuple[tuple[str | None, str, str], ...] = STATUS_RULES) -> Column:
    """A source's raw status word, banner colour or keyword as a common status; else the raw one, lower-cased and trimmed.

    A blank status is null for sources without a rule for it. Without a source only the rules of any source hold.
    """
    x = F.lower(F.trim(c))
    said = F.coalesce(x, F.lit(""))
    found = F.nullif(x, F.lit(""))
    for name, words, status in sorted(rules, key=lambda r: (len(r[1]), r[0] is not None)):
        if name is not None and source is None:
            continue
        fits = (said == words) if name in WHOLE else said.startswith(words)
        found = F.when(fits if name is None else fits & (source == name), status).otherwise(found)
    return found


def stale_sold(c: Column, dt: Column, as_of: str, days: int = 14) -> Column:
    """Whether a sold row's date lies more than days back; undated rows are not stale."""
    return F.coalesce((F.lower(F.trim(c)) == "sold") & (dt < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))), F.lit(False))


def skipped(c: Column, source: Column, rules: tuple[tuple[str, str], ...] = SKIPPED) -> Column:
    """Whether a row's raw status says that its source has taken it down; such rows are no listings."""
    found = F.lit(False)
    for name, word in rules:
        found = found | ((source == name) & F.array_contains(F.split(F.lower(F.trim(c)), r"\s+"), word))
    return F.coalesce(found, F.lit(False))
