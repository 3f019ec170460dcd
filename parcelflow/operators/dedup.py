"""Repeats within and across sources, latest events, rankings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Confirmed overlapping pairs, the source that wins first.
CONFIRMED_PAIRS: tuple[tuple[str, str], ...] = (("landmark", "brockscott"), ("patriot", "brockscott"), ("sullivan", "brockscott"), ("harmon", "patriot"))


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; a ranking that Spark cuts to one row a key before the shuffle.

    A hash of the keys comes before them, so that rows are sorted by a number and texts are compared where it is equal only.
    """
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_per_listing(listings: DataFrame) -> DataFrame:
    """One row per (source, listing_id): the latest date wins, dated beats undated; ties keep the earlier row of dated ones, the later of undated.

    Rows are dealt by the listing id and the source alone, as a load's joins and buckets are, so what comes after needs no other shuffle.
    """
    dt = F.col("auction_datetime")
    w = Window.partitionBy("listing_id", "source").orderBy(dt.desc_nulls_last(), F.when(dt.isNotNull(), F.col("seq")).otherwise(-F.col("seq")))
    return listings.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def cross_source(rows: DataFrame, key: Column, pairs: Sequence[Sequence[str]] = CONFIRMED_PAIRS, require_two_sources: bool = False) -> DataFrame:
    """Rows whose key is shared by sources of one confirmed pair only: the highest-priority row stays, the first on ties; all others stay.

    Rows with a null key stay. A key is aggregated and joined back, so a hot key is never one window.
    """
    return _marked(rows, key, pairs, require_two_sources).where(F.col("_seq").isNull() | (F.col("_seq") == F.col("seq"))).drop("_key", "_seq")


def cross_source_repeats(rows: DataFrame, key: Column, pairs: Sequence[Sequence[str]] = CONFIRMED_PAIRS, require_two_sources: bool = False) -> DataFrame:
    """The rows that cross_source() leaves out; only those of a pair's sources can be."""
    named = F.col("source").isin(sorted({n for p in pairs for n in p}))
    return _marked(rows, key, pairs, require_two_sources).where(named & ~(F.col("_seq").isNull() | F.coalesce(F.col("_seq") == F.col("seq"), F.lit(False)))).drop("_key", "_seq")


def _marked(rows: DataFrame, key: Column, pairs: Sequence[Sequence[str]], require_two_sources: bool) -> DataFrame:
    """rows with _key, and the seq of the row that stays where a key's rows are of one pair; by sums of fixed width, one a name and pair.

    A hash of the key comes before it, so that the join sorts numbers.
    """
    keyed = rows.withColumn("_key", key).withColumn("_hash", F.xxhash64("_key"))
    names = sorted({n for p in pairs for n in p})
    own = {n: F.coalesce(F.col("source") == n, F.lit(False)) for n in names}
    per = keyed.where(F.col("_key").isNotNull()).groupBy("_hash", "_key").agg(
        F.count(F.lit(1)).alias("_n"), *(F.bool_or(own[n]).alias(f"_has{i}") for i, n in enumerate(names)), *(F.min(F.when(own[n], F.col("seq"))).alias(f"_seq{i}") for i, n in enumerate(names)),
        *(F.bool_and(F.coalesce(F.col("source").isin(list(p)), F.lit(False))).alias(f"_in{j}") for j, p in enumerate(pairs)),
    )
    seq, fits = F.lit(None).cast("long"), F.lit(False)
    for j, pair in reversed(list(enumerate(pairs))):
        at = [names.index(n) for n in pair]
        on = F.col(f"_in{j}")
        if require_two_sources:
            on = on & (sum(F.col(f"_has{i}").cast("int") for i in at) > 1)
        best: Column = F.lit(None).cast("long")
        for i in reversed(at):
            best = F.when(F.col(f"_has{i}"), F.col(f"_seq{i}")).otherwise(best)
        seq, fits = F.when(on, best).otherwise(seq), fits | on
    return keyed.join(per.where((F.col("_n") > 1) & fits).select("_hash", "_key", seq.alias("_seq")), ["_hash", "_key"], "left").drop("_hash")


def merge_by_status(rows: DataFrame, keys: Sequence[str], ranks: Mapping[str, int], last_wins: bool = False) -> DataFrame:
    """One row per key: the higher status rank, the first on ties; or simply the last row."""
    if last_wins:
        return first_by(rows, keys, F.col("seq").desc())
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col("status")], F.lit(0))
    return first_by(rows, keys, rank.desc(), F.col("seq"))


def latest_event(events: DataFrame) -> DataFrame:
    """The last event of each auction by event id, as an aggregation with map-side combine."""
    fields = [c for c in events.columns if c != "auction_id"]
    return events.groupBy("auction_id").agg(F.max_by(F.struct(*fields), "event_id").alias("e")).select("auction_id", *(F.col(f"e.{c}").alias(c) for c in fields))


def cap_with_remainder(rows: DataFrame, keys: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key, with the number of rows left out as more."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order))).where(F.col("rank") <= n)
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    return ranked.join(total, list(keys)).withColumn("more", F.greatest(F.col("_total") - n, F.lit(0))).drop("_total")


def day_buckets(rows: DataFrame, dt: str) -> DataFrame:
    """Rows with their day and its place among the days; only the days are ranked."""
    days = rows.select(F.to_date(dt).alias("day")).distinct()
    placed = days.withColumn("bucket", F.dense_rank().over(Window.orderBy("day")))
    return rows.withColumn("day", F.to_date(dt)).join(placed, "day")


def newest_first(rows: DataFrame, key: str, time: str, tie: str) -> DataFrame:
    """rows with their place in each key's list, the latest time first."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), tie)).cast("long"))
