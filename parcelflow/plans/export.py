"""The live map: what is shown, and what is left out and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.functions import status
from parcelflow.functions.text import parse_description
from parcelflow.operators.aggregates import exclusion_accounting, left_out, postponements, stale
from parcelflow.operators.joins import drop_if_last_disappeared, hide_duplicates


def live_rows(properties: DataFrame, events: DataFrame, links: DataFrame | None, as_of: str) -> DataFrame:
    rows = properties.where(~status.off_map(F.col("status")) & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & ~F.coalesce(stale(as_of), F.lit(False)))
    return hide_duplicates(drop_if_last_disappeared(rows, events), links)


def export_live_map(properties: DataFrame, events: DataFrame, links: DataFrame | None, as_of: str, pdf: DataFrame | None = None) -> DataFrame:
    """Live listings with their details, documents and postponements, by auction time, undated first.

    pdf: (auction_id, ord, link). The order is the caller's: orderBy shuffles once.
    """
    out = live_rows(properties, events, links, as_of).join(postponements(events), "auction_id", "left")
    details = ("summary", "property_type", "bedrooms", "bathrooms", "sqft", "lot_size_raw", "year_built")
    described = parse_description(F.col("description"))
    specs = F.struct(*((F.col(c) if c in properties.columns else described.get(c, F.lit(None).cast("string"))).alias(c) for c in details)).alias("specs")
    none = F.array().cast("array<string>")
    if pdf is not None:
        out = out.join(pdf.groupBy("auction_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "link"))), lambda x: x["link"]).alias("_pdf")), "auction_id", "left")
    return out.select(
        "property_id", "source", "address", "state", "latitude", "longitude", "auction_datetime", F.lit("scheduled").alias("shown_status"), "url",
        F.coalesce("times_postponed", F.lit(0)).alias("times_postponed"), "original_date", specs, (F.coalesce("_pdf", none) if pdf is not None else none).alias("pdf_links"),
    ).orderBy(F.col("auction_datetime").asc_nulls_first(), "property_id")


def excluded_sample(properties: DataFrame, events: DataFrame, links: DataFrame, as_of: str, n: int = 25) -> DataFrame:
    """The first n left-out properties of each reason (missing_coords, disappeared, stale), by id; the ranking is cut before the shuffle."""
    reasons = F.array_compact(F.array(*(F.when(F.col(r), F.lit(r)) for r in ("missing_coords", "disappeared", "stale"))))
    rows = left_out(properties, events, links, as_of).select("property_id", "address", "source", "status", "last_seen_at", F.explode(reasons).alias("reason"))
    w = Window.partitionBy("reason").orderBy("property_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def map_meta(properties: DataFrame, events: DataFrame, links: DataFrame, as_of: str, n: int = 25) -> DataFrame:
    """The live map's one row of meta fields: counts, and of each reason of excluded_sample() its first n properties."""
    reasons = ("missing_coords", "disappeared", "stale")
    row = F.struct("rank", "property_id", "address", "source", "status", "last_seen_at")
    per = excluded_sample(properties, events, links, as_of, n).agg(*(F.array_sort(F.collect_list(F.when(F.col("reason") == r, row))).alias(f"excluded_{r}") for r in reasons))
    return exclusion_accounting(properties, events, links, as_of).join(per).withColumn("generated_at", F.lit(as_of))  # one row each
