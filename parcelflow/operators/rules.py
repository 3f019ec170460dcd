"""Field rules of sites as a table: every source's pages in one job, patterns as column values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "source string, field string, kind string, pattern string, grp int"
#: Rules up to which a table of them is sent to every task.
SENT = 10_000
_PDF = r'(?i)href="([^"]+\.pdf)"'
#: Where the sites' pages hold their fields. kind: the first match, or all of them joined by '; '.
SITE_RULES: tuple[tuple[str, str, str, str, int], ...] = (
    ("sullivan", "listing_id", "first", r'href="[^"]*[?&]id=(\d+)', 1),
    ("sullivan", "year_built", "first", r"(?i)<li[^>]*>\s*Year Built:\s*([^<]+)</li>", 1),
    ("sullivan", "documents", "all", _PDF, 1),
    ("brockscott", "state", "first", r"(?i)<p[^>]*>\s*(?:<b>)?State:?(?:</b>)?\s*</p>\s*<p[^>]*>\s*([^<]*)</p>", 1),
    ("brockscott", "county", "first", r"(?i)<p[^>]*>\s*(?:<b>)?County:?(?:</b>)?\s*</p>\s*<p[^>]*>\s*([^<]*)</p>", 1),
    ("harmon", "listing_id", "first", r"/auction/(\d+)", 1),
    ("harmon", "title", "first", r'class="blockAuction"[^>]*>\s*<h1[^>]*>([^<]+)</h1>', 1),
    ("harmon", "postponed_to", "first", r"Postponed To:\s*(\d{1,2}/\d{1,2}/\d{4}(?: at \d{1,2}:\d{2} [AP]M)?)", 1),
    ("patriot", "listing_id", "first", r'class="auction-list"[^>]*href="[^"]*id=(\d+)', 1),
    ("patriot", "banner", "first", r'class="banner (\w+)"', 1),
    ("towne", "street", "first", r"<tr>(?:<td>[^<]*</td>){3}<td>(?:<a[^>]*>)?([^<]+)", 1),
    ("jjmanning", "status", "first", r'<h4 class="elementor-heading-title"[^>]*>([^<]+)</h4>', 1),
    ("jjmanning", "address", "first", r'acf_field_list&quot;:&quot;address&quot;[^>]*>\s*<div class="dynamic-content-for-elementor-acf">([^<]*)</div>', 1),
    ("landmark", "title", "first", r'class="eventlist-title"[^>]*>(?:<a[^>]*>)?([^<]+)', 1),
    ("landmark", "documents", "all", _PDF, 1),
    ("keenan", "deposit", "first", r"Deposit: \$([\d,]+)", 1),
    ("keenan", "terms", "first", r"Terms: ([^<\n]+)", 1),
    ("skypoint", "listing_id", "first", r"(?:SP )?#(\d{4}[A-Z]?)", 1),
    ("skypoint", "status", "first", r"\b(SOLD|CANCELED|CANCELLED|NEW DATE)\b", 1),
)


def site_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SITE_RULES), RULES)


def extract_listings(pages: DataFrame, rules: DataFrame, html: str = "html") -> DataFrame:
    """pages, without html, with fields: a map of what its source's rules find in each page; null where a rule finds nothing.

    rules (RULES): several of one source and field count as one, the least pattern; a page whose source has none gets an empty map.
    The rules meet the pages as one array a source, sent to every task while they are few, so no page is shuffled or repeated.
    """
    own = rules.groupBy("source", "field").agg(F.min(F.struct("pattern", "kind", "grp")).alias("r"))
    per = own.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("field", "r.pattern", "r.kind", "r.grp"))).alias("_rules"))  # a field each
    per = F.broadcast(per) if rules.count() <= SENT else per
    text = F.coalesce(F.col(html), F.lit(""))

    def found(r: Column) -> Column:
        first = F.call_function("regexp_extract", text, r["pattern"], r["grp"])
        every = F.array_join(F.call_function("regexp_extract_all", text, r["pattern"], r["grp"]), "; ")
        return F.struct(r["field"], F.nullif(F.trim(F.when(r["kind"] == "all", every).otherwise(first)), F.lit("")))

    fields = F.map_from_entries(F.transform(F.coalesce("_rules", F.array().cast(per.schema["_rules"].dataType)), found))
    return pages.join(per, "source", "left").select(*(c for c in pages.columns if c != html), fields.alias("fields"))
