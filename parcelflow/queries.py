"""One query per operator over the shape tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.functions import dates, status, text
from parcelflow.operators import aggregates, dedup, joins, pages, rules
from parcelflow.plans import billing, cache, digest, export, links, load
from parcelflow.plans.shapes import AS_OF, Shapes, with_shapes
from parcelflow.sources import files, state
from parcelflow.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WEEK_AGO = "2024-01-24 00:00:00"
_SPECS = "coalesce(try_cast(regexp_extract(description, '# Bedrooms: ([0-9]+)', 1) as bigint), null) as bedrooms, try_cast(replace(regexp_extract(description, 'Square Feet: ([0-9,]+)', 1), ',', '') as bigint) as sqft, nullif(cast(regexp_extract(description, '([0-9]+) full', 1) as double) + 0.5 * cast(regexp_extract(description, '([0-9]+) half', 1) as double), 0) as bathrooms, try_cast(regexp_extract(description, 'Year Built: ([0-9]+)', 1) as bigint) as year_built, 'Residential' as property_type, trim(regexp_extract(description, 'Lot Size: ([^;]+)', 1)) as lot_size_raw"
_LAST = "(select auction_id, arg_max(event_type, event_id) as last_type from auction_events group by auction_id)"
_OFF = "status in ('sold back to mortgagee','3rd party purchase','sold','canceled','cancelled','withdrawn','bank buy back')"
_OLD = "last_seen_at < TS'2024-01-31 00:00:00' - interval 14 day"


def query(shapes: str = "", sql: str | None = None):
    def add(f: Callable[[Shapes], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Shapes(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = with_shapes(shapes.split(), sql) if shapes else sql
        return f

    return add


# sources and sinks


_FILE = "concat(source, ':', listing_id) as id, name, source, state, county, municipality, status, url, pdf_links, strftime(auction_datetime, '%Y-%m-%dT%H:%M:%S') as auction"


def _file(rows):
    names = {"ID": "id", "Name": "name", "Source": "source", "State": "state", "County": "county", "Municipality": "municipality", "Status": "status", "URL": "url", "PDF Links": "pdf_links", "Auction Date/Time": "auction"}
    return rows.select(*(F.coalesce(f"`{k}`", F.lit("")).alias(v) for k, v in names.items()))


@query("listings", f"select {_FILE} from listings where latitude is not null")
def write_listing_csv(s):
    """Written as files and read back."""
    path = files.scratch(s.spark, "listings")
    files.write_listing_csv(s.listings, path)
    return _file(s.spark.read.options(header=True, escape='"', multiLine=True).csv(path))


@query("listings", f"select concat(source, ':', listing_id) as id, source, listing_id, name, url, latitude, longitude, county, municipality, status, auction_datetime, pdf_links, {_SPECS} from listings where latitude is not null")
def read_listing_csv(s):
    """A written file read back and typed as a snapshot."""
    path = files.scratch(s.spark, "listings")
    files.write_listing_csv(s.listings, path)
    rows = files.read_listing_csv(s.spark, path)
    fields = ("source", "listing_id", "name", "url", "latitude", "longitude", "county", "municipality", "status", "auction_datetime", "bedrooms", "sqft", "bathrooms", "year_built", "property_type", "lot_size_raw")
    return load.typed(rows, AS_OF).select(F.concat("source", F.lit(":"), "listing_id").alias("id"), *fields, F.coalesce("pdf_links", F.lit("")).alias("pdf_links"))


@query("properties", "select cast(property_id as varchar) as id, latitude from properties where property_id % 7 <> 0")
def read_cache(s):
    path = files.scratch(s.spark, "cache")
    row = F.to_json(F.struct(F.col("property_id").cast("string").alias("id"), "latitude"))
    s.properties.select(F.when(F.col("property_id") % 7 == 0, F.concat(F.lit("{"), row)).otherwise(row).alias("value")).write.text(path)
    return files.read_cache(s.spark, path, T.StructType([T.StructField("id", T.StringType()), T.StructField("latitude", T.DoubleType())]))


@query("listings", f"select {_FILE} from listings where latitude is not null")
def write_listing_csv_by_source(s):
    """A folder of files per source, read back with the sources of their folders."""
    path = files.scratch(s.spark, "listings")
    files.write_listing_csv(s.listings, path, by_source=True)
    return _file(s.spark.read.options(header=True, escape='"', multiLine=True).csv(path))


@query("listings", f"select '2024-01-31' as snapshot_date, {_FILE} from listings where latitude is not null")
def dated_snapshot(s):
    """A dated copy of the files, written twice and beside another date's, read back by its date."""
    path = files.scratch(s.spark, "listings")
    for date, rows in ((AS_OF[:10], s.snapshot_1), ("2024-01-30", s.snapshot_2), (AS_OF[:10], s.listings)):
        files.write_listing_csv(rows, path, by_source=True, snapshot_date=date)
    rows = s.spark.read.options(header=True, escape='"', multiLine=True).csv(path).where(F.col("snapshot_date") == AS_OF[:10])
    return _file(rows).withColumn("snapshot_date", F.lit(AS_OF[:10]))


@query("listings", "select concat(source, ':', listing_id) as id, case when seq % 3 = 0 then null else round(latitude, 4) end as latitude from listings where seq % 3 <> 0")
def read_overrides(s):
    raw = s.listings.select(F.concat(F.lit(" "), "source", F.lit(":"), "listing_id").alias("id"), F.when(F.col("seq") % 3 == 0, "n/a").otherwise(F.format_string(" %.4f", "latitude")).alias("latitude"), F.format_string("%.4f", "longitude").alias("longitude"))
    return files.read_overrides(raw).select("id", "latitude")


@query("", "select page_id, url, length(html) as size from pages")
def read_pages(s):
    return s.pages.select("page_id", "url", F.length("html").cast("long").alias("size"))


_SHORT = "case when coalesce({0}, '') = '' then 'TBD' else coalesce(strftime(try_cast({0} as timestamp), '%b %-d %-I:%M %p'), {0}) end"


# row-level


@query("listings", "select seq, case when seq % 3 = 0 then regexp_extract(url, '[?&]id=([^&#]*)', 1) || ' lot/' || (seq % 7) || 'é' else regexp_extract(url, '[?&]id=([^&#]*)', 1) end as id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from listings")
def extract_listing_id(s):
    """Every third id has characters that the URL encodes."""
    url = F.when(F.col("seq") % 3 == 0, F.concat("url", F.lit("%20lot%2F"), (F.col("seq") % 7).cast("string"), F.lit("%C3%A9&x=1"))).otherwise(F.col("url"))
    return s.listings.select("seq", text.extract_listing_id(url, F.col("name")).alias("id"), text.slugify(F.col("name")).alias("slug"))


@query("", "select page_id, case when url like '%example.com%' then coalesce(nullif(regexp_extract(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/([0-9]+)/*$', 1), ''), url) else url end as id from pages")
def extract_page_listing_id(s):
    return s.pages.select("page_id", text.extract_listing_id(F.col("url"), F.lit(None).cast("string"), path_hosts=("example.com",)).alias("id"))


@query("", "select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug from pages")
def slugify(s):
    return s.pages.select("page_id", text.slugify(F.col("url")).alias("slug"))


@query("", "select o_orderkey, date_trunc('minute', o_orderdate) as dt, case when o_orderkey % 3 = 0 then null else date_trunc('minute', o_orderdate) end as any_form from orders")
def parse_auction_datetime(s):
    """Texts of the usual forms, and some that only the lenient parse reads."""
    day, time = F.date_format("o_orderdate", "MMM d, yyyy"), F.date_format("o_orderdate", "h:mm a")
    raw = F.concat(F.date_format("o_orderdate", "EEE"), F.lit(". "), day, F.lit(" at "), time)
    loose = F.when(F.col("o_orderkey") % 3 == 0, "TBD").when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("now to be held on "), day, F.lit(" "), time)).otherwise(raw)
    return s.orders.select("o_orderkey", dates.parse_auction_datetime(raw).alias("dt"), dates.auction_datetime(loose, AS_OF).alias("any_form"))


@query("", "select o_orderkey, date_trunc('minute', o_orderdate) + interval 3 day as dt from orders")
def last_date_chunk(s):
    said = lambda c: F.concat(F.date_format(c, "MMM d, yyyy"), F.lit(" at "), F.date_format(c, "h:mm a"))
    raw = F.concat(said(F.col("o_orderdate")), F.lit(" postponed to "), said(F.expr("o_orderdate + interval 3 days")))
    return s.orders.select("o_orderkey", dates.parse_auction_datetime(dates.last_date_chunk(raw)).alias("dt"))


@query("properties", "select property_id, case when d < 0 then 'Past' when d <= 7 then 'This Week' else 'Later' end as timing from (select property_id, date_diff('second', TS'2024-01-31 00:00:00', auction_datetime) / 86400.0 as d from properties)")
def classify_timing(s):
    return s.properties.select("property_id", dates.classify_timing(F.col("auction_datetime"), AS_OF).alias("timing"))


@query("", "with d as (select o_orderkey, make_timestamp(2024, month(o_orderdate), case when month(o_orderdate) = 2 and day(o_orderdate) = 29 then 28 else day(o_orderdate) end, 0, 0, 0) as t from orders) select o_orderkey, case when t < timestamp '2024-01-31' - interval 30 day then t + interval 1 year else t end as dt from d")
def year_rollover_date(s):
    return s.orders.select("o_orderkey", dates.year_rollover(F.month("o_orderdate"), F.day("o_orderdate"), AS_OF).alias("dt"))


_BLOCK = "concat('Registry: Essex Book / Page: ', cast(o_custkey as varchar(20)), '/7 ', case o_orderkey % 4 when 0 then 'Postponed To: 1/02/2024 at 10:30 AM Original Date: 1/01/2024 at 9:00 AM' when 1 then 'Begins: 2/03/2024 at 11:00 AM' when 2 then 'Original Date: 3/04/2024 at 1:15 PM' else 'none' end)"


@query("", "select o_orderkey, case o_orderkey % 4 when 0 then '1/02/2024 at 10:30 AM' when 1 then '2/03/2024 at 11:00 AM' else '' end as date_time, case o_orderkey % 4 when 0 then 'postponed' when 1 then 'active' when 2 then 'postponed' else 'sold' end as block_status, case when o_orderkey % 4 in (0, 2) then case o_orderkey % 4 when 0 then '1/01/2024 at 9:00 AM' else '3/04/2024 at 1:15 PM' end end as original from orders")
def labeled_status(s):
    rows = s.orders.select("o_orderkey", F.expr(_BLOCK).alias("block"))
    return rows.select("o_orderkey", dates.block_status(F.col("block"), F.lit(" Sold ")).alias("b"), dates.labeled_date(F.col("block"), "Original Date").alias("original")).select("o_orderkey", "b.*", "original")


@query("listings", f"select seq, {_SPECS} from listings")
def parse_description(s):
    found = text.parse_description(F.col("description"))
    return s.listings.select("seq", *(found[k].alias(k) for k in ("bedrooms", "sqft", "bathrooms", "year_built", "property_type", "lot_size_raw")))


@query("listings", f"select seq, case when seq % 3 = 0 then seq % 7 when seq % 3 = 1 then bedrooms else null end as bedrooms, sqft from (select seq, {_SPECS} from listings)")
def resolve_property_details(s):
    raw = F.when(F.col("seq") % 3 == 0, F.concat((F.col("seq") % 7).cast("string"), F.lit(" beds"))).when(F.col("seq") % 3 == 1, " ").otherwise("several")
    found = text.property_details({"bedrooms": raw}, F.col("description"))
    return s.listings.select("seq", found["bedrooms"].alias("bedrooms"), found["sqft"].alias("sqft"))


@query("listings", "select seq, 1000 + cast(regexp_extract(description, '1,([0-9]+) sf', 1) as bigint) as n, trim(regexp_replace(regexp_extract(description, 'Lot Size: ([^;]+)', 1), '(?i)\\s+lot\\s*$', '')) as lot from listings")
def clean_int_and_lot(s):
    return s.listings.select("seq", text.clean_int(F.regexp_extract("description", "Square Feet: ([^;]+)", 1)).alias("n"), text.clean_lot_size(F.regexp_extract("description", "Lot Size: ([^;]+)", 1)).alias("lot"))


@query("", "select o_orderkey, case o_orderkey % 4 when 0 then o_custkey % 5 + 0.5 when 1 then nullif(o_custkey % 4 + 0.5 * (o_custkey % 3), 0) else null end::double as bathrooms, case when o_orderkey % 4 = 2 then 'many' end as bathrooms_raw from orders")
def clean_bathrooms(s):
    raw = F.expr("case o_orderkey % 4 when 0 then concat(o_custkey % 5, '.5') when 1 then concat(o_custkey % 4, ' full / ', o_custkey % 3, ' half') when 2 then ' many' else '' end")
    return s.orders.select("o_orderkey", text.bathrooms(raw).alias("bathrooms"), text.bathrooms_raw(raw).alias("bathrooms_raw"))


@query("", "select event_id, nullif(trim(props), '') as summary, case when nullif(trim(props), '') is not null then json_valid(case when event_id % 5 = 0 then concat('{', props) else props end) end as metadata_ok from events")
def clean_summary_metadata(s):
    raw = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return s.events.select("event_id", text.blank_to_null(F.col("props")).alias("summary"), text.metadata_ok(raw).alias("metadata_ok"))


@query("listings", f"select seq, bedrooms, sqft, 'Residential' as property_type, lot_size_raw as lot_size, '' as county from (select seq, {_SPECS.replace('trim(regexp_extract', 'trim(regexp_replace(regexp_extract').replace(chr(39) + 'Lot Size: ([^;]+)' + chr(39) + ', 1)', chr(39) + 'Lot Size: ([^;]+)' + chr(39) + ', 1), ' + chr(39) + '(?i) +lot *$' + chr(39) + ', ' + chr(39) + chr(39) + ')')} from listings)")
def route_labeled_fields(s):
    entries = F.transform(F.split(F.element_at(F.split("description", r"\| "), -1), "; "), lambda p: F.struct(F.substring_index(p, ": ", 1).alias("k"), F.substr(p, F.instr(p, ": ") + 2).alias("v")))
    found = text.route_labels(F.map_from_entries(entries))
    return s.listings.select("seq", *(found[k].alias(k) for k in ("bedrooms", "sqft", "property_type", "lot_size", "county")))


@query("listings", "select seq, regexp_extract(description, 'Year Built: ([0-9]+)', 1) as year_built, regexp_extract(description, '# Bedrooms: ([0-9]+)', 1) as bedrooms, 6 as n from listings")
def extra_fields_to_map(s):
    rows = s.listings.select("seq", text.labels_to_map(F.element_at(F.split("description", r"\| "), -1)).alias("m"))
    return rows.select("seq", F.col("m")["year_built"].alias("year_built"), F.col("m")["bedrooms"].alias("bedrooms"), F.size("m").alias("n"))


@query("listings", "select seq, regexp_extract(name, '(0[0-9]+)$', 1) as zip, regexp_replace(regexp_replace(upper(split_part(name, ',', 1)), 'STREET', 'ST'), 'NORTH', 'N') as street from listings")
def address_key(s):
    key = text.address_key(F.split("name", ",")[0], F.col("name"))
    return s.listings.select("seq", key["zip"].alias("zip"), key["street"].alias("street"))


@query("properties", "select property_id, round_even(latitude, 6) as lat, round_even(longitude, 6) as lon from properties")
def coord_key(s):
    return s.properties.select("property_id", text.coord_key(F.col("latitude"), F.col("longitude")).alias("k")).select("property_id", "k.*")


@query("listings", "select seq, regexp_extract(name, '^([0-9]+)', 1) as house, trim(regexp_replace(regexp_replace(lower(regexp_extract(name, '^[0-9]+ ([^,]*)', 1)), 'street', 'st'), '^north', 'n')) as street from listings")
def parse_house_street(s):
    return s.listings.select("seq", text.house_number(F.col("name")).alias("house"), text.house_street(F.col("name")).alias("street"))


_HAVERSINE = "2 * 6371000.0 * asin(sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))"


@query("properties", f"select property_id, round({_HAVERSINE.format('42.0', '-71.0', 'latitude', 'longitude')}, 3) as metres from properties")
def haversine_m(s):
    return s.properties.select("property_id", F.round(text.haversine_m(F.lit(42.0), F.lit(-71.0), F.col("latitude"), F.col("longitude")), 3).alias("metres"))


@query("auction_events", "select event_id, new_value in ('sold back to mortgagee','3rd party purchase','sold','canceled','cancelled','withdrawn','bank buy back') as off_map, new_value in ('sold back to mortgagee','3rd party purchase','canceled','cancelled','withdrawn') as not_live, regexp_matches(lower(new_value), 'cancel|sold|third party|3rd party') as terminal from auction_events")
def status_predicates(s):
    c = F.col("new_value")
    return s.auction_events.select("event_id", status.off_map(c).alias("off_map"), status.not_live(c).alias("not_live"), status.terminal(c).alias("terminal"))


@query("auction_events", "select event_id, case event_id % 4 when 0 then 'postponed' when 1 then 'active' when 2 then 'cancelled' else lower(new_value) end as status, case event_id % 5 when 0 then 'active' when 1 then 'postponed' when 2 then 'cancelled' when 3 then 'sold' else 'active' end as by_source from auction_events")
def normalize_status(s):
    raw = F.expr("case event_id % 4 when 0 then ' Postponed to 8/21' when 1 then 'On_Time' when 2 then 'Canceled' else new_value end")
    source = F.expr("case event_id % 5 when 0 then 'sullivan' when 1 then 'patriot' when 2 then 'patriot' else 'skypoint' end")
    said = F.expr("case event_id % 5 when 0 then 'On' when 1 then 'yellow' when 2 then 'red' when 3 then 'SOLD 7/1' else 'NEW DATE 7/9' end")
    return s.auction_events.select("event_id", status.normalize_status(raw, F.when(F.col("event_id") % 4 == 1, "towne")).alias("status"), status.normalize_status(said, source).alias("by_source"))


@query("auction_events", "select event_id from auction_events where not (event_id % 5 = 2 and event_id % 3 <> 0)")
def skip_banner_rows(s):
    """Rows whose banner says that they were taken down do not reach the load."""
    source = F.when(F.col("event_id") % 5 == 2, "patriot").otherwise("towne")
    said = F.when(F.col("event_id") % 3 == 0, "banner yellow").otherwise("banner Red")
    return s.auction_events.where(~status.skipped(said, source)).select("event_id")


@query("listings", "select seq, split_part(name, ', ', 1) as street, split_part(name, ', ', 2) as city, substr(split_part(name, ', ', 3), 1, 2) as addr_state, substr(split_part(name, ', ', 3), 4) as zip, f.form, case when f.form = 'title' then concat(split_part(name, ', ', 1), ', Unit 2') else split_part(name, ', ', 1) end as form_street, split_part(name, ', ', 2) as form_city from listings, (select unnest(['gap', 'title', 'parts', 'blob', 'scan']) as form) f")
def split_address(s):
    """The plain form, and the others over the same addresses rewritten in each form."""
    part = lambda i: F.get(F.split("name", ", "), F.lit(i))
    town = F.concat(part(1), F.lit(", "), F.substring(part(2), 1, 2))
    texts = {
        "gap": F.concat(part(0), F.lit("   "), part(1), F.lit(", Upper County, "), part(2)), "title": F.concat(part(0), F.lit(", Unit 2, "), part(1), F.lit(", "), part(2), F.lit(" (NEW)")), "parts": F.col("name"), "blob": F.col("name"),
        "scan": F.concat(town, F.lit(" - Two Bedroom Cape "), part(0), F.lit(" 7,399 SF lot")),
    }
    plain = text.split_address(F.col("name"))
    forms = F.array(*(F.struct(F.lit(f).alias("form"), text.split_address(c, f)["street"].alias("form_street"), text.split_address(c, f)["city"].alias("form_city")) for f, c in texts.items()))
    return s.listings.select("seq", *(c.alias(k) for k, c in plain.items()), F.inline(forms))


@query("", "select o_orderkey, concat('Essex', o_orderkey % 5) as county, concat(o_custkey, '/', o_orderkey % 9, ' Deposit: $', o_custkey % 90 + 10, ',000') as book_page, concat(o_custkey % 90 + 10, ',000') as deposit, cast(o_custkey * 3 as varchar) as document, cast(o_custkey * 7 as varchar) as certificate from orders")
def registry_refs(s):
    found = text.registry_refs(F.expr("concat('Registry: Essex', o_orderkey % 5, ' Book / Page: ', o_custkey, '/', o_orderkey % 9, ' Deposit: $', o_custkey % 90 + 10, ',000')"))
    land = text.registry_refs(F.expr("concat('Registered land. Document # ', o_custkey * 3, ' Certificate No ', o_custkey, ', Certificate # ', o_custkey * 7)"))
    return s.orders.select("o_orderkey", *(found[k].alias(k) for k in ("county", "book_page", "deposit")), *(land[k].alias(k) for k in ("document", "certificate")))


@query("properties", "select property_id, state from properties where state in ('MA', 'NH')")
def target_state_filter(s):
    return digest.in_states(s.properties, ["MA", "NH"]).select("property_id", "state")


@query("properties", "select property_id from properties where not (status = 'sold back to mortgagee' and auction_datetime is not null and auction_datetime < TS'2024-01-31 00:00:00' - interval 14 day)")
def stale_sold_filter(s):
    said = F.when(F.col("status") == "sold back to mortgagee", "Sold ").otherwise(F.col("status"))
    return s.properties.where(~status.stale_sold(said, F.col("auction_datetime"), AS_OF)).select("property_id")


@query("listings", "select seq, replace(concat(url, '&a b|', name), ' ', '%20') as dirty, replace(replace(replace(concat(url, '&a b|é中%zz', name), '%zz', '%25zz'), ' ', '%20'), '|', '%7C').replace('é', '%C3%A9').replace('中', '%E4%B8%AD') as clean from listings")
def clean_url(s):
    raw = lambda x: F.concat("url", F.lit(x), "name")
    return s.listings.select("seq", F.replace(raw("&a b|"), F.lit(" "), F.lit("%20")).alias("dirty"), text.clean_url(raw("&a b|é中%zz")).alias("clean"))


@query("properties", f"select property_id, strftime(auction_datetime, '%b %-d %-I:%M %p') as short, strftime(auction_datetime, '%A, %B %-d') as day_header, strftime(auction_datetime, '%m/%d at %-I:%M %p') as digest_time, {_SHORT.format('t')} as report, case when coalesce(trim(t), '') = '' then '—' else coalesce(strftime(try_cast(t as timestamp), '%Y-%m-%d'), t) end as date_only from (select *, case property_id % 4 when 0 then '' when 1 then 'soon' when 2 then strftime(auction_datetime, '%Y-%m-%dT%H:%M:%S') else strftime(auction_datetime, '%Y-%m-%d %H:%M:%S') end as t from properties)")
def format_dates(s):
    c = F.col("auction_datetime")
    t = F.when(F.col("property_id") % 4 == 0, "").when(F.col("property_id") % 4 == 1, "soon").when(F.col("property_id") % 4 == 2, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return s.properties.select("property_id", dates.short(c).alias("short"), dates.day_header(c).alias("day_header"), dates.digest_time(c).alias("digest_time"), dates.report_time(t).alias("report"), dates.date_only(t).alias("date_only"))


@query("listings", f"select seq, concat_ws(' · ', property_type, bedrooms || ' bed', (case when bathrooms = floor(bathrooms) then cast(cast(bathrooms as bigint) as varchar) else cast(bathrooms as varchar) end) || ' bath', format('{{:,}}', sqft) || ' sf') as line from (select seq, {_SPECS} from listings)")
def spec_line(s):
    p = text.parse_description(F.col("description"))
    return s.listings.select("seq", text.spec_line(p["property_type"], p["bedrooms"], p["bathrooms"], p["sqft"]).alias("line"))


@query("properties", "select property_id, case when property_id % 3 = 0 then '' else concat('https://example.com/map?lat=', printf('%.6f', latitude), '&lon=', printf('%.6f', longitude)) end as link from properties")
def map_url(s):
    lat = F.when(F.col("property_id") % 3 != 0, F.col("latitude"))
    return s.properties.select("property_id", text.map_url("https://example.com/map", lat, F.col("longitude")).alias("link"))


@query("", "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from pages")
def escape_html(s):
    return s.pages.select("page_id", text.escape_html(F.col("html")).alias("html"))


@query("", "select c_custkey, 'MA' as geo_state, concat('Essex', c_nationkey) as county, concat('Town', c_nationkey) as municipality from customer")
def geography_fields(s):
    raw = F.expr("""concat('{"result":{"geographies":{"States":[{"STUSAB":"MA"}],"Counties":[{"NAME":"Essex', c_nationkey, ' County"}],"County Subdivisions":[{"NAME":"Town', c_nationkey, ' city"}]}}}')""")
    return s.customer.select("c_custkey", *(c.alias(k) for k, c in text.geography(raw).items()))


@query("", "select page_id, not (page_id % 9 = 0 or (page_id % 9 <> 1 and page_id % 7 = 0)) as alive from pages")
def soft_404(s):
    code = F.expr("case page_id % 9 when 0 then 404 when 1 then 503 else 200 end")
    html = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit("<p>We can’t find what you&rsquo;re looking for</p>"))).otherwise(F.col("html"))
    return s.pages.select("page_id", text.page_alive(code, html).alias("alive"))


@query("", "select c_custkey, case c_nationkey % 3 when 0 then 'MA' when 1 then 'NH' else 'ME' end || ',VT' as states from customer")
def normalize_state_list(s):
    raw = F.expr("concat(' ', case c_nationkey % 3 when 0 then 'ma' when 1 then 'Nh' else 'ME' end, ', ,vt, VT')")
    return s.customer.select("c_custkey", F.array_join(text.state_list(raw), ",").alias("states"))


_SEASONED = "coalesce(not (auction_datetime > TS'2024-01-31 00:00:00' + interval 7 day and last_seen_at < first_seen_at + interval 7 day), true)"


@query("properties", f"select property_id, {_SEASONED} as seasoned from properties")
def is_seasoned(s):
    return s.properties.select("property_id", aggregates.seasoned(AS_OF).alias("seasoned"))


_ACTIVE = f"auction_datetime is not null and not regexp_matches(lower(coalesce(status, '')), 'cancel|sold|third party|3rd party') and auction_datetime < TS'2024-01-31 00:00:00' + interval 30 day and ({_SEASONED} or auction_datetime < TS'2024-01-31 00:00:00' + interval 7 day)"


@query("properties", f"select property_id from properties where {_ACTIVE}")
def filter_active_listings(s):
    return digest.filter_active(s.properties, AS_OF).select("property_id")


_LABEL = "case when event_type = 'date_change' then concat(coalesce(strftime(try_cast(old_value as timestamp), '%Y-%m-%d'), nullif(trim(old_value), ''), '—'), ' → ', coalesce(strftime(try_cast(new_value as timestamp), '%Y-%m-%d'), nullif(trim(new_value), ''), '—')) else concat(event_type, ': ', coalesce(nullif(trim(new_value), ''), '—')) end"


@query("auction_events", f"select event_id, {_LABEL} as label from auction_events")
def change_label(s):
    return s.auction_events.select("event_id", aggregates.change_label().alias("label"))


@query("properties", "select property_id, auction_datetime < TS'2024-01-31 00:00:00' + interval 21 day as linked from properties")
def link_available(s):
    return s.properties.select("property_id", digest.link_available(AS_OF).alias("linked"))


@query("", "select page_id, round(((length(html) // 4 + 400) * 3.0 + 300 * 15.0) / 1e6, 6) as cost from pages")
def extraction_cost(s):
    return s.pages.select("page_id", F.round(text.extraction_cost(F.col("html")), 6).alias("cost"))


# pages


@query("", "select page_id, 0 as row, concat(page_id, '|', url) as cells from pages union all select page_id, 2, concat('a & b|', page_id % 5, ' x|') from pages union all select page_id, 4, '1|2' from pages where page_id % 3 = 0")
def page_table_rows(s):
    """Two tables before each page's own html, with a short row and one that is never closed; every third page needs the parser."""
    table = "concat('<table><tr><th>a</th><th>b</th></tr><tr><td>', page_id, '</td><td>', url, '</td></tr><TR class=\"x\"><td>short</td></tr><tr><td>a &amp; <b>b</b></td><td> ', page_id % 5, '\n x</td><td></td></tr><tr><td>open</td></table>'"
    more = f"{table}, case when page_id % 3 = 0 then '<p title=''>''></p><table><tr><td>x</td></tr><tr><td>1</td><td>2</td></tr></table>' else '' end, html)"
    return pages.table_rows(s.pages.withColumn("html", F.expr(more))).select("page_id", "row", F.array_join("cells", "|").alias("cells"))


@query("", r"select page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<(?:li|p)\b[^>]*>(.*?)</(?:li|p)>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: length(x) < 120 and regexp_matches(x, '^[^:]+:\s*\S')) as l, len(l) as n, array_to_string(l, '|') as labelled from pages".replace("as l, len(l) as n, array_to_string(l, '|') as labelled from pages", "as l from pages").join(["select page_id, len(l) as n, array_to_string(l, '|') as labelled from (", ")"]))
def page_label_values(s):
    found = pages.label_values(F.col("html"))
    return s.pages.select("page_id", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("labelled"))


@query("", "select page_id, array_to_string(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1), '; ') as links from pages")
def page_links(s):
    return s.pages.select("page_id", F.array_join(pages.page_links(F.col("html")), "; ").alias("links"))


#: As in HTML, these references also count without their semicolon, as where a page breaks off inside one.
_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query("", f"with a as (select page_id, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) as a from pages), b as (select page_id, {_TEXT.format(r"regexp_extract(a, '(?s)<h1>(.*?)</h1>', 1)")} as title, {_TEXT.format(r"regexp_replace(a, '(?s)<h1>.*?</h1>', ' ')")} as text from a) select page_id, 0 as ord, title, text from b where title <> ''")
def page_blocks(s):
    return pages.blocks(s.pages, ("article", "section", "div", "body")).select("page_id", "ord", "title", "text")


@query("", "select page_id, o_orderkey as block_id, concat('Lot ', o_orderkey) as title, case o_orderkey % 3 when 0 then '1/02/2024 at 10:30 AM' when 1 then '2/03/2024 at 11:00 AM' else '' end as date_time, case o_orderkey % 3 when 0 then 'postponed' when 1 then 'active' else 'sold' end as block_status from (select page_id, page_id * 2 + i as o_orderkey from pages, (select unnest([0, 1]) as i))")
def page_event_cards(s):
    """Two cards with an id, a date and a status before each page's own html, one of them twice, one without an id."""
    card = "'<article><h2>Lot ', {0}, '</h2><a href=\"/auction-calendar/', {0}, '\">x</a> ', case ({0}) % 3 when 0 then 'Postponed To: 1/02/2024 at 10:30 AM Original Date: 1/01/2024 at 9:00 AM' when 1 then 'Begins: 2/03/2024 at 11:00 AM' else 'SOLD' end, '</article>'"
    html = F.expr(f"concat({card.format('page_id * 2')}, {card.format('page_id * 2 + 1')}, {card.format('page_id * 2')}, '<article><h2>No id</h2>text</article>', html)")
    return pages.blocks(s.pages.withColumn("html", html), ("article",), r"/auction-calendar/(\d+)").select("page_id", F.col("block_id").cast("long").alias("block_id"), "title", "date_time", "block_status")


@query("", "with p as (select page_id, regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1) as l from pages) select page_id, unnest(l) as parcel from p where len(l) > 0 union all select page_id, null from p where len(l) = 0")
def expand_portfolio(s):
    return pages.expand_portfolio(s.pages, pages.page_links(F.col("html"))).select("page_id", "parcel")


@query("listings", "select l.seq, case when l.seq % 4 = 0 then 'sold' else l.status end as status from listings l")
def merge_detail(s):
    rows = s.listings.select("seq", "status")
    return pages.merge_detail(rows, rows.where(F.col("seq") % 2 == 0).select("seq", F.when(F.col("seq") % 4 == 0, "sold").otherwise("").alias("status")), "seq", ["status"])


_SITES = ("sullivan", "brockscott", "harmon", "patriot", "towne", "jjmanning", "landmark", "keenan", "skypoint")
#: A listing in each site's form, in SQL that both engines run; the page's own html follows.
_SNIPPETS = (
    "'<a href=\"/x?id=', page_id, '\">x</a><li>Year Built: 19', page_id % 90 + 10, '</li><a href=\"/doc/', page_id, '.pdf\">p</a><a href=\"https://d.example.com/b.PDF\">q</a>'",
    "'<div class=\"forecol\"><p>State:</p><p> M', page_id % 7, '</p></div><div class=\"col forecol\"><p><b>County</b></p> <p>Upper</p></div>'",
    "'<a href=\"/auction/', page_id, '/\">x</a><div class=\"blockAuction\"><h1>Lot ', page_id, '</h1>Postponed To: 1/2/2024 at 10:30 AM</div>'",
    "'<a class=\"auction-list\" href=\"?id=', page_id, '\"><div class=\"banner yellow\"></div></a>'",
    "'<table id=\"GridView1\"><tr><th>d</th></tr><tr><td>1/2</td><td>10</td><td>On_Time</td><td><a href=\"#\">', page_id, ' Oak St</a></td></tr></table>'",
    "'<h4 class=\"elementor-heading-title x\">no</h4><h4 class=\"elementor-heading-title\">Active</h4><div data-settings=\"&quot;acf_field_list&quot;:&quot;address&quot;\"><div class=\"dynamic-content-for-elementor-acf\">', page_id, ' Elm St</div></div>'",
    "'<h1 class=\"eventlist-title\"><a href=\"/e/', page_id, '\">Event ', page_id, '</a></h1><a href=\"t.pdf\">t</a>'",
    "'Deposit: $', page_id, ',000<br>Terms: cash or check<br>'",
    "'SP #', page_id % 9000 + 1000, 'A SOLD'",
)
_SITE_PAGES = f"select page_id, url, case page_id % 9 {' '.join(f'when {i} then {chr(39)}{n}{chr(39)}' for i, n in enumerate(_SITES))} end as source, case page_id % 9 {' '.join(f'when {i} then concat({x}, html)' for i, x in enumerate(_SNIPPETS))} end as html from {{pages}}"
_RULE_ROWS = ", ".join("('" + "', '".join(x.replace("'", "''") for x in r[:4]) + "')" for r in rules.SITE_RULES)


def _site_pages(s):
    return s.spark.sql(_SITE_PAGES, pages=s.pages)


@query("", f"with p as ({_SITE_PAGES.format(pages='pages')}), r(source, field, kind, pattern) as (values {_RULE_ROWS}) select page_id, p.source, field, nullif(trim(case kind when 'all' then array_to_string(regexp_extract_all(html, pattern, 1), '; ') else regexp_extract(html, pattern, 1) end), '') as value from p join r on p.source = r.source")
def extract_listings(s):
    """All fields of nine sources' pages, by one table of rules."""
    return rules.extract_listings(_site_pages(s), rules.site_rules(s.spark)).select("page_id", "source", F.explode("fields").alias("field", "value"))


_COLUMN = rf'class="(?:[^"]* )?forecol(?: [^"]*)?"[^>]*>\s*<p\b[^>]*>{pages.INSIDE}</p>\s*<p\b[^>]*>{pages.INSIDE}</p>'


@query("", f"with p as ({_SITE_PAGES.format(pages='pages')}), l as (select page_id, unnest(regexp_extract_all(html, '(?is){_COLUMN}', 1)) as a, unnest(regexp_extract_all(html, '(?is){_COLUMN}', 2)) as b from p) select page_id, regexp_replace(trim(regexp_replace(regexp_replace(a, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')), ':+$', '') as label, trim(regexp_replace(regexp_replace(b, '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) as value from l")
def page_label_pairs(s):
    """Label paragraphs with the value paragraphs after them."""
    return _site_pages(s).select("page_id", F.inline(pages.paragraph_pairs(F.col("html"), "forecol")))


@query("", f"with p as ({_SITE_PAGES.format(pages='pages')}), l as (select page_id, url, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) as link from p), r as (select *, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) as root from l where lower(link) like '%.pdf') select page_id, case when regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then link when starts_with(link, '/') then root || link else root || '/' || link end as document from r")
def page_documents(s):
    """Links to PDF files, absolute."""
    return _site_pages(s).select("page_id", F.explode(pages.documents(F.col("html"), F.col("url"))).alias("document"))


# joins

_LINKS_SQL = "links as (select property_id from properties where property_id % 11 = 0)"


def _links(s):
    return s.properties.where(F.col("property_id") % 11 == 0).select("property_id")


@query("properties auction_events", "select event_id, property_id, event_type, address from auction_events join properties using (auction_id)")
def events_with_property(s):
    return joins.events_with_property(s.auction_events, s.properties).select("event_id", "property_id", "event_type", "address")


@query("properties auctions", "select property_id, address, a.status, a.url, a.auction_datetime from (select property_id, address from properties) p join auctions a using (property_id)")
def current_listings(s):
    return joins.current_listings(s.properties.select("property_id", "address"), s.auctions).select("property_id", "address", "status", "url", "auction_datetime")


@query("properties", f"with {_LINKS_SQL} select property_id from properties where property_id not in (select property_id from links)")
def hide_duplicates(s):
    return joins.hide_duplicates(s.properties, _links(s)).select("property_id")


@query("properties auction_events", f"select property_id from properties p left join {_LAST} l on p.auction_id = l.auction_id where coalesce(last_type, '') <> 'disappeared'")
def drop_if_last_event_disappeared(s):
    return joins.drop_if_last_disappeared(s.properties, s.auction_events).select("property_id")


_PAIRS = f"""p as (select property_id, source, latitude, longitude, status, last_seen_at, regexp_extract(address, '^([0-9]+)', 1) as house, trim(regexp_replace(regexp_replace(lower(regexp_extract(address, '^[0-9]+ ([^,]*)', 1)), 'street', 'st'), '^north', 'n')) as street from properties),
pairs as (select a.property_id as a, b.property_id as b, a.status as sa, b.status as sb, a.last_seen_at as la, b.last_seen_at as lb, a.street = b.street as same, {_HAVERSINE.format('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as metres
from p a join p b on a.house = b.house and a.property_id < b.property_id and a.source <> b.source and abs(a.latitude - b.latitude) <= 0.0015 and abs(a.longitude - b.longitude) <= 0.0015)"""


@query("properties", f"with {_PAIRS} select a, b, round(metres, 3) as metres from pairs where metres <= 100")
def proximity_pairs(s):
    return joins.proximity_pairs(s.properties).select(F.col("a_property_id").alias("a"), F.col("b_property_id").alias("b"), F.round("metres", 3).alias("metres"))


def _loaded(s, which):
    """snapshot_1 on an empty state, then snapshot_2 on the result."""
    first = load.load_snapshot(s.snapshot_1, None, "2024-01-01 00:00:00", 1)
    return first if which == 1 else load.load_snapshot(s.snapshot_2, first.state, AS_OF, 2, 1_000_000_000, 1_000_000_000)


def _stored(s):
    """Both snapshots applied to a new store."""
    store = state.StateStore(s.spark, files.scratch(s.spark, "state"))
    streams.apply_snapshot(store, s.snapshot_1, "2024-01-01 00:00:00", "1")
    streams.apply_snapshot(store, s.snapshot_2, AS_OF, "2")
    return store


def _deduped(name):
    pairs = " or ".join(f"list_has_all(['{a}', '{b}'], srcs)" for a, b in dedup.CONFIRMED_PAIRS)
    rank = "case " + " ".join(f"when list_has_all(['{a}', '{b}'], srcs) then list_position(['{a}', '{b}'], source)" for a, b in dedup.CONFIRMED_PAIRS) + " end"
    return f"""{name}_w1 as (select * exclude (rn) from (select *, row_number() over (partition by source, listing_id order by auction_datetime desc nulls last, seq) as rn from {name}) where rn = 1),
{name}_k as (select *, round_even(latitude, 6) as ka, round_even(longitude, 6) as kb from {name}_w1),
{name}_g as (select ka, kb, list(distinct source) as srcs, count(*) as n from {name}_k group by ka, kb),
{name}_r as (select k.*, case when n > 1 and ({pairs}) then row_number() over (partition by k.ka, k.kb order by {rank}, seq) else 1 end as pick from {name}_k k join {name}_g g on k.ka = g.ka and k.kb = g.kb),
{name}_d as (select * from {name}_r where pick = 1)"""


_DIFF = f"""{_deduped('snapshot_1')}, {_deduped('snapshot_2')}, j as (select n.source, n.listing_id, o.listing_id as old_id, o.status as s1, n.status as s2, o.auction_datetime as d1, n.auction_datetime as d2 from snapshot_2_d n left join snapshot_1_d o on n.source = o.source and n.listing_id = o.listing_id),
gone as (select o.source, o.listing_id, o.status from snapshot_1_d o where source in (select source from snapshot_2_d) and not exists (select 1 from snapshot_2_d n where n.source = o.source and n.listing_id = o.listing_id)),
ev as (select source, listing_id, 'first_seen' as event_type, null as old_value, s2 as new_value from j where old_id is null
union all select source, listing_id, 'status_change', s1, s2 from j where old_id is not null and s1 is distinct from s2
union all select source, listing_id, 'date_change', strftime(d1, '%Y-%m-%dT%H:%M:%S'), strftime(d2, '%Y-%m-%dT%H:%M:%S') from j where old_id is not null and d1 is distinct from d2
union all select source, listing_id, 'disappeared', status, null from gone)"""


def _changes(s):
    """(source, listing_id, event_type, old_value, new_value) of the second snapshot against the state of the first, with no next state."""
    rows = load.one_source(files.kept(dedup.latest_per_listing(s.snapshot_2.select(*load.KEYS, "seq", "latitude", "longitude", "status", "auction_datetime")), "latest"))
    return load.compared(rows, _loaded(s, 1).state, load.sources_of(s.snapshot_2)).select("source", "listing_id", F.inline("made"))


@query("snapshot_1 snapshot_2", f"with {_DIFF} select source, listing_id, event_type, old_value, new_value from ev where event_type <> 'disappeared'")
def snapshot_diff(s):
    return _changes(s).where(F.col("event_type") != "disappeared")


@query("snapshot_1 snapshot_2", f"with {_DIFF} select source, listing_id from gone")
def detect_disappeared(s):
    return _changes(s).where(F.col("event_type") == "disappeared").select("source", "listing_id")


def _geo(s):
    rows = s.properties.select(F.concat("source", F.lit(":"), "listing_id").alias("id"), "address", "property_id", "latitude", "longitude")
    overrides = rows.where(F.col("property_id") % 13 == 0).select("id", F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"))
    cache = rows.where(F.col("property_id") % 3 == 0).groupBy("address").agg(F.min("latitude").alias("latitude"), F.min("longitude").alias("longitude"))
    return rows, overrides, cache


_CACHE_SQL = "c as (select address, min(latitude) as clat, min(longitude) as clon from properties where property_id % 3 = 0 group by address)"


@query("properties", f"with {_CACHE_SQL} select property_id, case when property_id % 13 = 0 then 1.5 else clat end as latitude, case when property_id % 13 = 0 then 'override' when clat is not null then 'cache' end as resolved_by from properties left join c using (address)")
def geocode_resolve(s):
    return joins.geocode_resolve(*_geo(s)).select("property_id", "latitude", "resolved_by")


@query("properties", f"with {_CACHE_SQL}, b as (select address, 7.0 as blat from properties group by address having min(property_id) % 2 = 0), t as (select address, 9.0 as slat from properties group by address having min(property_id) % 3 <> 1) select property_id, coalesce(blat, slat) as latitude, coalesce(clat, blat, slat) as cached from properties left join b using (address) left join t using (address) left join c using (address)")
def apply_geocode_results(s):
    rows, _, cache = _geo(s)
    first = rows.groupBy("address").agg(F.min("property_id").alias("p"))
    batch = first.where(F.col("p") % 2 == 0).select("address", F.lit(7.0).alias("latitude"), F.lit(8.0).alias("longitude"))
    single = first.where(F.col("p") % 3 != 1).select("address", F.lit(9.0).alias("latitude"), F.lit(8.5).alias("longitude"))
    longer = joins.extend_cache(cache, batch, single).select("address", F.col("latitude").alias("cached"))
    return joins.apply_geocodes(rows, batch, single).join(longer, "address", "left").select("property_id", "latitude", "cached")


@query("properties", "select property_id from properties where not (property_id % 2 = 0 and last_seen_at > TS'2024-01-31 00:00:00' - interval 1 day)")
def detail_fetch_list(s):
    rows = s.properties.select(F.col("property_id").alias("id"))
    cache = s.properties.where(F.col("property_id") % 2 == 0).select(F.col("property_id").alias("id"), F.col("last_seen_at").alias("scraped_at"))
    return joins.detail_fetch_list(rows, cache, AS_OF).select(F.col("id").alias("property_id"))


def _texts(s):
    rows = s.documents.select(F.col("doc_id").alias("id"), "text")
    return rows, rows.where(F.col("id") % 2 == 0).select("id", F.sha2(F.when(F.col("id") % 4 == 0, F.col("text")).otherwise("old"), 256).alias("digest"))


@query("", "select doc_id as id, sha256(text) as digest from documents where doc_id % 4 <> 0")
def changed_text(s):
    return joins.changed_text(*_texts(s)).select("id", "digest")


@query("", "select source || ':' || doc_id as id, sha256(text) as digest, doc_id % 4 <> 0 as hit, true as again, case when doc_id % 4 = 0 then 2 else 1 end as run_id, length(text)::varchar as said from documents")
def extract_cache(s):
    """Three runs over all documents: every fourth one has changed before the second, none before the third."""
    rows = s.documents.select(F.concat("source", F.lit(":"), "doc_id").alias("id"), "text", "doc_id")
    old = rows.withColumn("text", F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text")))
    fields = lambda df: df.select("id", F.create_map(F.lit("length"), F.length("text").cast("string")).alias("fields"))
    store = state.StateStore(s.spark, files.scratch(s.spark, "extract-cache"))
    cache.cached_fields(store, old, fields, 1)
    second, third = cache.cached_fields(store, rows, fields, 2), cache.cached_fields(store, rows, fields, 3)
    entries = store.read("extracted", cache.CACHE).select("id", "run_id")
    return second.join(third.select("id", F.col("hit").alias("again"), F.col("fields")["length"].alias("said")), "id").join(entries, "id").select("id", "digest", "hit", "again", "run_id", "said")


@query("auction_events", "with d as (select auction_id, run_id, arg_min(new_value, event_id) as new_date from auction_events where event_type = 'date_change' group by all) select event_id, new_date from auction_events e left join d on e.auction_id = d.auction_id and e.run_id = d.run_id where event_type = 'status_change' and new_value = 'postponed'")
def postponed_with_new_date(s):
    return joins.postponed_with_new_date(s.auction_events).select("event_id", "new_date")


_REMOVED = "(event_type = 'disappeared' or (event_type = 'status_change' and regexp_matches(lower(coalesce(new_value, '')), 'cancel|sold|third party|3rd party')))"


@query("auction_events notifications", f"with f as (select email, min(sent_at) as first_sent from notifications group by email), r as (select event_id, concat('user', auction_id % 100, '@example.com') as email, detected_at from auction_events where {_REMOVED}) select event_id, email from r join f using (email) where first_sent < detected_at")
def removed_gate(s):
    rows = s.auction_events.where(aggregates.is_removal()).select("event_id", F.expr("concat('user', auction_id % 100, '@example.com')").alias("email"), F.col("detected_at").alias("removed_at"))
    return joins.removed_gate(rows, s.notifications).select("event_id", "email")


@query("saved_properties auction_events notifications", "with n as (select email, max(sent_at) as t from notifications where kind = 'saved' group by email) select s.email, event_id, property_id from saved_properties s join auction_events e on e.auction_id = s.property_id left join n on n.email = s.email where event_type in ('date_change','disappeared','status_change') and detected_at > coalesce(t, TS'2024-01-31 00:00:00' - interval 8 day)")
def saved_property_changes(s):
    return joins.saved_changes(s.saved_properties, s.auction_events, s.notifications, AS_OF).select("email", "event_id", "property_id")


_PEOPLE = "e as (select distinct email, state from subscribers join subscriber_states using (subscriber_id) where active and alerts and subscription_status in ('active','trialing'))"


@query("subscriber_states subscribers properties auction_events", f"with {_PEOPLE}, r as (select state, 'Listing' as section, property_id, null::bigint as event_id, epoch_us(auction_datetime) as o from properties union all select state, 'Change', property_id, event_id, -epoch_us(detected_at) from auction_events v join properties p on v.auction_id = p.auction_id where detected_at >= TS'2024-01-24 00:00:00'), x as (select email, section, row_number() over (partition by email, section order by o nulls first, property_id, event_id) as rank, count(*) over (partition by email, section) as n, state, property_id, event_id from e join r using (state)) select email, section, rank, greatest(n - 25, 0) as more, state, property_id, event_id from x where rank <= 25")
def subscriber_fanout(s):
    """Every eligible subscriber with the first listings and changes of their states."""
    return digest.listings_and_changes(s.subscribers, s.subscriber_states, s.properties, s.auction_events, AS_OF)


@query("subscriber_states subscribers properties", "select state, sum(n) * any_value(m) as n from (select state, count(*) as n from subscriber_states where subscriber_id in (select subscriber_id from subscribers where active and alerts and subscription_status in ('active','trialing')) group by state) join (select state, count(*) as m from properties group by state) using (state) group by state")
def subscriber_fanout_whole(s):
    """Every eligible subscriber with every listing of their states, counted a state."""
    return joins.fan_out_counts(s.subscriber_states, digest.eligible(s.subscribers), s.properties)


@query("webhook_events subscribers", "select seq, email from webhook_events left join subscribers using (subscription_id)")
def billing_to_subscriber(s):
    return joins.billing_to_subscriber(s.webhook_events, s.subscribers).select("seq", "email")


_SAVE = "with e as (select subscriber_id, email from subscribers where active and alerts and subscription_status in ('active','trialing')), q as (select distinct email, l_orderkey as property_id from lineitem join e on l_suppkey = subscriber_id), n as (select * from q where property_id in (select property_id from properties) and not exists (select 1 from saved_properties s where s.email = q.email and s.property_id = q.property_id)), a as (select email, property_id, null as address, null as status from saved_properties union all select n.email, n.property_id, address, status from n join properties p using (property_id))"


def _saved(s):
    """Requests are the line items' suppliers and orders."""
    people = digest.eligible(s.subscribers)
    asked = s.lineitem.select(F.col("l_suppkey").alias("subscriber_id"), F.col("l_orderkey").alias("property_id")).join(people.select("subscriber_id", "email"), "subscriber_id")
    return joins.save_property(s.saved_properties, asked, people, s.properties, AS_OF)


@query("saved_properties subscribers properties", f"{_SAVE} select email, property_id, address, status from a")
def save_property(s):
    return _saved(s).select("email", "property_id", "address", "status")


@query("saved_properties subscribers properties", f"{_SAVE} select email, property_id from a where property_id % 3 <> 0")
def forget_property(s):
    gone = s.lineitem.where(F.col("l_orderkey") % 3 == 0).select(F.concat(F.lit("user"), F.col("l_suppkey").cast("string"), F.lit("@example.com")).alias("email"), F.col("l_orderkey").alias("property_id"))
    return joins.forget_property(_saved(s), gone).select("email", "property_id")


@query("saved_properties subscribers properties", f"{_SAVE} select email, property_id from a")
def save_property_whole(s):
    return _saved(s).select("email", "property_id")


# aggregates


@query("properties", "select status, count(*) as n from properties group by status")
def status_counts(s):
    return aggregates.status_counts(s.properties)


_OUT = f"x as (select *, {_OFF} as off, not {_OFF} and (latitude is null or longitude is null) as blind, not {_OFF} and {_OLD} as old, not {_OFF} and latitude is not null and longitude is not null and coalesce(last_type = 'disappeared', false) as lost, property_id % 11 = 0 as hid from (select p.* replace (case when property_id % 17 = 0 then null else latitude end as latitude), l.last_type from properties p left join {_LAST} l on p.auction_id = l.auction_id))"


def _some_blind(s):
    return s.properties.withColumn("latitude", F.when(F.col("property_id") % 17 != 0, F.col("latitude")))


@query("properties auction_events", f"with {_OUT} select count(*) as total, count_if(not (off or old or lost or hid or blind)) as exported, count_if(off or old or lost or hid or blind) as excluded_total, (select string_agg(concat(status, '=', n), ', ' order by concat(status, '=', n)) from (select status, count(*) as n from x where off group by status)) as by_status, count_if(blind) as missing_coords, count_if(hid) as duplicate, count_if(lost) as disappeared, count_if(old) as stale from x")
def exclusion_accounting(s):
    return aggregates.exclusion_accounting(_some_blind(s), s.auction_events, _links(s), AS_OF)


@query("auction_events", "select auction_id, count(*) as times_postponed, arg_min(old_value, event_id) as original_date from auction_events where event_type = 'date_change' group by auction_id")
def times_postponed(s):
    return aggregates.postponements(s.auction_events)


@query("properties", "select property_id, 0 as ord, url as link from properties union all select property_id, 1, concat(url, '.pdf') from properties")
def pdf_links(s):
    return aggregates.pdf_links(s.properties.withColumn("pdf_links", F.concat("url", F.lit("; ;"), "url", F.lit(".pdf ;"))))


@query("snapshot_1 snapshot_2", f"with {_DIFF}, x as (select 1 as run_id, (select count(*) from snapshot_1_d) as found, (select count(*) from snapshot_1_d) as new, 0 as changed, 0 as removed, 0 as failed, (select count(*) from snapshot_1_w1) - (select count(*) from snapshot_1_d) as cross_dropped union all select 2, (select count(*) from snapshot_2_d), (select count(*) from j where old_id is null), (select count(*) from j where old_id is not null and (s1 is distinct from s2 or d1 is distinct from d2)), (select count(*) from gone), 0, (select count(*) from snapshot_2_w1) - (select count(*) from snapshot_2_d)) select * from x")
def run_summary(s):
    return _stored(s).read("runs", load.RUNS).select("run_id", "found", "new", "changed", "removed", "failed", "cross_dropped")


@query("auction_events properties", "select event_type, address, event_id from auction_events join (select auction_id, address from properties) using (auction_id) where run_id = 1 and event_type in ('first_seen','status_change','date_change','disappeared')")
def change_sections(s):
    return aggregates.change_sections(s.auction_events, s.properties, 1).select("event_type", "address", "event_id")


def _groups(keys="address", extra=""):
    return f"""g as (select {keys}, arg_max(property_id, (detected_at, event_id)) as property_id, arg_max({_SEASONED}, (detected_at, event_id)) as seasoned, bool_or(event_type = 'first_seen') as was_new, bool_or({_REMOVED}) as was_removed,
bool_or(event_type in ('date_change', 'price_change')) as other, bool_or(event_type = 'date_change') as dated, max(detected_at) filter (where {_REMOVED}) as removed_at,
list({_LABEL} order by detected_at desc, event_id desc) filter (where event_type <> 'first_seen' and event_type <> 'disappeared' and event_type <> 'status_change') as labels from ch group by {keys}),
cg as (select * replace (array_to_string(list_filter(labels, lambda x, i: list_position(labels, x) = i), '|') as labels), case when was_removed then 'Removed' when was_new and not other then 'New' when dated then 'Date Changes' else 'Status Changes' end as category from g where seasoned and not (was_new and was_removed) and (was_removed or was_new or labels is not null))"""


_CHANGES = "ch as (select e.*, p.* exclude (auction_id) from auction_events e join properties p on e.auction_id = p.auction_id)"


@query("auction_events properties", f"with {_CHANGES}, {_groups()} select address, category, property_id, removed_at, case when category in ('Removed', 'New') then category when was_new then concat('New|', labels) else labels end as labels from cg")
def change_groups(s):
    found = aggregates.change_groups(joins.events_with_property(s.auction_events, s.properties), AS_OF)
    return found.select("address", "category", "property_id", "removed_at", F.array_join("labels", "|").alias("labels"))


@query("", "select count_if(doc_id % 4 = 0) as hits, count_if(doc_id % 4 <> 0) as misses, round(sum(case when doc_id % 4 <> 0 then ((length(text) // 4 + 400) * 3.0 + 300 * 15.0) / 1e6 else 0 end), 6) as cost from documents")
def extraction_stats(s):
    return aggregates.extraction_stats(*_texts(s))


@query("notifications", "select email, kind, max(sent_at) as last_sent from notifications group by grouping sets ((email), (email, kind))")
def last_sent(s):
    return aggregates.last_sent(s.notifications)


@query("notifications", "select email, kind, count(*) as sent from notifications group by all")
def sent_counts(s):
    return aggregates.sent_counts(s.notifications)


@query("subscribers notifications", "select p.email, count(n.email) as sent, count(n.email) > 0 as ever_sent from subscribers p left join notifications n on n.email = p.email and n.kind = 'weekly' group by p.email")
def ever_sent(s):
    return aggregates.ever_sent(s.subscribers.select("email"), s.notifications, "weekly")


_TOLD = "k as (select *, case when event_id % 2 = 0 then upper(new_value) else new_value end as said from auction_events), told as (select p.property_id, event_id from k join properties p using (auction_id) where event_type = 'status_change' and lower(said) in ('sold back to mortgagee','3rd party purchase','sold','canceled','cancelled','withdrawn','bank buy back') and detected_at >= TS'2024-01-24 00:00:00' and detected_at < TS'2024-01-31 00:00:00'), old as (select property_id from properties where last_seen_at >= TS'2024-01-10 00:00:00' and last_seen_at < TS'2024-01-17 00:00:00' and lower(status) not in ('sold back to mortgagee','3rd party purchase','sold','canceled','cancelled','withdrawn','bank buy back') and property_id not in (select property_id from told))"


def _shouted(s):
    """The events, every second one with its new value in capitals."""
    return s.auction_events.withColumn("new_value", F.when(F.col("event_id") % 2 == 0, F.upper("new_value")).otherwise(F.col("new_value")))


@query("properties auction_events", f"with {_TOLD}, u as (select count(*) as n_upcoming from properties where auction_datetime between TS'2024-01-31 00:00:00' and TS'2024-02-07 00:00:00'), e as (select count_if(event_type = 'first_seen') as n_new, count_if(event_type = 'status_change' and lower(said) = 'postponed') as n_postponed from k where detected_at >= TS'2024-01-24 00:00:00' and auction_id in (select auction_id from properties)), c as (select (select count(*) from told) + (select count(*) from old) as n_cancelled) select *, concat('Auction watch: ', n_upcoming, ' auction(s) this week', case when n_cancelled > 0 then concat(', ', n_cancelled, ' cancelled') else '' end) as subject from u, e, c")
def digest_counts(s):
    """Of the week ahead and the week behind."""
    events = _shouted(s)
    recent = events.where(F.col("detected_at") >= digest.at(WEEK_AGO))
    return aggregates.digest_counts(digest.upcoming_auctions(s.properties, AS_OF), recent, s.properties, digest.removed_union(events, s.properties, WEEK_AGO, AS_OF))


@query("listings", "select sources, count(*) as points from (select array_to_string(list_sort(list(distinct source)), ',') as sources from listings group by round_even(latitude, 6), round_even(longitude, 6)) group by sources")
def sources_present(s):
    return aggregates.sources_present(s.listings, text.coord_key(F.col("latitude"), F.col("longitude"))).groupBy("sources").agg(F.count(F.lit(1)).alias("points"))


# rankings


@query("listings", "select source, listing_id, seq from (select *, row_number() over (partition by source, listing_id order by auction_datetime desc nulls last, seq) as rn from listings) where rn = 1")
def dedup_latest_per_listing(s):
    return dedup.latest_per_listing(s.listings).select("source", "listing_id", "seq")


@query("listings", f"with {_deduped('listings')} select seq, source from listings_d")
def dedup_cross_source_coords(s):
    return load.deduplicate(s.listings).select("seq", "source")


def _addresses():
    # the address key is (zip, street, unit); at these rows it is the normalised name
    pairs = " or ".join(f"list_has_all(['{a}', '{b}'], srcs)" for a, b in dedup.CONFIRMED_PAIRS)
    rank = "case " + " ".join(f"when list_has_all(['{a}', '{b}'], srcs) then list_position(['{a}', '{b}'], source)" for a, b in dedup.CONFIRMED_PAIRS) + " end"
    return f"""k as (select *, concat(right(name, 5), regexp_replace(regexp_replace(upper(split_part(name, ',', 1)), 'STREET', 'ST'), 'NORTH', 'N')) as key from listings), g as (select key, list(distinct source) as srcs, count(*) as n from k group by key),
r as (select k.*, case when n > 1 and ({pairs}) then row_number() over (partition by k.key order by {rank}, seq) else 1 end as pick from k join g on k.key = g.key)"""


@query("listings", f"with {_addresses()} select seq, source from r where pick = 1")
def dedup_cross_source_address(s):
    return dedup.cross_source(s.listings, text.address_key(F.split("name", ",")[0], F.col("name"))).select("seq", "source")


@query("listings", "select source, listing_id, seq from (select *, row_number() over (partition by source, listing_id order by case status when 'active' then 3 when 'postponed' then 2 when 'cancelled' then 1 else 0 end desc, seq) as rn from listings) where rn = 1")
def merge_by_status_priority(s):
    return dedup.merge_by_status(s.listings, ["source", "listing_id"], {"active": 3, "postponed": 2, "cancelled": 1}).select("source", "listing_id", "seq")


@query("auction_events", "select auction_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from auction_events group by auction_id")
def latest_event(s):
    return dedup.latest_event(s.auction_events).select("auction_id", "event_id", "event_type")


_CANON = """c as (select case when w then b else a end as hid, case when w then a else b end as can, case when w then (la_live, la, -a) else (lb_live, lb, -b) end as r from (
select *, (la_live, la, -a) > (lb_live, lb, -b) as w from (select *, (sa not in ('sold back to mortgagee','3rd party purchase','canceled','cancelled','withdrawn'))::int as la_live, (sb not in ('sold back to mortgagee','3rd party purchase','canceled','cancelled','withdrawn'))::int as lb_live from pairs where metres <= 100 and same)))"""


@query("properties", f"with {_PAIRS}, {_CANON} select hid as property_id, arg_max(can, r) as canonical_id from c group by hid")
def choose_canonical(s):
    return links.link_candidates(s.properties).select("property_id", "canonical_id")


@query("properties", f"with u as (select * from properties where {_ACTIVE}) select state, property_id, rank, greatest(n - 5, 0) as more from (select state, property_id, row_number() over (partition by state order by auction_datetime, property_id) as rank, count(*) over (partition by state) as n from u) where rank <= 5")
def cap_with_remainder(s):
    return dedup.cap_with_remainder(digest.filter_active(s.properties, AS_OF), ["state"], 5, F.col("auction_datetime"), F.col("property_id")).select("state", "property_id", "rank", "more")


@query("properties", "select property_id, cast(cast(auction_datetime as date) as varchar) as day, dense_rank() over (order by cast(auction_datetime as date)) as bucket from properties")
def group_by_day(s):
    return dedup.day_buckets(s.properties, "auction_datetime").select("property_id", F.col("day").cast("string").alias("day"), "bucket")


# order, limits, unions


@query("properties", "select property_id, auction_datetime from properties order by auction_datetime nulls first, property_id")
def order_by_auction_time(s):
    return s.properties.select("property_id", "auction_datetime").orderBy(F.col("auction_datetime").asc_nulls_first(), "property_id")


@query("properties auction_events", f"with {_OUT}, r as (select 'missing_coords' as reason, property_id from x where blind union all select 'disappeared', property_id from x where lost union all select 'stale', property_id from x where old) select reason, property_id, rank from (select *, row_number() over (partition by reason order by property_id) as rank from r) where rank <= 25")
def capped_sample(s):
    return export.excluded_sample(_some_blind(s), s.auction_events, _links(s), AS_OF).select("reason", "property_id", "rank")


@query("auction_events", "select event_id, detected_at, row_number() over (order by detected_at desc, event_id desc) as place from auction_events")
def order_changes(s):
    """Newest first; the place in the order, by ranges."""
    newest = [F.desc_nulls_last("detected_at"), F.desc_nulls_last("event_id")]
    return joins.placed(s.auction_events.select("event_id", "detected_at"), newest).withColumn("place", (F.col("place") + 1).cast("long"))


@query("saved_properties auction_events", "with e as (select auction_id, max(detected_at) as saved_at from auction_events group by auction_id) select email, property_id, saved_at, row_number() over (partition by email order by saved_at desc, property_id) as place from saved_properties join e on auction_id = property_id")
def order_saved(s):
    """Each subscriber's saved list, the last saved first."""
    at = s.auction_events.groupBy(F.col("auction_id").alias("property_id")).agg(F.max("detected_at").alias("saved_at"))
    return dedup.newest_first(s.saved_properties.join(at, "property_id"), "email", "saved_at", "property_id").select("email", "property_id", "saved_at", "place")


@query("webhook_events subscribers", f"with o as (select event_id, arg_min(seq, seq) as seq, arg_min(event_time, seq) as event_time, arg_min(subscription_id, seq) as subscription_id, arg_min(kind, seq) as kind, arg_min(invoice_id, seq) as invoice_id from webhook_events group by event_id), i as (select invoice_id, arg_min(email, (event_time, event_id)) as email, arg_min(epoch_ms(date_trunc('second', event_time)), (event_time, event_id)) as paid_ms from o join subscribers using (subscription_id) where kind = 'invoice_paid' group by invoice_id) select email, invoice_id, row_number() over (partition by email order by paid_ms desc, invoice_id) as place from i")
def order_invoices(s):
    """Each subscriber's invoices, the last paid first."""
    return dedup.newest_first(billing.invoice_ledger(s.webhook_events, s.subscribers), "email", "paid_ms", "invoice_id").select("email", "invoice_id", "place")


@query("auction_events properties", f"with {_CHANGES}, {_groups()} select case category when 'New' then 1 when 'Date Changes' then 2 when 'Status Changes' then 3 else 4 end as category_rank, address from cg")
def union_categories(s):
    return aggregates.change_groups(joins.events_with_property(s.auction_events, s.properties), AS_OF).select(F.col("category_rank").cast("int").alias("category_rank"), "address")


@query("properties auction_events", f"with {_TOLD} select property_id, event_id, 'status' as reason from told union all select property_id, null, 'stale' from old")
def removed_union(s):
    return digest.removed_union(_shouted(s), s.properties, WEEK_AGO, AS_OF)


# end to end


@query("snapshot_1 snapshot_2", f"with {_DIFF} select source, listing_id, event_type, old_value, new_value from ev")
def load_snapshot(s):
    done = _loaded(s, 2)
    return done.events.join(done.state.select("auction_id", "source", "listing_id"), "auction_id").select("source", "listing_id", "event_type", "old_value", "new_value")


_REPORT = """t as (select *, case event_type when 'status_change' then 1 when 'date_change' then 2 when 'first_seen' then 3 else 4 end as section from ev join (select source as so, listing_id as li, coalesce(o.name, n.name) as address from snapshot_2_d n full join snapshot_1_d o using (source, listing_id)) on so = source and li = listing_id),
l as (select section, concat('  ', case event_type when 'status_change' then concat(rpad(address, 40, ' '), ' ', coalesce(old_value, '-'), ' -> ', coalesce(new_value, '-')) when 'date_change' then concat(rpad(address, 40, ' '), ' ', SHORT_OLD, ' -> ', SHORT_NEW) else address end) as line from t
  union all select 5, concat('  row ', seq, ' (', coalesce(name, 'unknown'), '): no coordinates or no listing id') from blind),
c as (select section, title, (select count(*) from l where l.section = x.section) as n from (select unnest([1, 2, 3, 4, 5]) as section, unnest(['Status changes', 'Auction date changes', 'New listings', 'Removed', 'Failed rows']) as title) x),
r as (select (select count(*) from snapshot_2_d) as found, (select count(*) from snapshot_2_w1) - (select count(*) from snapshot_2_d) as dupes, (select count(*) from j where old_id is null) as new, (select count(*) from j where old_id is not null and (s1 is distinct from s2 or d1 is distinct from d2)) as changed, (select count(*) from gone) as removed, (select count(*) from blind) as failed)
select section, line from l union all select section, concat(title, ' (', n, ')') from c union all select section, repeat('-', length(concat(title, ' (', n, ')'))::int) from c union all select section, '  (none)' from c where n = 0
union all select 0, unnest(['Run:                   2', 'Started:               2024-01-31 00:00:00', 'Summary', '-------', concat('Listings processed:    ', found), concat('Cross-source dupes:    ', dupes), concat('New properties:        ', new), concat('Changed auctions:      ', changed), concat('Removed listings:      ', removed), concat('Failed rows:           ', failed)]) from r"""


@query("snapshot_1 snapshot_2", f"with {_DIFF}, blind as (select * from snapshot_2 where seq % 19 = 0), {_REPORT.replace('SHORT_OLD', _SHORT.format('old_value')).replace('SHORT_NEW', _SHORT.format('new_value'))}")
def import_report(s):
    """The report of the second of two loads, with rows that lack coordinates, written as text and read back."""
    first = load.load_snapshot(s.snapshot_1, None, "2024-01-01 00:00:00", 1)
    blind = s.snapshot_2.where(F.col("seq") % 19 == 0).withColumn("latitude", F.lit(None).cast("double")).withColumn("listing_id", F.lit(None).cast("string"))
    done = load.load_snapshot(s.snapshot_2.unionByName(blind), first.state, AS_OF, 2, 1_000_000_000, 1_000_000_000, carried=["address"])
    report = files.kept(files.import_report(done.changes, None, done.run, done.rejects.select("seq", "name"), 2), "report-rows")
    path = files.scratch(s.spark, "report")
    files.write_report(report, path)
    return report.select("section", "line")


@query("snapshot_1 snapshot_2", f"with {_DIFF}, k as (select source, listing_id, pdf_links as l from snapshot_1_d union all select n.source, n.listing_id, n.pdf_links from snapshot_2_d n join j on n.source = j.source and n.listing_id = j.listing_id where old_id is null), u as (select source, listing_id, unnest(list_filter(list_transform(string_split(l, ';'), lambda x: trim(x)), lambda x: x <> '')) as link from k) select source, listing_id, link from u")
def load_pdf_links(s):
    store = _stored(s)
    return store.read("links", load.LINKS).join(store.read("state", load.STATE).select("auction_id", "source", "listing_id"), "auction_id").select("source", "listing_id", "link")


@query("snapshot_1 snapshot_2", f"with {_deduped('snapshot_1')}, {_deduped('snapshot_2')}, x as (select coalesce(n.source, o.source) as source, coalesce(n.listing_id, o.listing_id) as listing_id, coalesce(n.status, o.status) as status, coalesce(o.name, n.name) as address, case when n.source is null then o.county else coalesce(n.county, '') end as county, coalesce(n.description, o.description) as description, case when n.source is null then o.municipality else coalesce(n.municipality, '') end as municipality, case when o.source is null then TS'2024-01-31 00:00:00' else timestamp '2024-01-01 00:00:00' end as first_seen_at, case when n.source is null then timestamp '2024-01-01 00:00:00' else TS'2024-01-31 00:00:00' end as last_updated_at from snapshot_2_d n full join snapshot_1_d o on n.source = o.source and n.listing_id = o.listing_id) select x.* exclude (description), {_SPECS} from x")
def state_store(s):
    """Read back from the store after both snapshots."""
    return _stored(s).read("state", load.STATE).select("source", "listing_id", "status", "address", "county", "municipality", "first_seen_at", "last_updated_at", "bedrooms", "sqft", "bathrooms", "year_built", "property_type", "lot_size_raw")


@query("properties", f"with {_PAIRS}, {_CANON}, f as (select hid as property_id, arg_max(can, r) as canonical_id from c group by hid) select f.property_id, canonical_id, case when p.address like '% Forest %' and (f.property_id % 3 = 0) <> (canonical_id % 3 = 0) then round(18 / 19.0::double, 6) else 1 end as similarity from f join properties p on p.property_id = f.property_id")
def link_duplicates(s):
    """Every third record of one street has its name misspelt."""
    rows = s.properties.withColumn("address", F.when(F.col("property_id") % 3 == 0, F.replace("address", F.lit("Forest"), F.lit("Forrest"))).otherwise(F.col("address")))
    return links.link_duplicates(rows).select("property_id", "canonical_id", F.round("similarity", 6).alias("similarity"))


_STORED = f"""st as (select coalesce(o.source, n.source) as source, coalesce(o.listing_id, n.listing_id) as listing_id, coalesce(o.name, n.name) as address, coalesce(o.latitude, n.latitude) as latitude, coalesce(o.longitude, n.longitude) as longitude,
  case when n.source is null then o.status else n.status end as status, n.source is not null as last_seen_at, row_number() over (order by o.source is null, coalesce(o.seq, n.seq)) as property_id from snapshot_2_d n full join snapshot_1_d o on n.source = o.source and n.listing_id = o.listing_id), {_PAIRS.replace('from properties)', 'from st)')}"""


@query("snapshot_1 snapshot_2", f"with {_deduped('snapshot_1')}, {_deduped('snapshot_2')}, {_STORED}, {_CANON}, f as (select hid, arg_max(can, r) as can from c group by hid) select h.source || ':' || h.listing_id as hidden, k.source || ':' || k.listing_id as canonical from f join st h on h.property_id = hid join st k on k.property_id = can")
def stored_links(s):
    """Links of the store after two loads, by the records that they hide."""
    store = _stored(s)
    streams.relink(store, "2:links")
    rows = store.read("state", load.STATE).select("property_id", "source", "listing_id")
    side = lambda p: rows.select(F.col("property_id").alias(p), F.concat("source", F.lit(":"), "listing_id").alias(f"{p}_key"))
    found = store.read("duplicates", links.LINKS).join(side("property_id"), "property_id").join(side("canonical_id"), "canonical_id")
    return found.select(F.col("property_id_key").alias("hidden"), F.col("canonical_id_key").alias("canonical"))


@query("properties auction_events", f"select property_id, 'scheduled' as shown_status, coalesce(n, 0) as times_postponed, original_date, auction_datetime, url as pdf, {_SPECS.split(' as bedrooms')[0]} as bedrooms from properties p left join {_LAST} l on p.auction_id = l.auction_id left join (select auction_id, count(*) as n, arg_min(old_value, event_id) as original_date from auction_events where event_type = 'date_change' group by auction_id) d on d.auction_id = p.auction_id where not {_OFF} and not {_OLD} and coalesce(last_type, '') <> 'disappeared' and property_id % 11 <> 0")
def export_live_map(s):
    pdf = s.properties.select("auction_id", F.lit(0).alias("ord"), F.col("url").alias("link"))
    return export.export_live_map(s.properties, s.auction_events, _links(s), AS_OF, pdf).select("property_id", "shown_status", "times_postponed", "original_date", "auction_datetime", F.array_join("pdf_links", ";").alias("pdf"), "specs.bedrooms")


_FIND = f"from properties p left join {_LAST} l on p.auction_id = l.auction_id where coalesce(last_type, '') <> 'disappeared' and property_id % 11 <> 0 and state in ('MA', 'ME') and auction_datetime >= TS'2024-01-31 00:00:00'"


@query("properties auction_events", f"select property_id {_FIND} and auction_datetime <= TS'2024-01-31 00:00:00' + interval 14 day")
def find_upcoming(s):
    return digest.find_upcoming(s.properties, s.auction_events, _links(s), AS_OF, 14, ["MA", "ME"]).select("property_id")


@query("properties auction_events", f"select property_id {_FIND}")
def find_active(s):
    return digest.find_active(s.properties, s.auction_events, _links(s), AS_OF, ["MA", "ME"]).select("property_id")


@query("properties auction_events", "select event_id, property_id from auction_events e join properties p on e.auction_id = p.auction_id where detected_at >= TS'2024-01-24 00:00:00' and property_id % 11 <> 0 and state = 'NH' and not (auction_datetime is null and status in ('cancelled','sold back to mortgagee','3rd party purchase'))")
def find_recent_changes(s):
    return digest.find_recent_changes(s.auction_events, s.properties, _links(s), WEEK_AGO, ["NH"]).select("event_id", "property_id")


@query("properties", "select * exclude (g) from properties where property_id = 22")
def find_property(s):
    return s.properties.where(F.col("property_id") == 22).drop("g")


_ELIGIBLE = "(select * from subscribers where active and alerts and subscription_status in ('active', 'trialing'))"


def _digest(s):
    return digest.subscriber_digest(s.subscribers, s.subscriber_states, s.properties, s.auction_events, _links(s), s.notifications, AS_OF)


_DIGEST = f"""ch as (select e.*, p.* exclude (auction_id) from auction_events e join properties p on e.auction_id = p.auction_id where detected_at >= TS'2024-01-24 00:00:00' and property_id % 11 <> 0), {_groups('state, address')},
people as (select email, state from {_ELIGIBLE} join subscriber_states using (subscriber_id)),
up as (select email, 'Upcoming' as section, address, property_id, row_number() over (partition by email order by auction_datetime, property_id) as rank, count(*) over (partition by email) as n from people join (select p.* {_FIND.replace(" and state in ('MA', 'ME')", "")} and {_ACTIVE}) using (state)),
f as (select email, min(sent_at) as first_sent from notifications group by email),
fan as (select email, category, address, property_id from people join cg using (state) where category <> 'Removed' union all select email, category, address, property_id from people join cg using (state) join f using (email) where category = 'Removed' and first_sent < removed_at),
rk as (select email, category as section, address, property_id, row_number() over (partition by email, category order by address, property_id) as rank, count(*) over (partition by email, category) as n from fan),
dg as (select email, section, address, rank, greatest(n - 5, 0) as more, property_id from (select * from up union all select * from rk) where rank <= 5)"""


@query("properties auction_events subscribers subscriber_states notifications", f"with {_DIGEST} select * exclude (property_id) from dg")
def subscriber_digest(s):
    return _digest(s).select("email", "section", "address", "rank", "more")


@query("properties auction_events", f"with ch as (select e.*, p.* exclude (auction_id) from auction_events e join properties p on e.auction_id = p.auction_id where detected_at >= TS'2024-01-24 00:00:00' and property_id % 11 <> 0 and state in ('MA', 'ME')), {_groups('state, address')} select 'Upcoming' as section, address, '' as labels {_FIND} and {_ACTIVE} union all select category, address, case when category in ('Removed', 'New') then category when was_new then concat('New|', labels) else labels end from cg")
def status_view(s):
    """Without states in the request, the saved ones count."""
    return digest.status_view(s.properties, s.auction_events, _links(s), AS_OF, [" "], True, saved_states=["ma", "ME "]).select("section", "address", F.array_join("labels", "|").alias("labels"))


_SAVED = "ch as (select s.email, e.*, p.* exclude (auction_id) from saved_properties s join auction_events e on e.auction_id = s.property_id join properties p on p.auction_id = e.auction_id left join (select email, max(sent_at) as t from notifications where kind = 'saved' group by email) n on n.email = s.email where event_type in ('date_change','disappeared','status_change') and detected_at > coalesce(t, TS'2024-01-31 00:00:00' - interval 8 day))"


@query("saved_properties auction_events properties notifications", f"with {_SAVED}, {_groups('email, address')} select email, address, category from cg where category <> 'Removed' union all select email, address, category from cg join (select email, min(sent_at) as first_sent from notifications group by email) f using (email) where category = 'Removed' and first_sent < removed_at")
def saved_property_alert(s):
    return digest.saved_property_alert(s.saved_properties, s.auction_events, s.properties, s.notifications, AS_OF).select("email", "address", "category")


@query("saved_properties auction_events notifications", "with n as (select email, max(sent_at) as t from notifications where kind = 'saved' group by email) select s.email, event_id, case when detected_at <= t then 'sent' else 'new' end as tag from saved_properties s join auction_events e on e.auction_id = s.property_id left join n on n.email = s.email where event_type in ('date_change','disappeared','status_change') and detected_at >= TS'2024-01-31 00:00:00' - interval 90 day")
def saved_alert_tags(s):
    return digest.saved_alert_tags(s.saved_properties, s.auction_events, s.notifications, AS_OF).select("email", "event_id", "tag")


@query("properties", "select property_id from properties where auction_datetime between TS'2024-01-31 00:00:00' and TS'2024-01-31 00:00:00' + interval 7 day")
def upcoming_auctions(s):
    return digest.upcoming_auctions(s.properties, AS_OF).select("property_id")


@query("auction_events properties", "select event_id, address from auction_events join (select auction_id, address from properties) using (auction_id) where event_type = 'first_seen' and detected_at >= TS'2024-01-24 00:00:00'")
def new_listings(s):
    return digest.new_listings(s.auction_events, s.properties, WEEK_AGO).select("event_id", "address")


@query("subscribers", f"select subscriber_id, email from {_ELIGIBLE}")
def eligible_recipients(s):
    return digest.eligible(s.subscribers).select("subscriber_id", "email")


@query("subscribers notifications", f"select email from {_ELIGIBLE} where email not in (select email from notifications where sent_at > TS'2024-01-31 00:00:00' - interval 4 hour)")
def due_notifications(s):
    return digest.due_notifications(s.subscribers, s.notifications, AS_OF).select("email")


@query("subscribers notifications", f"select email from {_ELIGIBLE} where email not in (select email from notifications where kind = 'welcome')")
def due_welcome(s):
    return digest.due_welcome(s.subscribers, s.notifications).select("email")


@query("subscribers subscriber_states", "with q as (select subscriber_id, 1 as seq, case subscriber_id % 3 when 0 then ['NH'] when 1 then ['MA','ME'] else ['XX'] end as l, subscription_status in ('active','trialing') as paid from subscribers where active union all select subscriber_id, 2, ['ME'], false from subscribers where active and subscriber_id % 5 = 0), ok as (select *, not list_contains(l, 'XX') and (len(l) = 1 or paid) as good from q), g as (select subscriber_id, arg_max(l, seq) as l from ok where good group by subscriber_id) select 'state' as kind, subscriber_id, state from subscriber_states where subscriber_id not in (select subscriber_id from g) union all select 'state', subscriber_id, unnest(l) from g union all select 'rejected', subscriber_id, case subscriber_id % 3 when 1 then 'MA, me' else 'XX' end from ok where not good union all select 'rejected', subscriber_id, case subscriber_id % 3 when 0 then 'nh' when 1 then 'MA, me' else 'XX' end from subscribers where not active union all select 'rejected', subscriber_id, 'me' from subscribers where not active and subscriber_id % 5 = 0 union all select 'start', subscriber_id, case when subscriber_id % 7 = 3 then '2023-01-01' else '2024-01-31' end from (select subscriber_id from g union select subscriber_id from subscribers where subscriber_id % 7 = 3)")
def set_states(s):
    """States after the requests, rejected requests and start dates, one below the other."""
    first = s.subscribers.select("subscriber_id", F.expr("case subscriber_id % 3 when 0 then 'nh' when 1 then 'MA, me' else 'XX' end").alias("states"), F.lit(1).alias("seq"))
    asked = first.unionByName(s.subscribers.where(F.col("subscriber_id") % 5 == 0).select("subscriber_id", F.lit("me").alias("states"), F.lit(2).alias("seq")))
    starts = s.subscribers.where(F.col("subscriber_id") % 7 == 3).select("subscriber_id", F.lit("2023-01-01").cast("timestamp_ntz").alias("started_at"))
    new, rejected, began = digest.set_states(s.subscriber_states, asked, s.subscribers, ["MA", "NH", "ME"], AS_OF, starts)
    kind = lambda df, name, c: df.select(F.lit(name).alias("kind"), "subscriber_id", c.alias("state"))
    return kind(new, "state", F.col("state")).unionByName(kind(rejected, "rejected", F.col("states"))).unionByName(kind(began, "start", F.date_format("started_at", "yyyy-MM-dd")))


@query("properties auction_events subscribers subscriber_states notifications", f"with {_DIGEST} select email, count_if(section = 'Upcoming') as n_upcoming, count_if(section <> 'Upcoming') as n_changes, arg_min(address, rank) filter (where section = 'Upcoming') as first_address, max(more) filter (where section = 'Upcoming') as more from dg group by email")
def digest_payload(s):
    rows = digest.payload(_digest(s), AS_OF)
    at = lambda path: F.get_json_object("payload", path)
    n = lambda part: F.coalesce(F.json_array_length(at(f"$.{part}")), F.lit(0)).alias(f"n_{part}")
    return rows.select("email", n("upcoming"), n("changes"), at("$.upcoming[0].address").alias("first_address"), at("$.upcoming[0].more").cast("long").alias("more"))


@query("properties auction_events subscribers subscriber_states notifications", f"with {_DIGEST}, l as (select email, case section when 'Upcoming' then 0 when 'New' then 1 when 'Date Changes' then 2 when 'Status Changes' then 3 else 4 end as place, rank, address, more, property_id, section from dg), m as (select l.*, max(rank) over (partition by email, place) as last, case when p.auction_datetime is null or section = 'Removed' then '' when section = 'New' and p.auction_datetime >= TS'2024-02-21 00:00:00' then ' (soon)' else ' ' || p.url end as link from l join properties p using (property_id)) select email, string_agg(concat(address, link, case when rank = last and more > 0 then concat('+', more, ' more') else '' end), '|' order by place, rank) as lines, count_if(link like ' http%') as n_links, count_if(link = ' (soon)') as n_soon from m group by email")
def render_digest(s):
    """The plain bodies' addresses, links and remainders, in their order, and the html bodies' links; a test reads whole bodies."""
    rows = digest.render(_digest(s), AS_OF)
    lines = F.split(F.regexp_replace("plain", r"\n  (\+\d+ more)", "$1"), "\n")
    shown = F.filter(lines, lambda x: x.startswith("  "))
    line = F.transform(shown, lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^  (?:date unknown|\d\d/\d\d at \d+:\d\d [AP]M)  ", ""), r"  \[[^+]*\]", ""), "  ", " "))
    return rows.select("email", F.array_join(line, "|").alias("lines"), F.regexp_count("html", F.lit(">details</a>")).cast("long").alias("n_links"), F.regexp_count("html", F.lit("<i>soon</i>")).cast("long").alias("n_soon"))


@query("properties auction_events", f"select property_id, address, state, url, strftime(auction_datetime, '%Y-%m-%d') as day, {_SPECS.split(' as bedrooms')[0]} as bedrooms, (select count(*) from properties) as total from properties p left join {_LAST} l on p.auction_id = l.auction_id where not {_OFF} and not {_OLD} and coalesce(last_type, '') <> 'disappeared' and property_id % 11 <> 0")
def write_live_map(s):
    """The map's rows and its meta row's total, written as JSON and read back."""
    rows, meta = _map(s, s.properties)
    return rows.crossJoin(meta.select("total")).select("property_id", "address", "state", "url", F.substring("auction_datetime", 1, 10).alias("day"), "specs.bedrooms", "total")


def _map(s, properties):
    """Rows and meta row written as JSON and read back."""
    path = files.scratch(s.spark, "map")
    rows, meta = export.export_live_map(properties, s.auction_events, _links(s), AS_OF), export.map_meta(properties, s.auction_events, _links(s), AS_OF)
    files.write_live_map(rows, meta, path)
    back = s.spark.read.schema("property_id long, address string, state string, url string, auction_datetime string, specs struct<bedrooms:long>").json(f"{path}/properties")
    return back, s.spark.read.schema(meta.schema).json(f"{path}/meta")


@query("properties auction_events", f"with {_OUT}, m as (select count(*) as total, count_if(not (off or old or lost or hid or blind)) as exported, (select string_agg(concat(status, '=', n), ', ' order by concat(status, '=', n)) from (select status, count(*) as n from x where off group by status)) as by_status, count_if(blind) as missing_coords, count_if(hid) as duplicate, count_if(lost) as disappeared, count_if(old) as stale from x), s as (select (select string_agg(concat(property_id, ' ', address, ' ', source, ' ', status), '|' order by property_id) from (select * from x where blind order by property_id limit 25)) as first_blind, (select string_agg(concat(property_id, ' ', address, ' ', source, ' ', status), '|' order by property_id) from (select * from x where lost order by property_id limit 25)) as first_gone, (select string_agg(concat(property_id, ' ', address, ' ', source, ' ', status, ' ', strftime(last_seen_at, '%Y-%m-%d')), '|' order by property_id) from (select * from x where old order by property_id limit 25)) as first_stale) select * from m, s")
def live_map_meta(s):
    """The meta row as read back: its counts, and the first rows of each reason."""
    meta = _map(s, _some_blind(s))[1]
    told = lambda c, *more: F.array_join(F.transform(c, lambda x: F.concat_ws(" ", x["property_id"], x["address"], x["source"], x["status"], *(F.date_format(x[m], "yyyy-MM-dd") for m in more))), "|")
    samples = (told("excluded_missing_coords").alias("first_blind"), told("excluded_disappeared").alias("first_gone"), told("excluded_stale", "last_seen_at").alias("first_stale"))
    return meta.select("total", "exported", "by_status", "missing_coords", "duplicate", "disappeared", "stale", *samples)


# streaming, in batch form


@query("webhook_events", "select event_id, min(seq) as seq from webhook_events group by event_id")
def webhook_dedup(s):
    return billing.once(s.webhook_events).select("event_id", "seq")


_ONCE = "o as (select event_id, arg_min(seq, seq) as seq, arg_min(event_time, seq) as event_time, arg_min(subscription_id, seq) as subscription_id, arg_min(kind, seq) as kind, arg_min(coalesce(status, ''), seq) as status, arg_min(invoice_id, seq) as invoice_id, arg_min(amount, seq) as amount from webhook_events group by event_id)"


@query("webhook_events", f"with {_ONCE} select subscription_id, arg_max(case kind when 'checkout' then 'active' when 'deleted' then 'canceled' else status end, (event_time, event_id)) as subscription_status from o where kind in ('checkout','updated','deleted') group by subscription_id")
def subscription_state(s):
    return billing.subscription_state(s.webhook_events).select("subscription_id", "subscription_status")


@query("webhook_events subscribers", f"with {_ONCE} select invoice_id, arg_min(email, (event_time, event_id)) as email, arg_min(amount, (event_time, event_id)) as amount from o join subscribers using (subscription_id) where kind = 'invoice_paid' group by invoice_id")
def invoice_ledger(s):
    return billing.invoice_ledger(s.webhook_events, s.subscribers).select("invoice_id", "email", "amount")


def _arrivals(s, df, label):
    """df as a stream of one arrival, and a folder for the stream's checkpoint."""
    path = files.scratch(s.spark, label)
    df.write.parquet(path)
    return s.spark.readStream.schema(df.schema).parquet(path), files.scratch(s.spark, f"{label}-stream")


def _appended(stream, checkpoint):
    """What a stream appends, once all of its input is read."""
    out = f"{checkpoint}-out"
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return out


@query("snapshot_1 snapshot_2", f"with {_DIFF} select 1 as run_id, 'first_seen' as event_type, count(*) as n from snapshot_1_d union all select 2, event_type, count(*) from ev group by event_type")
def snapshot_stream(s):
    """Both snapshots arrive at once; each is applied by itself, in order of its time."""
    store = state.StateStore(s.spark, files.scratch(s.spark, "state"))
    path, checkpoint = files.scratch(s.spark, "snapshots"), files.scratch(s.spark, "snapshots-stream")
    for name, rows, as_of in (("b", s.snapshot_2, AS_OF), ("a", s.snapshot_1, "2024-01-01 00:00:00")):
        rows.drop("g").withColumn("as_of", F.lit(as_of)).select("as_of", *sorted(set(rows.columns) - {"g"})).write.parquet(f"{path}/{name}")
    source = s.spark.readStream.schema(s.spark.read.parquet(f"{path}/a").schema).option("recursiveFileLookup", "true").parquet(path)
    streams.snapshot_stream(s.spark, source, store, "as_of", checkpoint).awaitTermination()
    return store.read("events", load.EVENTS).groupBy("run_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _gated(rows, key, time, gap):
    """A recursive table g (key, t): the times that a gate lets through, of a table with a key and a time."""
    return f"g as (select {key}, min({time}) as t from {rows} group by {key} union all select g.{key}, min(n.{time}) from g join {rows} n on n.{key} = g.{key} and n.{time} >= g.t + interval {gap} group by g.{key})"


@query("properties", f"with recursive k as (select user_id % 2500 as property_id, ts as checked_at, event_type = 'error' as dead from events), {_gated('k', 'property_id', 'checked_at', '15 minute')}, d as (select k.property_id, min(checked_at) as checked_at from k join g on g.property_id = k.property_id and g.t = k.checked_at where dead group by k.property_id) select row_number() over (order by property_id) as event_id, auction_id, 'disappeared' as event_type, status as old_value, null::varchar as new_value, checked_at as detected_at, 1::bigint as run_id from d join properties using (property_id)")
def link_check_events(s):
    """Disappeared events that a stream of checks of every stored listing makes."""
    state = s.properties.withColumn("last_event", F.lit("first_seen"))
    checks = s.events.select((F.col("user_id") % 2500).alias("property_id"), F.col("ts").cast("timestamp").alias("checked_at"), F.when(F.col("event_type") == "error", 404).otherwise(200).alias("http_status"), F.lit("fine").alias("html"))
    stream, checkpoint = _arrivals(s, checks, "checks")
    dead = s.spark.read.schema("property_id long, checked_at timestamp").parquet(_appended(streams.link_checks(stream), checkpoint))
    return streams.disappeared_events(dead, state, 0, 1)


@query("notifications", f"with recursive {_gated('notifications', 'email', 'sent_at', '4 hour')} select email, t as sent_at from g")
def cooldown_gate(s):
    stream, checkpoint = _arrivals(s, s.notifications.select("email", F.col("sent_at").cast("timestamp").alias("sent_at")), "sends")
    sent = s.spark.read.schema("email string, sent_at timestamp").parquet(_appended(streams.cooldown(stream), checkpoint))
    return sent.select("email", F.col("sent_at").cast("timestamp_ntz").alias("sent_at"))


def _deliveries(s):
    """The webhook events as a stream of two arrivals, a checkout with its email; and a folder for its checkpoint."""
    email = F.when(F.col("kind") == "checkout", F.concat(F.regexp_replace("subscription_id", "^sub_", "user"), F.lit("@example.com")))
    rows = s.webhook_events.withColumn("email", email)
    path = files.scratch(s.spark, "webhooks")
    half = rows.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0] or 0
    for name, part in (("a", F.col("seq") <= half), ("b", F.col("seq") > half)):
        rows.where(part).coalesce(1).write.parquet(f"{path}/{name}")
    stream = s.spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(path)
    return stream, files.scratch(s.spark, "webhooks-stream")


@query("webhook_events", "select event_id, min(seq) as seq from webhook_events group by event_id")
def webhook_stream(s):
    """The log after a stream of all deliveries: of each event the first."""
    stream, checkpoint = _deliveries(s)
    store = state.StateStore(s.spark, files.scratch(s.spark, "webhook-log"))
    streams.webhook_stream(stream, store, checkpoint).awaitTermination()
    return store.read("webhooks", streams.WEBHOOKS).select("event_id", "seq")


def _subscriptions(s):
    stream, checkpoint = _deliveries(s)
    store = state.StateStore(s.spark, files.scratch(s.spark, "subscriptions"))
    streams.subscription_stream(stream, store, checkpoint).awaitTermination()
    return store.read("subscriptions", billing.SUBSCRIPTIONS)


@query("webhook_events", f"with {_ONCE} select subscription_id, arg_max(case kind when 'checkout' then 'active' when 'deleted' then 'canceled' else status end, (event_time, event_id)) as subscription_status from o where kind in ('checkout','updated','deleted') group by subscription_id")
def subscription_stream(s):
    """The stored states after a stream of all events."""
    return _subscriptions(s).select("subscription_id", "subscription_status")


_BILLED = f"""{_ONCE}, c as (select subscription_id, replace(subscription_id, 'sub_', 'user') || '@example.com' as email, min((event_time, event_id)) filter (kind = 'checkout') as first, max((event_time, event_id)) filter (kind = 'deleted') as gone,
  arg_max(case kind when 'checkout' then 'active' when 'deleted' then 'canceled' else status end, (event_time, event_id)) as now from o where kind in ('checkout','updated','deleted') group by subscription_id having first is not null),
b as (select p.email, coalesce(c.subscription_id, p.subscription_id) as subscription_id, coalesce(now, subscription_status) as subscription_status, active and not coalesce(gone > first, false) as active, alerts from subscribers p left join c on p.email = c.email)"""


@query("webhook_events subscribers", f"with {_BILLED} select * exclude (alerts) from b")
def subscribers_after_billing(s):
    """Subscribers as the stream of billing events leaves them."""
    return billing.after_billing(s.subscribers, _subscriptions(s)).select("email", "subscription_id", "subscription_status", "active")


@query("webhook_events subscribers", f"with {_BILLED} select email from b where active and alerts and subscription_status in ('active','trialing')")
def recipients_after_billing(s):
    """Who is to be mailed after the stream of billing events: deactivated subscribers are not."""
    return digest.eligible(billing.after_billing(s.subscribers, _subscriptions(s))).select("email")
