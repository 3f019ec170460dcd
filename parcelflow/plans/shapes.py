"""Listing-domain tables derived from the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"

#: name: (tables it reads, SQL). DAYS(x) is an interval of x days and TS'...' a timestamp without zone.
SHAPES: dict[str, tuple[tuple[str, ...], str]] = {
    "listings": (
        ("orders",),
        """select o_orderkey as seq,
  case k % 10 when 0 then 'landmark' when 1 then 'brockscott' when 2 then 'harmon' when 3 then 'patriot' when 4 then 'sullivan'
    when 5 then 'brockscott' when 6 then 'towne' when 7 then 'jjmanning' when 8 then 'keenan' else 'skypoint' end as source,
  cast(k as varchar(20)) as listing_id, concat('https://example.com/auction/?id=', cast(k as varchar(20))) as url,
  concat(cast(g % 200 + 1 as varchar(20)), ' ', case g % 4 when 0 then 'Forest' when 1 then 'North' when 2 then 'Harbor' else 'Millbrook' end,
    case when k % 2 = 0 then ' Street, ' else ' St, ' end, case g % 3 when 0 then 'Lowell, MA' when 1 then 'Keene, NH' else 'Bath, ME' end, ' 0', cast(1000 + g % 6 as varchar(20))) as name,
  case g % 3 when 0 then 'MA' when 1 then 'NH' else 'ME' end as state,
  42.0e0 + (g % 2000) * 0.0005e0 as latitude, -71.0e0 - floor(g / 2000.0) * 0.01e0 as longitude,
  case when o_orderkey % 13 = 0 then 'cancelled' when o_orderstatus = 'F' then 'sold back to mortgagee' when o_orderstatus = 'P' then 'postponed' else 'active' end as status,
  o_orderdate as auction_datetime,
  concat('Lot | Property Type: Residential; Lot Size: 0.', cast(o_custkey % 9 + 1 as varchar(20)), ' acres lot; Square Feet: 1,', cast(100 + o_custkey % 900 as varchar(20)), ' sf; # Bedrooms: ', cast(o_custkey % 6 as varchar(20)),
    '; # Baths: ', cast(o_custkey % 4 as varchar(20)), ' full / ', cast(o_custkey % 3 as varchar(20)), ' half; Year Built: ', cast(1900 + o_custkey % 120 as varchar(20))) as description,
  case g % 4 when 0 then 'Upper' when 1 then '' else 'Lower' end as county, concat('Town', cast(g % 9 as varchar(20))) as municipality,
  case when k % 4 = 0 then concat('https://example.com/pdf/', cast(k as varchar(20)), '.pdf; ; https://example.com/pdf/', cast(k as varchar(20)), 'b.pdf') else '' end as pdf_links, g
from (select *, cast(floor(k / 2.0) as bigint) as g from (select *, case when o_orderkey % 20 = 1 then o_orderkey - 1 else o_orderkey end as k from {orders}))""",
    ),
    "snapshot_1": (("listings",), "select * from {listings} where seq % 7 <> 0"),
    "snapshot_2": (
        ("listings",),
        """select seq, source, listing_id, url, name, state, latitude, longitude, case when seq % 17 = 0 then 'cancelled' else status end as status,
  case when seq % 5 = 0 then auction_datetime + DAYS(14) else auction_datetime end as auction_datetime, description, county, municipality, pdf_links, g from {listings} where seq % 11 <> 0""",
    ),
    "properties": (
        ("listings",),
        """select cast(listing_id as bigint) as property_id, cast(listing_id as bigint) as auction_id, source, listing_id, url, name as address, state, latitude, longitude, status,
  TS'2024-01-31 10:00:00' + DAYS(g % 90 - 30) as auction_datetime, TS'2024-01-31 00:00:00' - DAYS(g % 60) as first_seen_at, TS'2024-01-31 00:00:00' - DAYS(g % 30) as last_seen_at, description, g
from (select *, row_number() over (partition by source, listing_id order by auction_datetime desc, seq) as rn from {listings}) where rn = 1""",
    ),
    "auctions": (("properties",), "select auction_id, property_id, status, url, auction_datetime from {properties}"),
    "auction_events": (
        ("events",),
        """select event_id, cast((event_id * 7) % 2500 as bigint) as auction_id,
  case event_type when 'signup' then 'first_seen' when 'click' then 'date_change' when 'view' then 'status_change' when 'purchase' then 'disappeared' else 'price_change' end as event_type,
  case when event_type = 'click' then concat(cast(year(ts) as varchar(20)), '-', lpad(cast(month(ts) as varchar(20)), 2, '0'), '-', lpad(cast(day(ts) as varchar(20)), 2, '0'), 'T', lpad(cast(hour(ts) as varchar(20)), 2, '0'), ':', lpad(cast(minute(ts) as varchar(20)), 2, '0'), ':00') else concat('v', cast(cast(floor(value) as bigint) as varchar(20))) end as old_value,
  case when event_type = 'click' then concat(cast(year((ts + DAYS(7))) as varchar(20)), '-', lpad(cast(month((ts + DAYS(7))) as varchar(20)), 2, '0'), '-', lpad(cast(day((ts + DAYS(7))) as varchar(20)), 2, '0'), 'T', lpad(cast(hour((ts + DAYS(7))) as varchar(20)), 2, '0'), ':', lpad(cast(minute((ts + DAYS(7))) as varchar(20)), 2, '0'), ':00') else case cast(floor(value) as bigint) % 5 when 0 then 'cancelled' when 1 then 'postponed' when 2 then 'sold' else 'active' end end as new_value,
  ts as detected_at, cast(floor(event_id / 1000.0) as bigint) as run_id from {events}""",
    ),
    "subscribers": (
        ("customer",),
        """select c_custkey as subscriber_id, concat('user', cast(c_custkey as varchar(20)), '@example.com') as email,
  case c_mktsegment when 'BUILDING' then 'active' when 'MACHINERY' then 'trialing' when 'AUTOMOBILE' then 'canceled' else 'none' end as subscription_status,
  c_custkey % 4 <> 0 as alerts, c_custkey % 7 <> 0 as active, concat('sub_', cast(c_custkey as varchar(20))) as subscription_id from {customer}""",
    ),
    "subscriber_states": (("customer",), "select c_custkey as subscriber_id, case c_nationkey % 3 when 0 then 'MA' when 1 then 'NH' else 'ME' end as state from {customer} union all select c_custkey, case c_nationkey % 3 when 0 then 'NH' when 1 then 'ME' else 'MA' end from {customer} where c_custkey % 2 = 0"),
    "notifications": (
        ("events",),
        """select event_id as notification_id, concat('user', cast(user_id as varchar(20)), '@example.com') as email,
  case event_id % 3 when 0 then 'weekly' when 1 then 'saved' else 'welcome' end as kind, ts as sent_at from {events} where event_id % 4 = 0""",
    ),
    "saved_properties": (("lineitem",), "select distinct concat('user', cast(l_suppkey as varchar(20)), '@example.com') as email, l_orderkey as property_id from {lineitem} where l_orderkey % 5 = 0"),
    "webhook_events": (
        ("events",),
        """select case when event_id % 10 = 9 then event_id - 1 else event_id end as event_id, event_id as seq, ts as event_time, concat('sub_', cast(user_id as varchar(20))) as subscription_id,
  case event_type when 'signup' then 'checkout' when 'click' then 'updated' when 'view' then 'updated' when 'purchase' then 'invoice_paid' else 'deleted' end as kind,
  case event_type when 'click' then 'active' when 'view' then 'past_due' else null end as status,
  concat('in_', cast(cast(floor(event_id / 2.0) as bigint) as varchar(20))) as invoice_id, cast(floor(value * 100) as bigint) as amount from {events}""",
    ),
}


def dialect(sql: str, spark: bool) -> str:
    sql = re.sub(r"DAYS\(([^()]*)\)", r"make_dt_interval(cast(\1 as int))" if spark else r"to_days(cast(\1 as integer))", sql)
    return sql.replace("TS'", "timestamp_ntz'" if spark else "timestamp '")


class Shapes:
    """The shape tables over one folder of given tables; each is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in SHAPES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        tables, sql = SHAPES[name]
        return self.spark.sql(dialect(sql, True), **{t: getattr(self, t) for t in tables})


def with_shapes(names: list[str], query: str) -> str:
    """query for DuckDB, with the shape tables that it names, and theirs, as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for t in SHAPES[name][0]:
            if t in SHAPES:
                add(t)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    plain = lambda n: re.sub(r"\{(\w+)\}", r"\1", dialect(SHAPES[n][1], False))
    body = query.strip()
    head = ", ".join(f"{n} as ({plain(n)})" for n in order)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {dialect(body[15:], False)}"
    if body.lower().startswith("with "):
        return f"with {head}, {dialect(body[5:], False)}"
    return f"with {head} {dialect(body, False)}"
