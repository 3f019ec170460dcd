import datetime as dt
import difflib
import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import dates, status, text
from parcelflow.functions.udf import fuzzy_date, street_similarity
from parcelflow.operators import dedup, joins, markup, pages, rules, thresholds
from parcelflow.plans import billing, cache, digest, links, load
from parcelflow.plans.shapes import Shapes
from parcelflow.sources import files
from parcelflow.sources.state import StateStore
from parcelflow.streaming import streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, value", [("2,296", 2296), ("864 sf", 864), ("3,107± sf", 3107), ("", None), (None, None), ("none", None)])
def test_clean_int(spark, raw, value):
    assert one(spark, text.clean_int(F.col("a")), a=raw) == value


@pytest.mark.parametrize("raw, value", [("2", 2.0), ("2.5", 2.5), ("3 full / 2 half", 4.0), ("0 full", None), ("many", None), (None, None)])
def test_bathrooms(spark, raw, value):
    assert one(spark, text.bathrooms(F.col("a")), a=raw) == value


def test_columns_win_over_description(spark):
    found = text.property_details({"bedrooms": F.col("b")}, F.col("a"))
    said = "Lot | # Bedrooms: 5; Square Feet: 1,356 sf"
    assert one(spark, found["bedrooms"], a=said, b="4 beds") == 4
    assert one(spark, found["bedrooms"], a=said, b=" ") == 5
    assert one(spark, found["bedrooms"], a=said, b="several") is None
    assert one(spark, found["sqft"], a=said, b="") == 1356


def test_streets(spark):
    assert one(spark, text.normalize_street(F.col("a")), a="65 Quarry Terrace, Unit 4 a/k/a other") == "65 QUARRY TER"
    assert one(spark, text.address_key(F.col("a"), F.col("b"))["unit"], a="65 Oak St Apt 2a", b="Lowell, MA 01201-1234") == "2A"
    assert one(spark, text.address_key(F.col("a"), F.col("b")), a="65 Oak St", b="Lowell, MA") is None
    assert one(spark, text.house_number(F.col("a")), a="126b North Street, Keene") == "126b"
    assert one(spark, text.house_street(F.col("a")), a="126 North Street, Keene") == "n st"
    assert one(spark, text.house_number(F.col("a")), a="North Street") is None


@pytest.mark.parametrize("raw, value", [("Wed. Jul. 8, 2026 at 11 am", "2026-07-08 11:00:00"), ("7/9/2026 at 1:30 PM", "2026-07-09 13:30:00"), ("July 4, 2026", "2026-07-04 00:00:00"), ("TBD", None), (None, None)])
def test_dates(spark, raw, value):
    got = one(spark, dates.parse_auction_datetime(F.col("a")), a=raw)
    assert (str(got) if got else None) == value


def test_last_chunk_rollover_and_labels(spark):
    said = "Thu. Jul. 9 at 11 am Mon. Aug. 10, 2026 at 1 pm"
    assert str(one(spark, dates.parse_auction_datetime(dates.last_date_chunk(F.col("a"))), a=said)) == "2026-08-10 13:00:00"
    assert str(one(spark, dates.year_rollover(F.col("m"), F.col("d"), "2026-12-20"), m=1, d=5)) == "2027-01-05 00:00:00"
    assert str(one(spark, dates.year_rollover(F.col("m"), F.col("d"), "2026-12-20"), m=12, d=1)) == "2026-12-01 00:00:00"
    block = one(spark, dates.block_status(F.col("a"), F.col("b")), a="Original Date: 1/02/2026 at 10:00 AM", b="x")
    assert (block["date_time"], block["block_status"]) == ("", "postponed")
    assert one(spark, dates.block_status(F.col("a"), F.col("b")), a="nothing", b=None)["block_status"] == "unknown"


def test_fuzzy_date_and_similarity(spark):
    df = spark.createDataFrame([("sold on the 5th of May 2026 at noon 12:00", "tide", "diet"), (None, None, "x")], "t string, a string, b string")
    rows = df.select(fuzzy_date(F.col("t"), "2024-01-31").alias("d"), street_similarity("a", "b").alias("s")).collect()
    assert rows[0]["d"] == dt.datetime(2026, 5, 5, 12) and rows[0]["s"] == 0.25 and rows[1]["d"] is None
    assert rows[1]["s"] == difflib.SequenceMatcher(None, "", "x").ratio()


def test_listing_ids_and_urls(spark):
    ids = lambda url, address="": one(spark, text.extract_listing_id(F.col("u"), F.col("a"), ("slug.com",), ("path.com",), ("frag.com",), ("auc.com",)), u=url, a=address)
    assert ids("https://path.com/auction/1942") == "1942"
    assert ids("https://slug.com/x", "6 March St, Lowell") == "6-march-st-lowell"
    assert ids("https://frag.com/#2649A") == "2649A"
    assert ids("https://auc.com/auction/21094/six/") == "21094" and ids("https://auc.com/?id=7") == "7"
    assert ids("https://other.com/?a=1&id=21306") == "21306" and ids("https://other.com/a") == "https://other.com/a"
    assert one(spark, text.clean_url(F.col("a")), a="http://a.b/x y%20z|") == "http://a.b/x%20y%20z%7C"
    assert one(spark, text.escape_html(F.col("a")), a="<a&b>") == "&lt;a&amp;b&gt;"


def test_status(spark):
    assert one(spark, status.terminal(F.col("a")), a="Sold to Third Party") is True
    assert one(spark, status.terminal(F.col("a")), a=None) is False
    assert one(spark, status.normalize_status(F.col("a")), a="Canceled") == "cancelled"


def test_latest_per_listing_ties(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [("s", "1", 1, day(2)), ("s", "1", 2, day(2)), ("s", "1", 3, None), ("s", "2", 4, None), ("s", "2", 5, None)]
    df = spark.createDataFrame(rows, "source string, listing_id string, seq long, auction_datetime timestamp_ntz")
    assert {r["seq"] for r in dedup.latest_per_listing(df).collect()} == {1, 5}


def test_cross_source(spark):
    rows = [(1, "brockscott", "k"), (2, "landmark", "k"), (3, "harmon", "j"), (4, "landmark", "j"), (5, "patriot", "i"), (6, "patriot", "i"), (7, "harmon", None)]
    df = spark.createDataFrame(rows, "seq long, source string, key string")
    assert {r["seq"] for r in dedup.cross_source(df, F.col("key")).collect()} == {2, 3, 4, 5, 7}
    assert {r["seq"] for r in dedup.cross_source(df, F.col("key"), require_two_sources=True).collect()} == {2, 3, 4, 5, 6, 7}


def test_duplicate_links(spark):
    day = dt.datetime(2026, 7, 1)
    rows = [(1, "a", "126 North Avenue", 42.0, -71.0, "sold back to mortgagee", day), (2, "b", "126 North Ave", 42.0, -71.0, "active", day), (3, "b", "128 North Ave", 42.0, -71.0, "active", day), (4, "c", "126 North Ave", 43.0, -71.0, "active", day), (5, "c", "126 North Ave", 42.0, -71.0, "active", day)]
    df = spark.createDataFrame(rows, "property_id long, source string, address string, latitude double, longitude double, status string, last_seen_at timestamp_ntz")
    assert {(r["property_id"], r["canonical_id"]) for r in links.link_duplicates(df).collect()} == {(1, 2), (5, 2)}


def linked(df):
    return sorted((r["property_id"], r["canonical_id"], round(r["metres"], 6), round(r["similarity"], 9)) for r in df.collect())


def test_duplicate_links_equal_those_of_all_pairs(spark):
    import random

    p = Shapes(spark, "/root/testdata/sf0.01").properties.select("property_id", "source", "address", "latitude", "longitude", "status", "last_seen_at")
    want = linked(links.link_duplicates_by_pairs(p))
    assert linked(links.link_duplicates(p)) == want and len(want) > 1000
    rng = random.Random(6)
    streets = ["tide lane", "diet lane", "North Main Street", "Main St", "Mian St.", "Maine Ave", "tide", "diet", "Oak", "", "Élm 9"]
    rows = [(i, rng.choice("abc"), f"{rng.choice([1, 1, 2, 33])} {rng.choice(streets)}, Keene" if rng.random() < 0.9 else None, 42.0 + rng.randrange(4) * 0.0006, -71.0 + rng.randrange(3) * 0.0007, rng.choice(["active", "sold", "cancelled", None]), dt.datetime(2024, 1, rng.randrange(1, 5))) for i in rng.sample(range(10_000), 160)]
    df = spark.createDataFrame(rows, "property_id long, source string, address string, latitude double, longitude double, status string, last_seen_at timestamp_ntz")
    assert linked(links.link_duplicates(df)) == linked(links.link_duplicates_by_pairs(df))
    # Python sees few of the pairs
    pairs = joins.proximity_pairs(p).count()
    near = links.place_pairs(links.places(p), 100.0)
    assert links.open_streets(near, 0.6).count() < 0.1 * pairs


def test_one_place_with_many_records(spark):
    rows = spark.range(50_000).select(F.col("id").alias("property_id"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"), F.lit("1 Oak Street").alias("address"), F.lit(42.0).alias("latitude"), F.lit(-71.0).alias("longitude"), F.lit("active").alias("status"), F.lit("2024-01-01").cast("timestamp_ntz").alias("last_seen_at"))
    got = links.link_duplicates(rows).groupBy("canonical_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0, 40_000), (1, 9_999)}


def empty_state(spark):
    return spark.createDataFrame([], load.STATE)


def test_snapshot_twice_gives_no_events(spark, sf_dir):
    s = Shapes(spark, sf_dir)
    first = load.load_snapshot(s.snapshot_1, empty_state(spark), "2024-01-01 00:00:00", 1)
    state, events = first.state.cache(), first.events.cache()
    assert events.count() == state.count() == state.select("property_id").distinct().count() > 0
    assert sorted(r[0] for r in events.select("event_id").collect()) == list(range(1, events.count() + 1))
    again = load.load_snapshot(s.snapshot_1, state, "2024-01-02 00:00:00", 2, 10**6, 10**6)
    assert again.events.count() == 0
    nothing = load.load_snapshot(s.snapshot_1.limit(0), state, "2024-01-03 00:00:00", 3, 10**6, 10**6)
    assert nothing.events.count() == 0 and nothing.state.count() == state.count()


FIELDS = "seq long, source string, listing_id string, url string, name string, latitude double, longitude double, status string, county string"


def kinds(loaded):
    return sorted((r["auction_id"], r["event_type"], r["old_value"], r["new_value"]) for r in loaded.events.collect())


def test_load_follows_a_listing(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), FIELDS)
    one = load.load_snapshot(make((1, "a", "x", "u", "1 Oak St", 1.0, 2.0, "active", "Upper"), (2, "a", "y", "u", "2 Oak St", 3.0, 2.0, "active", "")), empty_state(spark), "2024-01-01 00:00:00", 1)
    assert kinds(one) == [(1, "first_seen", None, "active"), (2, "first_seen", None, "active")]
    # a source whose rows are all rejected has run: what it stored has disappeared, once
    blind = make((1, "a", "x", "u", "1 Oak St", None, 2.0, "active", ""))
    two = load.load_snapshot(blind, one.state, "2024-01-02 00:00:00", 2, 2, 2)
    assert kinds(two) == [(1, "disappeared", "active", None), (2, "disappeared", "active", None)] and two.rejects.count() == 1
    assert load.load_snapshot(blind, two.state, "2024-01-03 00:00:00", 3, 2, 4).events.count() == 0
    # it comes back with another status and no county, and keeps its name and its first day
    back = load.load_snapshot(make((5, "a", "x", "new", "other name", 1.0, 2.0, "postponed", "")), two.state, "2024-01-04 00:00:00", 4, 2, 4)
    assert kinds(back) == [(1, "status_change", "active", "postponed")]
    row = back.state.where("listing_id = 'x'").first()
    assert (row["address"], row["county"], row["url"], row["first_seen_at"], row["last_seen_at"], row["last_event"]) == ("1 Oak St", "", "new", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4), "status_change")
    run = back.run.first()
    assert (run["found"], run["new"], run["changed"], run["removed"], run["failed"], run["last_property"], run["last_event"]) == (1, 0, 1, 0, 0, 2, 5)


def test_store_shows_whole_versions_only(spark, tmp_path, monkeypatch):
    store = StateStore(spark, f"file://{tmp_path}/s")
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "a long")
    assert store.commit("1", replace={"state": rows(1)}, append={"events": rows(1)}) == 1
    write = spark.range(1).write.__class__.parquet

    def broken(self, path, *a, **k):
        if "/events/" in path:
            raise OSError("lost")
        return write(self, path, *a, **k)

    monkeypatch.setattr(spark.range(1).write.__class__, "parquet", broken)
    with pytest.raises(OSError):
        store.commit("2", replace={"state": rows(2)}, append={"events": rows(2)})
    monkeypatch.undo()
    got = lambda t, v=None: sorted(r["a"] for r in store.read(t, "a long", v).collect())
    assert (got("state"), got("events")) == ([1], [1])
    assert store.commit("2", replace={"state": rows(2)}, append={"events": rows(2)}) == 2 == store.commit("2", replace={"state": rows(9)})
    assert (got("state"), got("events"), got("state", 1)) == ([2], [1, 2], [1])


def listed(*rows):
    return lambda spark: spark.createDataFrame([(*r[:4], "1 Oak St", float(r[0]), 2.0, r[4], "") for r in rows], FIELDS)


def files_of(folder):
    return {os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_load_of_one_source_leaves_the_others_files(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s", buckets=3)
    both = listed((1, "a/b", "x", "u", "active"), (2, "a/b", "y", "u", "active"), (3, "c", "x", "u", "active"))(spark)
    streams.apply_snapshot(store, both, "2024-01-01 00:00:00", "1")
    root = f"{tmp_path}/s/state"
    first, parts = files_of(root), store.manifest()["keyed"]["state"]
    streams.apply_snapshot(store, listed((9, "c", "x", "u", "postponed"), (10, "c", "z", "u", "active"))(spark), "2024-01-02 00:00:00", "2")
    after = store.manifest()["keyed"]["state"]
    kept = "p" + "a/b".encode().hex()
    assert set(parts) == set(after) and after[kept] == parts[kept] and len({p for p in parts if after[p] == parts[p]}) == 1
    assert first < files_of(root) and all(kept not in f for f in files_of(root) - first)
    state = {(r["source"], r["listing_id"]): (r["property_id"], r["status"]) for r in store.read("state", load.STATE).collect()}
    assert state == {("a/b", "x"): (1, "active"), ("a/b", "y"): (2, "active"), ("c", "x"): (3, "postponed"), ("c", "z"): (4, "active")}
    assert store.read("state", load.STATE, version=1).count() == 3 and store.read("state", load.STATE, parts=["c", "none"]).count() == 2
    events = sorted((r["event_id"], r["auction_id"], r["event_type"]) for r in store.read("events", load.EVENTS).collect())
    assert events == [(1, 1, "first_seen"), (2, 2, "first_seen"), (3, 3, "first_seen"), (4, 3, "status_change"), (5, 4, "first_seen")]
    # the stored side of the comparison is one scan of buckets, without a shuffle
    stored = store.bucketed("state", load.STATE, load.KEYS, ["a/b", "c"])
    assert stored.count() == 4
    plan = load.compared(load.widened(both), stored, ["c"])._jdf.queryExecution().executedPlan().toString()
    left, right = plan[plan.index("SortMergeJoin") :].split("FileScan")[0], plan[plan.index("FileScan") - 900 : plan.index("FileScan")]
    assert "Bucketed: true" in plan and left.count("Exchange") == 1 and "Exchange" not in right
    # an empty snapshot changes nothing, and no load leaves tables of its own behind
    shared = files.scratch(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    before = set(os.listdir(shared))
    streams.apply_snapshot(store, both.limit(0), "2024-01-03 00:00:00", "3")
    streams.relink(store, "3:links")
    assert set(os.listdir(shared)) == before and store.read("duplicates", links.LINKS).count() == 0
    assert store.manifest()["keyed"]["state"] == after and store.read("events", load.EVENTS).count() == 5


def test_logs_merge_in_tiers_and_old_versions_go(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s", fan=3, keep=4)
    sizes = []
    for i in range(1, 41):
        before = store.read("log", "a long", i - 1) if i > 1 else None
        assert store.commit(f"{i // 4}:{i % 4}", replace={"now": spark.createDataFrame([(i,)], "a long")}, append={"log": spark.createDataFrame([(i,)], "a long").coalesce(1)}) == i
        assert before is None or before.count() == i - 1
        sizes.append((len(store.manifest()["logs"]["log"]), os.path.getsize(f"{tmp_path}/s/manifests/{i:08d}.json")))
    assert max(n for n, _ in sizes) <= 2 * 4 and max(b for _, b in sizes) < 2000  # 40 commits fill tiers 0 to 3
    assert sorted(r["a"] for r in store.read("log", "a long").collect()) == list(range(1, 41))
    assert store.versions() == [37, 38, 39, 40] and store.read("log", "a long", 37).count() == 37
    assert len(os.listdir(f"{tmp_path}/s/now")) == 4 and len(os.listdir(f"{tmp_path}/s/log")) <= 4 * 8
    # batches that are in change nothing, whatever their item
    assert store.applied("9:3") and not store.applied("10:1") and store.commit("3:1", append={"log": spark.createDataFrame([(99,)], "a long")}) == 40


def test_page_tables_and_blocks(spark):
    html = "<table><tr><th>a</th></tr><tr><td>1</td><td>2 <b>x</b></td></tr><tr><td>short</td></tr></table><article><h2>T</h2>one</article><article>no title</article><article><h2>T</h2>two</article>"
    df = spark.createDataFrame([(1, "http://a/b", html), (2, "u", None)], "page_id long, url string, html string")
    assert [r["cells"] for r in pages.table_rows(df).collect()] == [["1", "2 x"]]
    assert [(r["title"], r["text"], r["block_status"]) for r in pages.blocks(df).collect()] == [("T", "one", "unknown")]


def test_tags_as_a_parser_sees_them(spark, sf_dir):
    import random

    rng = random.Random(12)
    bits = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th class=\"card x\">", "</th>", "<article>", "</article>", "<section>", "</section>", "<DIV class=\"a card\">", "</div>", "<h2>", "</h2>", "<b>", "</b>", "<br/>", "<!-- c -->"]
    bits += ["one", " two\n", "&amp;", "a &lt; b", "&copy;&nbsp;", '<a href="/x/12">', '<a href="/x/7?a=1&amp;b=2">', "</a>", "x & y", "<script>if (a) b</script>"]
    strange = ["&eacute;", "<a href='q'>", "<td/>", "3 < 4", "<script>a</p>b</script>", '<p title=">">', "&#233;", "<textarea>"]
    rows = [(i, "http://a/b", "".join(rng.choices(bits + (strange if i % 4 == 0 else []), k=rng.randrange(1, 40)))) for i in range(600)] + [(900, "u", None), (901, "u", "")]
    # a cell that outlives its row stops the parser
    ok = [r for r in rows if not _stops(r[2])]
    df = spark.createDataFrame(ok, "page_id long, url string, html string").cache()
    assert 300 < df.where(markup.decidable(F.col("html"))).count() < len(ok)
    every = lambda d: sorted(map(str, d.collect()))
    assert every(pages.table_rows(df, 1)) == every(pages.parsed_rows(df, 1))
    for pattern in (None, r"/x/(\d+)"):
        cut = pages.blocks(df, ("article", "section"), pattern).select("page_id", "ord", "title", "text", "block_id")
        assert every(cut) == every(pages.parsed_blocks(df, ("article", "section"), pattern))
    real = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet")
    tags = ("article", "section", "div", "body")
    assert real.where(markup.decidable(F.col("html"))).count() == real.count()
    assert every(pages.blocks(real, tags).select("page_id", "ord", "title", "text", "block_id")) == every(pages.parsed_blocks(real, tags, None))


def _stops(html):
    try:
        p = pages._Table()
        p.feed(html or "")
    except AttributeError:
        return True
    return False


def test_csv_round_trip(spark, tmp_path, sf_dir):
    rows = Shapes(spark, sf_dir).listings.limit(20)
    files.write_listing_csv(rows, f"file://{tmp_path}/out")
    back = files.read_listing_csv(spark, f"file://{tmp_path}/out")
    assert back.count() == 20 and set(files.COLUMNS) < set(back.columns)
    (tmp_path / "bad.csv").write_text("Name,URL\na,b\n")
    with pytest.raises(ValueError, match="missing columns"):
        files.read_listing_csv(spark, f"file://{tmp_path}/bad.csv")
    files.write_listing_csv(rows, f"file://{tmp_path}/split", by_source=True, snapshot_date="2024-01-31")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/split").count() == 20


def test_a_date_is_published_once(spark, tmp_path, sf_dir):
    rows = Shapes(spark, sf_dir).listings
    put = lambda df, date: files.write_listing_csv(df, f"file://{tmp_path}/out", by_source=True, snapshot_date=date)
    put(rows, "2024-01-30")
    put(rows.where("source in ('towne', 'harmon')").withColumn("source", F.when(F.col("source") == "towne", "a/b c").otherwise(F.col("source"))), "2024-01-31")
    other = files_in(tmp_path / "out" / "snapshot_date=2024-01-30")
    for _ in range(2):
        put(rows.where("source in ('harmon', 'keenan')"), "2024-01-31")
    back = spark.read.option("header", True).csv(f"file://{tmp_path}/out")
    want = {("2024-01-30", r[0]): r[1] for r in rows.groupBy("source").count().collect()} | {("2024-01-31", r[0]): r[1] for r in rows.where("source in ('harmon', 'keenan')").groupBy("source").count().collect()}
    assert {(str(r[0]), r[1]): r[2] for r in back.groupBy("snapshot_date", "Source").count().collect()} == want
    assert files_in(tmp_path / "out" / "snapshot_date=2024-01-30") == other


def files_in(folder):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if n.endswith(".csv")}


def test_rules_of_sites(spark, sf_dir):
    from parcelflow.queries import QUERIES

    found = QUERIES["extract_listings"](spark, sf_dir).collect()
    assert {(r["source"], r["field"]) for r in found} == {r[:2] for r in rules.SITE_RULES} and all(r["value"] for r in found)
    table = spark.createDataFrame([("a", "x", "first", "(z+)", 1), ("a", "x", "first", "(a+)(b+)", 2), ("a", "all", "all", "b.", 0)], rules.RULES)
    pages_ = spark.createDataFrame([(1, "a", "aabb bc"), (2, "b", "aabb"), (3, None, None), (4, "a", None)], "page_id long, source string, html string")
    assert {r["page_id"]: r["fields"] for r in rules.extract_listings(pages_, table).collect()} == {1: {"x": "bb", "all": "bb; bc"}, 2: {}, 3: {}, 4: {"x": None, "all": None}}


def test_label_paragraphs(spark):
    got = lambda html, cls=None: [tuple(x) for x in one(spark, pages.paragraph_pairs(F.col("a"), cls), a=html) or []]
    html = '<div class="x forecol y"><p>State: </p>\n<p><b>MA</b>  x</p><p>more</p></div><div class="forecol"><p>Only</p></div><div class="other"><p>No</p><p>no</p></div><p>Sale Date:</p><p>1/2</p><p>:</p><p>none</p>'
    assert got(html, "forecol") == [("State", "MA x")] and got(html) == [("State", "MA x"), ("Sale Date", "1/2")]


def test_caches(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.LongType())])
    assert files.read_cache(spark, f"file://{tmp_path}/none", schema).count() == 0
    (tmp_path / "c.json").write_text('{"id": "a", "v": 1}\n{broken\n')
    assert [tuple(r) for r in files.read_cache(spark, f"file://{tmp_path}/c.json", schema).collect()] == [("a", 1)]


def test_snapshot_stream_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    rows = [("2024-01-01 00:00:00", 1, "a", "x", "active"), ("2024-01-02 00:00:00", 2, "a", "x", "postponed"), ("2024-01-02 00:00:00", 3, "a", "y", "active")]
    schema = "as_of string, seq long, source string, listing_id string, status string, latitude double, longitude double"
    spark.createDataFrame([(*r, float(r[1]), 2.0) for r in rows], schema).write.parquet(f"file://{tmp_path}/in/1")
    store = StateStore(spark, f"file://{tmp_path}/state")
    source = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    apply, calls = streams.apply_snapshot, []

    def once(*a):
        calls.append(a[2])
        if len(calls) == 2:
            raise OSError("lost")
        apply(*a)

    monkeypatch.setattr(streams, "apply_snapshot", once)
    with pytest.raises(Exception):
        streams.snapshot_stream(spark, source(), store, "as_of", f"file://{tmp_path}/cp").awaitTermination()
    assert store.versions() == [1]
    streams.snapshot_stream(spark, source(), store, "as_of", f"file://{tmp_path}/cp").awaitTermination()
    got = sorted((r["run_id"], r["event_id"], r["event_type"]) for r in store.read("events", load.EVENTS).collect())
    assert got == [(1, 1, "first_seen"), (2, 2, "status_change"), (2, 3, "first_seen")] and calls == ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:00"]


def test_digest_is_capped_over_all_states(spark):
    day = lambda n: dt.datetime(2024, 2, n, 10)
    props = spark.createDataFrame([(i, i, ("MA", "NH", "ME")[i % 3], f"{i} Oak & Elm", day(1 + i % 20), "active", dt.datetime(2023, 12, 1), dt.datetime(2024, 1, 30), f"https://e.com/{i}", 42.0, -71.0) for i in range(1, 28)], "property_id long, auction_id long, state string, address string, auction_datetime timestamp_ntz, status string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, url string, latitude double, longitude double")
    events = spark.createDataFrame([(i, i, "date_change", "2024-02-01T10:00:00", "2024-02-08T10:00:00", dt.datetime(2024, 1, 30)) for i in range(1, 28)] + [(90, 27, "disappeared", "active", None, dt.datetime(2024, 1, 30, 1))], "event_id long, auction_id long, event_type string, old_value string, new_value string, detected_at timestamp_ntz")
    people = spark.createDataFrame([(1, "all@e.com", "active", True, True), (2, "one@e.com", "active", True, True)], "subscriber_id long, email string, subscription_status string, alerts boolean, active boolean")
    states = spark.createDataFrame([(1, "MA"), (1, "NH"), (1, "ME"), (2, "MA")], "subscriber_id long, state string")
    sent = spark.createDataFrame([("all@e.com", "weekly", dt.datetime(2024, 1, 1))], "email string, kind string, sent_at timestamp_ntz")
    rows = digest.subscriber_digest(people, states, props, events, None, sent, "2024-01-31 00:00:00").cache()
    got = {(r["email"], r["section"]): (r["n"], r["more"]) for r in rows.groupBy("email", "section").agg(F.count("*").alias("n"), F.max("more").alias("more")).collect()}
    assert got == {("all@e.com", "Upcoming"): (5, 21), ("all@e.com", "Date Changes"): (5, 21), ("all@e.com", "Removed"): (1, 0), ("one@e.com", "Upcoming"): (5, 3), ("one@e.com", "Date Changes"): (5, 3)}
    assert rows.where("email = 'all@e.com' and section = 'Upcoming'").orderBy("rank").first()["property_id"] == 20
    body = {r["email"]: r for r in digest.render(rows, "2024-01-31 00:00:00").collect()}
    plain = body["one@e.com"]["plain"].splitlines()
    upcoming = plain[: plain.index("== Date Changes")]
    # MA: 3, 6, ..., 24 on days 4, 7, ..., 19, 2 (21), 5 (24); 27 disappeared
    assert upcoming == ["== Friday, February 2", "  02/02 at 10:00 AM  21 Oak & Elm  https://e.com/21", "== Sunday, February 4", "  02/04 at 10:00 AM  3 Oak & Elm  https://e.com/3", "== Monday, February 5", "  02/05 at 10:00 AM  24 Oak & Elm  https://e.com/24", "== Wednesday, February 7", "  02/07 at 10:00 AM  6 Oak & Elm  https://e.com/6", "== Saturday, February 10", "  02/10 at 10:00 AM  9 Oak & Elm  https://e.com/9", "  +3 more"]
    changed = plain[len(upcoming) :]
    assert changed[0] == "== Date Changes" and len(changed) == 7 and changed[-1] == "  +3 more" and all(re.search(r"  (\d+) Oak & Elm  \[2024-02-01 → 2024-02-08\]  https://e.com/\1$", x) for x in changed[1:-1])
    html = body["all@e.com"]["html"]
    assert html.count("<p><b>") == 11 and html.count(">details</a>") == 10 and "27 Oak &amp; Elm" in html and "<mark>Removed</mark></p>" in html and html.count("+21 more") == 2 and "& Elm" not in html
    sent_rows = json.loads({r["email"]: r["payload"] for r in digest.payload(rows, "2024-01-31 00:00:00").collect()}["one@e.com"])
    assert [x["propertyId"] for x in sent_rows["upcoming"]] == [21, 3, 24, 6, 9] and sent_rows["changes"][0]["labels"] == ["2024-02-01 → 2024-02-08"]


def test_first_rows_for_every_threshold(spark):
    import random

    rng, t = random.Random(8), lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    rows = [("ABC"[min(2, rng.randrange(9))], f"{rng.randrange(90)} Oak", i, t(rng.randrange(60))) for i in range(700)] + [("D", f"{i:03d}", i, t(i % 50)) for i in range(60)] + [("E", "x", 1, None)]
    df = spark.createDataFrame(rows, "state string, by_address string, property_id long, removed_at timestamp_ntz").repartition(5)
    top = [tuple(r) for r in thresholds.threshold_top(df, "state", "removed_at", 3, ("by_address", "property_id")).select("state", "by_address", "property_id", "removed_at", "from_value").collect()]
    assert len(top) < len(rows) / 3
    for state in "ABCDE":
        own = sorted((a, p, r) for s, a, p, r in rows if s == state and r is not None)
        for m in range(-1, 61):
            want = [x for x in own if x[2] > t(m)][:3]
            assert sorted((a, p, r) for s, a, p, r, since in top if s == state and r > t(m) and (since is None or t(m) >= since)) == want


def test_removals_follow_the_first_notification(spark):
    import random

    rng = random.Random(9)
    t = lambda m: dt.datetime(2024, 1, 24) + dt.timedelta(seconds=m)
    week = 7 * 86400
    gone = [(rng.choice(["MA", "NH"]), i, f"{rng.randrange(40)} Elm", t(rng.randrange(week))) for i in range(300)]
    gone += [("MA", 900 + i, f"{i} Ash", t(week // 2 + i)) for i in range(40)]  # in one minute
    told = [(f"u{i}", s, t(rng.choice([-5000, rng.randrange(week), week // 2 + rng.randrange(50)]))) for i in range(60) for s in ({"MA"} if i % 3 else {"MA", "NH"})]
    told = [(e, s, min(x for f, _, x in told if f == e)) for e, s, _ in told]
    rows, counts = digest.removals(
        spark.createDataFrame(told, "email string, state string, first_sent timestamp_ntz"),
        spark.createDataFrame([(s, p, a, a, r) for s, p, a, r in gone], "state string, property_id long, address string, by_address string, removed_at timestamp_ntz"), "2024-01-24 00:00:00", 5,
    )
    got, n = {}, {r["email"]: r["_n"] for r in counts.collect()}
    for r in rows.collect():
        got.setdefault((r["email"], r["state"]), []).append((r["address"], r["property_id"]))
    for e, s, first in told:
        assert sorted(got.get((e, s), [])) == sorted((a, p) for st, p, a, r in gone if st == s and r > first)[:5]
    for e in {x[0] for x in told}:
        assert n[e] == sum(1 for f, s, first in told if f == e for st, _, _, r in gone if st == s and r > first)


def test_fan_out_of_a_hot_state(spark):
    people = spark.range(4000).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("email"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("S"), (F.col("id") % 7).cast("string"))).otherwise("MA").alias("state"))
    rows = spark.createDataFrame([("MA", i) for i in range(9)] + [("S3", 1), ("none", 2), (None, 3)], "state string, property_id long")
    want = sorted(map(tuple, people.join(rows, "state").collect()))
    for sent, each in ((1 << 20, 10), (0, 500), (0, 10_000)):
        got = joins.skewed_fan_out(people, rows, sent_bytes=sent, each=each)
        assert sorted((r["state"], r["email"], r["property_id"]) for r in got.collect()) == want
    assert joins.measured_bytes(rows) == 12 * 16 + 9 * 2 + 2 + 4 and joins.measured_bytes(rows.limit(0)) == 0


def test_texts_are_extracted_once(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s", buckets=3)
    asked = []

    def extract(df):
        asked.append(sorted(r["id"] for r in df.collect()))
        return df.select("id", F.create_map(F.lit("t"), "text").alias("fields"))

    run = lambda n, *rows: {r["id"]: (r["hit"], r["fields"]["t"]) for r in cache.cached_fields(store, spark.createDataFrame(list(rows), "id string, text string"), extract, n).collect()}
    assert run(1, ("a", "x"), ("b", None), (None, "y"), ("c", "z"), ("c", "z")) == {"a": (False, "x"), "b": (False, ""), "c": (False, "z")}
    assert run(2, ("a", "x"), ("b", ""), ("c", "zz"), ("d", "n")) == {"a": (True, "x"), "b": (True, ""), "c": (False, "zz"), "d": (False, "n")}
    assert run(3, ("a", "x"), ("b", ""), ("c", "zz"), ("d", "n")) == {"a": (True, "x"), "b": (True, ""), "c": (True, "zz"), "d": (True, "n")}
    assert run(4, ("c", "z")) == {"c": (False, "z")} and run(5) == {}
    assert asked == [["a", "b", "c"], ["c", "d"], [], ["c"], []]
    assert sorted((r["id"], r["run_id"]) for r in store.read("extracted", cache.CACHE).collect()) == [("a", 1), ("b", 1), ("c", 4), ("d", 2)]


def test_links_of_bodies(spark):
    day = lambda n: dt.datetime(2024, 2, n, 10)
    rows = [("Upcoming", 1, day(28)), ("New", 1, day(20)), ("New", 2, day(21)), ("New", 3, None), ("Date Changes", 1, day(28)), ("Status Changes", 1, None), ("Removed", 1, day(3))]
    df = spark.createDataFrame([("a@e", s, r, 0, "MA", 10 * i, f"{i} Oak St", t, [], f"https://e.com/?a={i}&b=1", 42.0, -71.0) for i, (s, r, t) in enumerate(rows)], "email string, section string, rank int, more int, state string, property_id long, address string, auction_datetime timestamp_ntz, labels array<string>, url string, latitude double, longitude double")
    body = digest.render(df, "2024-01-31 00:00:00").first()
    linked = {i for i in range(7) if f"https://e.com/?a={i}&b=1" in body["plain"]}
    assert linked == {0, 1, 4} and body["plain"].count("(soon)") == 1 and "2 Oak St  (soon)" in body["plain"]
    assert {i for i in range(7) if f'href="https://e.com/?a={i}&amp;b=1"' in body["html"]} == linked and body["html"].count(">map</a>") == 3 and body["html"].count("<i>soon</i>") == 1


def test_removed_as_the_map_sees_it(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    props = spark.createDataFrame([(1, 1, "MA", "active", day(12)), (2, 2, "MA", "SOLD", day(12)), (3, 3, "NH", "active", day(12)), (4, 4, "MA", None, day(12)), (5, 5, "MA", "active", day(30)), (6, 6, "MA", "active", day(12))], "property_id long, auction_id long, state string, status string, last_seen_at timestamp_ntz")
    events = spark.createDataFrame([(10, 5, "status_change", "Sold", day(25)), (11, 5, "status_change", "withdrawn", day(26)), (12, 6, "status_change", "Cancelled", day(27)), (13, 1, "status_change", "postponed", day(27)), (14, 9, "status_change", "sold", day(27)), (15, 1, "status_change", "sold", day(31))], "event_id long, auction_id long, event_type string, new_value string, detected_at timestamp_ntz")
    got = lambda **k: sorted(digest.removed_union(events, props, "2024-01-24 00:00:00", "2024-01-31 00:00:00", **k).collect())
    assert [tuple(r) for r in sorted(got(states=["MA"]), key=str)] == [(1, None, "stale"), (5, 10, "status"), (5, 11, "status"), (6, 12, "status")]
    assert [r["property_id"] for r in digest.removed_union(events, props, "2024-01-24 00:00:00", "2024-01-31 00:00:00").where("reason = 'stale'").orderBy("property_id").collect()] == [1, 3]


def test_ids_of_urls_are_decoded(spark):
    got = lambda u: one(spark, text.extract_listing_id(F.col("a"), F.lit("x")), a=u)
    assert [got(u) for u in ("https://e.com/?id=a%20b", "https://e.com/?id=a+b%2Fc", "https://e.com/?id=100%", "https://e.com/x")] == ["a b", "a b/c", "100%", "https://e.com/x"]


def test_status_view_takes_saved_states_and_its_limit(spark, sf_dir):
    s = Shapes(spark, sf_dir)
    view = lambda states, paid, saved=(): {r["state"] for r in digest.status_view(s.properties, s.auction_events, None, "2024-01-31 00:00:00", states, paid, saved_states=saved).collect()}
    assert view([], False, ["nh"]) == {"NH"} and view(["ma", " "], False, ["nh"]) == {"MA"} and view([], False) == set()
    with pytest.raises(ValueError):
        view(["MA", "NH"], False)


def test_set_states_takes_the_last_good_request(spark):
    people = spark.createDataFrame([(1, "none", True), (2, "active", True), (3, "active", False)], "subscriber_id long, subscription_status string, active boolean")
    asked = spark.createDataFrame([(1, "MA", 1), (1, "nh", 2), (1, "MA,NH", 3), (2, "MA,NH,ME,VT", 1), (2, "MA,XX", 2), (3, "MA", 1)], "subscriber_id long, states string, seq long")
    now = spark.createDataFrame([(1, "ME"), (2, "ME"), (3, "ME")], "subscriber_id long, state string")
    new, rejected, began = digest.set_states(now, asked, people, ["MA", "NH", "ME", "VT"], "2024-01-31 00:00:00", spark.createDataFrame([(2, dt.datetime(2023, 1, 1))], "subscriber_id long, started_at timestamp_ntz"))
    assert sorted(map(tuple, new.collect())) == [(1, "NH"), (2, "MA"), (2, "ME"), (2, "NH"), (2, "VT"), (3, "ME")]
    assert sorted(map(tuple, rejected.collect())) == [(1, "MA,NH"), (2, "MA,XX"), (3, "MA")]
    assert sorted(map(tuple, began.collect())) == [(1, dt.datetime(2024, 1, 31)), (2, dt.datetime(2023, 1, 1))]


@pytest.mark.parametrize("raw, source, value", [("On", "sullivan", "active"), ("once", "sullivan", "once"), ("yellow", "patriot", "postponed"), ("", "patriot", "active"), ("Red", "patriot", "cancelled"), ("NEW DATE 7/9", "skypoint", "active"), (None, "skypoint", "active"), ("SOLD", "skypoint", "sold"), ("Canceled 7/1", "skypoint", "canceled"), ("Canceled", "towne", "cancelled"), ("On_Time", "towne", "active"), ("3rd Party", None, "3rd party"), ("", None, None)])
def test_statuses_by_source(spark, raw, source, value):
    assert one(spark, status.normalize_status(F.col("a"), F.col("b")), a=raw, b=source) == value


@pytest.mark.parametrize("form, raw, street, city, state, code", [
    ("gap", "12 Oak St   Keene, Cheshire County, NH 03431", "12 Oak St", "Keene", "NH", "03431"), ("gap", "12 Oak St Keene", "12 Oak St Keene", None, None, None),
    ("title", "9 Elm St, Apt. 5 a/k/a Unit 5, Salem, MA 01960 (LATE)", "9 Elm St, Apt. 5 a/k/a Unit 5", "Salem", "MA", "01960"), ("parts", "9 Elm St., Salem, MA", "9 Elm St.", "Salem", "MA", None), ("parts", "9 Elm St., Salem", "9 Elm St.", "Salem", None, None),
    ("blob", "Lots 1, 2 Elm St, Salem, MA", "Lots 1, 2 Elm St", "Salem", "MA", None), ("blob", "9 Elm St, MA", "9 Elm St", None, "MA", None), ("blob", "two lots", "two lots", None, None, None), ("scan", "Salem, MA - Three Bedroom Home 21 Nichols Drive 7,399 SF", "21 Nichols Drive", "Salem", "MA", None),
])
def test_addresses_by_form(spark, form, raw, street, city, state, code):
    found = text.split_address(F.col("a"), form)
    row = spark.createDataFrame([(raw,)], "a string").select(*(c.alias(k) for k, c in found.items())).first()
    assert tuple(row) == (street, city, state, code)


def test_urls_are_quoted_once(spark):
    from urllib.parse import quote

    for raw in ("http://a.b/é中 x", "http://a.b/%C3%A9 %zz", "http://a.b/\U0001f600\t\u007f", "http://a.b/ok?x=[1]&y=%20", ""):
        want = quote(__import__("re").sub("%(?![0-9A-Fa-f]{2})", "%25", raw), safe="-._~:/?#[]@!$&'()*+,;=%")
        assert one(spark, text.clean_url(F.col("a")), a=raw) == want


def test_lenient_dates_and_stale_sold(spark):
    got = [str(one(spark, dates.auction_datetime(F.col("a"), "2024-01-31 10:00:00"), a=x)) for x in ("Jul. 8, 2026 at 11 am", "sold on the 5th of May 2026 at noon 12:00", "March 7 at 2pm", "TBD")]
    assert got == ["2026-07-08 11:00:00", "2026-05-05 12:00:00", "2024-03-07 14:00:00", "None"]
    rows = spark.createDataFrame([(1, "SOLD", dt.datetime(2024, 1, 1)), (2, "sold", None), (3, "sold", dt.datetime(2024, 1, 20)), (4, "active", dt.datetime(2023, 1, 1))], "i long, s string, d timestamp_ntz")
    assert [r["i"] for r in rows.where(status.stale_sold(F.col("s"), F.col("d"), "2024-01-31 00:00:00")).collect()] == [1]


def brute_gate(rows, gap):
    last, out = {}, []
    for key, t in sorted(rows, key=lambda r: r[1]):
        if key not in last or t >= last[key] + gap:
            last[key] = t
            out.append((key, t))
    return out


def test_streams_against_brute_force(spark, sf_dir):
    from parcelflow.queries import QUERIES

    s = Shapes(spark, sf_dir)
    sends = [(r["email"], r["sent_at"]) for r in s.notifications.collect()]
    assert sorted((r["email"], r["sent_at"]) for r in QUERIES["cooldown_gate"](spark, sf_dir).collect()) == sorted(brute_gate(sends, dt.timedelta(hours=4)))
    checks = [(r["user_id"] % 2500, r["ts"], r["event_type"] == "error") for r in s.events.collect()]
    bad = {(k, t) for k, t, dead in checks if dead}
    first = {}
    for k, t in brute_gate([c[:2] for c in checks], dt.timedelta(minutes=15)):
        if (k, t) in bad:
            first.setdefault(k, t)
    known = {r["property_id"]: r["auction_id"] for r in s.properties.collect()}
    got = QUERIES["link_check_events"](spark, sf_dir).collect()
    assert sorted((r["auction_id"], r["detected_at"]) for r in got) == sorted((known[k], t) for k, t in first.items() if k in known)
    assert sorted(r["event_id"] for r in got) == list(range(1, len(got) + 1)) and {r["event_type"] for r in got} == {"disappeared"}


def test_link_checks_and_cooldown(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, t(0), 404, ""), (1, t(5), 404, ""), (1, t(20), 404, ""), (2, t(0), 200, "fine"), (3, t(0), 200, "Nothing found")], "property_id long, checked_at timestamp, http_status int, html string").write.parquet(f"file://{tmp_path}/r")
    src = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/r").schema).parquet(f"file://{tmp_path}/r")
    q = streams.link_checks(src).writeStream.format("memory").queryName("dead").option("checkpointLocation", f"file://{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r[0], r[1].minute) for r in spark.table("dead").collect()} == {(1, 0), (1, 20), (3, 0)}
    spark.createDataFrame([("a", t(0)), ("a", t(60)), ("a", t(241)), ("b", t(1))], "email string, sent_at timestamp").write.parquet(f"file://{tmp_path}/s")
    src = spark.readStream.schema("email string, sent_at timestamp").parquet(f"file://{tmp_path}/s")
    q = streams.cooldown(src).writeStream.format("memory").queryName("sent").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sent").count() == 3


def arrivals(spark, path, schema, batches):
    """A stream with a batch for each list of rows."""
    for i, own in enumerate(batches):
        if not (path / str(i)).exists():
            spark.createDataFrame(own, schema).coalesce(1).write.parquet(f"file://{path}/{i}")
            os.utime(next(p for p in (path / str(i)).iterdir() if p.suffix == ".parquet"), (1_700_000_000 + 60 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{path}")


HOOKS = "event_id long, seq long, event_time timestamp_ntz, subscription_id string, kind string, status string, email string"


def test_replays_after_days_are_stopped_by_the_log(spark, tmp_path):
    d = lambda n, h=0: dt.datetime(2024, 1, n, h)
    hook = lambda e, q, t, kind="updated", sub="s1", status=None, email=None: (e, q, t, sub, kind, status, email)
    batches = [
        [hook(1, 1, d(1), "checkout", email="a@e"), hook(1, 2, d(1)), hook(2, 3, d(1, 5), status="past_due"), hook(None, 4, d(1))],
        [hook(3, 5, d(3), status="active"), hook(2, 6, d(3, 1), status="past_due")],  # two days late
        [hook(1, 7, d(3, 5), "deleted"), hook(9, 8, None, "other")],
        [hook(9, 9, None, "other"), hook(4, 10, d(2), "deleted", sub="s2")],
    ]
    store = StateStore(spark, f"file://{tmp_path}/s")
    run = lambda: streams.subscription_stream(arrivals(spark, tmp_path / "in", HOOKS, batches), store, f"file://{tmp_path}/c").awaitTermination()
    run()
    assert sorted((r[0], r[1]) for r in store.read("webhooks", streams.WEBHOOKS).collect()) == [(1, 1), (2, 3), (3, 5), (4, 10), (9, 8)]
    got = {r["subscription_id"]: (r["email"], r["subscription_status"], r["deleted"]) for r in store.read("subscriptions", billing.SUBSCRIPTIONS).collect()}
    assert got["s1"] == ("a@e", "active", None) and got["s2"][:2] == (None, "canceled")
    # only the folders of near days are read
    plan = store.read("webhooks", streams.WEBHOOKS).where("day between date'2024-01-02' and date'2024-01-04'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_billing_has_one_order_over_batches(spark, tmp_path):
    import random

    rng, t = random.Random(4), lambda n: dt.datetime(2024, 1, 1, n)
    events = []
    for i in range(120):
        sub = f"s{rng.randrange(12)}"
        kind = rng.choice(["checkout", "updated", "updated", "deleted", "other"])
        events.append((i, i, t(rng.randrange(6)), sub, kind, rng.choice(["active", "past_due", "trialing"]), f"u{int(sub[1:]) // 2}@e" if kind == "checkout" else None))
    rng.shuffle(events)
    store = StateStore(spark, f"file://{tmp_path}/s")
    streams.subscription_stream(arrivals(spark, tmp_path / "in", HOOKS, [events[:50], events[50:80], events[80:]]), store, f"file://{tmp_path}/c").awaitTermination()
    fields = [f for f in billing.merged(billing.folded(spark.createDataFrame(events, HOOKS))).columns]
    whole = {tuple(r) for r in billing.folded(spark.createDataFrame(events, HOOKS)).select(fields).collect()}
    state = store.read("subscriptions", billing.SUBSCRIPTIONS)
    assert {tuple(r) for r in state.select(fields).collect()} == whole
    # the same by applying one event after the other
    sub, status, active = {}, {}, {f"u{i}@e": True for i in range(7)}
    for e in sorted(events, key=lambda e: (e[2], e[0])):
        if e[4] == "checkout":
            sub[e[6]], status[e[6]] = e[3], "active"
        for email in [m for m, x in sub.items() if x == e[3]]:
            if e[4] == "updated":
                status[email] = e[5]
            if e[4] == "deleted":
                status[email] = "canceled"
                active[email] = False
    people = spark.createDataFrame([(f"u{i}@e", "old", "none", True, True) for i in range(7)], "email string, subscription_id string, subscription_status string, active boolean, alerts boolean")
    got = {r["email"]: r for r in billing.after_billing(people, state).collect()}
    assert {m: (r["subscription_id"], r["subscription_status"]) for m, r in got.items()} == {m: (sub.get(m, "old"), status.get(m, "none")) for m in active}
    assert not any(got[m]["active"] and not active[m] for m in active if len({e[3] for e in events if e[6] == m}) == 1)
    assert {r["email"] for r in digest.eligible(billing.after_billing(people, state)).collect()} == {m for m, r in got.items() if r["active"] and r["subscription_status"] in ("active", "trialing")}


def test_timed_state_is_freed(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [[(f"a{i}", t(i % 50)) for i in range(40)], [("a0", t(100)), ("b", t(110))], [("a0", t(241)), ("a1", t(242)), ("late", t(241))], [("z", t(2000))], [("a0", t(1999)), ("y", t(9000))]]
    src = arrivals(spark, tmp_path / "s", "email string, sent_at timestamp", rows)
    q = streams.cooldown(src).writeStream.format("memory").queryName("gate").option("checkpointLocation", f"file://{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        q.stop()
    got = sorted((r[0], r[1]) for r in spark.table("gate").collect())
    assert got == sorted(brute_gate([r for own in rows for r in own], dt.timedelta(hours=4)))
    assert max(held) >= 40 and held[-1] <= 4  # each row of state has a timer's row or two


def test_fan_out_counts_every_listing_of_eligible_subscribers(spark):
    states = spark.createDataFrame([(1, "MA"), (1, "NH"), (2, "MA"), (3, "MA"), (4, "ME")], "subscriber_id long, state string")
    people = spark.createDataFrame([(1,), (2,), (4,)], "subscriber_id long")
    rows = spark.createDataFrame([(i, ("MA", "NH")[i % 2]) for i in range(1, 8)] + [(9, None)], "property_id long, state string")
    assert {tuple(r) for r in joins.fan_out_counts(states, people, rows).collect()} == {("MA", 6), ("NH", 4)}


def test_whole_queries_reach_every_listing(spark, sf_dir):
    from parcelflow.plans import digest
    from parcelflow.plans.shapes import Shapes
    from parcelflow.queries import QUERIES

    s = Shapes(spark, sf_dir)
    people = digest.eligible(s.subscribers)
    pairs = joins.fan_out(s.subscriber_states.join(people.select("subscriber_id"), "subscriber_id"), s.properties.select("state", "property_id"))
    assert {tuple(r) for r in QUERIES["subscriber_fanout_whole"](spark, sf_dir).collect()} == {tuple(r) for r in pairs.groupBy("state").count().collect()}
    saved = {tuple(r)[:2] for r in QUERIES["save_property_whole"](spark, sf_dir).collect()}
    email = {r["subscriber_id"]: r["email"] for r in people.collect()}
    known = {r["property_id"] for r in s.properties.collect()}
    asked = {(email[r["l_suppkey"]], r["l_orderkey"]) for r in s.lineitem.collect() if r["l_suppkey"] in email and r["l_orderkey"] in known}
    assert saved == {tuple(r) for r in s.saved_properties.select("email", "property_id").collect()} | asked


def test_page_blocks_match_their_sql_on_a_reference_without_its_semicolon(spark, tmp_path):
    import duckdb

    from parcelflow.queries import ORACLES, QUERIES
    from tests.oracle import same

    htmls = ["<article><h1>A &amp; B</h1><p>x &lt; y &amp</p></article>", "<article><h1>A &amp</h1><p>x &lt</p></article>", "<article><h1>A</h1><p>&quot; &gt &am</p></article>", "<article><h1>A</h1>&amp;lt; &amp;amp</article>"]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(htmls)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    found = {r["page_id"]: (r["title"], r["text"]) for r in QUERIES["page_blocks"](spark, str(tmp_path)).collect()}
    assert found == {0: ("A & B", "x < y &"), 1: ("A &", "x <"), 2: ("A", '" > &am'), 3: ("A", "&lt; &amp")}
    same(spark, con, str(tmp_path), QUERIES["page_blocks"], ORACLES["page_blocks"])


def test_the_live_map_is_read_back_with_its_meta_rows_total(spark, sf_dir):
    from parcelflow.queries import QUERIES

    rows = QUERIES["write_live_map"](spark, sf_dir)
    assert [r["total"] for r in rows.select("total").distinct().collect()] == [Shapes(spark, sf_dir).properties.count()]


def test_dates_are_tidied_once_and_parsed_only_where_they_look_right(spark):
    """A text that fits no form meets no formatter, and its tidy form is not worked out again for each of them."""
    made = str(dates.parse_auction_datetime(F.col("a"))).lower()
    assert made.count("regexp_replace") < len(dates.PATTERNS) and made.count("rlike") == len(dates.PATTERNS)
    day = dt.datetime(2024, 9, 5)
    wanted = {"Sep 5, 2024 at 3:07 PM": (15, 7), "Thursday, September 05, 2024 at 3 p.m.": (15, 0), "sep 5, 2024": (0, 0), "9/5/2024 at 3:07 am": (3, 7), "9/5/2024 3 PM": (15, 0), "2024-09-05T01:02:00": (1, 2)}
    for raw, (hour, minute) in wanted.items():
        assert one(spark, dates.parse_auction_datetime(F.col("a")), a=raw) == day.replace(hour=hour, minute=minute)
    for raw in ("Sep 31, 2024", "Sept 5, 2024", "Sep 5, 2024 13:07 PM", "9/5/24x", "2024-9-05", "Sep 5, 2024 now"):
        assert one(spark, dates.parse_auction_datetime(F.col("a")), a=raw) is None


def test_a_lenient_date_is_parsed_once_a_worker():
    from parcelflow.functions.udf import lenient

    lenient.cache_clear()
    assert {lenient("held on Sep 5, 2024", "2024-01-31") for _ in range(3)} == {dt.datetime(2024, 9, 5)} and lenient.cache_info().misses == 1


def test_street_words_are_shortened_in_one_pass(spark):
    made = str(text.address_key(F.col("a"), F.col("a")))
    assert made.count("regexp_replace") < len(text.STREET_WORDS)
    for raw, short in (("12 North-East Street, Apt 4", "12 N-E ST"), ("STREETS OF NORTH'S ROAD", "STREETS OF N'S RD"), ("Éast Court #7", "ÉAST CT #7"), (" _North  Lane ", "_NORTH LN")):
        assert one(spark, text.normalize_street(F.col("a")), a=raw) == short
    assert one(spark, text.house_street(F.col("a")), a="12a North  Street-Road, Lowell") == "n st rd"


def test_comparison_reads_what_events_need_only(spark):
    """A comparison without a next state shuffled whole rows of both sides."""
    kept = lambda ddl: files.kept(spark.createDataFrame([], ddl), "narrow")
    made = load.compared(kept(load.SNAPSHOT), kept(load.STATE), ["a"]).select("source", "listing_id", F.inline("made"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "500")
    try:
        plan = made._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert "made" in plan and "description" not in plan.split("Relation")[0]


def test_details_of_a_description_need_no_lambda(spark):
    rows = spark.createDataFrame([("# Baths: 2 full / 1 half",), ("# Baths: 1.5; x",), ("# Baths: none",), (None,)], "description string")
    found = load.described(rows, [])
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r["bathrooms"] for r in found.collect()] == [2.5, 1.5, None, None]


def test_cross_source_repeats_are_the_rest(spark):
    df = spark.createDataFrame([(1, "landmark", "k"), (2, "brockscott", "k"), (3, "landmark", None), (4, "harmon", "m"), (5, "keenan", "m"), (6, "patriot", "n"), (7, None, "n")], "seq long, source string, key string")
    assert {r["seq"] for r in dedup.cross_source_repeats(df, F.col("key")).collect()} == {2}
    assert {r["seq"] for r in dedup.cross_source(df, F.col("key")).collect()} == {1, 3, 4, 5, 6, 7}


def test_rows_are_ranked_for_sets_of_states_not_for_people(spark):
    """Every person's rows were sorted after the fan-out, in as few tasks as people had files."""
    rng = random.Random(12)
    states = {f"u{i}": rng.sample(["MA", "NH", "ME", "VT"], rng.randrange(1, 4)) for i in range(60)}
    people = spark.createDataFrame([(e, s) for e, own in states.items() for s in own] + [("none", None), (None, "MA")], "email string, state string")
    rows = [(rng.choice(["MA", "NH", "ME", None]), rng.choice("ab"), rng.randrange(9), i) for i in range(80)]
    found = digest.first_of_states(people, spark.createDataFrame(rows, "state string, section string, by long, id long"), 3, ("by", "id"))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for email, own in (states | {None: ["MA"]}).items():
        for section in "ab":
            mine = sorted((b, i, s) for s, x, b, i in rows if s in own and x == section)
            want += [(email, section, n, max(len(mine) - 3, 0), s, i) for n, (b, i, s) in enumerate(mine[:3], 1)]
    assert sorted(map(tuple, found.select("email", "section", "rank", "more", "state", "id").collect()), key=str) == sorted(want, key=str)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_pairs_against_brute_force(spark):
    rng, box = random.Random(17), 0.0015
    at = [(c + rng.choice([0, box, -box, 4 * box, rng.uniform(-3 * box, 3 * box)]), -d + rng.uniform(-3 * box, 3 * box)) for c, d in ((0.0, 0.0), (42.0, 71.0), (6 * box, 6 * box), (-42.003, 250.0)) for _ in range(60)]
    rows = [(i, "ab"[i % 2], lat, lon, "12"[i % 3 == 0], "elm") for i, (lat, lon) in enumerate(at)]
    df = spark.createDataFrame(rows, "property_id long, source string, latitude double, longitude double, house string, street string")
    side = lambda p: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    got = sorted((r["a_property_id"], r["b_property_id"]) for r in joins.near_pairs(side("a"), side("b"), box, ["house"]).collect())
    assert got == sorted((a[0], b[0]) for a in rows for b in rows if a[4] == b[4] and abs(a[2] - b[2]) <= box and abs(a[3] - b[3]) <= box)


def test_candidates_are_read_once_and_streets_bounded_once(spark):
    """Ranks were joined to the pairs from the properties again, and letters counted for every pair of places."""
    props = spark.createDataFrame([(1, "a", 42.0, -71.0, "1 Elm St", "active", dt.datetime(2024, 1, 1)), (2, "b", 42.0, -71.0, "1 Elm Street", "sold", dt.datetime(2024, 1, 2))], "property_id long, source string, latitude double, longitude double, address string, status string, last_seen_at timestamp_ntz")
    found = links.link_candidates(props)
    assert plan_of(found).count("Join ") == 1 and [tuple(r)[:2] for r in found.collect()] == [(1, 2)]
    names = links.open_streets(spark.createDataFrame([("elm st", "elms st"), ("elms st", "elm st"), ("x", "elm")], "a_street string, b_street string"), 0.6)
    assert "Aggregate" not in plan_of(names) and sorted(map(tuple, names.collect())) == [("elm st", "elms st"), ("elms st", "elm st")]


def test_joins_of_a_load_sort_by_what_differs_first(spark, tmp_path, monkeypatch):
    """They sorted by the source, of which there are few, and by a struct of coordinates."""
    both = load.compared(spark.createDataFrame([], load.SNAPSHOT), spark.createDataFrame([], load.STATE), ["a"])
    df = spark.createDataFrame([(1, "a", "1"), (2, "b", "2")], "seq long, source string, listing_id string")
    plan = lambda x: x._jdf.queryExecution().analyzed().toString()
    assert re.search(r"Join FullOuter, \(\(listing_id#\d+ = listing_id#\d+\) AND", plan(both))
    assert re.search(r"Join LeftOuter, \(\(_hash#\d+L = _hash#\d+L\) AND", plan(dedup.cross_source_repeats(df, F.struct("source"))))
    rows = df.select("source", "listing_id", "seq")
    new, old = (StateStore(spark, f"file://{tmp_path}/{x}", buckets=3) for x in ("new", "old"))
    new.commit("1", keyed={"t": (rows, load.KEYS, ["a", "b"])})
    assert new.manifest()["by"]["t"] == list(load.JOINED)
    # a table of an older version, dealt by its keys in order, stays so
    with monkeypatch.context() as m:
        m.setattr(StateStore, "dealt_by", staticmethod(lambda _, __, keys: list(keys)))
        old.commit("1", keyed={"t": (rows, load.KEYS, ["a", "b"])})
    path = tmp_path / "old/manifests/00000001.json"
    path.write_text(json.dumps({k: v for k, v in json.loads(path.read_text()).items() if k != "by"}))
    (tmp_path / "old/manifests/.00000001.json.crc").unlink(missing_ok=True)
    more = spark.createDataFrame([("b", str(i), i) for i in range(20)], "source string, listing_id string, seq long")
    for store, by in ((new, load.JOINED), (old, load.KEYS)):
        store.commit("2", keyed={"t": (more, load.KEYS, ["b"])})
        assert store.manifest()["by"]["t"] == list(by)
        held = store.bucketed("t", "source string, listing_id string, seq long", load.KEYS, ["a", "b"])
        assert sorted(tuple(r) for r in held.join(more.select(*load.KEYS), list(by)).select("seq").collect()) == [(i,) for i in range(20)] and held.count() == 21


def test_a_cache_bucket_is_one_file_and_texts_move_only_if_missing(spark, tmp_path):
    """Each of 64 buckets was dealt to as many files as there are shuffle partitions, and every text was shuffled and written."""
    store = StateStore(spark, f"file://{tmp_path}/s", buckets=3)
    seen = []

    def extract(df):
        seen.append(plan_of(df))
        return df.select("id", F.create_map(F.lit("t"), "text").alias("fields"))

    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("text "), "id").alias("text"))
    assert cache.cached_fields(store, rows, extract, 1).where("not hit").count() == 400
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]
    assert len(list(tmp_path.glob("s/extracted/*/part=*/*.parquet"))) == len(store.manifest()["keyed"]["extracted"]) <= cache.BUCKETS
    changed = rows.withColumn("text", F.when(F.col("id") == "7", F.lit("new")).otherwise(F.col("text"))).union(rows.where("id = '9'"))
    found = cache.cached_fields(store, changed, extract, 2)
    assert [tuple(r) for r in found.where("not hit").select("id", "fields.t").collect()] == [("7", "new")] and found.count() == 400


def test_a_load_shuffles_whole_rows_once_and_compares_narrow_ones(spark, sf_dir):
    """Whole rows were shuffled for the latest, the comparison and the ids, and the next state was kept beside its use; the report joined it again for addresses."""
    s = Shapes(spark, sf_dir)
    first = load.load_snapshot(s.snapshot_1, empty_state(spark), "2024-01-01 00:00:00", 1)
    # a state is a join of buckets; what it shuffles is the repeats and the new ids of each load
    again = load.load_snapshot(s.snapshot_1, None, "2024-01-01 00:00:00", 1)
    assert rows_of(again.state) == rows_of(first.state) and again.state.count() > 0
    done = load.load_snapshot(s.snapshot_2.unionByName(s.snapshot_2.where("seq % 19 = 0").withColumn("latitude", F.lit(None).cast("double"))), again.state, "2024-01-31 00:00:00", 2, 10**6, 10**6, carried=["address"])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [x.state.select("*")._jdf.queryExecution().executedPlan().toString() for x in (again, done)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert [(p.count("Bucketed: true"), p.count("Exchange hashpartitioning"), p.count("FullOuter")) for p in plans] == [(1, 2, 0), (2, 4, 1)]
    joined = files.import_report(done.events, done.state.select("auction_id", "address"), done.run, done.rejects.select("seq", "name"), 2)
    report = files.import_report(done.changes, None, done.run, done.rejects.select("seq", "name"), 2)
    assert rows_of(report) == rows_of(joined) and report.where("section = 5").count() > 2


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_a_stored_state_is_written_as_it_is_joined(spark, tmp_path, monkeypatch):
    """The next state was written beside, read back, shuffled to buckets and written again."""
    store, dealt = StateStore(spark, f"file://{tmp_path}/s", buckets=3), []
    shuffle = spark.range(1).__class__.repartition
    monkeypatch.setattr(spark.range(1).__class__, "repartition", lambda df, *a: dealt.append("first_seen_at" in df.columns) or shuffle(df, *a))
    rows = [(i, "ab"[i % 2], str(i), "u", "active") for i in range(1, 41)]
    streams.apply_snapshot(store, listed(*rows)(spark), "2024-01-01 00:00:00", "1")
    streams.apply_snapshot(store, listed(*((*r[:4], "sold") for r in rows if r[0] % 3), (50, "a", "50", "u", "active"))(spark), "2024-01-02 00:00:00", "2")
    assert dealt and not any(dealt)
    state = {int(r["listing_id"]): (r["property_id"], r["status"], r["last_event"]) for r in store.read("state", load.STATE).collect()}
    assert state == {i: (i, "sold", "status_change") if i % 3 else (i, "active", "disappeared") for i in range(1, 41)} | {50: (41, "active", "first_seen")}
    written = files_of(f"{tmp_path}/s/state")
    assert len(written) == len({(os.path.dirname(f), re.search(r"_(\d{5})\.c", f)[1]) for f in written}) <= 2 * 2 * 3  # a file a bucket


def test_changes_are_placed_newest_first_without_a_time_last(spark, tmp_path):
    """next_ids dropped its own column when it was to be named place; events without a time came first, and an hour that clocks skip was moved."""
    import duckdb

    from parcelflow.queries import ORACLES, QUERIES
    from tests.oracle import same

    ids = joins.next_ids(spark.range(9, 0, -1, 3).toDF("k"), "k", 4, "place")
    assert ids.columns == ["k", "place"] and sorted(map(tuple, ids.collect())) == [(k, k + 4) for k in range(1, 10)]
    # a night in which New York's clocks skip an hour, some eight events a time, and every seventh without one
    ts = "case when id % 7 <> 0 then timestamp_ntz'2024-03-09 20:00:00' + make_dt_interval(0, 0, 20 * cast(id div 2 % 40 as int)) end as ts"
    spark.range(300).selectExpr("id as event_id", ts, "1L as user_id", "'click' as event_type", "1.0D as value", "'' as props").union(
        spark.createDataFrame([(None, None), (None, dt.datetime(2024, 3, 10, 3, 20))], "event_id long, ts timestamp_ntz").selectExpr("event_id", "ts", "1L", "'view'", "2.0D", "''")
    ).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        same(spark, con, str(tmp_path), QUERIES["order_changes"], ORACLES["order_changes"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
