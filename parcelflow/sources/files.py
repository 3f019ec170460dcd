"""Listing files, caches, the live map and run reports."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a listing file, in order; those that must be there.
COLUMNS = ("ID", "Name", "Latitude", "Longitude", "Source", "State", "County", "Municipality", "Timing", "Property Type", "Bedrooms", "Bathrooms", "Sqft", "Lot Size", "Year Built", "Description", "Summary", "Metadata", "Auction Date/Time", "Status", "PDF Links", "URL")
REQUIRED = ("Name", "Latitude", "Longitude", "Source", "State", "Description", "Auction Date/Time", "Status", "PDF Links", "URL")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a temporary one in a local session without it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_temporary = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Within it, tables that kept() makes in this thread last until its end; for work that has written all its results by then."""
    before, _temporary.paths = getattr(_temporary, "paths", None), []
    try:
        yield
    finally:
        paths, _temporary.paths = _temporary.paths, before
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def kept(df: DataFrame, label: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; dealt to buckets by columns, if given, it is not shuffled for joins on them."""
    spark = df.sparkSession
    path = scratch(spark, label)
    if (paths := getattr(_temporary, "paths", None)) is not None:
        paths.append(path)
    if not by:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n, name = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200")), f"kept_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).format("parquet").option("path", path).saveAsTable(name)
    try:
        rows = spark.table(name)
        rows.schema  # noqa: B018, resolves the scan
    finally:
        spark.sql(f"drop table {name}")  # the files stay
    return rows


def nothing(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows of a schema, as a plan that Spark knows to be empty: a join with it goes away."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).limit(0)


def read_listing_csv(spark: SparkSession, path: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """A listing file with all columns as text and seq, the row's place in the file; fails if a required column is missing."""
    options = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(**options).csv(path).columns
    names = [h.removeprefix("﻿") for h in header]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(**options | {"enforceSchema": True}).schema(schema).csv(path).withColumn("seq", F.monotonically_increasing_id())


def listing_rows(rows: DataFrame) -> DataFrame:
    """Rows in the shape of a listing file; rows without a latitude are left out, falsy values are empty."""
    names = {
        "Name": "name", "Latitude": "latitude", "Longitude": "longitude", "Source": "source", "State": "state", "County": "county", "Municipality": "municipality", "Timing": "timing", "Property Type": "property_type", "Bedrooms": "bedrooms",
        "Bathrooms": "bathrooms", "Sqft": "sqft", "Lot Size": "lot_size_raw", "Year Built": "year_built", "Description": "description", "Summary": "summary", "Metadata": "metadata", "Status": "status", "PDF Links": "pdf_links", "URL": "url",
    }
    values: dict[str, Column] = {k: F.col(v).cast("string") for k, v in names.items() if v in rows.columns}
    values["ID"] = F.concat("source", F.lit(":"), "listing_id")
    if "auction_datetime" in rows.columns:
        values["Auction Date/Time"] = F.date_format("auction_datetime", "yyyy-MM-dd'T'HH:mm:ss")
    for name in ("Bedrooms", "Bathrooms", "Sqft", "Year Built"):
        if name in values:
            values[name] = F.when(F.col(names[name]).cast("double") != 0, values[name])
    return rows.where(F.col("latitude").isNotNull()).select(*(F.coalesce(values.get(c, F.lit("")), F.lit("")).alias(c) for c in COLUMNS))


def write_listing_csv(rows: DataFrame, path: str, by_source: bool = False, snapshot_date: str | None = None) -> None:
    """Listing files, a folder per source or per date if asked for.

    A folder's files are replaced as one when the job is done: a date that is written again has one copy, without sources that
    it no longer has; other dates, and without a date other sources, are left alone. Without folders the path must be new.
    """
    out, parts = listing_rows(rows), []
    if snapshot_date:
        out, parts = out.withColumn("snapshot_date", F.lit(snapshot_date)), ["snapshot_date"]
    if by_source:
        parts = [*parts, "Source"]
    writer = out.write.options(header=True, escape='"').partitionBy(*parts)
    if not parts:
        writer.csv(path)
        return
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(path)
    if snapshot_date:
        _drop_others(rows.sparkSession, f"{path}/snapshot_date={snapshot_date}", {r[0] for r in out.select("Source").distinct().collect()} if by_source else set())  # a value a site


def _drop_others(spark: SparkSession, folder: str, sources: set[str]) -> None:
    """Deletes a date's folders of sources that it no longer has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for found in fs.listStatus(at):
        own = found.getPath().getName()
        if own.startswith("Source=") and name(own.removeprefix("Source=")) not in sources:
            fs.delete(found.getPath(), True)


def read_overrides(df: DataFrame) -> DataFrame:
    """(id, latitude, longitude) of rows with an id and numeric coordinates."""
    number = lambda c: F.trim(c).try_cast("double")
    out = df.select(F.trim("id").alias("id"), number(F.col("latitude")).alias("latitude"), number(F.col("longitude")).alias("longitude"))
    return out.where((F.col("id") != "") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())


def read_cache(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON cache; lines that cannot be read are left out, a missing cache is empty."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return spark.createDataFrame([], schema)
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).option("mode", "PERMISSIVE").json(path)
    keep = F.lit(False)
    for f in schema.fields:
        keep = keep | F.col(f.name).isNotNull()
    return rows.where(keep & F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def write_live_map(rows: DataFrame, meta: DataFrame, path: str) -> None:
    """The live rows as JSON lines, the one meta row beside them."""
    rows.write.json(f"{path}/properties")
    meta.coalesce(1).write.json(f"{path}/meta")  # one row


def import_report(events: DataFrame, properties: DataFrame | None, run: DataFrame, rejects: DataFrame, run_id: int) -> DataFrame:
    """(section, ord, line) of a run's report: its head, its counters, the changes of each kind by address, the rows that failed.

    properties: those that give the events' addresses; None if the events have them. run: a load's row of counters; rejects: seq and name of rows that could not be loaded. Sections: 0 head and counters, 1 to 4
    changes, 5 failed rows. A section has a title with its number of lines, a rule, and its lines or '(none)'.
    """
    from parcelflow.functions.dates import report_time
    from parcelflow.operators.aggregates import change_sections

    titles: Mapping[str, tuple[int, str]] = {"status_change": (1, "Status changes"), "date_change": (2, "Auction date changes"), "first_seen": (3, "New listings"), "disappeared": (4, "Removed")}
    #: The counters' captions.
    said = (("Listings processed:", "found"), ("Cross-source dupes:", "cross_dropped"), ("New properties:", "new"), ("Changed auctions:", "changed"), ("Removed listings:", "removed"), ("Failed rows:", "failed"))
    entry = lambda t, c: F.concat(F.rpad(F.lit(t), 23, " "), F.col(c).cast("string"))
    heads = F.array(entry("Run:", "run_id"), entry("Started:", "as_of"), F.lit("Summary"), F.lit("-------"), *(entry(t, c) for t, c in said))
    counters = run.select(F.posexplode(heads).alias("ord", "line")).select(F.lit(0).alias("section"), F.col("ord").cast("long").alias("ord"), "line")
    pick = lambda k: F.create_map(*[F.lit(x) for t, v in titles.items() for x in (t, v[k])])[F.col("event_type")]
    rows = change_sections(events, properties, run_id)
    moved = F.concat(F.rpad("address", 40, " "), F.lit(" "))
    line = F.when(F.col("event_type") == "status_change", F.concat(moved, F.coalesce("old_value", F.lit("-")), F.lit(" -> "), F.coalesce("new_value", F.lit("-")))).when(
        F.col("event_type") == "date_change", F.concat(moved, report_time(F.col("old_value")), F.lit(" -> "), report_time(F.col("new_value")))
    ).otherwise(F.col("address"))
    failed = F.concat(F.lit("row "), F.col("seq").cast("string"), F.lit(" ("), F.coalesce("name", F.lit("unknown")), F.lit("): no coordinates or no listing id"))
    lines = rows.select(pick(0).alias("section"), F.col("event_id").alias("ord"), F.concat(F.lit("  "), line).alias("line")).unionByName(rejects.select(F.lit(5).alias("section"), F.col("seq").cast("long").alias("ord"), F.concat(F.lit("  "), failed).alias("line")))
    named = F.array(*(F.struct(F.lit(k).alias("section"), F.lit(v).alias("title")) for k, v in [*titles.values(), (5, "Failed rows")]))
    sections = run.sparkSession.range(1).select(F.inline(named))  # five rows
    counted = sections.join(lines.groupBy("section").agg(F.count(F.lit(1)).alias("n")), "section", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    title = F.concat("title", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    tops = F.array_compact(F.array(title, F.repeat(F.lit("-"), F.length(title)), F.when(F.col("n") == 0, "  (none)")))
    heading = counted.select("section", F.posexplode(tops).alias("at", "line")).select("section", (F.col("at") - 3).cast("long").alias("ord"), "line")
    return counters.unionByName(heading).unionByName(lines)


def write_report(report: DataFrame, path: str) -> None:
    """The report's lines as text files, in order over the files."""
    report.orderBy("section", "ord").select("line").write.text(path)
