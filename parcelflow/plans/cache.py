"""Extracted fields kept by key and content hash, so that a text is extracted once until it changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.joins import SENT_BYTES, measured_bytes
from parcelflow.sources.files import kept
from parcelflow.sources.state import StateStore

CACHE = "bucket string, id string, digest string, fields map<string,string>, run_id long"
KEYS = ("bucket", "id")
BUCKETS = 64


def cached_fields(store: StateStore, rows: DataFrame, extract: Callable[[DataFrame], DataFrame], run_id: int) -> DataFrame:
    """(id, digest, fields, hit) of rows (id, text): stored fields where the text's hash is the stored one, else extracted and stored.

    extract gets the missing rows (id, text) and gives (id, fields). A key has one entry, that of the last run; a run is
    applied once. Null ids are left out, a null text is an empty one, and of several texts of one id the one with the greatest hash
    counts. Only the buckets of the rows' keys are read and replaced, a file each: buckets are dealt by hash already. Hashes are compared without the texts, which
    are read again for what is missing: as they are where all of them are, each id once; else by a join.
    """
    own = rows.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("string")
    digest = F.sha2("text", 256)
    one = own.select("id", digest.alias("digest")).groupBy(F.xxhash64("id"), "id").agg(F.max("digest").alias("digest"), F.count(F.lit(1)).alias("_n"))
    keyed = kept(one.select(bucket.alias("bucket"), "id", "digest", "_n"), "digests")
    parts = [r[0] for r in keyed.select("bucket").distinct().collect()]  # at most BUCKETS
    stored = store.bucketed("extracted", CACHE, KEYS, parts)
    held = stored.select(*KEYS, F.col("digest").alias("_digest"), F.col("fields").alias("_fields"))
    looked = kept(keyed.join(held, list(reversed(KEYS)), "left").withColumn("hit", F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))), "looked-up")
    missing = kept(looked.where(~F.col("hit")).select("id", F.col("digest").alias("_digest")), "missing")
    fresh = kept(extract(texts_of(missing, own, keyed.agg(F.sum("_n")).first()[0] or 0)).select("id", F.col("fields").alias("_new")), "extracted")
    out = kept(looked.join(fresh, "id", "left").select(*KEYS, "digest", F.when(F.col("hit"), F.col("_fields")).otherwise(F.col("_new")).alias("fields"), "hit"), "fields")
    new = out.where(~F.col("hit")).select(*KEYS, "digest", "fields", F.lit(run_id).cast("long").alias("run_id"))
    entry = F.struct("run_id", F.struct("digest", "fields").alias("e"))
    both = stored.unionByName(new).groupBy(*KEYS).agg(F.max_by(entry, "run_id").alias("x"))
    store.commit(str(run_id), keyed={"extracted": (both.select(*KEYS, "x.e.digest", "x.e.fields", "x.run_id"), KEYS, parts, KEYS[0])})
    return out.select("id", "digest", "fields", "hit")


def texts_of(missing: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(id, text) of missing (id, _digest) among n rows (id, text), each id once.

    Where as many are missing as there are rows, each row is its id's only one, and no text is moved.
    """
    if missing.count() == n:
        return rows
    few = measured_bytes(missing) <= SENT_BYTES
    found = rows.join(F.broadcast(missing) if few else missing, "id").where(F.sha2("text", 256) == F.col("_digest"))
    return found.groupBy("id").agg(F.max("text").alias("text"))
