"""Importance resampling to a target: array-scored weights, then exact ranks by parallel sorting with regular samples.

Both corpora are counted into one array of feature buckets; a document's weight is the mean gain of its features' buckets, and its
score adds noise that only depends on its id. The scored rows, without texts, are kept as sorted runs. Regular samples of the runs
give splitters, each segment between two splitters is exchanged to one task and sorted there, and the counts of the segments before
it place its rows exactly. Only segments that the draw reaches are exchanged.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import partitions, returning, written
from parcelflow.llm.features import features

BUCKETS, SHARE, SEED, MIN_WORDS = 10_000, 25, 7, 20
#: Segments at most; their square bounds the samples that reach the driver, of 16 bytes each.
SEGMENTS = 1024
#: monotonically_increasing_id() holds the place within the partition in its lower bits.
PLACE = (1 << 33) - 1
LAST = (1 << 63) - 1


def texts_of(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket's features occur in all texts; a task sends its array, Spark adds them up, the driver gets one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in features(texts_of(batch.column(0)), buckets):
                total += np.bincount(bucket, minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(returning(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share of the target over its share of the source."""
    n = len(source)
    of_source, of_target = int(source.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((float(t + 1) * of_source) / (float(s + 1) * of_target))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """(id_col, n_features, weight, score, fit) of every row, where its text is read; fit: it has min_words words or more.

    Null and empty texts have no feature and weight 0; a null id's noise is that of an empty one.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                n = part.num_rows
                total, count, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
                for bucket, text, own in features(texts_of(part.column(1)), len(gain)):
                    first, order = np.unique(text, return_inverse=True)
                    count[first] += np.bincount(order)
                    total[first] += np.rint(np.bincount(order, gain[bucket])).astype(np.int64)
                    words += own
                weight = np.where(count > 0, total // np.maximum(count, 1), 0)
                score = weight + np.array([noise(x or "", seed) for x in part.column(2).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count), pa.array(weight), pa.array(score), pa.array(words >= min_words)], names=[id_col, "n_features", "weight", "score", "fit"])

    own = docs.select(F.col(id_col), F.col(text_col).cast("binary"), F.col(id_col).cast("string")).toDF(id_col, "_text", "_key")
    return own.mapInArrow(returning(run), f"`{id_col}` {kind}, n_features long, weight long, score long, fit boolean")


def after(splits: list[tuple[int, int]]) -> Column:
    """The number of splits at or before a row in descending score and ascending tie; a balanced tree of comparisons."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        s, t = splits[mid]
        return F.when((F.col("score") > s) | ((F.col("score") == s) & (F.col("tie") < t)), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splits)).cast("int")


def splitters(runs: DataFrame, rows: int, segments: int) -> list[tuple[int, int]]:
    """segments - 1 splitters at most: every row at a regular distance in its sorted run is a sample, every so many samples a splitter.

    The distance keeps the samples under the square of segments, plus one a run of that length; runs begin at places of their own,
    so short runs are sampled too.
    """
    if segments < 2 or not rows:
        return []
    apart = -(-rows // (segments * segments))
    run, place = F.shiftright("at", 33), F.col("at").bitwiseAND(PLACE)
    sample = runs.where("fit").where(F.pmod(place + F.pmod(F.xxhash64(run), F.lit(apart)), F.lit(apart)) == 0).select("score", "tie")
    found = sorted(((s, t) for s, t in sample.collect()), key=lambda x: (-x[0], x[1]))
    return sorted({found[len(found) * i // segments] for i in range(1, segments)} if found else set(), key=lambda x: (-x[0], x[1]))


def ranked(runs: DataFrame, share: int, segments: int) -> DataFrame:
    """runs with rank: 1, 2, 3... by descending score and ascending tie for the first share percent of the fit rows, else null."""
    rows = runs.where("fit").count()
    draw = share * rows // 100
    splits = splitters(runs, rows, segments)
    placed = runs.withColumn("segment", after(splits))
    sizes = dict(placed.where("fit").groupBy("segment").count().collect())
    before, total = [], 0
    for k in range(len(splits) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    reached = max((k for k, n in enumerate(before) if n < draw), default=-1)
    taken = F.col("fit") & (F.col("segment") <= reached)
    # the exchange puts segment k into partition k, so the place within the partition is the place within the segment
    exchanged = placed.where(taken).repartitionById(max(1, reached + 1), "segment").sortWithinPartitions(F.desc("score"), "tie", "n_features")
    place = F.element_at(F.array(*(F.lit(n).cast("long") for n in before)), F.col("segment") + 1) + F.col("own").bitwiseAND(PLACE) + 1
    chosen = exchanged.withColumn("own", F.monotonically_increasing_id()).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).drop("own")
    return chosen.unionByName(placed.where(~taken).withColumn("rank", F.lit(None).cast("long"))).drop("segment")


def importance_sample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    share: int = SHARE, seed: int = SEED, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
) -> DataFrame:
    """(id_col, n_features, weight, score, rank) of every row of docs; rank is set for the drawn ones.

    share percent, rounded down, of the rows with min_words words or more are drawn, by descending score, ties by ascending id (null
    ids last), then by fewer features; equal rows take neighbouring ranks. Null and empty texts have weight 0; an empty target or
    table is counted as it is. Other columns are dropped. Texts over 4 MiB are looked at in pieces that count alike.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    rows = scored(docs, gain, id_col, text_col, seed, min_words).withColumn("tie", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)))
    runs = written(rows.sortWithinPartitions(F.desc("fit"), F.desc("score"), "tie", "n_features").withColumn("at", F.monotonically_increasing_id()), "runs")
    return ranked(runs, share, min(SEGMENTS, partitions(spark))).select(id_col, "n_features", "weight", "score", "rank")


def oracle() -> str:
    """The same rows in DuckDB's SQL, with the CRC-32 of every distinct feature byte by byte."""
    step = "case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end"
    table = "select i, i::ubigint as c from range(256) t(i)"
    for _ in range(8):
        table = f"select i, {step} as c from ({table})"
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
with crc as (select list(c order by i) as t from ({table})),
w as (
  select 0 as side, row_number() over () as n, doc_id, {words} as w from documents
  union all select 1, row_number() over (), null, {words} from benchmark),
f as (
  select side, n, unnest(w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) as f from w),
c as (select side, n, f, count(*) as k from f group by side, n, f),
b as (
  select f, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::ubigint),
      lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::bigint + 1]), 4294967295::ubigint), 4294967295::ubigint) % {BUCKETS} as b
  from (select f, hex(encode(f)) as h from (select distinct f from c)), crc),
cb as (select side, n, b, sum(k) as k from c join b using (f) group by side, n, b),
s as (select b, sum(k) filter (side = 0) as s, sum(k) filter (side = 1) as t from cb group by b),
a as (select sum(k) filter (side = 0) as s, sum(k) filter (side = 1) as t from cb),
g as (
  select b, floor(1000 * ln(((coalesce(s.t, 0) + 1)::double * (coalesce(a.s, 0) + {BUCKETS})) / ((coalesce(s.s, 0) + 1)::double * (coalesce(a.t, 0) + {BUCKETS}))))::bigint as g
  from s, a),
d as (select n, sum(k) as n_features, floor(sum(k * g) / sum(k)::double)::bigint as weight from cb join g using (b) where side = 0 group by n),
x as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0) as weight, len(w) >= {MIN_WORDS} as fit,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::ubigint + 0.5::double) / 4294967296)))::bigint as score
  from w left join d using (n) where side = 0),
r as (select *, row_number() over (partition by fit order by score desc, doc_id nulls last, n_features) as r, count(*) filter (fit) over () as total from x)
select doc_id, n_features, weight, score, case when fit and r <= {SHARE} * total // 100 then r end as rank from r"""
