"""The first rows of a key among those over a threshold, for every threshold at once."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.sources.files import kept


def threshold_top(rows: DataFrame, key: str, value: str, n: int, order: Sequence[str]) -> DataFrame:
    """rows that are among the first n of their key, in an order, of those with a value over some threshold; with from_value.

    A row is among them for the thresholds t with from_value <= t < value (from_value null: all below value): from_value is the n-th
    largest value of the rows before it in the order, and rows whose value is not over it are never shown. In an order that
    has nothing to do with the values some n * log(rows) rows of a key stay. The rows are dealt by ranges of key and order, so
    a key of any size takes many tasks; a task holds n values, and starts with the n largest of the ranges before it, of which the
    driver sees n a range and key.
    """
    spark = rows.sparkSession
    sort = [key, *order]
    ranged = kept(rows.where(F.col(value).isNotNull()).repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()), "ranged")
    top = Window.partitionBy("_part", key).orderBy(F.desc(value))
    largest = ranged.select("_part", key, value, F.row_number().over(top).alias("_rank")).where(F.col("_rank") <= n)
    found: dict[int, dict] = {}
    for part, name, v in largest.select("_part", key, F.unix_micros(F.col(value).cast("timestamp"))).collect():
        found.setdefault(part, {}).setdefault(name, []).append(v)
    before: dict[int, dict] = {}
    so_far: dict = {}
    for part in sorted(found):
        before[part] = {name: so_far[name] for name in found[part] if name in so_far}
        so_far |= {name: heapq.nlargest(n, [*so_far.get(name, []), *own]) for name, own in found[part].items()}
    at = len(ranged.columns)
    own = ranged.withColumn("_micros", F.unix_micros(F.col(value).cast("timestamp")))
    key_at, part_at = ranged.columns.index(key), ranged.columns.index("_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, heap = None, []
        for batch in batches:
            take, since = [], []
            for i, (name, part, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key_at, part_at, at)), strict=True)):
                if (part, name) != last:
                    last, heap = (part, name), list(before.get(part, {}).get(name, []))
                    heapq.heapify(heap)
                full = len(heap) == n
                if not full or v > heap[0]:
                    take.append(i)
                    since.append(heap[0] if full else None)
                    (heapq.heapreplace if full else heapq.heappush)(heap, v)
            part = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(since, pa.int64())], names=[*batch.schema.names[:at], "_since"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    dealt = own.repartition(max(1, len(found)), "_part").sortWithinPartitions("_part", *sort)
    out = dealt.mapInArrow(run, f"{fields}, _since long")
    return out.withColumn("from_value", F.timestamp_micros("_since").cast("timestamp_ntz")).drop("_part", "_since")
