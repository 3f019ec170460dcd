"""Shared plumbing of the training-data operators: tables, the shared folder, grouped Arrow streams."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); in a local session without one, a new temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, computed once and kept as a table in the shared folder; later reads survive lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Scratch:
    """Tables that one run writes to the shared folder; clear() deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def written(self, df: DataFrame, label: str) -> DataFrame:
        path = new_dir(self.spark, label)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.folders[id(table)] = (table, path)
        return table

    def clear(self, *keep: DataFrame) -> None:
        """Deletes all tables but those to keep; call it once everything that was made of them is written."""
        kept = {id(t) for t in keep}
        for key, (_, path) in list(self.folders.items()):
            if key not in kept:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
                del self.folders[key]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def returning(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, that gives freed memory back to the system when its task ends: workers are kept for later tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return whole


def dealt_to(written_table: DataFrame, each: int) -> int:
    """Partitions for the rows of a written table: each rows or more a task, from 4 up to the session's number."""
    return max(4, min(partitions(written_table.sparkSession), -(-written_table.count() // each)))


def grouped_arrow(
    df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, parts: int | None = None
) -> DataFrame:
    """fn on each group of keys, over partitions dealt by keys and streamed in sorted order.

    Cheaper than applyInArrow for millions of small groups: a partition is one Python call and only one group is held at
    a time. Callers bound the size of a group. Keys are not null.
    parts: the number of partitions, where it is not the session's.
    """
    n = parts or partitions(df.sparkSession)
    dealt = df.repartitionById(n, F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t, cols = pa.Table.from_batches([batch]), [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(batch.num_rows - 1, bool)
            for c in cols:
                new |= c[1:] != c[:-1]
            at = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for begin, end in zip(at, at[1:]):
                key, part = tuple(c[begin] for c in cols), t.slice(begin, end - begin)
                if held and last == key:
                    held.append(part)
                else:
                    if held and (out := fn(pa.concat_tables(held))) is not None:
                        yield out
                    held, last = [part], key
        if held and (out := fn(pa.concat_tables(held))) is not None:
            yield out

    return dealt.mapInArrow(returning(run), schema)


def range_count(spark: SparkSession, rows: int, each: int) -> int:
    """Ranges to deal rows into: at least the session's partitions, at most 4,096, which keeps the plan small."""
    return min(4096, max(partitions(spark), -(-rows // each)))


def shard_splits(docs: DataFrame, key: str, parts: int) -> list[int]:
    """At most parts - 1 ascending bounds that deal the values of key evenly; only these leave the executors."""
    if parts < 2:
        return []
    found = docs.select(key).where(F.col(key).isNotNull()).approxQuantile(key, [i / parts for i in range(1, parts)], 0.2 / parts)
    return sorted({int(x) for x in found or []})


def shard_of(key: str, splits: list[int]):
    """The shard of a key: the number of bounds that are <= key; null keys are in shard 0."""
    if not splits:
        return F.lit(0)
    # a balanced tree of comparisons keeps the expression log2(n) deep
    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < splits[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    found = tree(0, len(splits))
    return F.when(F.col(key).isNull(), 0).otherwise(found).cast("int")
