"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import Scratch, dealt_to

PAIRS = "id long, label long"


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, label) of every id but the least of its component, of the edges given: all ids of one component get its least."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    child = np.flatnonzero(root != np.arange(len(ids)))
    return ids[child], ids[root[child]]


def rows_of(**columns: pa.Array) -> Iterator[pa.RecordBatch]:
    t = pa.table(columns)
    yield from t.to_batches(max_chunksize=100_000)


def folded(pairs: DataFrame) -> DataFrame:
    """The first two columns of pairs as (id, label), each partition's edges turned into stars; connects the same ids.
    Each label is also an id, once a partition, with a null label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            ids, labels = stars(*(np.concatenate(x) for x in zip(*held)))
            heads = np.unique(labels)
            yield from rows_of(id=pa.array(np.concatenate([ids, heads])), label=pa.concat_arrays([pa.array(labels), pa.nulls(len(heads), pa.int64())]))

    return pairs.mapInArrow(run, PAIRS)


def labelled(pairs: DataFrame) -> DataFrame:
    """Of folded() pairs dealt by id: (id, label, head, open), a row an id, with its least label. head: it is others' label;
    open: it has several labels, or has one and is a head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            held, far = pa.Table.from_batches(found), np.iinfo(np.int64)
            ids, at = np.unique(held.column("id").to_numpy(), return_inverse=True)
            has = held.column("label").is_valid().to_numpy()
            value = held.column("label").fill_null(0).to_numpy()
            low, top, head = np.full(len(ids), far.max), np.full(len(ids), far.min), np.zeros(len(ids), bool)
            np.minimum.at(low, at[has], value[has])
            np.maximum.at(top, at[has], value[has])
            head[at[~has]] = True
            own = top > far.min
            yield from rows_of(id=pa.array(ids), label=pa.array(low, mask=~own), head=pa.array(head), open=pa.array(own & (head | (top > low))))

    return pairs.mapInArrow(run, "id long, label long, head boolean, open boolean")


#: Pairs that a task is dealt at least.
EACH = 20_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a long, b long) that reaches another: the smallest id that it reaches, itself included.

    Each partition's edges become stars first, so that an id is at most once a partition beside its label. A round deals
    the pairs by id, whose labels so meet, and turns them into stars again; it ends when every id has one label and no
    label has one itself, else labels that have one are replaced by it. The rounds grow with the logarithm of the longest
    chain. Pairs are dealt by id alone, so a large component is no hot key. An id that has only loops to itself has no
    row; an empty table gives none. Each round is written to the shared folder.
    """
    tables = Scratch(edges.sparkSession)
    pairs = tables.written(folded(edges.select("a", "b")), "edges")
    n = dealt_to(pairs, EACH)
    by_id = lambda rows: rows.repartitionById(n, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    pairs = pairs.where(F.col("label").isNotNull())
    while True:
        found = tables.written(folded(by_id(pairs)), "stars")
        ids = tables.written(labelled(by_id(found)), "labels")
        if ids.where("open").isEmpty():
            tables.clear(ids)
            return ids.select("id", F.coalesce("label", "id").alias("component"))
        above = ids.where(F.col("head") & F.col("label").isNotNull()).select(F.col("id").alias("label"), F.col("label").alias("next"))
        pairs = found.where(F.col("label").isNotNull()).join(above, "label", "left").select("id", F.coalesce("next", "label").alias("label"))
