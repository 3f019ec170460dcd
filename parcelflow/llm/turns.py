"""Rows of conversations put in order over many tasks, in chunks, so that a conversation of any length is never one task's work."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import partitions, returning

#: Rows of a chunk are those whose place shares all but its lowest bits.
CHUNK_BITS = 8


def key_of(id_col: str) -> Column:
    """A string for each conversation id that tells null from every value."""
    return F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit("-"))


def placed(rows: DataFrame) -> DataFrame:
    """rows (key, turn, role, text, ...) with at: ascending by key, turn (nulls first), role and text, and chunk.

    The rows are dealt by ranges of their order, so a long conversation takes several tasks; equal rows should be one row with a
    count. The numbers hold for one evaluation: write the result.
    """
    head = lambda c: F.substring(c, 1, 32)
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "key", F.asc_nulls_first("turn"), head("role"), head("text"))
    ordered = dealt.sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    return ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("at", CHUNK_BITS))


def id_of(kind: str) -> Column:
    """The id of a key, as kind."""
    return F.when(F.col("key") != "-", F.expr("substring(key, 2)").cast(kind))


def hashed(parts: DataFrame, columns: list[str], joint: str, sums: list[str] | None = None) -> DataFrame:
    """(key, <column>_sha256..., sums...): SHA-256 of each binary column's parts by ascending chunk, null parts passed over, and sums of longs.

    joint stands between two parts. A digest of one conversation is sequential, so its parts, of many rows each, pass one task in
    a stream; no more than a batch is held.
    """
    n, sums = partitions(parts.sparkSession), sums or []
    own = parts.select("key", "chunk", *columns, *sums).repartition(n, "key").sortWithinPartitions("key", "chunk")
    names = ["key", *(f"{c}_sha256" for c in columns), *sums]
    kinds = [pa.string(), *[pa.string()] * len(columns), *[pa.int64()] * len(sums)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, states, totals, done = None, [], [], []
        between = joint.encode()

        def close() -> None:
            if last is not None:
                done.append((last, *(s.hexdigest() for s, _ in states), *totals))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, *range(2, batch.num_columns))), strict=True):
                if row[0] != last:
                    close()
                    last, states, totals = row[0], [[hashlib.sha256(), False] for _ in columns], [0] * len(sums)
                for state, body in zip(states, row[1:]):
                    if body is not None:
                        if state[1]:
                            state[0].update(between)
                        state[0].update(body)
                        state[1] = True
                totals = [a + b for a, b in zip(totals, row[1 + len(columns) :], strict=True)]
            if done:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    return own.mapInArrow(returning(run), ", ".join([*(f"{c} string" for c in names[: 1 + len(columns)]), *(f"{c} long" for c in sums)]))
