"""SimHash fingerprints of whole texts, and complete radius search: block tables for a small radius, a packed scan for a large one."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.llm.common import grouped_arrow, partitions, range_count, shard_of, shard_splits, written
from parcelflow.llm.words import chunks, mix, shingles

#: At a similarity of 0.75 of the shingle sets the expected distance is about 22 bits; 32 holds it with two standard deviations.
BITS, BLOCKS, RADIUS = 128, 6, 32
#: The scan: fingerprints of a block, queries of a packed row, packed rows of a group.
BLOCK_ROWS, PACK_ROWS, GROUP_PACKS = 65_536, 4_096, 256
#: Documents of a range that one task sorts and fingerprints in order.
RANGE_ROWS = 8_000


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """Two 64-bit words a text. Terms are 5-word shingles weighted by how often they occur; each bit is the sign of the terms' votes.

    Texts without a word have all bits zero.
    """
    out = np.zeros((len(texts), 2), np.uint64)
    for a, b in chunks(texts):
        h, at = shingles(texts[a:b])
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            continue
        weight = np.diff(at)[full]
        for half, seed in enumerate((0x2545F4914F6CDD1D, 0x9E3779B97F4A7C15)):
            bits = np.unpackbits(mix(h ^ np.uint64(seed)).view(np.uint8), bitorder="little").reshape(-1, 64)
            votes = np.add.reduceat(bits, at[:-1][full], axis=0, dtype=np.int32)
            signs = (2 * votes > weight[:, None]).astype(np.uint8)
            out[a + full, half] = np.packbits(signs, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many first code points of following (or all)."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def hexed(f: np.ndarray) -> list[str]:
    return [f"{a:016x}{b:016x}" for a, b in f.tolist()]


def fingerprint_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each whole text, of its edited text, and likenesses to that and to the next text's fingerprint.

    The next row is by ascending id (null ids first, ties by text); the last row's next is the first. Likeness is 1 less the
    share of differing bits. A null text counts as empty; one row per row; other columns are dropped; an empty table gives
    no rows. The rows are dealt by ranges of ids, each sorted in one task, with the first row of the following range added
    to each: the texts are shuffled once and no task sees more than its range (rows that share one id stay together).
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, least, nulls = own.agg(F.count(F.lit(1)), F.min(id_col), F.count_if(F.col(id_col).isNull())).first()
    n = range_count(spark, rows, RANGE_ROWS)
    # a bound is an id of the table, so each range but the first begins with the rows of its bound, and none is empty
    splits = [x for x in shard_splits(own, id_col, n) if nulls or x != least]
    dealt = own.withColumn("shard", shard_of(id_col, splits))
    begins = F.col(id_col).isin([*splits, *([] if nulls or least is None else [least])]) | F.col(id_col).isNull()
    handed = dealt.where(begins).groupBy("shard", id_col).agg(F.min("text").alias("text")).where(F.col(id_col).isNull() | (F.col("shard") > 0) | F.lit(not nulls)).select(
        ((F.col("shard") + len(splits)) % (len(splits) + 1)).cast("int").alias("shard"), id_col, "text", F.lit(1).alias("extra")
    )
    rows = dealt.withColumn("extra", F.lit(0)).unionByName(handed).repartitionById(len(splits) + 1, "shard").sortWithinPartitions("shard", "extra", F.col(id_col).asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            # held: rows in order with the row after each; only rows of one shard follow each other
            pairs = [(a, b) for a, b in zip(held, held[1:]) if not a[3]]
            texts = [t for _, t, *_ in (a for a, _ in pairs)]
            later = [b[1] for _, b in pairs]
            edits = [edited(t, x) for t, x in zip(texts, later, strict=True)]
            raw = [x.encode() for x in edits]
            f, e = fingerprints([t.encode() for t in texts]), fingerprints(raw)
            g = np.concatenate([f[1:], np.zeros((1, 2), np.uint64)]) if len(f) else f
            lone = [k for k, (_, b) in enumerate(pairs) if b[3] or k + 1 == len(pairs)]
            if lone:
                g[lone] = fingerprints([later[k].encode() for k in lone])
            share = lambda x: 1 - distance(f, x) / BITS
            blocks = block_values(f)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a, _ in pairs], id_type), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array(hexed(f)), pa.array(hexed(e)), pa.array(share(e)), pa.array(share(g)), pa.array(list(blocks), pa.list_(pa.int32())),
                ],
                names=names,
            )

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                held.append(row)
                if len(held) > 1024:
                    yield out()
                    held[:] = held[-1:]
        if len(held) > 1:
            yield out()

    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "blocks"]
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.select(id_col, "text", "shard", "extra").mapInArrow(
        run, f"{id_col} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, blocks array<int>"
    )


def block_values(f: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """The fingerprint's bits cut into blocks, each as an integer."""
    bits = np.unpackbits(np.ascontiguousarray(f).view(np.uint8).reshape(len(f), -1), axis=1, bitorder="little")
    bounds = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return np.stack([bits[:, a:b].astype(np.int64) @ (1 << np.arange(b - a)) for a, b in zip(bounds, bounds[1:])], axis=1).astype(np.int32)


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, n_within): rows of index within the Hamming radius of each distinct query fingerprint, itself included.

    Both sides: fingerprint string, blocks array<int>. Of the blocks, at least blocks - radius agree for a pair within the
    radius, so a table for each choice of that many blocks, keyed by their values, finds every such pair. A radius of blocks
    or more leaves no block that must agree; then scanned() compares. Equal fingerprints are one entry with a count, so
    copies of a text meet once.
    """
    agree = blocks - radius
    entry = lambda df, name: df.groupBy(F.col("fingerprint").alias(name)).agg(F.first("blocks").alias("blocks"), F.count(F.lit(1)).alias("n"))
    if agree < 1:
        return scanned(queries.select(F.col("fingerprint").alias("query")).distinct(), index.groupBy(F.col("fingerprint").alias("found")).agg(F.count(F.lit(1)).alias("n")), radius)
    tables = F.array(*(F.xxhash64(F.lit(t), *(F.col("blocks")[i] for i in pick)) for t, pick in enumerate(combinations(range(blocks), agree))))
    q = entry(queries, "query").select("query", F.explode(tables).alias("key"))
    i = entry(index, "found").select("found", "n", F.explode(tables).alias("key"))
    word = lambda c, k: F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("long")
    apart = sum((F.bit_count(word("query", k).bitwiseXOR(word("found", k))) for k in range(BITS // 32)), F.lit(0))
    pairs = q.join(i, "key").where(apart <= radius).select("query", "found", "n").distinct()
    return pairs.groupBy("query").agg(F.sum("n").alias("n_within"))


def unhexed(packed: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(packed), ">u8").astype(np.uint64).reshape(-1, 2)


def counts_within(q: np.ndarray, f: np.ndarray, n: np.ndarray, radius: int) -> np.ndarray:
    """Sum of n over the fingerprints f within the radius of each of q, compared in pieces that stay in the cache."""
    out = np.zeros(len(q), np.int64)
    rows, wide = 32, 2048
    xor, apart, other = np.empty((rows, wide), np.uint64), np.empty((rows, wide), np.uint8), np.empty((rows, wide), np.uint8)
    first, second = (np.ascontiguousarray(f[:, k]) for k in (0, 1))
    for a in range(0, len(q), rows):
        own = q[a : a + rows]
        for b in range(0, len(f), wide):
            x, y, z = (m[: len(own), : len(first[b : b + wide])] for m in (xor, apart, other))
            np.bitwise_count(np.bitwise_xor(own[:, :1], first[b : b + wide], out=x), out=y)
            np.bitwise_count(np.bitwise_xor(own[:, 1:], second[b : b + wide], out=x), out=z)
            np.add(y, z, out=y)
            if y.min() <= radius:
                row, at = np.nonzero(y <= radius)
                np.add.at(out, a + row, n[b + at])
    return out


def scanned(q: DataFrame, f: DataFrame, radius: int) -> DataFrame:
    """(query, n_within) by comparing every query with every entry (found, n) of f; both are distinct fingerprints.

    The entries are dealt to blocks by hash and the queries, packed, are sent to each block: 32 bytes a query and block, and
    a task holds a block and a group of queries. The comparisons are queries x entries, two words each.
    """
    rows, asked = f.count(), q.count()
    n_blocks, packs = max(partitions(f.sparkSession), -(-rows // BLOCK_ROWS)), -(-asked // PACK_ROWS)
    groups = max(1, -(-packs // GROUP_PACKS))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    packed = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(max(1, packs))).alias("pack")).agg(F.array_join(F.collect_list("query"), "").alias("prints"))
    sent = packed.select(every(n_blocks).alias("block"), (F.col("pack") % groups).cast("int").alias("part"), F.lit(0).alias("side"), "prints", F.lit(0).cast("long").alias("n"))
    own = f.select(F.pmod(F.xxhash64(F.lit(1), "found"), F.lit(n_blocks)).cast("int").alias("block"), every(groups).alias("part"), F.lit(1).alias("side"), F.col("found").alias("prints"), "n")

    def compare(t: pa.Table) -> pa.RecordBatch | None:
        side, prints = t.column("side").to_numpy(), t.column("prints").to_pylist()
        split = int(np.searchsorted(side, 1))
        if not 0 < split < len(side):
            return None
        asked, held = unhexed("".join(prints[:split])), unhexed("".join(prints[split:]))
        found = counts_within(asked, held, t.column("n").to_numpy()[split:], radius)
        hit = np.flatnonzero(found)
        return pa.RecordBatch.from_arrays([pa.array(hexed(asked[hit]), pa.string()), pa.array(found[hit])], names=["query", "n"])

    return grouped_arrow(sent.unionByName(own), ["block", "part"], ["side"], compare, "query string, n long").groupBy("query").agg(F.sum("n").alias("n_within"))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 50, radius: int = RADIUS) -> DataFrame:
    """fingerprint_in_order() with n_within: for rows whose id is divisible by every, the rows within the radius; else null."""
    prints = written(fingerprint_in_order(docs, id_col, text_col), "simhash")
    asked = F.col(id_col) % every == 0
    found = within_radius(prints.where(asked), prints, radius).withColumnRenamed("query", "fingerprint")
    plain = prints.drop("blocks")
    # only the queries are joined; the rest passes by
    return plain.where(asked).join(found, "fingerprint", "left").unionByName(
        plain.where(~asked | F.col(id_col).isNull()).withColumn("n_within", F.lit(None).cast(T.LongType()))
    ).select(*plain.columns, "n_within")
