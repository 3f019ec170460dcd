"""Exact removal of long repeated byte strings, over anchors dealt by content and hashes of their strings.

Every string of LENGTH bytes picks an anchor, its least-hashed run of GRAM bytes; equal strings pick equal anchors at equal
offsets, so only strings with one anchor can be equal. Anchors that occur once are dropped at once. Of the others, an
anchor with its whole context (all strings that picked it) that occurs twice is repeated throughout. What is left are the
edges of repeated passages: their contexts meet at their anchor's hash. A suffix array by linear grouping over the blocks
right of the anchors tells which contexts are equal how far to the right; a string is compared only with those of contexts
that have its blocks, and only its bytes before and after these blocks by hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import partitions, returning, written
from parcelflow.llm.grouping import suffix_array
from parcelflow.llm.words import mix, powers

LENGTH, GRAM, BLOCK = 200, 40, 20
#: Distinct contexts of one anchor that one task compares; anchors with more are split by longer cores.
MOST, CORES = 2000, 8
#: Contexts of one suffix array.
BATCH = 2000

#: Bytes of a text that are looked at together; a task's arrays take some 90 times as many.
PART = 1 << 21

NOT = np.uint64(0xFFFFFFFFFFFFFFFF)


def rolling(buf: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of bytes follows."""
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(len(buf) + 1)[0][: len(buf)], out=total[1:])
    return total


def run_hash(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((total[end] - total[begin]) * powers(len(total) + 1)[1][begin] + (end - begin).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by doubling."""
    done, out = 1, x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    if done < width:
        out = np.minimum(out[: len(out) - (width - done)], out[width - done :])
    return out


def anchors_of(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first string, strings, anchor hash, context hash) of the anchors of texts of length or more bytes."""
    size = np.array([len(t) for t in texts])
    begin = np.concatenate(([0], np.cumsum(size)))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    total = rolling(buf)
    n = len(buf) - gram + 1
    place = np.arange(n, dtype=np.uint64)
    hashed = run_hash(total, np.arange(n), np.arange(n) + gram)
    order = (hashed & ~np.uint64((1 << 26) - 1)) | place
    picked = sliding_least(order, length - gram + 1)
    valid = np.zeros(len(picked), bool)
    for b, m in zip(begin, size):
        valid[b : b + m - length + 1] = True
    at = np.flatnonzero(valid)
    anchor = (picked[at] & np.uint64((1 << 26) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]))))
    first = at[new]
    count = np.diff(np.concatenate((new, [len(at)])))
    anchor = anchor[new]
    text = np.searchsorted(begin, anchor, "right") - 1
    context = mix(run_hash(total, first, first + count - 1 + length) + (anchor - first).astype(np.uint64))
    return text, anchor - begin[text], first - begin[text], count, hashed[anchor], context


def row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def pieces(texts: list[bytes], length: int, most: int = 1 << 20) -> Iterator[list[int]]:
    """Runs of texts of at least length bytes, about most bytes a run."""
    held, size = [], 0
    for i, t in enumerate(texts):
        if len(t) >= length:
            if held and size + len(t) > most:
                yield held
                held, size = [], 0
            held.append(i)
            size += len(t)
    if held:
        yield held


def anchors(docs: DataFrame, length: int, gram: int, part: int = PART) -> DataFrame:
    """docs (key, text) as (key, at, first, n, h, ctx): each anchor with the run of strings that picked it.

    A text over part bytes is cut into parts that overlap by one byte less than a string, so that each string is whole in just
    one of them and places stay within the 26 bits that their order has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given, texts, begin = [], [], []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                for b in range(0, max(1, len(raw) - length + 1), part - length + 1):
                    given.append(key)
                    texts.append(raw[b : b + part])
                    begin.append(b)
            keys, begin = np.array(given, np.int64), np.array(begin)
            for own in pieces(texts, length):
                text, at, first, n, h, ctx = anchors_of([texts[i] for i in own], length, gram)
                base = begin[np.array(own)[text]]
                at, first = at + base, first + base
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[np.array(own)[text]]), pa.array(at, pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))],
                    names=["key", "at", "first", "n", "h", "ctx"],
                )

    return docs.select("key", "text").mapInArrow(returning(run), "key long, at int, first int, n int, h long, ctx long")


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted anchors' contexts: wanted with data, and a hash of each core for anchors that are hot."""
    per = wanted.groupBy("key").agg(F.collect_list(F.struct("at", "first", "n", "h", "c", "hot")).alias("w"))
    rows = docs.join(per, "key").select("key", "text", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("key", "at", "first", "n", "h", "c", "hot", "data")}
            for key, text, w in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode()
                for x in w:
                    out["key"].append(key)
                    for k in ("at", "first", "n", "h", "c", "hot"):
                        out[k].append(x[k])
                    out["data"].append(raw[x["first"] : x["first"] + x["n"] - 1 + length])
            if out["key"]:
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return rows.mapInArrow(returning(run), "key long, at int, first int, n int, h long, c long, hot boolean, data binary")


def string_hashes(data: list[bytes], n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each string of each context, and the context of each."""
    begin = np.concatenate(([0], np.cumsum([len(d) for d in data])))[:-1]
    own = np.repeat(np.arange(len(data)), n)
    start = begin[own] + (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
    return run_hash(rolling(np.frombuffer(b"".join(data), np.uint8)), start, start + length), own


def by_suffixes(data: list[bytes], offset: np.ndarray, depth: int) -> np.ndarray:
    """(depth + 1, contexts): for each number of blocks, a number that contexts share whose blocks right of their anchors are
    equal so far, by a suffix array over the blocks. Where a context has fewer blocks its number means nothing."""
    symbols: dict[bytes, int] = {}
    text: list[int] = []
    blocks = np.zeros((len(data), depth), np.int64)
    heads = np.zeros(len(data), np.int64)
    for i, (d, o) in enumerate(zip(data, offset.tolist())):
        heads[i] = len(text)
        own = [symbols.setdefault(d[k : k + BLOCK], len(symbols) + 2) for k in range(o, min(len(d), o + depth * BLOCK) - BLOCK + 1, BLOCK)]
        blocks[i, : len(own)] = own
        text += own
        text.append(1)
    text.append(0)
    place = np.full(len(text), -1)
    place[heads] = np.arange(len(data))
    order = place[np.array(suffix_array(text))]
    order = order[order >= 0]
    equal = np.cumprod(blocks[order][1:] == blocks[order][:-1], axis=1)
    groups = np.zeros((depth + 1, len(data)), np.int64)
    groups[1:, order[1:]] = np.cumsum(equal == 0, axis=0).T
    return groups


def repeated_in(data: list[bytes], offset: np.ndarray, n: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(context, first string, one past the last) of runs of strings that another context of the same anchor also has."""
    groups = by_suffixes(data, offset, length // BLOCK)
    base = np.cumsum(n) - n
    own = np.repeat(np.arange(len(data)), n)
    left = offset[own] - (np.arange(len(own)) - base[own])
    # whole blocks from the anchor to the string's end, which all strings with its group have in common
    whole = (length - left) // BLOCK
    group = groups[whole, own] * (length + 1) + left
    _, number, count = np.unique(group, return_inverse=True, return_counts=True)
    open_ = count[number] > 1
    own, left, whole, group = own[open_], left[open_], whole[open_], group[open_]
    at = np.flatnonzero(open_) - base[own]
    begin = np.concatenate(([0], np.cumsum([len(d) for d in data])))[:-1]
    total = rolling(np.frombuffer(b"".join(data), np.uint8))
    start = begin[own] + at
    after = start + left + whole * BLOCK
    hashed = mix(run_hash(total, start, start + left) + mix(run_hash(total, after, start + length) + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    twice = np.zeros(len(hashed), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    own, at = own[twice], at[twice]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
    return [(int(own[a]), int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edge, [*edge[1:], len(own)])]


def edges(found: DataFrame, length: int) -> DataFrame:
    """(key, begin, end) of repeated bytes in the contexts of anchors that are not hot, each anchor's compared in one task."""
    n = partitions(found.sparkSession)
    dealt = found.where(~F.col("hot")).select("h", "key", "at", "first", "n", "c", "data").repartition(n, "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            at, first, size = (np.array([r[k] for r in held], np.int64) for k in (2, 3, 4))
            rows = [(held[i][1], held[i][3] + a, held[i][3] + b - 1 + length) for i, a, b in repeated_in([r[6] for r in held], at - first, size, length) if held[i][5] == 1]
            key, begin, end = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(begin, pa.int32()), pa.array(end, pa.int32())], names=["key", "begin", "end"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if len(held) >= BATCH and held[-1][0] != row[0]:
                    yield out()
                    held.clear()
                held.append(row)
        if held:
            yield out()

    return dealt.mapInArrow(returning(run), "key long, begin int, end int")


def hot_edges(found: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for hot anchors: strings are counted by their hash, after the cores that occur once are dropped.

    A core is what all strings of a share of the offsets have in common; a string can be repeated only if its core is. All
    counting is by aggregation, so the rows of one anchor never meet in one task.
    """
    hot = found.where("hot").select("key", "at", "first", "n", "c", "h", "data")
    step = -(-(length - gram + 1) // CORES)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "at": [], "part": [], "core": []}
            for key, at, first, n, data in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3, 6)), strict=True):
                total = rolling(np.frombuffer(data, np.uint8))
                offset = at - first
                for j in range(CORES):
                    # strings whose anchor is from j * step to (j + 1) * step - 1 bytes in
                    if j * step <= offset and offset - n + 1 < (j + 1) * step:
                        a, b = offset - j * step, offset - (j + 1) * step + 1 + length
                        if a >= 0 and b <= len(data):
                            core = run_hash(total, np.array([a]), np.array([b]))[0]
                        else:
                            core = None
                        out["key"].append(key)
                        out["at"].append(at)
                        out["part"].append(j)
                        out["core"].append(None if core is None else int(core.view(np.int64)))
            if out["key"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["at"], pa.int32()), pa.array(out["part"], pa.int32()), pa.array(out["core"], pa.int64())], names=list(out))

    parts = written(hot.mapInArrow(returning(cores), "key long, at int, part int, core long"), "cores")
    twice = parts.where(F.col("core").isNotNull()).groupBy("part", "core").count().where(F.col("count") > 1).select("part", "core")
    left = parts.join(twice, ["part", "core"]).select("key", "at", "part").unionByName(parts.where(F.col("core").isNull()).select("key", "at", "part"))
    # a core that is cut off by its context's end is compared whole, string by string
    left = left.groupBy("key", "at").agg(F.collect_set("part").alias("parts"))

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"key": [], "start": [], "c": [], "string": []}
            for key, at, first, n, c, data, parts in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                hashed, _ = string_hashes([data], np.array([n]), length)
                for i in range(n):
                    if (at - first - i) // step in parts:
                        out["key"].append(key)
                        out["start"].append(first + i)
                        out["c"].append(c)
                        out["string"].append(int(hashed[i].view(np.int64)))
            if out["key"]:
                yield pa.RecordBatch.from_arrays([pa.array(out["key"], pa.int64()), pa.array(out["start"], pa.int32()), pa.array(out["c"], pa.int64()), pa.array(out["string"], pa.int64())], names=list(out))

    rows = hot.join(left, ["key", "at"]).select("key", "at", "first", "n", "c", "data", "parts").mapInArrow(returning(strings), "key long, start int, c long, string long")
    rows = written(rows, "strings")
    again = rows.groupBy("string").count().where(F.col("count") > 1).select("string")
    return rows.join(again, "string").where(F.col("c") == 1).select("key", F.col("start").alias("begin"), (F.col("start") + length).alias("end"))


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """docs (key, text): (key, begin, end), runs of bytes that are covered by a repeated string; runs may overlap."""
    found = written(anchors(docs, length, gram, part), "anchors")
    # counts are written first, so that the join reads both sides from shuffles and a hot anchor's rows can be split
    again = written(found.groupBy("h").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > 1).select("h"), "anchor-counts")
    found = written(found.join(again, "h"), "repeated-anchors")
    each = found.groupBy("h", "ctx").agg(F.count(F.lit(1)).alias("c"), *(F.first(k).alias(k) for k in ("key", "at", "first", "n")))
    each = written(each, "contexts")
    kinds = each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)
    wanted = each.join(kinds, "h").withColumn("hot", F.col("kinds") > MOST)
    whole = found.join(each.where(F.col("c") > 1).select("h", "ctx"), ["h", "ctx"]).select("key", F.col("first").alias("begin"), (F.col("first") + F.col("n") + (length - 1)).alias("end"))
    compared = written(contexts(docs, wanted, length), "context-bytes")
    return whole.unionByName(edges(compared, length)).unionByName(hot_edges(compared, length, gram))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, part: int = PART) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row: bytes under a repeated string of length bytes removed.

    A string is repeated if it also starts anywhere else in the column, in the same text or another; matches never cross
    texts and are judged on the input. n_spans: maximal removed runs; kept: the remaining bytes. A null text counts as
    empty; texts under length bytes have nothing removed; repeated rows remove each other's bytes; null ids are kept; an
    empty table gives no rows; other columns are dropped. The work follows the bytes: a common string's occurrences are
    counted by aggregation, never brought together.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", row_key("id", "text"))
    runs = repeated_bytes(rows.select("key", "text"), length, gram, part)
    per = runs.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("runs"))
    joined = rows.join(per, "key", "left").select("id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode()
                kept, spans, upto = [], 0, -1
                done = 0
                for b, e in sorted((r["begin"], r["end"]) for r in runs or ()):
                    if b > upto:
                        kept.append(raw[done:b])
                        spans += 1
                    upto = max(upto, e)
                    done = upto
                kept.append(raw[done:])
                rest = b"".join(kept)
                for to, v in zip(out, (len(raw), len(raw) - len(rest), spans, hashlib.sha256(rest).hexdigest(), rest), strict=True):
                    to.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, kinds, strict=True))], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(returning(run), f"{id_col} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
