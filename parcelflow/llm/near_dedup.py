"""Near-duplicate documents by a chosen-path similarity join over minwise tokens, with links confirmed on full shingle sets.

A document's set is its distinct word shingles; documents with equal sets are one class. Independent trees branch classes
by selected minwise tokens: a small node is compared exhaustively on sketches, a large one sheds its pivot's
near copies and branches again. What survives are loose groups, a superset of the links; each class's full set is then sent once to its loose group and compared
exactly. Pairs that are already connected are not compared, so groups of copies give stars, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import Scratch, dealt_to, grouped_arrow, returning
from parcelflow.llm.graph import components
from parcelflow.llm.words import chunks, mix, shingles

THRESHOLD, WORDS = 75, 5
#: Trees, branches of a large node, exhaustive node size, deepest level, sketch bytes, least share of equal sketch bytes.
#: At a similarity of 0.75 a pair stays together in a large node with a chance of 0.9, so it misses all 12 trees with
#: (1 - 0.75 * 0.9)**12, about 1e-6, and the sketch bound (4.5 standard deviations below) with about 3e-6.
TREES, BRANCHES, SMALL, DEPTH, SKETCH, LOOSE = 12, 2, 64, 2, 96, 0.55
#: In a large node, members this close to its pivot leave it, and members this close are tied to the pivot: by the triangle
#: inequality of the Jaccard distance, what is linked to a member that left is at a distance of 0.25 + 0.25 of the pivot.
LEAVE, TIE = 0.8, 0.35
#: Members that one task compares exhaustively in a dense node or group, and the least members that a task is dealt.
BLOCK, EACH = 256, 1024

_seed = np.random.Generator(np.random.PCG64(20240229))
_A = _seed.integers(0, 1 << 32, TREES + SKETCH, dtype=np.uint32) | np.uint32(1)
_B = _seed.integers(0, 1 << 32, TREES + SKETCH, dtype=np.uint32)

FEATURES = "id long, n_shingles long, s1 long, s2 long, keys array<int>, sketch array<long>"


def rows_of(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def features(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS) -> DataFrame:
    """Size and digest of each document's shingle set, a minwise token per tree, and the sketch, eight bytes a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [(t or "").encode() for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts):
                h, at = shingles(texts[a:b], k)
                m = b - a
                n, s1, s2 = np.zeros(m, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)
                full = np.flatnonzero(np.diff(at))
                low = np.zeros((m, TREES + SKETCH), np.uint32)
                if len(full):
                    for d in full:
                        u = np.unique(h[at[d] : at[d + 1]])
                        n[d] = len(u)
                        s1[d] = mix(u ^ np.uint64(0x1F83D9ABFB41BD6B)).sum(dtype=np.uint64).astype(np.int64)
                        s2[d] = mix(u ^ np.uint64(0x5BE0CD19137E2179)).sum(dtype=np.uint64).astype(np.int64)
                    high = (h >> np.uint64(32)).astype(np.uint32)
                    for f in range(TREES + SKETCH):
                        low[full, f] = np.minimum.reduceat(high * _A[f] + _B[f], at[:-1][full])
                keys = low[:, :TREES].astype(np.int32)
                raw = (low[:, TREES:] ^ (low[:, TREES:] >> np.uint32(11))).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, m), pa.array(n), pa.array(s1), pa.array(s2), rows_of(keys), rows_of(raw.view(np.int64))],
                    names=["id", "n_shingles", "s1", "s2", "keys", "sketch"],
                )

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(returning(run), FEATURES)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (grp, size, id, text) with each text's sorted distinct shingle hashes as data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(3).to_pylist()]
            for a, b in chunks(texts):
                h, at = shingles(texts[a:b], k)
                data = [np.unique(h[at[d] : at[d + 1]]).tobytes() for d in range(b - a)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array(data, pa.binary())], names=["grp", "size", "id", "data"])

    return docs.select("grp", "size", "id", "text").mapInArrow(returning(run), MEMBERS)


MEMBERS = "grp long, size long, id long, data binary"


def sketch_match(least: float) -> Callable:
    def prepare(data: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)

    def against(one: np.ndarray, i: int, many: np.ndarray, js: np.ndarray) -> np.ndarray:
        return (many[js] == one[i]).mean(axis=1) >= least

    return lambda: (prepare, against)


def set_match(percent: int) -> Callable:
    def prepare(data: list[bytes]) -> list[np.ndarray]:
        return [np.frombuffer(d, np.uint64) for d in data]

    def against(one: list[np.ndarray], i: int, many: list[np.ndarray], js: np.ndarray) -> np.ndarray:
        x, out = one[i], np.zeros(len(js), bool)
        n = np.array([len(many[j]) for j in js])
        ok = np.flatnonzero((100 * np.minimum(n, len(x)) >= percent * np.maximum(n, len(x))) & (n > 0))
        for begin in range(0, len(ok), 64):
            some = ok[begin : begin + 64]
            every = np.concatenate([many[js[j]] for j in some])
            at = np.searchsorted(x, every)
            at[at == len(x)] = 0
            same = np.add.reduceat((x[at] == every).astype(np.int64), np.concatenate(([0], np.cumsum(n[some])[:-1])))
            out[some] = 100 * same >= percent * (n[some] + len(x) - same)
        return out

    return lambda: (prepare, against)


def linked(members: DataFrame, match: Callable, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect just the members (grp, size, id, data), a written table, of each group that match(es) connect.

    A group is dealt into blocks of about block members. Each block is clustered by itself; the clusters' first members
    are clustered in blocks again; then the members outside their group's largest cluster are compared with every block,
    so that no matching pair is left unconnected, whatever a group's size. Only a block is ever held in one task.
    """
    tables, parts = Scratch(members.sparkSession), dealt_to(members, EACH)

    def cluster(t: pa.Table) -> pa.RecordBatch | None:
        prepare, against = match()
        ids, raw = t.column("id").to_numpy(), t.column("data").to_pylist()
        data, label = prepare(raw), np.arange(len(ids))
        for i in range(len(ids) - 1):
            js = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            if len(js):
                hit = js[against(data, i, data, js)]
                if len(hit):
                    label[np.isin(label, label[hit])] = label[i]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        own, blocks = least[label], t.column("blocks").to_numpy()
        keep = np.flatnonzero((own != ids) | (blocks > 1))
        if not len(keep):
            return None
        # the first member of a cluster of many blocks carries its data along
        heads = [raw[i] if own[i] == ids[i] else None for i in keep]
        return pa.RecordBatch.from_arrays([pa.array(t.column("grp").to_numpy()[keep]), pa.array(blocks[keep]), pa.array(ids[keep]), pa.array(own[keep]), pa.array(heads, pa.binary())], names=["grp", "blocks", "id", "label", "data"])

    def query(t: pa.Table) -> pa.RecordBatch | None:
        prepare, against = match()
        asks = t.column("asks").to_numpy()
        if not asks.any():
            return None
        ids, label, data = t.column("id").to_numpy(), t.column("label").to_numpy().copy(), prepare(t.column("data").to_pylist())
        rest, edges = np.flatnonzero(asks == 0), []
        for i in np.flatnonzero(asks):
            js = rest[label[rest] != label[i]]
            if len(js):
                for j in js[against(data, i, data, js)]:
                    if label[j] != label[i]:
                        edges.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
        if not edges:
            return None
        a, b = zip(*edges, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def clustered(rows: DataFrame, label: str) -> DataFrame:
        dealt = grouped_arrow(rows.select("grp", "part", "blocks", "id", "data"), ["grp", "part"], ["id"], cluster, "grp long, blocks long, id long, label long, data binary", parts)
        return tables.written(dealt, label)

    tied = lambda rows: rows.where(F.col("id") != F.col("label")).select(F.col("id").alias("a"), F.col("label").alias("b"))
    part = lambda n: F.when(n > 1, F.pmod(F.xxhash64("grp", "id"), n)).otherwise(F.lit(0)).cast("long")
    dealt = members.withColumn("blocks", F.ceil(F.col("size") / block).cast("long")).withColumn("part", part(F.col("blocks")))
    first = clustered(dealt, "clusters")
    edges, many = tied(first), first.where(F.col("blocks") > 1)
    if many.isEmpty():
        return edges
    heads = many.where(F.col("id") == F.col("label")).select("grp", "id", "data")
    count = tables.written(heads.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("n")), "counts")
    second = clustered(heads.join(count, "grp").select("grp", part(F.col("n")).alias("part"), F.lit(2).cast("long").alias("blocks"), "id", "data"), "heads")
    edges = edges.unionByName(tied(second))
    labels = tables.written(many.select("grp", "id", "label").join(second.select("grp", F.col("id").alias("label"), F.col("label").alias("top")), ["grp", "label"]).select("grp", "id", F.col("top").alias("label")), "labels")
    tops = tables.written(labels.groupBy("grp", "label").count().groupBy("grp").agg(F.max_by("label", F.struct("count", "label")).alias("top")), "tops")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda p: F.struct(p.alias("part"), F.lit(1).alias("asks")))
    places = F.concat(F.array(F.struct("part", F.lit(0).alias("asks"))), F.when(F.col("label") != F.col("top"), every).otherwise(F.array().cast("array<struct<part:bigint,asks:int>>")))
    asked = dealt.where(F.col("blocks") > 1).join(labels, ["grp", "id"]).join(tops, "grp").select("grp", F.inline(places), "id", "label", "data")
    return edges.unionByName(grouped_arrow(asked, ["grp", "part"], ["asks", "id"], query, "a long, b long", parts))


def equal_share(a: str, b: str) -> Column:
    """The share of equal bytes of two sketches."""
    apart = F.lit(0)
    for k in range(SKETCH // 8):
        z = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        # a byte's bits are gathered in its lowest one
        for step, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            z = z.bitwiseOR(F.shiftrightunsigned(z, step)).bitwiseAND(F.lit(mask))
        apart = apart + F.bit_count(z)
    return 1 - apart / SKETCH


def sketch_byte(sketch: str, at: Column) -> Column:
    """The byte of a sketch at a place."""
    return F.call_function("shiftrightunsigned", F.get(sketch, F.floor(at / 8).cast("int")), 8 * (at % 8)).bitwiseAND(F.lit(255))


def sketch_bytes(sketch: str) -> Column:
    return F.concat(*(F.unhex(F.lpad(F.hex(F.get(sketch, F.lit(k))), 16, "0")) for k in range(SKETCH // 8)))


def loose_links(node: np.ndarray, cid: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect the members of each small node (rows in order of node) whose sketches agree in LOOSE or more bytes.

    All rows are compared with the first of their node at once; only nodes where some differ from it need more.
    """
    least, n = int(np.ceil(LOOSE * sketch.shape[1])), len(node)
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    size = np.diff(np.append(starts, n))
    first = np.repeat(starts, size)
    near = (sketch == sketch[first]).sum(axis=1, dtype=np.uint16) >= least
    hit = np.flatnonzero(near & (first != np.arange(n)))
    a, b = [cid[hit]], [cid[first[hit]]]
    for g in np.flatnonzero((np.add.reduceat(~near, starts) > 0) & (size > 2)) if n else ():
        own = np.arange(starts[g], starts[g] + size[g])
        label = np.where(near[own], 0, np.arange(len(own)))
        for i in np.flatnonzero(~near[own]):
            js = np.flatnonzero(label != label[i])
            js = js[js > 0]
            js = js[(sketch[own[js]] == sketch[own[i]]).sum(axis=1, dtype=np.uint16) >= least]
            if len(js):
                a.append(np.full(len(js), cid[own[i]]))
                b.append(cid[own[js]])
                label[np.isin(label, label[js])] = label[i]
    return np.concatenate(a), np.concatenate(b)


def small_nodes(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of the members (node, cid, sketch) of small nodes; a task holds a batch and the node that it ends in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            if batch is None:
                now, held = held, None
            else:
                if not batch.num_rows:
                    continue
                now = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy().view(np.uint8).reshape(batch.num_rows, -1)]
                now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
                end = int(np.searchsorted(now[0], now[0][-1]))
                now, held = [x[:end] for x in now], [x[end:] for x in now]
            if now and len(now[0]):
                a, b = loose_links(*now)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    n = dealt_to(rows, 8 * EACH)
    dealt = rows.select("node", "cid", "sketch").repartitionById(n, F.pmod(F.xxhash64("node"), F.lit(n)).cast("int")).sortWithinPartitions("node", "cid")
    return dealt.mapInArrow(returning(run), "a long, b long")


def loose_edges(classes: DataFrame, tables: Scratch) -> DataFrame:
    """Edges (a, b) between classes that connect all that some tree finds alike.

    A large node first sheds the members that are nearly its pivot's copies, so that a group of copies is not carried down
    the tree; what stays is small, or branches. Small nodes of all levels are compared exhaustively; so are large ones that
    the deepest level leaves, in blocks.
    """
    lookup, small, ties, deepest = classes.select("cid", "sketch"), None, [], None

    def sized(rows: DataFrame) -> DataFrame:
        # sizes are written first, so that the join reads both sides from shuffles and a hot node's rows can be split
        return rows.join(tables.written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("cid").alias("pivot")).where(F.col("size") > 1), "sizes"), "node")

    for level in range(DEPTH + 1):
        if level:
            pick = lambda j: F.pmod(F.xxhash64("node", F.lit(j)), F.lit(SKETCH)).cast("int")
            child = [F.xxhash64("node", F.lit(j), sketch_byte("sketch", pick(j))) for j in range(BRANCHES)]
            nodes = sized(tables.written(rest.select("cid", "sketch", F.explode(F.array(*child)).alias("node")), f"children-{level}"))
        else:
            # only members of nodes with others are given their sketches
            first = classes.select("cid", F.posexplode("keys").alias("tree", "key")).select(F.xxhash64("tree", "key").alias("node"), "cid")
            nodes = sized(first).join(lookup, "cid")
        nodes = tables.written(nodes.select("node", "size", "pivot", "cid", "sketch"), f"nodes-{level}")
        own = nodes.where(F.col("size") <= SMALL).select("node", "cid", "sketch")
        small = own if small is None else small.unionByName(own)
        large = nodes.where(F.col("size") > SMALL)
        pivots = tables.written(large.where(F.col("cid") == F.col("pivot")).select("node", F.col("sketch").alias("target")), f"pivots-{level}")
        if pivots.isEmpty():
            break
        seen = large.where(F.col("cid") != F.col("pivot")).join(pivots, "node").select("node", "cid", "pivot", "sketch", equal_share("sketch", "target").alias("share"))
        seen = tables.written(seen.where((F.col("share") >= TIE) | (F.col("share") < LEAVE)), f"seen-{level}")
        ties.append(seen.where(F.col("share") >= TIE).select(F.col("cid").alias("a"), F.col("pivot").alias("b")))
        rest = seen.where(F.col("share") < LEAVE)
        if level == DEPTH:
            deepest = tables.written(sized(rest.select("node", "cid", "sketch")).select(F.col("node").alias("grp"), "size", F.col("cid").alias("id"), sketch_bytes("sketch").alias("data")), "dense")
    edges = small_nodes(small)
    if deepest is not None:
        edges = edges.unionByName(linked(deepest, sketch_match(LOOSE)))
    for t in ties:
        edges = edges.unionByName(t)
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. component_id: the smallest id
    reachable over links, itself included; kept: it is the row's own id. Null and empty texts and texts without words have
    an empty set and are linked with nothing. Rows that share an id are one document with several texts, and so linked;
    a row with a null id takes no part: its component is null and it is kept. Other columns are dropped. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    tables = Scratch(spark)
    rows = tables.written(features(docs, id_col, text_col, words), "features")
    able = rows.where((F.col("n_shingles") > 0) & F.col("id").isNotNull())
    classes = tables.written(able.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("cid"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "classes")
    loose = components(loose_edges(classes, tables))
    sizes = tables.written(loose.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    groups = loose.join(sizes, "component").select(F.col("component").alias("grp"), "size", "id")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(groups, "id")
    sets = tables.written(shingle_sets(texts, words), "sets")
    joined = components(linked(sets, set_match(percent))).withColumnRenamed("id", "cid")
    # a class of one row that is linked with nothing is its own component
    found = tables.written(classes.select("s1", "s2", "cid", "copies").join(joined, "cid", "left").where((F.col("copies") > 1) | F.col("component").isNotNull()).select("s1", "s2", F.coalesce("component", "cid").alias("component")), "found")
    tables.clear(rows, found)
    own = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id")).otherwise(F.col("id"))
    every = rows.select("id", "n_shingles", "s1", "s2").join(found, ["s1", "s2"], "left").select(F.col("id").alias(id_col), "n_shingles", own.alias("component_id"))
    return every.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """docs, all columns as they are, with one row of each group of near-duplicates: the one with the smallest id.

    Of rows with one id the least by its text stays; rows with a null id all stay.
    """
    kept = near_duplicates(docs, id_col, text_col, percent, words).where(F.col("kept") & F.col(id_col).isNotNull()).select(id_col).distinct()
    rows = docs.where(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi")
    # of several rows of one id the least by its text, then by all columns
    order = [F.col(text_col).asc_nulls_first(), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))]
    rank = next(n for n in ("_rank", "_rank_of_id", "_rank_of_id_") if n not in docs.columns)
    named = rows.withColumn(rank, F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).where(F.col(rank) == 1).drop(rank)
    return named.unionByName(docs.where(F.col(id_col).isNull()))
