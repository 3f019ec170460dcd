"""Repair of conversation structure: the cheapest edits that make the roles alternate, by block tables over the rows' symbols.

A row is one symbol: must it be deleted, is it truncated, and the initial of its role. A cost vector holds the least cost of reaching
each state of the alternation (nothing yet, after system, after user, after assistant); shifted to a least entry of zero and without
entries that can no longer win, only a few vectors exist. A table gives, for each vector and each block of WIDTH symbols, the vector
after the block and what the cost grew by, so a conversation is a walk of lookups. For the edits, blocks are expanded from the last
to the first: of each the states on some cheapest path are kept, with the least edit from each, remembered by vector, block and the
states behind. From a state each edit leads to one state only, so a walk from the start reads off the least of the cheapest edits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import partitions, returning, written
from parcelflow.llm.turns import hashed, key_of, placed

#: Costs of the edits, and what a truncated row adds that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 30
WIDTH = 4
ROLES = {"u": "user", "a": "assistant"}
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. What may come next, and the state then.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FREE = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Inserts that end a conversation from a state.
TAIL = {0: 0, 1: 2, 2: 1, 3: 0}
#: Digits of a block: 0 no row, 1 a row to delete, 2 to 5 a whole row by its initial (s, u, a, other), 6 to 9 a truncated one.
INITIALS = "sua"
#: Symbols of rows are hexadecimal digits, fault * 4 + initial, with faults whole, truncated, duplicate, blank.
WHOLE, CUT, DUPLICATE, BLANK = range(4)
SYMBOLS = "0123456789abcdef"
DIGITS = str.maketrans(SYMBOLS, "2345678911111111")
WHITE = " \t\n\x0b\x0c\r"


def edges(state: int, digit: int) -> list[tuple[str, int, int]]:
    """(edit, cost, next state) of the edits that use up a row, in the order of their names."""
    if digit == 0:
        return [("", 0, state)]
    found = [("D", DELETE, state)]
    if digit > 1:
        extra, initial = TRUNCATED * (digit > 5), "suao"[(digit - 2) % 4]
        if (state, initial) in NEXT:
            found.append(("K", extra, NEXT[state, initial]))
        found.append(("R", REROLE + extra, NEXT[state, FREE[state]]))
    return found


def settled(costs: list[int]) -> tuple[int, ...]:
    """costs after any inserts, without states that cannot lie on a cheapest path.

    From after-assistant everything can follow that follows from system, and from nothing but for a kept system row, which is
    two more to delete; a state that costs more than that is never on a cheapest path.
    """
    f = list(costs)
    for _ in range(2):
        f[2] = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
        f[3] = min(f[3], f[2] + INSERT)
    if f[0] > f[3] + DELETE:
        f[0] = NEVER
    if f[1] > f[3]:
        f[1] = NEVER
    return tuple(min(x, NEVER) for x in f)


def moved(f: tuple[int, ...], digit: int) -> tuple[int, ...]:
    g = [NEVER] * 4
    for state in range(4):
        if f[state] < NEVER:
            for _, cost, to in edges(state, digit):
                g[to] = min(g[to], f[state] + cost)
    return settled(g)


class BlockTables:
    """Cost vectors, their transitions for every block of symbols, and the expanded blocks met so far."""

    #: Expanded blocks remembered.
    KEPT = 500_000

    def __init__(self, width: int = WIDTH):
        self.width = width
        first = settled([0, NEVER, NEVER, NEVER])
        self.vectors, known, step, gain = [first], {first: 0}, [], []
        for v in self.vectors:  # grows while it is read
            step.append([])
            gain.append([])
            for digit in range(10):
                g = moved(v, digit)
                least = min(g)
                g = tuple(x - least if x < NEVER else NEVER for x in g)
                if g not in known:
                    known[g] = len(self.vectors)
                    self.vectors.append(g)
                step[-1].append(known[g])
                gain[-1].append(least)
        one, grown = np.array(step), np.array(gain)
        after, cost = one, grown
        for _ in range(width - 1):
            cost = (cost[:, :, None] + grown[after]).reshape(len(one), -1)
            after = one[after].reshape(len(one), -1)
        self.after, self.cost = after.tolist(), cost.tolist()
        self.known = known
        self.expanded: dict[tuple[int, int, int], tuple[int, list]] = {}

    def expand(self, vector: int, block: int, ends: int) -> tuple[int, list]:
        """Of a block behind a vector and before the states ends (a set as bits) on cheapest paths: the states before it on such
        paths, and from each of them the least edits and the state that they lead to."""
        key = (vector, block, ends)
        if key in self.expanded:
            return self.expanded[key]
        digits = [int(d) for d in str(block).zfill(self.width)]
        f = [self.vectors[vector]]
        for d in digits:
            f.append(moved(f[-1], d))
        good, best = {s for s in range(4) if ends >> s & 1}, []
        for j in range(self.width - 1, -1, -1):
            inner, row = {}, {}
            for s in range(4):
                if f[j][s] < NEVER:
                    for edit, cost, to in edges(s, digits[j]):
                        if to in good and f[j][s] + cost == f[j + 1][to]:
                            row[s] = (edit, to, j + 1)
                            break
            for _ in range(2):
                for s in range(4):
                    to = NEXT[s, FREE[s]]
                    # an insert comes before keeping and reroling, but after deleting and where no row is left
                    if f[j][s] < NEVER and to in row and f[j][s] + INSERT == f[j][to] and (s not in row or row[s][0] in "KR" and row[s][0]):
                        inner[s] = ("I", to, j)
                row |= inner
            good = set(row)
            best.append(row)
        best.reverse()
        out: list = [None] * 4
        for s in good:
            text, at, state = [], 0, s
            while at < self.width:
                edit, state, at = best[at][state]
                text.append(edit)
            out[s] = ("".join(text), state)
        if len(self.expanded) >= self.KEPT:
            self.expanded.clear()
        self.expanded[key] = (sum(1 << s for s in good), out)
        return self.expanded[key]

    def repair(self, chunks: list[str]) -> tuple[int, list[str], list[int]]:
        """Of a conversation's digits, chunk by chunk: the cost, each chunk's edits and the state before it."""
        w, blocks, firsts = self.width, [], []
        for c in chunks:
            firsts.append(len(blocks))
            c += "0" * (-len(c) % w)
            blocks += [int(c[i : i + w]) for i in range(0, len(c), w)]
        vector, total, before = 0, 0, []
        for b in blocks:
            before.append(vector)
            total += self.cost[vector][b]
            vector = self.after[vector][b]
        f = self.vectors[vector]
        least = min(f[s] + INSERT * TAIL[s] for s in range(4))
        ends, pieces = sum(1 << s for s in range(4) if f[s] + INSERT * TAIL[s] == least), []
        for v, b in zip(reversed(before), reversed(blocks), strict=True):
            ends, out = self.expand(v, b, ends)
            pieces.append(out)
        pieces.reverse()
        state, edits, states = 0, [], []
        for k, first in enumerate(firsts):
            states.append(state)
            text = []
            for out in pieces[first : firsts[k + 1] if k + 1 < len(firsts) else None]:
                piece, state = out[state]
                text.append(piece)
            edits.append("".join(text))
        if edits:
            edits[-1] += "I" * TAIL[state]
        return total + least, edits, states


_tables: list[BlockTables] = []


def tables() -> BlockTables:
    """The tables, made once a worker."""
    if not _tables:
        _tables.append(BlockTables())
    return _tables[0]


def symbols(rows: DataFrame) -> DataFrame:
    """Rows (key, turn, role, text, n) with symbol, of the first of the n equal rows, and again, of the others.

    The first row of a role and text is told by the least turn of their rows; equal rows are one row with a count, so no group's
    rows come together but as partial aggregates.
    """
    first = rows.groupBy("key", "role", "text").agg(F.bool_or(F.col("turn").isNull()).alias("_null"), F.min("turn").alias("_least")).toDF("_key", "_role", "_text", "_null", "_least")
    joined = rows.join(first, (F.col("key") == F.col("_key")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text")))
    new = F.when(F.col("_null"), F.col("turn").isNull()).otherwise(F.col("turn") == F.col("_least"))
    body = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(body == "", BLANK).when(~new, DUPLICATE).when(F.right(body, F.lit(1)).isin(".", "!", "?"), WHOLE).otherwise(CUT)
    letter = F.substring("role", 1, 1)
    at = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(3)
    digit = lambda fault: F.substring(F.lit(SYMBOLS), fault * 4 + at + 1, F.lit(1))
    return joined.select("key", "turn", "role", "text", "n", digit(fault).alias("symbol"), digit(F.when(body == "", BLANK).otherwise(DUPLICATE)).alias("again"))


def audits(conversations: DataFrame) -> DataFrame:
    """(key, blank, duplicate, truncated, illegal, cost, chunks) of conversations (key, chunks array<struct<chunk, symbols>>).

    chunks, returned, has each chunk's edits and, for the rows' sake, the state before it.
    """
    one = "struct<chunk:bigint,edits:string,state:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables()
        legal = np.zeros((4, 4), bool)
        for pair in ("su", "ua", "au"):
            legal[INITIALS.index(pair[0]), INITIALS.index(pair[1])] = True
        for batch in batches:
            out = []
            for key, chunks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = [c["symbols"] for c in chunks]
                code = np.frombuffer("".join(parts).encode(), np.uint8)
                code = np.where(code > 57, code - 87, code - 48)
                n = np.bincount(code >> 2, minlength=4)
                illegal = int((~legal[code[:-1] & 3, code[1:] & 3]).sum())
                cost, edits, states = t.repair([p.translate(DIGITS) for p in parts])
                out.append((key, int(n[BLANK]), int(n[DUPLICATE]), int(n[CUT]), illegal, cost, [{"chunk": c["chunk"], "edits": e, "state": s} for c, e, s in zip(chunks, edits, states, strict=True)]))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.struct([("chunk", pa.int64()), ("edits", pa.string()), ("state", pa.int32())]))]
            names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "chunks"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return conversations.mapInArrow(returning(run), f"key string, blank long, duplicate long, truncated long, illegal long, cost long, chunks array<{one}>")


def edited(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """(key, chunk, turns array<struct<edit, role, text>>): each chunk's rows after its edits; deleted rows are gone.

    rows (key, chunk, at, role, text, n). A chunk's edits come before its rows in one stream.
    """
    null = lambda kind: F.lit(None).cast(kind)
    heads = audit.select("key", F.explode("chunks").alias("c")).select("key", "c.chunk", F.lit(-1).cast("long").alias("at"), null("string").alias("role"), "c.edits", F.col("c.state").cast("long").alias("n"))
    own = rows.select("key", "chunk", "at", "role", F.col("text").alias("edits"), F.col("n").cast("long"))
    n = partitions(rows.sparkSession)
    dealt = heads.unionByName(own).repartition(n, "key", "chunk").sortWithinPartitions("key", "chunk", "at")
    turn = pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, int, list]] = []
        edits, at, state, turns = "", 0, 0, []

        def insert() -> None:
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                initial = FREE[state]
                turns.append({"edit": "I", "role": ROLES[initial], "text": ""})
                state = NEXT[state, initial]
                at += 1

        def out() -> pa.RecordBatch:
            flat = [t for _, _, own in done for t in own]
            ends = np.cumsum([0, *(len(own) for _, _, own in done)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, turn))
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), lists], names=["key", "chunk", "turns"])

        chunk = None
        for batch in batches:
            for key, number, place, role, text, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place < 0:
                    if chunk:
                        insert()
                        done.append((*chunk, turns))
                    chunk, edits, at, state, turns = (key, number), text, 0, count, []
                    continue
                for _ in range(count):
                    insert()
                    edit = edits[at]
                    at += 1
                    if edit == "D":
                        continue
                    initial = role[:1] if edit == "K" else FREE[state]
                    turns.append({"edit": edit, "role": role if edit == "K" else ROLES[initial], "text": text})
                    state = NEXT[state, initial]
            if done:
                yield out()
                done.clear()
        if chunk:
            insert()
            done.append((*chunk, turns))
            yield out()

    return dealt.mapInArrow(returning(run), "key string, chunk long, turns array<struct<edit:string,role:string,text:string>>")


def repair_conversations(rows: DataFrame, id_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(audit, turns) of conversations.

    rows: id_col, turn, role, text, and n, how often the row stands there (a column that is absent counts as 1). Null roles and texts
    count as one space, null turns come first, null ids are one conversation; rows of one turn are ordered by role, then text. Other
    columns are dropped; an empty table gives two empty ones.
    audit: key, gaps, blank, duplicate, truncated, illegal, cost, chunks (chunk, edits, state), a row per conversation.
    turns: key, chunk, turns (edit, role, text), a row per chunk of a conversation, in ascending chunk.
    """
    n = F.col("n").cast("long") if "n" in rows.columns else F.lit(1).cast("long")
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    own = rows.select(key_of(id_col).alias("key"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), n.alias("n"))
    counted = own.groupBy("key", "turn", "role", "text").agg(F.sum("n").alias("n"))
    told = written(symbols(written(counted, "turns")), "symbols")
    ordered = written(placed(told), "ordered")
    run = F.concat("symbol", F.repeat("again", (F.col("n") - 1).cast("int")))
    chunks = ordered.groupBy("key", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", run.alias("s")))).alias("s")).select("key", "chunk", F.array_join(F.col("s.s"), "").alias("symbols"))
    conversations = chunks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("chunk", "symbols"))).alias("chunks"))
    audit = written(audits(conversations), "audits")
    spans = ordered.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    turns = written(edited(ordered, audit), "repaired")
    return audit.join(spans.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))), "key"), turns


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) with faults put in by a checksum of id and turn; n: how often the row now stands there."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("_kind") == 3, 2).otherwise(1).alias("n"))


def repair_digests(conversations: DataFrame, damaged: DataFrame) -> DataFrame:
    """A row per conv_id of conversations with what repair_conversations() found and made of damaged: counts, cost, audit and a digest.

    A conversation without rows in damaged has zeros, an empty audit and the digest of an empty string.
    """
    audit, turns = repair_conversations(damaged)
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    body = F.when(F.size("turns") > 0, F.array_join(lines, "\n").cast("binary"))
    digest = hashed(turns.select("key", "chunk", body.alias("repaired")), ["repaired"], "\n")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = audit.select("key", *counts, F.array_join(F.col("chunks.edits"), "").alias("audit")).join(digest, "key", "left")
    ids = conversations.select(key_of("conv_id").alias("key"), "conv_id").groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts]
    return ids.join(found, "key", "left").select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
