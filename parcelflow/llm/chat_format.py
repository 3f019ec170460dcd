"""Chat formatting by token-level assembly: segments are encoded by themselves and spliced with reserved ids.

A turn is a mark for its role, its text and an end mark; a role without a mark of its own is spelled out between two marks. Marks are
ids behind the vocabulary, so no text can hold one; as the output may also be read as text, control strings in a text are escaped
by a backslash, and backslashes too, which is undone on reading. The loss mask covers the texts of the assistant: +1 where one
begins and -1 where it ends, summed from the left.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import new_dir, returning, written
from parcelflow.llm.token_files import Encoder, default_vocabulary
from parcelflow.llm.turns import hashed, id_of, key_of, placed

#: Marks in the order of their ids, the first of which is the vocabulary's size: roles with a mark, any other role, its end, a turn's end.
MARKS = ("### System: ", "### User: ", "### Assistant: ", "### Role ", ": ", " </turn>\n")
ROLES = {"system": 0, "user": 1, "assistant": 2}
LEARNED = "assistant"
OTHER, NAMED, CLOSE = 3, 4, 5
#: What a text may not hold unescaped; in a role the colon too.
CONTROL = r"\\|###|</turn>|<\|[a-z_]+\|>"
IN_TEXT, IN_ROLE, ESCAPED = re.compile(CONTROL), re.compile(CONTROL + "|:"), re.compile(rf"\\({CONTROL}|:)")
#: Turns and ids of an output row at most, but for a single turn; bytes of texts encoded at once.
TURNS, IDS, STEP = 256, 1 << 20, 2 << 20


def escaped(text: str) -> str:
    return IN_TEXT.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes texts and decodes ids and marks of one vocabulary file."""

    def __init__(self, vocabulary: str):
        self.encoder = Encoder(vocabulary)
        library = self.encoder.library
        library.encode_special_tokens = True  # their names in a text are text
        self.encoder.special = []
        self.first = library.get_vocab_size()
        known, of = library.get_vocab(), byte_of()
        special = {t.content for t in library.get_added_tokens_decoder().values()}
        spelled = [b""] * self.first + [m.encode() for m in MARKS]
        for token, i in known.items():
            if token not in special:
                spelled[i] = bytes(of[c] for c in token)
        self.sizes = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(x, "<u4")[:-1].astype(np.int32) for x in self.encoder.encode(texts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, and where each id's bytes end."""
        size = self.sizes[ids]
        stop = np.cumsum(size)
        return self.flat[np.repeat(self.starts[ids] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)], stop


_codecs: dict[str, Codec] = {}


def codec(vocabulary: str) -> Codec:
    """The codec of a vocabulary file, loaded once a worker."""
    if vocabulary not in _codecs:
        _codecs[vocabulary] = Codec(vocabulary)
    return _codecs[vocabulary]


def assembled(c: Codec, roles: list[str], texts: list[str]) -> list[tuple[np.ndarray, int, int]]:
    """Of each turn its ids, and from where to where the loss mask covers them."""
    segments = []
    for role, text in zip(roles, texts, strict=True):
        if role not in ROLES:
            segments.append(IN_ROLE.sub(r"\\\g<0>", role))
        segments.append(escaped(text))
    ids, out = iter(c.encode(segments)), []
    for role in roles:
        mark = ROLES.get(role)
        head = np.array([c.first + mark], np.int32) if mark is not None else np.concatenate([[c.first + OTHER], next(ids), [c.first + NAMED]]).astype(np.int32)
        body = next(ids)
        stop = len(head) + len(body)
        out.append((np.concatenate([head, body, np.array([c.first + CLOSE], np.int32)]), len(head) if role == LEARNED else stop, stop))
    return out


def format_conversations(rows: DataFrame, path: str | None = None, id_col: str = "conv_id", vocabulary: str | None = None) -> DataFrame:
    """Writes conversations as token ids with a loss mask to path (a new shared folder), and returns the written table.

    rows: id_col, turn, role, text; other columns are dropped. Turns come by turn, null ones first, ties by role, then text; equal
    rows are turns of their own; null roles and texts are empty; null ids are one conversation; an empty table gives an empty one.
    Returns id_col, at and sub (the order of a conversation's parts), n_turns, ids and mask (1 under the loss); a part has TURNS
    turns at most, so a conversation of any length is never held whole.
    """
    spark, kind = rows.sparkSession, rows.schema[id_col].dataType.simpleString()
    vocabulary = vocabulary or default_vocabulary()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    own = rows.select(key_of(id_col).alias("key"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    counted = written(own.groupBy("key", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n")), "turns")
    names = ["key", "at", "sub", "n_turns", "ids", "mask"]

    def parts(batch: pa.RecordBatch, c: Codec) -> Iterator[pa.RecordBatch]:
        keys, ats, roles, texts, counts = (batch.column(i).to_pylist() for i in range(5))
        begin = 0
        while begin < len(keys):
            end, size = begin, 0
            while end < len(keys) and (end == begin or size + len(texts[end]) <= STEP):
                size += len(texts[end]) + len(roles[end])
                end += 1
            yield from packed(keys[begin:end], ats[begin:end], counts[begin:end], assembled(c, roles[begin:end], texts[begin:end]))
            begin = end

    def packed(keys: list, ats: list, counts: list, turns: list) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # key, at, sub, turns of a part
        held = last = sub = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([t[0] for d in done for t in d[3]])
            size = np.array([len(t[0]) for d in done for t in d[3]])
            at = np.cumsum(size) - size
            step = np.zeros(len(ids) + 1, np.int8)
            for side, k in ((1, 1), (-1, 2)):
                np.add.at(step, at + np.array([t[k] for d in done for t in d[3]]), side)
            mask = np.cumsum(step[:-1], dtype=np.int8)
            ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *(len(d[3]) for d in done)])].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (ids, mask)]
            scalars = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array([len(d[3]) for d in done], pa.int64())]
            return pa.RecordBatch.from_arrays([*scalars, *lists], names=names)

        for key, at, count, turn in zip(keys, ats, counts, turns, strict=True):
            for _ in range(count):
                if not done or done[-1][0] != key or len(done[-1][3]) >= TURNS:
                    sub = sub + 1 if done and last == at else 0
                    if held > IDS:
                        yield out()
                        done, held = [], 0
                    done.append((key, at, sub, []))
                    last = at
                done[-1][3].append(turn)
                held += len(turn[0])
        if done:
            yield out()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            yield from parts(batch, c)

    made = placed(counted).select("key", "at", "role", "text", "n").mapInArrow(returning(run), "key string, at long, sub long, n_turns long, ids array<int>, mask array<tinyint>")
    path = path or new_dir(spark, "chat")
    made.select(id_of(kind).alias(id_col), "at", "sub", "n_turns", "ids", "mask").write.parquet(path)
    return spark.read.parquet(path)


def turns_of(c: Codec, ids: np.ndarray) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(role, text) of each turn that ids hold, with the bytes they stand for and where each id's end."""
    raw, stop = c.decode(ids)
    at = np.flatnonzero(ids >= c.first)
    marks, names, out, role = (ids[at] - c.first).tolist(), {k: r for r, k in ROLES.items()}, [], ""
    text = raw.tobytes()
    begin = 0
    for mark, start, end in zip(marks, (stop[at] - c.sizes[ids[at]]).tolist(), stop[at].tolist(), strict=True):
        if mark in names:
            role = names[mark]
        elif mark == NAMED:
            role = unescaped(text[begin:start].decode())
        elif mark == CLOSE:
            out.append((role, unescaped(text[begin:start].decode())))
        begin = end
    return out, raw, stop


def read_conversations(formatted: DataFrame, id_col: str = "conv_id", vocabulary: str | None = None) -> DataFrame:
    """(key, chunk, n_turns, turns, loss, loss_chars, formatted_chars) of each part of a formatted table, from its ids and mask.

    turns: role, line feed, text, line feed of every turn, and loss: the text under the mask, both unescaped, as UTF-8.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary)
        for batch in batches:
            lists = [(col.offsets.to_numpy(), col.values.to_numpy(zero_copy_only=False)) for col in (batch.column(2), batch.column(3))]
            found = []
            for i in range(batch.num_rows):
                ids, mask = (values[ends[i] : ends[i + 1]] for ends, values in lists)
                turns, raw, stop = turns_of(c, ids)
                loss = unescaped(raw[np.repeat(mask, np.diff(stop, prepend=0)) > 0].tobytes().decode())
                found.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns).encode(), loss.encode(), len(loss), len(raw.tobytes().decode())))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], t) for k, t in enumerate(kinds))], names=["key", "chunk", "n_turns", "turns", "loss", "loss_chars", "formatted_chars"])

    own = formatted.select(key_of(id_col).alias("key"), F.struct("at", "sub").alias("chunk"), "ids", "mask")
    return own.mapInArrow(returning(run), "key string, chunk struct<at:bigint,sub:bigint>, n_turns long, turns binary, loss binary, loss_chars long, formatted_chars long")


def format_digests(rows: DataFrame, id_col: str = "conv_id", vocabulary: str | None = None) -> DataFrame:
    """rows formatted, written and read back: (id_col, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) per conversation."""
    kind = rows.schema[id_col].dataType.simpleString()
    parts = read_conversations(format_conversations(rows, id_col=id_col, vocabulary=vocabulary), id_col, vocabulary)
    found = hashed(parts, ["turns", "loss"], "", ["n_turns", "loss_chars", "formatted_chars"])
    return found.select(id_of(kind).alias(id_col), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
