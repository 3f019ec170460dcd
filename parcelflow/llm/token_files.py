"""Token files: one zstandard frame per document, frame checksums and a trailing seek table.

File: a frame per document (its token ids, little-endian unsigned 32-bit, with zstandard's own content checksum), then one
frame with the documents' ids, then a skippable frame that holds the seek table of the public seekable format: for each
frame its compressed size, its size and the low 32 bits of its XXH64, then the number of frames, a descriptor and a magic
number. A reader needs the tail and the frames of the documents that it wants, no more.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelflow.llm.common import new_dir, range_count, returning, shard_of, shard_splits, written

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE, HAS_CHECKSUM = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
END_ID = 2
DOCS_PER_FILE = 10_000
LEVEL = 1


def file_system(path: str):
    """The store of a path, as executors reach it: local or mounted folders, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(ENTRY.pack(*f) for f in frames) + FOOTER.pack(len(frames), HAS_CHECKSUM, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Reader:
    """Random access to one token file."""

    def __init__(self, path: str):
        import zstandard

        store, at = file_system(path)
        self.file = store.open_input_file(at)
        self.zstd = zstandard.ZstdDecompressor()
        end = self.file.size()
        n, flags, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, end - FOOTER.size))
        if magic != SEEKABLE or flags != HAS_CHECKSUM:
            raise ValueError(f"{path} has no seek table")
        size = n * ENTRY.size
        raw = self.file.read_at(size, end - FOOTER.size - size)
        self.frames = np.frombuffer(raw, "<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype=np.int64)))
        known = np.frombuffer(self.frame(n - 1), "<i8")
        self.doc_ids = [int(x) if ok else None for x, ok in known.reshape(-1, 2)]

    def frame(self, i: int) -> bytes:
        import xxhash

        packed, size, check = (int(x) for x in self.frames[i])
        data = self.zstd.decompress(self.file.read_at(packed, int(self.starts[i])), max_output_size=size)
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return data

    def tokens(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        return np.frombuffer(self.frame(i), "<u4")

    def close(self) -> None:
        self.file.close()


class Encoder:
    """Token ids of whole texts, the same as the library's encode() gives, with the pieces of texts remembered.

    A byte-level vocabulary's own splitting ends a piece before a space, around a line feed, and between a letter and a sign
    or digit, so a text's ids are those of its pieces, put together. A batch is cut by array operations over its bytes, its
    distinct pieces are looked up (new ones encoded, many in one call), and the ids gathered. Only boundaries that are
    certain from the bytes are used: letters are a-z, A-Z and U+00C0 to U+024F without the two signs there. Texts that begin
    or end with white space, have two such characters side by side or any beyond ASCII, or hold a special token's name, go
    to the library whole.
    """

    #: Pieces remembered; bytes of texts cut at once; pieces gathered at once.
    KEPT, CHUNK, STEP = 800_000, 2 << 20, 1 << 19
    END = b"\xff"
    #: White space and controls next to each other or at an end; white space beyond ASCII (first bytes of U+0085 to U+3000).
    WIDE = re.compile("[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, vocabulary: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library, self.end_id = Tokenizer.from_file(vocabulary), end_id
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        at = np.arange(256)
        self.space = np.isin(at, [0x20, *range(0x09, 0x0E)])
        self.letter = ((at | 32) >= 97) & ((at | 32) <= 122)
        self.sign = (at < 128) & ~self.letter & ~self.space
        self.forget()
        # a vocabulary that does not split so is never cut
        probe = ["ab cd, ef\ngh ij", "\u00e9t\u00e9,9x it's a-b 12ab"]
        self.splits = self.feed is not None and [x.tobytes() for x in self.pieced([t.encode() for t in probe])] == self.whole(probe)

    def forget(self) -> None:
        self.kept = {self.END: 0}
        self.flat, self.used = np.full(1 << 16, self.end_id, "<u4"), 1
        self.starts, self.sizes = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def whole(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids and the end id, as little-endian unsigned 32-bit integers."""
        return [np.asarray([*e.ids, self.end_id], "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, n = len(self.kept), len(pieces)
        while first + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.used += len(ids)
        self.kept.update(zip(pieces, range(first, first + n), strict=True))

    def learn(self, pieces: list[bytes]) -> None:
        # pieces without white space inside are encoded in one text, a line feed after each
        plain = [p for p in pieces if len(p.split()) == 1 and not p[-1:].isspace() and p[:1] not in b"\t\n\x0b\x0c\r"]
        for begin in range(0, len(plain), 4096):
            some = plain[begin : begin + 4096]
            ids = np.asarray(self.library.encode_batch_fast([b"\n".join([*some, b"x"]).decode()], add_special_tokens=False)[0].ids, "<u4")
            at = np.flatnonzero(ids == self.feed)[: len(some)]
            self.keep(some, np.delete(ids[: at[-1]], at[:-1]), np.diff(at, prepend=-1) - 1)
        known = self.kept.keys()
        rest = [p for p in pieces if p not in known]
        if rest:
            found = [e.ids for e in self.library.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)]
            self.keep(rest, np.array([x for f in found for x in f], "<u4"), np.array([len(f) for f in found]))

    def pieced(self, texts: list[bytes]) -> list[np.ndarray]:
        """Of each text, without odd white space, its ids and the end id."""
        if not texts:
            return []
        raw = self.END.join([*texts, b""])
        buf = np.frombuffer(raw, np.uint8)
        letter = self.letter[buf]
        # the second byte of U+00C0 to U+024F, without the multiplication and division signs
        letter[1:] |= (buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC9) & ~((buf[:-1] == 0xC3) & ((buf[1:] == 0x97) | (buf[1:] == 0xB7)))
        cut = (buf == 0x20) | (buf == 0x0A) | (buf == 0xFF)
        cut[1:] |= (letter[:-1] & self.sign[buf[1:]]) | (buf[:-1] == 0x0A) | (buf[:-1] == 0xFF)
        cut[0] = True
        at = np.append(np.flatnonzero(cut), len(buf)).astype(np.int32)
        found, stops, total = [], [], 0
        for begin in range(0, len(at) - 1, self.STEP):
            some = at[begin : begin + self.STEP + 1]
            pieces = pa.Array.from_buffers(pa.binary(), len(some) - 1, [None, pa.py_buffer(some), pa.py_buffer(raw)]).dictionary_encode()
            own = pieces.dictionary.to_pylist()
            new = [p for p in own if p not in self.kept]
            if len(self.kept) + len(new) > self.KEPT:
                self.forget()
                new = [p for p in own if p not in self.kept]
            self.learn(new)
            code = np.fromiter(map(self.kept.__getitem__, own), np.int64, len(own))[pieces.indices.to_numpy()]
            size = self.sizes[code]
            stop = np.cumsum(size)
            found.append(self.flat[np.repeat(self.starts[code] - (stop - size), size) + np.arange(stop[-1])])
            stops.append(stop[np.flatnonzero(code == 0)] + total)
            total += stop[-1]
        return np.split(np.concatenate(found), np.concatenate(stops)[:-1])

    def odd(self, text: str, raw: bytes) -> bool:
        return not self.splits or bool(self.WIDE.search(text) if len(raw) > len(text) or not text.isprintable() else False) or any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text its ids and the end id, as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(texts)
        raw = [t.encode() for t in texts]
        aside = {i for i, (t, r) in enumerate(zip(texts, raw, strict=True)) if self.odd(t, r)}
        for some in self.parts(raw):
            mine = [i for i in some if i not in aside]
            # white space at an end or side by side
            buf = np.frombuffer(b" ".join([b"", *(raw[i] for i in mine), b""]), np.uint8)
            gap = self.space[buf]
            ends = np.cumsum([len(raw[i]) + 1 for i in mine]) if mine else np.zeros(0, int)
            aside.update(mine[k] for k in set(np.searchsorted(ends, np.flatnonzero(gap[1:] & gap[:-1]) + 1).tolist()) if k < len(mine))
            mine = [i for i in mine if i not in aside]
            for i, x in zip(mine, self.pieced([raw[i] for i in mine]), strict=True):
                out[i] = x.tobytes()
        rest = sorted(i for i in range(len(texts)) if out[i] is None)
        for i, x in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def parts(self, raw: list[bytes]) -> Iterator[range]:
        begin, size = 0, 0
        for i, r in enumerate(raw):
            if size and size + len(r) > self.CHUNK:
                yield range(begin, i)
                begin, size = i, 0
            size += len(r) + 1
        yield range(begin, len(raw))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(vocabulary: str, end_id: int = END_ID) -> Encoder:
    """The encoder of a vocabulary file and an end id, loaded once a worker."""
    if (vocabulary, end_id) not in _encoders:
        _encoders[vocabulary, end_id] = Encoder(vocabulary, end_id)
    return _encoders[vocabulary, end_id]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded_frames(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, end_id: int) -> DataFrame:
    """(id, shard, frame, size, check) of each row; encoding and compression run where the text was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        t, z = encoder(vocabulary, end_id), zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                part = batch.slice(begin, 1024)
                ids = t.encode([x or "" for x in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), part.column(1), pa.array([z.compress(x) for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([xxhash.xxh64_intdigest(x) & 0xFFFFFFFF for x in ids], pa.int64()),
                    ],
                    names=["id", "shard", "frame", "size", "check"],
                )

    # by place, since a column of docs may itself be named shard
    own = docs.toDF("id", "text", "shard")
    return own.select(F.col("id").cast("long"), "shard", "text").mapInArrow(returning(run), "id long, shard int, frame binary, size long, check long")


def write_token_files(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, docs_per_file: int = DOCS_PER_FILE
) -> DataFrame:
    """Writes docs as token files in path, by ascending id over all files, and returns the manifest: (shard, piece, path, n_docs, n_tokens).

    Ids are dealt by ranges; a range is a run of files of docs_per_file documents. Null ids come first, ties stay together in any order of equal rows; a null or empty text is its end id alone; other
    columns are dropped; an empty table writes no file. A file is written under a name of its own and then renamed, so
    a task that is run twice leaves one whole file.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    splits = shard_splits(docs, id_col, range_count(spark, docs.count(), docs_per_file))
    frames = encoded_frames(docs.select(id_col, text_col, shard_of(id_col, splits).alias("shard")), id_col, text_col, vocabulary, end_id)
    sorted_rows = frames.repartitionById(len(splits) + 1, "shard").sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "size", "check")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        store, at = file_system(path)
        z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        sink, shard, piece, name, entries, ids, tokens = None, None, 0, "", [], [], 0

        def close() -> pa.RecordBatch:
            known = np.asarray([[i or 0, i is not None] for i in ids], "<i8").tobytes()
            packed = z.compress(known)
            sink.write(packed)
            sink.write(seek_table([*entries, (len(packed), len(known), xxhash.xxh64_intdigest(known) & 0xFFFFFFFF)]))
            sink.close()
            final = f"tokens-{shard:05d}-{piece:06d}.zst"
            store.move(name, f"{at}/{final}")
            row = [(shard, pa.int32()), (piece, pa.int32()), (f"{path}/{final}", pa.string()), (len(ids), pa.int64()), (tokens, pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in row], names=["shard", "piece", "path", "n_docs", "n_tokens"])

        for batch in batches:
            for i, s, frame, size, check in zip(*(batch.column(k) for k in range(5)), strict=True):
                if s.as_py() != shard or len(ids) >= docs_per_file:
                    if sink:
                        yield close()
                    piece = piece + 1 if s.as_py() == shard else 0
                    shard, entries, ids, tokens = s.as_py(), [], [], 0
                    name = f"{at}/.{shard:08d}-{uuid.uuid4().hex}"
                    store.create_dir(at)
                    sink = store.open_output_stream(name)
                raw = frame.as_py()
                sink.write(raw)
                entries.append((len(raw), size.as_py(), check.as_py()))
                ids.append(i.as_py())
                tokens += size.as_py() // 4
        if sink:
            yield close()

    return written(sorted_rows.mapInArrow(put, "shard int, piece int, path string, n_docs long, n_tokens long"), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of a manifest, each frame checked."""
    # the manifest has a row per file; a running sum over it gives each file's first token
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = Reader(path)
                for begin in range(0, len(file.doc_ids), 1024):
                    docs = range(begin, min(begin + 1024, len(file.doc_ids)))
                    data = [file.frame(i) for i in docs]
                    size = np.asarray([len(x) // 4 for x in data], np.int64)
                    first = start + np.cumsum(size) - size
                    start += int(size.sum())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file.doc_ids[i] for i in docs], pa.int64()), pa.array(first), pa.array(size), pa.array([zlib.crc32(x) for x in data], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )
                file.close()

    n = max(1, manifest.count())
    return placed.select("path", "start").repartition(n, "path").mapInArrow(get, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """docs written as token files in a new shared folder and read back: (doc_id, start, n_tokens, ids_crc32)."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, new_dir(spark, "tokens"), id_col, text_col, vocabulary, end_id))
