"""Token ids as patched frame-of-reference files (operator 1).

The ids of a shard form one stream, cut into blocks of 1,024.  A block
stores its minimum, every id less the minimum at the width that holds
``WIDTH_PERCENTILE`` per cent of them, and the rest as exceptions
(position, value).  A footer indexes the byte at which every block starts
and the ids, lengths and names of the documents, so any block or document
can be read by itself.

Layout (little-endian): magic; blocks ``u32 base, u16 n, u16 exceptions,
u8 width, packed bits, u16 positions, u32 values``; footer: block starts
``i64``, document ids ``i64``, null marks ``u8``, document token starts
``i64``, then ``u64`` blocks, documents, tokens and footer start, magic.

Writing is a range partition on the document id; each task streams its
rows into files of its own in the shared folder under fresh names and
returns one manifest row a file.  Only the manifest of successful tasks is
kept, so a task that is run again leaves at most an unnamed file behind.

Null and empty texts are documents with the end id alone; null ids come
first; rows with equal ids follow one another by a hash of their text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import create_file, keyed, materialize, open_file, scratch_path, text_buffers, text_steps, tidy

#: Encoded bytes that a task reads (a larger file is one task's).
READ_BYTES = 8 << 20
MAGIC = b"PFORIDS1"
BLOCK = 1024
WIDTH_PERCENTILE = 90
#: Tokens after which a task begins its next file.
FILE_TOKENS = 1 << 26
_RUN = 256  # blocks handled by one numpy step
_HEAD, _HEAD_SIZE = "<IHHB", struct.calcsize("<IHHB")
_TAIL, _TAIL_SIZE = "<QQQQ", struct.calcsize("<QQQQ")


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of packed bits, least significant first."""
    if width == 0:
        return np.zeros((len(values), 0), np.uint8)
    if width == 16:
        return np.ascontiguousarray(values.astype("<u2")).view(np.uint8).reshape(len(values), -1)
    bits = np.unpackbits(np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(len(values), -1, 4),
                         axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int, count: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(packed), count), np.uint32)
    bits = np.unpackbits(packed, axis=1, bitorder="little", count=count * width).reshape(-1, width)
    out = np.zeros((len(bits), 4), np.uint8)
    out[:, :(width + 7) // 8] = np.packbits(bits, axis=1, bitorder="little")
    return out.view("<u4").reshape(len(packed), count)


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits of each number."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of a stream of ids (the last may be short)."""
    out: list[bytes] = []
    for at in range(0, len(ids), BLOCK * _RUN):
        part = ids[at:at + BLOCK * _RUN].astype(np.uint32)
        count = np.full(-(-len(part) // BLOCK), BLOCK)
        short = len(part) % BLOCK
        if short:
            count[-1] = short
            part = np.concatenate([part, np.full(BLOCK - short, part[-short:].min(), np.uint32)])
        rows = part.reshape(-1, BLOCK)
        base = rows.min(axis=1)
        rows = rows - base[:, None]
        k = -(-BLOCK * WIDTH_PERCENTILE // 100) - 1
        width = _widths(np.partition(rows, k, axis=1)[:, k])
        odd = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
        packed: dict[int, bytes] = {}
        for w in np.unique(width).tolist():
            which = np.flatnonzero(width == w)
            bits = _pack(np.where(odd[which], 0, rows[which]), w)
            packed.update(zip(which.tolist(), (r.tobytes() for r in bits)))
        for i in range(len(rows)):
            pos = np.flatnonzero(odd[i])
            out.append(struct.pack(_HEAD, int(base[i]), int(count[i]), len(pos), int(width[i])) + packed[i]
                       + pos.astype("<u2").tobytes() + rows[i, pos].astype("<u4").tobytes())
    return out


def decode_blocks(blocks: list[bytes]) -> np.ndarray:
    """The ids of consecutive blocks."""
    rows = np.zeros((len(blocks), BLOCK), np.uint32)
    base = np.zeros(len(blocks), np.uint32)
    count = np.zeros(len(blocks), np.int64)
    by_width: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        base[i], count[i], _, w = struct.unpack_from(_HEAD, b)
        by_width.setdefault(w, []).append(i)
    for w, which in by_width.items():
        size = BLOCK * w // 8
        packed = np.frombuffer(b"".join(blocks[i][_HEAD_SIZE:_HEAD_SIZE + size] for i in which), np.uint8)
        rows[which] = _unpack(packed.reshape(len(which), size), w, BLOCK)
        for i in which:
            odd = struct.unpack_from(_HEAD, blocks[i])[2]
            if odd:
                at = _HEAD_SIZE + size
                rows[i, np.frombuffer(blocks[i], "<u2", odd, at)] = np.frombuffer(blocks[i], "<u4", odd, at + 2 * odd)
    rows += base[:, None]
    return rows[np.arange(BLOCK)[None, :] < count[:, None]]


class Writer:
    """Streams ids into one file."""

    def __init__(self, folder: str, name: str):
        self.uri, self.out = create_file(folder, name)
        self.out.write(MAGIC)
        self.at, self.starts = len(MAGIC), []
        self.ids: list[np.ndarray] = []
        self.held = self.tokens = 0
        self.doc_ids: list[int | None] = []
        self.doc_starts: list[int] = []

    def add(self, doc_ids: list, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents whose ids lie between the given bounds of ``ids``."""
        self.doc_ids += doc_ids
        self.doc_starts += (self.tokens + bounds[:-1]).tolist()
        self.tokens += len(ids)
        self.ids.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK * _RUN:
            self._flush(self.held - self.held % BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.uint32)
        for b in encode_blocks(ids[:count]):
            self.starts.append(self.at)
            self.out.write(b)
            self.at += len(b)
        self.ids, self.held = [ids[count:]], len(ids) - count

    def close(self) -> dict:
        self._flush(self.held)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        self.out.write(np.array(self.starts + [self.at], "<i8").tobytes())
        self.out.write(np.array([d or 0 for d in self.doc_ids], "<i8").tobytes() + null.tobytes())
        self.out.write(np.array(self.doc_starts + [self.tokens], "<i8").tobytes())
        self.out.write(struct.pack(_TAIL, len(self.starts), len(null), self.tokens, self.at) + MAGIC)
        self.out.close()
        return {"file": self.uri, "n_docs": len(null), "n_tokens": self.tokens, "bytes": self.at}


class Reader:
    """Random access to one file through its footer."""

    def __init__(self, uri: str):
        self.f = open_file(uri)
        size = self.f.size()
        tail = self.f.read_at(_TAIL_SIZE + len(MAGIC), size - _TAIL_SIZE - len(MAGIC))
        if not tail.endswith(MAGIC):
            raise ValueError(f"{uri}: no token-id file")
        blocks, docs, self.tokens, at = struct.unpack(_TAIL, tail[:_TAIL_SIZE])
        foot = self.f.read_at(size - at, at)
        self.starts = np.frombuffer(foot, "<i8", blocks + 1)
        p = 8 * (blocks + 1)
        ids, null = np.frombuffer(foot, "<i8", docs, p), np.frombuffer(foot, np.uint8, docs, p + 8 * docs)
        self.doc_ids = [None if n else i for i, n in zip(ids.tolist(), null.tolist())]
        self.doc_starts = np.frombuffer(foot[p + 9 * docs:p + 9 * docs + 8 * (docs + 1)], "<i8")

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of blocks ``first`` to ``last - 1``, read in one go."""
        if last <= first:
            return np.zeros(0, np.uint32)
        at = self.starts[first:last + 1]
        raw = self.f.read_at(int(at[-1] - at[0]), int(at[0]))
        rel = (at - at[0]).tolist()
        return decode_blocks([raw[i:j] for i, j in zip(rel, rel[1:])])

    def tokens_between(self, start: int, end: int) -> np.ndarray:
        """The ids at positions ``start`` to ``end - 1`` of the file."""
        first = start // BLOCK
        return self.blocks(first, -(-end // BLOCK))[start - first * BLOCK:end - first * BLOCK]

    def runs(self) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
        """``(doc_ids, token starts, ids of each)`` for runs of documents of about a
        megatoken (one document at least)."""
        s, i = self.doc_starts, 0
        while i < len(self.doc_ids):
            j = max(int(np.searchsorted(s, s[i] + BLOCK * _RUN * 4, side="right")) - 1, i + 1)
            j = min(j, len(self.doc_ids))
            ids = self.tokens_between(int(s[i]), int(s[j]))
            cut = (s[i:j + 1] - s[i]).tolist()
            yield self.doc_ids[i:j], s[i:j], [ids[a:b] for a, b in zip(cut, cut[1:])]
            i = j

    def close(self) -> None:
        self.f.close()


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text and write the ids in ascending id order.  Returns the manifest, kept as a
    table of the shared folder: ``(part, seq, file, n_docs, n_tokens, bytes, start)``, one row a file;
    ``start`` counts the ids of all files before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = codec(tokenizer), TaskContext.get().partitionId()
        done: list[dict] = []
        out: Writer | None = None
        for b in text_steps(batches, "text"):
            ids, at = c.encode(*text_buffers(b.column(2)))
            if end_id is not None:
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(len(at))
            if out is None:
                out = Writer(folder, f"ids-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.pfor")
            out.add(b.column(0).to_pylist(), ids, at)
            if out.tokens >= FILE_TOKENS:
                done.append(out.close())
                out = None
        if out is not None:
            done.append(out.close())
        if done:
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": i, **d} for i, d in enumerate(done)],
                                             pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()),
                                                        ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())]))

    ordered = keyed(docs, id_col, text_col).repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    manifest = materialize(ordered.mapInArrow(
        tidy(run), "part int, seq int, file string, n_docs long, n_tokens long, bytes long"), "pfor-manifest")
    # one row a file, so the running total is a small window
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32[, ids])`` of every document, read from the files; ``start`` is its
    place in the stream of all files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                r = Reader(row["file"])
                for doc_ids, starts, ids in r.runs():
                    raw = [np.ascontiguousarray(x, "<u4").tobytes() for x in ids]
                    cols = [pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"], pa.int64()),
                            pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                    if with_ids:
                        cols.append(pa.array(raw, pa.binary()))
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:len(cols)])
                r.close()

    # few rows, much work each: the number of tasks follows the bytes to be read (a stated number is not merged again)
    n_files, size = manifest.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    tasks = max(1, min(n_files, -(-(size or 0) // READ_BYTES)))
    return manifest.select("file", "start").repartitionByRange(tasks, "file").mapInArrow(tidy(run), schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, with_ids: bool = False,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files below the shared folder and read them back."""
    manifest = write_ids(docs, tokenizer, scratch_path(docs.sparkSession, "pfor-ids"), end_id, id_col, text_col)
    return read_ids(manifest, with_ids)
