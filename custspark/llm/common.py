"""Helpers shared by the operators: worker-side state, word scanning and
hashing over Arrow text buffers, files in the shared folder, row keys."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path  # noqa: F401  (re-exported)

#: Text bytes that one numpy step looks at; longer single texts form a step of their own.
STEP_BYTES = (1 << 20) - 1
#: Bytes of an Arrow batch that Spark sends to a task's Python (a longer row is a batch of its own).
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Longer spans are hashed byte by byte with a cryptographic hash.
LONG_SPAN = 64


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker.  Functions reach
    executors by value, so module globals would start empty in every task."""
    return sys.modules.setdefault("_custspark_llm_state", types.ModuleType("_custspark_llm_state")).__dict__


def tidy(run: Callable) -> Callable:
    """``run``, a function for ``mapInArrow``, with bounds on what a reused Python worker holds: what another operator
    left in :func:`worker_state` goes before the first batch, and freed memory returns to the system after the last.
    Arrow batches are bounded by their bytes in this session, unless it has a bound of its own."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    owner = run.__module__

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = worker_state()
        if st.get("owner") != owner:
            st.clear()
            st["owner"] = owner
            _release()
        yield from run(batches)
        _release()

    return tidied


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(tidy(run), schema)


# --- batches of text -------------------------------------------------------

def text_steps(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most ``max_bytes`` of text
    (one row at least), so that working arrays stay small."""
    for b in batches:
        if not b.num_rows:
            continue
        off = text_buffers(b.column(b.schema.get_field_index(text)))[1]
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(off, off[start] + max_bytes, side="right")) - 1
            end = min(max(end, start + 1), b.num_rows)
            yield b.slice(start, end - start)
            start = end


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a text column; a null is an empty text."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, col.offset + len(col) + 1)[col.offset:]
    base, top = int(offsets[0]), int(offsets[-1])
    if data is None or top == base:
        return np.zeros(0, np.uint8), offsets - base
    return np.frombuffer(data, np.uint8, top)[base:], offsets - base


# --- words -----------------------------------------------------------------

def space_class() -> np.ndarray:
    """Byte table of the words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_class() -> np.ndarray:
    """Byte table of the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (after lower-casing)."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x80:] = True
    return t


def lower_ascii(data: np.ndarray) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t[data]


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C55
_WORD_BASE = 0xD6E8FEB86659FD95


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    st = worker_state()
    have = st.get(("powers", base))
    if have is None or len(have[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = tuple(out)
        if size <= 1 << 21:  # larger tables serve one long text
            st[("powers", base)] = have
    return have[0][:n], have[1][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of every span.  Short spans take a polynomial, which texts of some hundred bytes
    can be built to defeat, so longer ones take a cryptographic hash."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(_BASE, len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:], dtype=np.uint64)
    out = _mix((sums[end] - sums[start]) * down[start])
    for i in np.flatnonzero(end - start > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``start .. start + length``."""
    out = np.cumsum(length) - length
    return np.repeat(start - out, length) + np.arange(int(length.sum()))


class Words:
    """Words of a run of texts: ``doc`` (row), ``start`` and ``end`` (bytes),
    ``first`` (first word of each row, one more entry at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        mask = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = mask[:-1], mask[1:]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        before[cuts], after[cuts - 1] = False, False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` hashes that begin at each position (``len - k + 1``)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers(_WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:], dtype=np.uint64)
    return _mix((sums[k:] - sums[:-k]) * down[:n - k + 1] + np.uint64(k))


def spans(hashes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hash of the ``n`` hashes that begin at ``first``, for each pair."""
    up, down = _powers(_WORD_BASE, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:], dtype=np.uint64)
    return _mix((sums[first + n] - sums[first]) * down[first] + n.astype(np.uint64))


def whole_rows(words: Words, k: int) -> np.ndarray:
    """Mask over the windows of length ``k``: those within one row."""
    n = len(words.start) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    return words.doc[:n] == words.doc[k - 1:]


# --- files of the shared folder ----------------------------------------------

#: Hadoop's names of stores that Arrow knows by others.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """``(pyarrow file system, path)`` of a Spark path (``file:/x``, ``/x``, ``hdfs://...``)."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("dbfs:"):  # mounted on every machine
        return fs.LocalFileSystem(), "/dbfs/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def create_file(folder: str, name: str):
    """``(uri, output stream)`` of a new file below a shared folder."""
    system, path = filesystem(folder)
    system.create_dir(path, recursive=True)
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def open_file(uri: str):
    system, path = filesystem(uri)
    return system.open_input_file(path)


# --- frames --------------------------------------------------------------------

def text_column(df: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def unused_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to be no column of ``df``."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def keyed(df: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """``(doc_id, key, text, *more)``: a row is known by its id and a hash of its
    text, so ids that are null or stand in several rows do no harm."""
    text = text_column(df, text_col)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"), *more)


def parallelism(spark: SparkSession) -> int:
    """Width of shuffles whose number of partitions must be stated."""
    try:
        return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    except (TypeError, ValueError):
        return max(spark.sparkContext.defaultParallelism, 1)


def to_int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
