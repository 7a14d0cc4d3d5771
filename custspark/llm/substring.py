"""Substring deduplication with a count-min prefilter (operator 4).

A window is ``WINDOW`` consecutive words of one text; every word covered by
a window whose word sequence also starts anywhere else is removed.

Prefilter.  A window is represented by its anchor, the ``GRAM``-word gram of
least hash in it: equal windows have equal anchors at equal places, and
neighbouring windows mostly share theirs, so there are about a twelfth as
many anchors as words.  Each task counts its anchors into the cells of a
sketch (sparse, as most cells of a task are empty; the width grows with the
input); the sketches are merged by adding.  A cell's count is at least the
count of any window whose anchor falls in it, so windows in cells counted
once occur once: none is lost.

Second pass.  Windows in cells counted twice or more are grouped exactly, a
run of windows with one anchor at a time: the run's whole stretch of words
(128 bits, with the anchor) is counted first, with partial counts before
the shuffle.  A stretch that repeats has nothing but repeated windows.  An
anchor with several different stretches gives one text of each back to be
hashed window by window, which finds the windows that only part of two
stretches share.

Null and empty texts have no words.  A text equal to another repeats all
its windows; texts shorter than a window have none and stay whole.  A row is
known by its id and a 64-bit hash of its text, so ids may be null or repeat:
rows that agree in both have the same windows.  A very long text is a step of
its own.  Further columns take no part, whatever their names, and ``replace``
hands them on; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (tidy, Words, _mix, gather, keyed, materialize, space_class, spans, text_buffers, text_column,
                     text_steps, to_int64, unused_names, whole_rows, windows)

WINDOW = 35
GRAM = 12
#: Sketch cells for each expected anchor (only cells in use take space, so a wide sketch costs nothing).
CELLS = 1 << 10
_PLACE_BITS = 28


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive entries."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(words: Words, h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor, first window, windows)``: runs of windows that have one anchor, windows by their first word."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
    grams = windows(h, gram)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    at = (_sliding_min((grams & ~low) | place, window - gram + 1) & low).astype(np.int64)
    full = whole_rows(words, window)
    own = np.flatnonzero(full)
    at = at[own]
    new = np.ones(len(own), bool)
    new[1:] = (at[1:] != at[:-1]) | (words.doc[own[1:]] != words.doc[own[:-1]])
    start = np.flatnonzero(new)
    return grams[at[start]], own[start], np.diff(np.append(start, len(own)))


def _cell(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(anchor) >> np.uint64(64 - bits)).view(np.int64)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, text)``: the hash of the text tells rows of one id, or of none, apart."""
    return keyed(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(0)).alias("id"), "key", "text")


def sketch(rows: DataFrame, bits: int, window: int, gram: int) -> DataFrame:
    """``(cell)``: cells that count two anchors or more, over the merged sketches of all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text", 16 << 20):
            cells, counts = [], []
            for s in text_steps(iter([b]), "text"):
                words = Words(*text_buffers(s.column(0)), space_class())
                c, n = np.unique(_cell(anchors(words, words.hashes(), window, gram)[0], bits), return_counts=True)
                cells.append(c)
                counts.append(n)
            cell, inverse = np.unique(np.concatenate(cells), return_inverse=True)
            count = np.bincount(inverse, np.concatenate(counts), len(cell)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.minimum(count, 2).astype(np.int8))], ["cell", "n"])

    return (rows.select("text").mapInArrow(tidy(run), "cell long, n byte").groupBy("cell").agg(F.sum("n").alias("n"))
            .where(F.col("n") > 1).select("cell"))


_N = 1 << 8  # a place packs the first word of a run and its windows


def _runs(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """``(anchor, stretch, id, key, place)`` of every run of windows that have one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            words = Words(*text_buffers(b.column(2)), space_class())
            h = words.hashes()
            anchor, first, n = anchors(words, h, window, gram)
            doc = words.doc[first] if len(first) else first
            row = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [to_int64(_mix(anchor)), to_int64(spans(h, first, n + window - 1)), b.column(0).take(row), b.column(1).take(row),
                 pa.array((first - words.first[doc]) * _N + n)], ["anchor", "stretch", "id", "key", "place"])

    return rows.mapInArrow(tidy(run), "anchor long, stretch long, id long, key long, place long")


def _window_hashes(texts: DataFrame, window: int) -> DataFrame:
    """``(anchor, h, id, key, place, single)`` of all windows of the given runs; ``place`` as of a run with one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            words = Words(*text_buffers(b.column(2)), space_class())
            h = words.hashes()
            if len(h) < window:
                continue
            off = b.column(3).offsets.to_numpy().astype(np.int64)
            flat = b.column(3).flatten()
            doc = np.repeat(np.arange(b.num_rows), np.diff(off))
            place = flat.field(1).to_numpy().astype(np.int64)
            n, first = place % _N, place // _N
            at = gather(first, n)
            of = np.repeat(np.arange(len(n)), n)
            value = windows(_mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), window)[at + words.first[doc][of]]
            row = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [flat.field(0).take(row), to_int64(value), b.column(0).take(pa.array(doc[of])), b.column(1).take(pa.array(doc[of])),
                 pa.array(at * _N + 1), flat.field(2).take(row)], ["anchor", "h", "id", "key", "place", "single"])

    return texts.mapInArrow(tidy(run), "anchor long, h long, id long, key long, place long, single boolean")


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``(id, key, runs)``: the runs ``(first, n)`` of repeated windows of each row that has some."""
    if window - gram + 1 >= _N:
        raise ValueError(f"a window may hold {_N - 1} grams at most")
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about one anchor for every 12 words, or 60 bytes
    bits = min(60, max(16, (total // 60 * CELLS).bit_length()))
    cells = materialize(sketch(rows, bits, window, gram), "repeated-cells")
    runs = materialize(_runs(rows, window, gram).join(
        cells, F.shiftrightunsigned("anchor", 64 - bits) == F.col("cell"), "left_semi"), "candidate-runs")
    stretches = materialize(runs.groupBy("anchor", "stretch").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "key", "place")).alias("one")),
                            "stretches")
    mixed = stretches.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > 1).select("anchor")
    # one run of each stretch of those anchors, hashed window by window
    wanted = (stretches.join(mixed, "anchor", "left_semi")
              .select("anchor", "one.id", "one.key", "one.place", (F.col("c") == 1).alias("single"))
              .groupBy("id", "key").agg(F.collect_list(F.struct("anchor", "place", "single")).alias("runs")))
    hashed = materialize(_window_hashes(rows.join(wanted, ["id", "key"]), window), "candidate-windows")
    shared = hashed.groupBy("anchor", "h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).select("anchor", "h")
    shared = materialize(shared, "shared-windows")
    edges = hashed.where("single").join(shared, ["anchor", "h"], "left_semi").select("id", "key", "place")
    whole = runs.join(stretches.where(F.col("c") > 1).select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").select("id", "key", "place")
    return (whole.union(edges).groupBy("id", "key")
            .agg(F.collect_list(F.struct(F.expr(f"place div {_N}").alias("first"), (F.col("place") % _N).alias("n"))).alias("runs")))


def _kept(words: Words, runs: pa.Array, window: int) -> np.ndarray:
    """Mask of the words that no repeated window covers."""
    off = runs.offsets.to_numpy().astype(np.int64)
    flat = runs.flatten()
    first = np.repeat(words.first[:-1], np.diff(off)) + flat.field(0).to_numpy()
    size = len(words.start) + 1
    edge = np.bincount(first, minlength=size)[:size] - np.bincount(first + flat.field(1).to_numpy() + window - 1, minlength=size)[:size]
    return np.cumsum(edge)[:len(words.start)] == 0


def deduplicate(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                replace: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` of every row; ``kept`` is the kept words joined by one space.  With
    ``replace`` the rows of ``docs`` as they are, but for the texts that lost words, which become ``kept``."""
    found = repeated_windows(docs, window, gram, id_col, text_col)
    own, key, whole_text, marks, own_found, key_found = unused_names(docs, "__id", "__key", "__text", "__runs", "__fid", "__fkey")
    text = text_column(docs, text_col)
    joined = docs.withColumns({own: F.coalesce(F.col(id_col).cast("long"), F.lit(0)), key: F.xxhash64(text), whole_text: text}).join(
        found.toDF(own_found, key_found, marks), (F.col(own) == F.col(own_found)) & (F.col(key) == F.col(key_found)), "left")
    joined = joined.withColumn(marks, F.coalesce(marks, F.array().cast("array<struct<first:long,n:long>>")))
    if replace:
        names, schema = docs.columns, docs.schema
        given = joined.select(*docs.columns, whole_text, marks)
    else:
        names, schema = [], "doc_id long, n_words long, n_removed long, kept string"
        given = joined.select(F.col(id_col).cast("long").alias("doc_id"), whole_text, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, whole_text):
            col = b.column(b.schema.get_field_index(whole_text))
            words = Words(*text_buffers(col), space_class())
            stays = _kept(words, b.column(b.schema.get_field_index(marks)), window)
            sums = np.concatenate([[0], np.cumsum(~stays)])
            removed = sums[words.first[1:]] - sums[words.first[:-1]]
            raw = words.data.tobytes()
            kept: list[str | None] = []
            first = words.first.tolist()
            for d in range(b.num_rows):
                if replace and not removed[d]:
                    kept.append(None)
                    continue
                at = np.flatnonzero(stays[first[d]:first[d + 1]]) + first[d]
                kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist())]).decode())
            if replace:
                cols = [b.column(b.schema.get_field_index(c)) for c in names]
                i = names.index(text_col)
                whole = cols[i].to_pylist()
                cols[i] = pa.array([w if k is None else k for w, k in zip(whole, kept)], cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, names)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)),
                                                  pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return given.mapInArrow(tidy(run), schema)
