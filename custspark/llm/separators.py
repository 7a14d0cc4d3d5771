"""Token counts by separator scan (operator 6).

A flat token file is nothing but ids, 16 bits each here, with an
end-of-document id behind every document and no index.  The files are cut
into byte blocks that tasks search independently with one vectorised
comparison; a block does not know where the document that runs into it
began.  That is stitched afterwards by a prefix scan over the block
summaries of each file: separators seen before the block, and the place of
the last one.

A tail without a separator counts as a last, unterminated document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import create_file, materialize, open_file, scratch_path, text_buffers, text_column, text_steps, tidy

#: Bytes of a file that one scan step reads.
BLOCK_BYTES = 4 << 20
#: Blocks that a task reads.
BLOCKS_A_TASK = 4
#: Tokens after which a task begins its next file.
FILE_TOKENS = 1 << 28
_ID = np.dtype("<u2")


def write_flat(docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Write ids and separators to flat files, no row leaving its task.  Returns ``(doc_id, file,
    doc_no)``: which document of which file each row became.  Special-token strings within a text are
    ordinary text, so ``end_id`` marks ends only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, True)
        if max(len(c.size) - 1, end_id) > np.iinfo(_ID).max:
            raise ValueError(f"the vocabulary does not fit the ids of the files ({_ID.itemsize * 8} bits)")
        out, uri, tokens, docs_in = None, "", 0, 0
        for b in text_steps(batches, "text"):
            ids, at = c.encode(*text_buffers(b.column(1)))
            ids = np.insert(ids, at[1:], end_id)
            if out is None:
                uri, out = create_file(folder, f"flat-{uuid.uuid4().hex}.u16")
                tokens = docs_in = 0
            out.write(ids.astype(_ID).tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([uri] * b.num_rows), pa.array(np.arange(docs_in, docs_in + b.num_rows))],
                ["doc_id", "file", "doc_no"])
            tokens += len(ids)
            docs_in += b.num_rows
            if tokens >= FILE_TOKENS:
                out.close()
                out = None
        if out is not None:
            out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    return materialize(rows.mapInArrow(tidy(run), "doc_id long, file string, doc_no long"), "flat-rows")


def scan(files: DataFrame, end_id: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, doc_no, start, n_tokens, terminated)`` of every document of the given files (column ``file``)."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.column(0).to_pylist()
            tokens = []
            for n in names:
                with open_file(n) as f:
                    tokens.append(f.size() // _ID.itemsize)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tokens, pa.int64())], ["file", "tokens"])

    per_block = block_bytes // _ID.itemsize
    blocks = (files.select("file").distinct().mapInArrow(tidy(sizes), "file string, tokens long")
              .select("file", "tokens", F.explode(F.sequence(
                  F.lit(0), F.greatest(F.expr(f"(tokens + {per_block} - 1) div {per_block}") - 1, F.lit(0)))).alias("block")))
    # few rows, much work each: the number of tasks is stated, so that they are not merged again
    blocks = materialize(blocks, "flat-blocks")
    blocks = blocks.repartitionByRange(max(1, -(-blocks.count() // BLOCKS_A_TASK)), "file", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                first = row["block"] * per_block
                with open_file(row["file"]) as f:
                    raw = f.read_at(min(per_block, row["tokens"] - first) * _ID.itemsize, first * _ID.itemsize)
                seps = np.flatnonzero(np.frombuffer(raw, _ID) == end_id) + first
                yield pa.RecordBatch.from_pylist(
                    [{"file": row["file"], "tokens": row["tokens"], "block": row["block"], "seps": seps.tolist()}],
                    pa.schema([("file", pa.string()), ("tokens", pa.int64()), ("block", pa.int64()),
                               ("seps", pa.list_(pa.int64()))]))

    found = materialize(blocks.mapInArrow(tidy(search), "file string, tokens long, block long, seps array<long>"), "separators")
    # the summaries: one short row a block, scanned within each file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (found.select("file", "block", "tokens", F.size("seps").alias("n"),
                             F.when(F.size("seps") > 0, F.element_at("seps", -1)).alias("last"))
                .select("file", "block", "tokens", "n",
                        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seen"),
                        F.coalesce(F.last("last", ignorenulls=True).over(earlier), F.lit(-1)).alias("open"), "last",
                        (F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()).alias("final")))
    stitched = materialize(stitched, "separator-carry")
    ends = (found.select("file", "block", "seps").join(stitched.select("file", "block", "seen", "open"), ["file", "block"])
            .select("file", "seen", F.explode(F.arrays_zip(
                F.col("seps").alias("e"), F.concat(F.array("open"), "seps").alias("b"),
                F.sequence(F.lit(0), F.size("seps")).alias("i"))).alias("s"))
            .where(F.col("s.e").isNotNull())
            .select("file", (F.col("seen") + F.col("s.i")).alias("doc_no"), (F.col("s.b") + 1).alias("start"),
                    (F.col("s.e") - F.col("s.b") - 1).alias("n_tokens"), F.lit(True).alias("terminated")))
    last = F.coalesce("last", "open")
    tails = (stitched.where(F.col("final") & (last + 1 < F.col("tokens")))
             .select("file", (F.col("seen") + F.col("n")).alias("doc_no"), (last + 1).alias("start"),
                     (F.col("tokens") - last - 1).alias("n_tokens"), F.lit(False).alias("terminated")))
    return ends.unionByName(tails)


def token_counts(docs: DataFrame, tokenizer: str, end_id: int, block_bytes: int = BLOCK_BYTES,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, file, doc_no, start, n_tokens)`` of every row: files are written, scanned, and the counts
    matched to the rows by file and ordinal.  Null and empty texts have 0 tokens."""
    folder = scratch_path(docs.sparkSession, "flat-ids")
    rows = write_flat(docs, tokenizer, folder, end_id, id_col, text_col)
    counts = scan(rows, end_id, block_bytes)
    return (rows.join(counts, ["file", "doc_no"])
            .select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "doc_no", "start", "n_tokens"))
