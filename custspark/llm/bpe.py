"""BPE encoding by forced boundaries (operator 10).

A pair of neighbouring bytes that occurs inside no vocabulary token can
never be merged across, so a text may be cut there; the pieces are encoded
one by one and their ids concatenated.  A piece is short and comes again
and again, so a worker keeps the ids of the pieces it has met.

The tokenizer also splits texts by a pattern before it merges.  That
pattern looks ahead only behind white space (``\\s+(?!\\S)``) and treats an
apostrophe with its neighbours, so no cut is made after a white-space
character or before an apostrophe; nor inside a character.  Added tokens
(``<|endoftext|>``) are tokens too: no cut falls inside one.

Null texts count as empty; empty texts have no ids.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gather, span_hashes, text_buffers, text_column, text_steps, worker_state, tidy

#: Pieces kept by a worker (a bound on memory, not on results).
CACHE_PIECES = 800_000
#: Longer pieces are encoded anew in every step.
CACHE_PIECE_BYTES = 48


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from U+0100 on, in ascending order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _differ(data: np.ndarray, start: np.ndarray, size: np.ndarray, like: np.ndarray, like_size: np.ndarray) -> np.ndarray:
    """The spans whose bytes are not those of the span they are held against."""
    other = size != like_size
    same = np.flatnonzero(~other & (start != like))
    for at in range(0, len(same), 1 << 16):
        rows = same[at:at + (1 << 16)]
        n = size[rows]
        wrong = data[gather(start[rows], n)] != data[gather(like[rows], n)]
        if wrong.any():
            other[rows[np.searchsorted(np.cumsum(n), np.flatnonzero(wrong), side="right")]] = True
    return np.flatnonzero(other)


class Codec:
    """A byte-level BPE tokenizer file with its cut table and piece cache."""

    def __init__(self, path: str, plain_specials: bool = False):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_of_char()
        added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(alphabet[c] for c in t)
                                           for t, i in spec["model"]["vocab"].items() if i not in added}
        self.bytes_of.update(added)
        inside = np.zeros(65536, bool)
        for t in self.bytes_of.values():
            a = np.frombuffer(t, np.uint8).astype(np.int64)
            inside[a[:-1] * 256 + a[1:]] = True
        left, right = np.divmod(np.arange(65536), 256)
        white = (left <= 0x20) | (left == 0x7F)
        self.cut = ~inside & ~white & ((right < 0x80) | (right >= 0xC0)) & (right != 0x27)
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.shown = {b: c for c, b in alphabet.items()}
        tokens = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ascending byte positions of all forced boundaries, row bounds included."""
        if len(data) < 2:
            return np.unique(offsets)
        at = np.flatnonzero(self.cut[data[:-1].astype(np.int32) * 256 + data[1:]]) + 1
        # a cut after a non-ASCII white-space character is no certain cut
        odd = at[(data[at - 1] >= 0x80) & (at >= 2)]
        p1, p2 = data[odd - 1], data[odd - 2]
        p3 = np.where(odd >= 3, data[np.maximum(odd - 3, 0)], 0)
        space = (p2 == 0xC2) & ((p1 == 0x85) | (p1 == 0xA0))
        space |= (p3 == 0xE1) & (p2 == 0x9A) & (p1 == 0x80)
        space |= (p3 == 0xE2) & (p2 == 0x80) & ((p1 <= 0x8A) | (p1 == 0xA8) | (p1 == 0xA9) | (p1 == 0xAF))
        space |= (p3 == 0xE2) & (p2 == 0x81) & (p1 == 0x9F)
        space |= (p3 == 0xE3) & (p2 == 0x80) & (p1 == 0x80)
        keep = np.ones(len(at), bool)
        keep[np.searchsorted(at, odd[space])] = False
        mark = np.zeros(len(data) + 1, bool)
        mark[at[keep]] = True
        mark[offsets] = True
        return np.flatnonzero(mark)

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces that are not in the cache."""
        out: list[bytes] = [b""] * len(pieces)
        rest: list[tuple[int, str]] = []
        tokenize, shown = self.tok.model.tokenize, self.shown
        for i, p in enumerate(pieces):
            t = p.decode()
            word = t[1:] if t[:1] == " " else t
            if word.isalpha() and (word.isascii() or max(word) < "\u0250"):  # one pre-token by itself: the merges alone decide
                out[i] = array("I", [x.id for x in tokenize(p.decode("latin-1").translate(shown))]).tobytes()
            else:
                rest.append((i, t))
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            for (i, _), e in zip(part, self.tok.encode_batch_fast([t for _, t in part], add_special_tokens=False)):
                out[i] = array("I", e.ids).tobytes()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, row offsets)`` of the texts between the given byte offsets."""
        bounds = self.cuts(data, offsets)
        start, end = bounds[:-1], bounds[1:]
        _, first, inverse = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        pieces = [raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())]
        # bytes decide: a piece that only hashes like the one it is counted with is a piece of its own
        for i in _differ(data, start, end - start, start[first][inverse], (end - start)[first][inverse]).tolist():
            inverse[i] = len(pieces)
            pieces.append(raw[start[i]:end[i]])
        # two generations: what was met since the last change of generation lives on
        if len(self.cache) > CACHE_PIECES // 2:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        got = [cache.get(p) for p in pieces]
        new: list[int] = []
        for i, x in enumerate(got):
            if x is None:
                p = pieces[i]
                if p in older:
                    got[i] = cache[p] = older[p]
                else:
                    new.append(i)
        for i, x in zip(new, self._encode_pieces([pieces[i] for i in new])):
            got[i] = x
            if len(pieces[i]) <= CACHE_PIECE_BYTES:
                cache[pieces[i]] = x
        size = np.array([len(x) for x in got], np.int64) // 4
        flat = np.frombuffer(b"".join(got), "<u4")
        lengths = size[inverse]
        ids = flat[gather((np.cumsum(size) - size)[inverse], lengths)]
        upto = np.zeros(len(start) + 1, np.int64)
        np.cumsum(lengths, out=upto[1:])
        return ids, upto[np.searchsorted(bounds, offsets)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        i = ids.astype(np.int64)
        return self.flat[gather(self.at[i], self.size[i])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; broken UTF-8 as U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def codec(path: str, plain_specials: bool = False) -> Codec:
    """The worker's codec for a tokenizer file."""
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    st = worker_state()
    key = ("codec", path, plain_specials)
    if key not in st:
        st[key] = Codec(path, plain_specials)
    return st[key]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           with_text: bool = False) -> DataFrame:
    """``(doc_id, ids, n_tokens[, decoded])`` of every row, in one narrow pass: ``ids`` binary,
    little-endian unsigned 32-bit."""
    schema = "doc_id long, ids binary, n_tokens long" + (", decoded string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in text_steps(batches, "text"):
            ids, at = c.encode(*text_buffers(b.column(1)))
            rows = [ids[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
            cols = [b.column(0), pa.array([x.tobytes() for x in rows], pa.binary()), pa.array(np.diff(at))]
            if with_text:
                cols.append(pa.array([c.decode(x) for x in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "decoded"][:len(cols)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_column(docs, text_col).alias("text")).mapInArrow(tidy(run), schema)


def roundtrip_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode the ids, and digest both: ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``.
    The digests are taken where the ids are, so neither ids nor texts leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for b in text_steps(batches, "text"):
            ids, at = c.encode(*text_buffers(b.column(1)))
            rows = [ids[i:j] for i, j in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(at)),
                 pa.array([hashlib.sha256(x).hexdigest() for x in rows], pa.string()),
                 pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in rows], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
