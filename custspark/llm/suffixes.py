"""Benchmark decontamination by training suffix arrays (operator 8).

Every task builds suffix arrays over the words of its shard of the training
texts and looks up every suffix of the test items in them by binary search,
one word deeper at a time.  A suffix that survives ``WINDOW`` words (or all
words of a shorter item) occurs verbatim; the array's interval gives all
its places.  Equal windows have one interval, which is worked on once, with the set of items that hold it,
so neither a repeated window nor a prompt that many items share makes (suffix, place) pairs.  The full lengths of the matches
come from one order of the items' suffixes and the hit stretches together.
The arrays live in their task: a shard is a few megabytes of text, and only suffixes that begin with words of the items are sorted, as deep as a window.

A suffix that begins with too few words of the test vocabulary cannot match
and is left out of the array; that does not change what is found.

The test items are a table in the shared folder that tasks read in blocks,
so neither side has to fit anywhere whole.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII
characters.  Texts or items that are null or hold no word have no windows.
Repeated items with one id count once; a null item id counts as the id
``null``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_class, filesystem, gather, lower_ascii, scratch_path, text_buffers, text_column, text_steps, tidy

WINDOW = 10
#: Text bytes of the items of one block.
BLOCK_BYTES = 4 << 20
#: Text bytes of one suffix array.
SHARD_BYTES = (2 << 20) - 1


class Tests:
    """One block of test items: distinct texts, their word ids and windows."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        texts: dict[str, list[str]] = {}
        for item, text in rows:
            texts.setdefault(text, []).append(item)
        data, offsets = text_buffers(pa.array(list(texts), pa.large_string()))
        words = Words(lower_ascii(data), offsets, alnum_class())
        self.vocabulary, self.ids = np.unique(words.hashes(), return_inverse=True)
        self.names = list(texts.values())
        self.item = words.doc
        # a suffix is asked for if a window starts there; depth: words it must match
        left = words.first[1:][words.doc] - np.arange(len(words.doc))
        self.left = left
        self.depth = np.minimum(words.count[words.doc], window)
        self.asked = np.flatnonzero(left >= self.depth)
        self.shortest = int(self.depth.min()) if len(self.depth) else window


def read_tests(folder: str, window: int) -> Iterator[Tests]:
    """The item table in blocks."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    system, path = filesystem(folder)
    rows: list[tuple[str, str]] = []
    held = 0
    for info in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda i: i.path):
        if not info.path.endswith(".parquet"):
            continue
        with system.open_input_file(info.path) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1024, columns=["item_id", "text"]):
                for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    rows.append((item, text))
                    held += len(text)
                    if held >= BLOCK_BYTES:
                        yield Tests(rows, window)
                        rows, held = [], 0
    if rows:
        yield Tests(rows, window)


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: np.ndarray, right: bool) -> np.ndarray:
    """First place in ``[lo, hi)`` of a sorted stretch with an entry >= (> if right) the value, for all at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        x = column[np.where(open_, mid, 0)]
        low = (x <= value) if right else (x < value)
        lo = np.where(open_ & low, mid + 1, lo)
        hi = np.where(open_ & ~low, mid, hi)


class SuffixArray:
    """Suffixes of a shard's words, sorted on their first ``depth`` words."""

    def __init__(self, words: Words, ids: np.ndarray, depth: int, shortest: int):
        """``ids``: number of each word in the test vocabulary, -1 for others."""
        n = len(ids)
        # words ahead that are in the vocabulary and in the same text
        stop = np.flatnonzero(np.concatenate([(ids < 0) | (np.arange(n) + 1 == words.first[1:][words.doc]), [True]]))
        nxt = stop[np.searchsorted(stop, np.arange(n))] if n else np.zeros(0, np.int64)
        run = np.where(ids < 0, 0, nxt - np.arange(n) + (np.append(ids, -1)[np.minimum(nxt, n)] >= 0))
        at = np.flatnonzero(run >= shortest)
        cols = [np.where(run[at] > j, ids[np.minimum(at + j, n - 1)], -1) for j in range(depth)] if n else [at] * depth
        order = np.lexsort(cols[::-1]) if len(at) else np.zeros(0, np.int64)
        self.at = at[order]
        self.columns = [c[order] for c in cols]

    def find(self, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(asked suffix, first, last)``: the interval of the array that matches each to its depth."""
        t = tests.asked
        lo, hi = np.zeros(len(t), np.int64), np.full(len(t), len(self.at))
        for j, column in enumerate(self.columns):
            go = np.flatnonzero((tests.depth[t] > j) & (lo < hi))
            if not len(go):
                continue
            value = tests.ids[t[go] + j]
            a, b = lo[go], hi[go]
            lo[go], hi[go] = _narrow(column, a, b, value, False), _narrow(column, a, b, value, True)
        some = lo < hi
        return t[some], lo[some], hi[some]


def _intervals(words: Words, ids: np.ndarray, tests: Tests, window: int):
    """Occurring windows, each once: ``(places, at, width, window of each suffix, asked suffix)``.  Equal windows of items have one
    interval of the array; ``places[at[i]:at[i] + width[i]]`` are the word positions of window ``i``."""
    array = SuffixArray(words, ids, window, tests.shortest)
    t, lo, hi = array.find(tests)
    _, first, of = np.unique(lo * (window + 1) + tests.depth[t], return_index=True, return_inverse=True)
    return array.at, lo[first], (hi - lo)[first], tests.depth[t][first], of, t


def _item_sets(tests: Tests, of: np.ndarray, t: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``(sets, set of each window)``: the different sets of items that hold a window."""
    order = np.lexsort((tests.item[t], of))
    window, item = of[order], tests.item[t][order]
    new = np.ones(len(window), bool)
    new[1:] = (window[1:] != window[:-1]) | (item[1:] != item[:-1])
    window, item = window[new], item[new]
    cuts = np.flatnonzero(np.diff(window)) + 1
    known: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    number = []
    for items in np.split(item, cuts):
        k = items.tobytes()
        if k not in known:
            known[k] = len(sets)
            sets.append(items)
        number.append(known[k])
    return sets, np.array(number, np.int64)


class Joint:
    """Suffixes of the test items and of the hit stretches of a shard in one order, by prefix doubling; common prefixes from its ranks."""

    def __init__(self, ids: np.ndarray, left: np.ndarray):
        """``left``: words from each place to the end of its sequence."""
        n = len(ids)
        at = np.arange(n)
        self.left = left
        self.ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
        span = 1
        while span < (left.max() if n else 0):
            low = self.ranks[-1]
            nxt = np.where(left > span, low[np.minimum(at + span, n - 1)] + 1, 0)
            self.ranks.append(np.unique(low * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64))
            span *= 2
        self.order = np.argsort(self.ranks[-1], kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = at

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common at their beginning."""
        most = np.minimum(self.left[a], self.left[b])
        done = np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            go = np.flatnonzero(done < most)
            same = self.ranks[k][a[go] + done[go]] == self.ranks[k][b[go] + done[go]]
            done[go[same]] += 1 << k
            np.minimum(done, most, out=done)
        return done


def _longest(words: Words, ids: np.ndarray, tests: Tests, window: int, places, at, width, depth, of, t) -> Iterator[tuple[int, int, int, str]]:
    """``(row, words, place, item)``: the longest match of each hit row, the first of equally long ones, and the least item that holds it."""
    # what each hit place matches at least: the deepest window there
    spread = np.repeat(np.arange(len(at)), width)
    p = places[gather(at, width)]
    order = np.lexsort((depth[spread], p))
    last = np.ones(len(p), bool)
    last[:-1] = p[order][1:] != p[order][:-1]
    p, held = p[order][last], spread[order][last]
    length = depth[held].astype(np.int64)
    full = np.flatnonzero(length == window)  # shorter matches are whole items and go no further
    if len(full):
        # the stretches of test words that hold full matches, and the items, in one sequence
        stop = np.append(ids < 0, True)  # a sequence ends before an unknown word, or with its row
        stop[words.first[1:]] = True
        ends = np.flatnonzero(stop)
        to = ends[np.searchsorted(ends, p[full], side="right")]
        begin, where = np.unique(to, return_inverse=True)
        least = np.full(len(begin), len(ids), np.int64)
        np.minimum.at(least, where, p[full])
        size = begin - least
        base = len(tests.ids) + np.cumsum(size) - size
        joint = Joint(np.concatenate([tests.ids, ids[gather(least, size)]]),
                      np.concatenate([tests.left, np.repeat(begin, size) - gather(least, size)]))
        mine = base[where] + p[full] - least[where]
        # the nearest test suffixes before and behind in the order
        test = joint.order < len(tests.ids)
        before = np.maximum.accumulate(np.where(test, np.arange(len(test)), -1))
        behind = np.minimum.accumulate(np.where(test, np.arange(len(test)), len(test))[::-1])[::-1]
        for near in (before[joint.place[mine]], behind[joint.place[mine]]):
            ok = np.flatnonzero((near >= 0) & (near < len(test)))
            length[full[ok]] = np.maximum(length[full[ok]], joint.common(mine[ok], joint.order[near[ok]]))
        tests_in_order = np.flatnonzero(test)
    row = words.doc[p]
    order = np.lexsort((p, -length, row))
    first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])] if len(order) else order
    in_full = np.full(len(p), -1, np.int64)
    in_full[full] = np.arange(len(full))
    for i in first.tolist():
        if in_full[i] >= 0:
            # all test suffixes with the match in common stand next to each other
            x = int(mine[in_full[i]])
            k = int(np.searchsorted(tests_in_order, joint.place[x]))
            items: set[int] = set()
            for side in (tests_in_order[k:], tests_in_order[:k][::-1]):
                for s in range(0, len(side), 256):
                    suffix = joint.order[side[s:s + 256]]
                    same = joint.common(np.full(len(suffix), x), suffix) >= length[i]
                    stop_at = len(same) if same.all() else int(np.argmin(same))
                    items.update(tests.item[suffix[:stop_at]].tolist())
                    if stop_at < len(same):
                        break
        else:
            items = set(tests.item[t[of == held[i]]].tolist())
        yield int(row[i]), int(length[i]), int(p[i]), min(min(tests.names[j]) for j in items)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, items, spans, longest, longest_at, longest_item)``, one row for every row of
    ``docs``: words inside occurrences of windows, ids of the items with occurring windows (sorted as strings),
    the hit passages as word ranges, and the longest verbatim match with its place and item."""
    folder = _item_table(items, item_col, item_text_col)
    schema = ("doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, "
              "longest long, longest_at long, longest_item string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder, window)
        for b in text_steps(batches, "text", SHARD_BYTES):
            words, hit, n_hit, named, best = examine(b.column(1), blocks)
            spans: list[list[dict]] = [[] for _ in range(b.num_rows)]
            for d in np.flatnonzero(n_hit).tolist():
                own = hit[words.first[d]:words.first[d + 1]]
                step = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                spans[d] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(step == 1).tolist(),
                                                                  np.flatnonzero(step == -1).tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(words.count.astype(np.int64)), pa.array(n_hit.astype(np.int64)),
                 pa.array([sorted(s) for s in named], pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                 pa.array([x[0] for x in best], pa.int64()), pa.array([-x[1] for x in best], pa.int64()),
                 pa.array([x[2] for x in best], pa.string())],
                ["doc_id", "n_words", "n_hit", "items", "spans", "longest", "longest_at", "longest_item"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       text_column(docs, text_col).alias("text")).mapInArrow(tidy(run), schema)


def _item_table(items: DataFrame, item_col: str, item_text_col: str) -> str:
    """The items written to the shared folder, ids as strings."""
    folder = scratch_path(items.sparkSession, "test-items")
    (items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"),
                  text_column(items, item_text_col).alias("text")).write.parquet(folder))
    return folder


class _Blocks:
    """The test blocks of a task: a single one, the usual case, is kept; more are read again for each shard."""

    def __init__(self, folder: str, window: int):
        self.folder, self.window = folder, window
        self.kept: list[Tests] | None = None

    def __iter__(self) -> Iterator[Tests]:
        if self.kept is None:
            self.kept = []
            for block in read_tests(self.folder, self.window):
                self.kept.append(block)
                if len(self.kept) > 1:
                    break
        return iter(self.kept) if len(self.kept) < 2 else read_tests(self.folder, self.window)


def examine(texts: pa.Array, blocks: _Blocks):
    """``(words, hit mask of the words, hits of each row, item ids of each row, longest match of each row)``."""
    data, offsets = text_buffers(texts)
    words = Words(lower_ascii(data), offsets, alnum_class())
    hashes = words.hashes()
    edge = np.zeros(len(hashes) + 1, np.int64)
    named: list[set[str]] = [set() for _ in range(len(texts))]
    best: list[tuple[int, int, str | None]] = [(0, 0, None)] * len(texts)
    for tests in blocks:
        if not len(tests.asked) or not len(hashes):
            continue
        ids = np.searchsorted(tests.vocabulary, hashes)
        ids = np.where(tests.vocabulary[np.minimum(ids, len(tests.vocabulary) - 1)] == hashes, ids, -1)
        found = _intervals(words, ids, tests, blocks.window)
        places, at, width, depth, of, t = found
        if not len(at):
            continue
        p, held = places[gather(at, width)], np.repeat(np.arange(len(at)), width)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + depth[held], -1)
        sets, number = _item_sets(tests, of, t)
        both = np.unique(words.doc[p] * np.int64(len(sets)) + number[held])
        for doc, k in zip((both // len(sets)).tolist(), (both % len(sets)).tolist()):
            for item in sets[k].tolist():
                named[doc].update(tests.names[item])
        for doc, n, pp, item in _longest(words, ids, tests, blocks.window, *found):
            match = (n, int(words.first[doc]) - pp, item)
            if match[:2] > best[doc][:2] or (match[:2] == best[doc][:2] and match[2] < best[doc][2]):
                best[doc] = match
    hit = np.cumsum(edge[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(hit)])
    return words, hit, sums[words.first[1:]] - sums[words.first[:-1]], named, best


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, columns as they are, in one narrow pass."""
    folder = _item_table(items, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(folder, window)
        for b in text_steps(batches, text_col, SHARD_BYTES):
            n_hit = examine(b.column(b.schema.get_field_index(text_col)), blocks)[2]
            yield b.filter(pa.array(n_hit == 0))

    return docs.mapInArrow(tidy(run), docs.schema)
