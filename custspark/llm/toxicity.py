"""Toxic passages by maximum-scoring segments (operator 2).

Fit.  Word counts of the whole corpus are the informative Dirichlet prior
of two word distributions, learned from toxic and from other labelled
rows, where a word counts once for each pair of neighbours it is seen
between (copies of a text would else pose as independent evidence).  The
prior weighs ``PRIOR`` times what the labelled rows do.  A word's score is its log-odds between the two; words whose log-odds
are within ``MIN_Z`` standard errors of zero or below ``MIN_ODDS``, and
unseen words, score nothing.  Every word pays ``DRIFT``, so that the expected score of clean
text is negative.

Scan.  One pass over a text finds all maximal scoring segments (each the
best it can be, none overlapping): linear in the words.

Calibration.  Best segments of clean text follow an extreme-value law
``P(S >= x) = 1 - exp(-K n exp(-lambda x))``: lambda solves
``sum p exp(lambda s) = 1`` over the clean word distribution, K is fitted to
clean rows.  The significant segments of a text are aggregated to the
smallest p-value of their sums, and a logistic curve turns ``-log p`` into a
probability.  Both are fitted on rows scored by a model learned without
them (two folds).

At most ``MAX_ROWS`` labelled rows (a hash sample) are learned from; their
words bound the model's size, and every word that counts is kept.  Corpus
counts, scan and scores cover every row.  Null and empty texts have no
words and get the probability of no evidence; null labels are not used; a
row labelled both ways counts as toxic; without both classes every score is
the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, alnum_class, lower_ascii, materialize, text_buffers, text_column, text_steps, to_int64, tidy

MAX_ROWS = 20_000
PRIOR = 0.1
MIN_Z = 3.0
#: Smallest log-odds that say something: with many rows even tiny differences pass the test above.
MIN_ODDS = 2.0
DRIFT = 0.05
#: Passages reported have an E-value of at most this.
MAX_E = 0.05
THRESHOLD = 0.7
_FOLDS = ("a", "b")
_HELD_ROWS = 1 << 20  # distinct words a task gathers before it hands them on


@dataclass
class Scores:
    """Sorted word hashes with their scores, and the law of clean maxima."""
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    k: float = 1e-3

    def of(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), -DRIFT)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.scores[at], 0.0) - DRIFT


@dataclass
class Model:
    scores: Scores
    intercept: float
    slope: float
    share: float | None = None  # the only answer if there is nothing to learn from

    def probability(self, evidence: float) -> float:
        if self.share is not None:
            return self.share
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, self.intercept + self.slope * evidence))))


# --- the scan ------------------------------------------------------------------

def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` in order of place (Ruzzo and Tompa)."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.cumsum(scores)
    before, after = (total[up] - scores[up]).tolist(), total[up].tolist()
    kept: list[tuple[float, float, int, int]] = []  # cumulative score left and right, words
    for at, left, right in zip(up.tolist(), before, after):
        new = (left, right, at, at + 1)
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0]:
                j -= 1
            if j < 0 or kept[j][1] >= new[1]:
                kept.append(new)
                break
            new = (kept[j][0], new[1], kept[j][2], new[3])
            del kept[j:]
    return [(s, e, r - l) for l, r, s, e in kept]


def evidence(segments: list[tuple[int, int, float]], n: int, law: Scores) -> float:
    """``-log`` of the smallest p-value of the sum of the r best segments, r = 1, 2, ..."""
    if not segments or not n:
        return 0.0
    shift = math.log(max(law.k * n, 1e-12))
    excess = sorted((law.lam * s - shift for _, _, s in segments), reverse=True)
    best = total = 0.0
    for r, x in enumerate(excess, 1):
        if x <= 0:
            break
        total += x
        if r == 1:
            p = -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total
        else:
            p = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) if total > r else 0.0
        best = max(best, p)
    return best


def _scan(col: pa.Array, law: Scores):
    """``(words, [segments])`` of a run of texts."""
    data, offsets = text_buffers(col)
    words = Words(lower_ascii(data), offsets, alnum_class())
    scores = law.of(words.hashes())
    hot = np.zeros(len(words.count), bool)
    hot[words.doc[scores > 0]] = True
    first = words.first.tolist()
    return words, [maximal_segments(scores[first[d]:first[d + 1]]) if h else [] for d, h in enumerate(hot.tolist())]


# --- the fit -------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_rows(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """``(doc_id, toxic, fold)`` of at most about ``max_rows`` labelled rows that are not held out."""
    rows = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
            .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    rows = materialize(rows, "toxic-labels")
    n = rows.count()
    chance = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    return (rows.where(chance < F.lit(int((1 << 30) * min(1.0, max_rows / max(n, 1)))))
            .withColumn("fold", F.when(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)) == 0, "a").otherwise("b")))


_COUNTS = ("n", "ta", "ca", "tb", "cb")


def corpus_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: occurrences in the whole corpus, summed up within tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            words, inverse = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
            return words, np.bincount(inverse, np.concatenate([n for _, n in held])).astype(np.int64)

        def rows(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([to_int64(part[0]), pa.array(part[1])], ["word", "n"])

        for b in text_steps(batches, "text"):
            data, offsets = text_buffers(b.column(0))
            held.append(np.unique(Words(lower_ascii(data), offsets, alnum_class()).hashes(), return_counts=True))
            if sum(len(w) for w, _ in held) > 2 * _HELD_ROWS:
                held = [merged()]
                if len(held[0][0]) > _HELD_ROWS:
                    yield rows(held.pop())
        if held:
            yield rows(merged())

    return docs.select("text").mapInArrow(tidy(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def class_counts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """``(word, ta, ca, tb, cb)``: distinct neighbourhoods of a word in toxic and clean rows of both folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            data, offsets = text_buffers(b.column(0))
            words = Words(lower_ascii(data), offsets, alnum_class())
            h = words.hashes()
            if not len(h):
                continue
            edge = np.diff(words.doc) != 0
            left, right = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint64)
            left[1:], right[:-1] = np.where(edge, 0, h[:-1]), np.where(edge, 0, h[1:])
            kind = np.array([(0 if t else 1) + (2 if f == "b" else 0)
                             for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], np.int64)
            near = left * np.uint64(0x9E3779B97F4A7C15) + right * np.uint64(0xC2B2AE3D27D4EB4F)
            rows = np.unique(np.stack([h, near, kind[words.doc].astype(np.uint64)]), axis=1)
            yield pa.RecordBatch.from_arrays([to_int64(rows[0]), to_int64(rows[1]), pa.array(rows[2].astype(np.int32))],
                                             ["word", "near", "kind"])

    # the training rows are bounded by MAX_ROWS, so they are sent to every task and no text moves
    seen = docs.join(F.broadcast(train), "doc_id").select("text", "toxic", "fold").mapInArrow(tidy(run), "word long, near long, kind int")
    return seen.distinct().groupBy("word").agg(*[F.count_if(F.col("kind") == k).alias(c) for k, c in enumerate(_COUNTS[1:])])


def _log_odds(y1, y0, n1, n0, prior, weight):
    """Log-odds of words between two counts under a Dirichlet prior, and its z-score."""
    a, b = y1 + prior, y0 + prior
    odds = np.log(a / (n1 + weight - a)) - np.log(b / (n0 + weight - b))
    return odds, odds / np.sqrt(1 / a + 1 / b)


def _scores(words, y1, y0, n1, n0, share) -> Scores:
    """Significant words with their scores, and lambda of the clean word law."""
    weight = PRIOR * (n1 + n0)
    prior = weight * share
    odds, z = _log_odds(y1, y0, n1, n0, prior, weight)
    keep = (np.abs(z) >= MIN_Z) & (np.abs(odds) >= MIN_ODDS)
    order = np.argsort(words[keep])
    s = odds[keep][order]
    p = ((y0 + prior) / (n0 + weight))[keep][order]

    def excess(lam: float) -> float:
        return float((p * np.exp(lam * (s - DRIFT))).sum() + max(0.0, 1 - p.sum()) * math.exp(-lam * DRIFT)) - 1

    lo, hi = 1e-3, 1.0
    while excess(hi) < 0 and hi < 16 and (s > DRIFT).any():
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if excess(mid) < 0 else (lo, mid)
    return Scores(words[keep][order], s, max(lo, 1e-2))


def _fit_k(law: Scores, rows: list[tuple[int, float]]) -> float:
    """Most likely K for clean rows ``(words, best score)``."""
    rows = [(n, s) for n, s in rows if n]
    return len(rows) / sum(n * math.exp(-law.lam * s) for n, s in rows) if rows else 1e-3


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Ridge-penalised logistic curve of one variable."""
    w, design, penalty = np.zeros(2), np.stack([np.ones(len(x)), x], 1), np.array([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -50, 50)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty + 1e-9),
                               design.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id",
        label_col: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learn the word scores, the extreme-value law and the curve."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text"))
    train = materialize(training_rows(labels, label_id_col, label_col, max_rows), "toxic-train")
    classes = materialize(class_counts(docs, train), "toxic-words")
    sums = classes.agg(*[F.sum(c) for c in _COUNTS[1:]]).first()
    ta, ca, tb, cb = (x or 0 for x in sums)
    share = train.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    if not (ta + tb and ca + cb):
        return Model(Scores(), 0.0, 0.0, share or 0.0)
    corpus = materialize(corpus_counts(docs), "corpus-words")
    n, vocabulary = corpus.agg(F.sum("n"), F.count(F.lit(1))).first()

    def counts(y1: Column, y0: Column, n1: int, n0: int) -> Column:
        """The test of :func:`_scores` as a column, with room for rounding."""
        weight = F.lit(float(PRIOR * (n1 + n0)))
        prior = weight * (F.col("n") + 1) / F.lit(float(n + vocabulary))
        a, b = y1 + prior, y0 + prior
        odds = F.log(F.try_divide(a, F.lit(n1) + weight - a)) - F.log(F.try_divide(b, F.lit(n0) + weight - b))
        z = F.try_divide(odds, F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b)))
        return F.coalesce((F.abs(z) >= MIN_Z - 1e-6) & (F.abs(odds) >= MIN_ODDS - 1e-6), F.lit(False))

    # words that count in one of the three laws below; the others score nothing
    yta, yca, ytb, ycb = (F.col(x) for x in _COUNTS[1:])
    wanted = counts(ytb, ycb, tb, cb) | counts(yta, yca, ta, ca) | counts(yta + ytb, yca + ycb, ta + tb, ca + cb)
    top = classes.join(corpus, "word").where(wanted).select("word", *_COUNTS).toArrow()
    words = np.ascontiguousarray(top.column("word").to_numpy()).view(np.uint64)
    c = {x: top.column(x).to_numpy().astype(float) for x in _COUNTS}
    prior = (c["n"] + 1) / (n + vocabulary)
    laws = {"a": _scores(words, c["tb"], c["cb"], tb, cb, prior), "b": _scores(words, c["ta"], c["ca"], ta, ca, prior)}
    final = _scores(words, c["ta"] + c["tb"], c["ca"] + c["cb"], ta + tb, ca + cb, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            fold = np.array(b.column(2).to_pylist())
            out = [None] * b.num_rows
            size = None
            for f in _FOLDS:
                w, segments = _scan(b.column(0), laws[f])
                size = w.count
                for i in np.flatnonzero(fold == f).tolist():
                    out[i] = [s for _, _, s in segments[i]]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(size.astype(np.int64)),
                                              pa.array(out, pa.list_(pa.float64()))], ["toxic", "fold", "n", "s"])

    rows = (docs.join(F.broadcast(train), "doc_id").select("text", "toxic", "fold")
            .mapInArrow(tidy(run), "toxic int, fold string, n long, s array<double>").collect())  # MAX_ROWS bounds them
    for f in _FOLDS:
        laws[f].k = _fit_k(laws[f], [(r.n, max(r.s, default=0.0)) for r in rows if r.fold == f and not r.toxic])
    final.k = float(np.mean([laws[f].k for f in _FOLDS]))
    x = np.array([evidence([(0, 0, s) for s in r.s], r.n, laws[r.fold]) for r in rows])
    return Model(final, *_logistic(x, np.array([float(bool(r.toxic)) for r in rows])))


# --- applying it ---------------------------------------------------------------

def _judged(col: pa.Array, model: Model):
    """``(words, segments, probability of each row)``."""
    words, segments = _scan(col, model.scores)
    count = words.count.tolist()
    return words, segments, [model.probability(evidence(s, n, model.scores)) for s, n in zip(segments, count)]


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", max_e: float = MAX_E) -> DataFrame:
    """``(doc_id, score, n_words, passages)`` of every row; ``passages``: the significant segments
    as word ranges with score and E-value.  One narrow pass."""
    law = model.scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, "text"):
            words, segments, p = _judged(b.column(1), model)
            passages = [[{"start": s, "end": e, "score": x, "e_value": law.k * n * math.exp(-law.lam * x)} for s, e, x in own]
                        for own, n in zip(segments, words.count.tolist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(p, pa.float64()), pa.array(words.count.astype(np.int64)),
                 pa.array([[x for x in own if x["e_value"] <= max_e] for own in passages],
                          pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()),
                                              ("e_value", pa.float64())])))],
                ["doc_id", "score", "n_words", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(docs, text_col).alias("text")).mapInArrow(
        tidy(run), "doc_id long, score double, n_words long, "
             "passages array<struct<start:long,end:long,score:double,e_value:double>>")


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_steps(batches, text_col):
            p = _judged(b.column(b.schema.get_field_index(text_col)), model)[2]
            yield b.filter(pa.array([x < threshold for x in p], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
