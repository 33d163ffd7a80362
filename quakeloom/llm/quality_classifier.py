"""Quality classifier learned from trusted positives and unlabelled text.

Each whole text becomes 24 exact statistics (shares of character classes, repetition, lengths), and each
of these one of 8 bins, so that a feature is 0 or 1. With g(x) = w x and the squared loss, the unbiased
risk of positive-unlabelled learning, prior * R_p(+) + R_u(-) - prior * R_p(-), needs first and second
moments of the features only: over the trusted positives, and over all documents as the unlabelled ones. These
are whole numbers, summed in one pass over the corpus, and the fit itself is on a matrix of fixed size. Its
solution's direction does not depend on the prior: it is the density ratio of positives to all text. The part that
stands for negatives, R_u(-) - prior * R_p(-), can't be below zero for any true model; where the
fit drives it there, descent goes on with that part held at zero from below (the non-negative risk).

The class prior comes from positives and unlabelled text, too: at each cutoff the share of all text above it,
by the share of positives above it, is the prior plus what negatives add; the least such quotient, with
the deviation of both shares allowed for, is taken. A third of the positives is kept from the fit for this and
for the scores. The score is prior * share of positives / share of all text
at the model's value, pooled so that it never falls and drawn through bins of equal width, so between 0 and 1.

Defined results: null and empty texts have no words and are scored by the bins of such texts; labels that are
null, of a null doc_id, or contradict each other are ignored; a doc_id without documents teaches nothing; rows that
share a doc_id are scored each, and each is a positive; without any positive (of either part) or document all scores are the prior 0.5;
columns other than doc_id and text, and quality in the labels, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.session import cut, table

WINDOW = 5
#: Statistics in permille, or in words, whose bins are by powers of two.
SHARES = (
    "symbols", "pipes", "marks", "commas", "digits", "upper", "wide", "spaces", "capital_words", "odd_words", "short_words", "long_words",
    "same_as_last", "repeated_windows", "new_words", "commonest_word", "dup_lines", "lines_without_stop",
)
SIZES = ("n_words", "line_words", "sentence_words", "word_bytes", "longest_word", "n_lines")
STATS = SHARES + SIZES
#: Lower edges of the bins after the first.
SHARE_EDGES = (1, 8, 30, 80, 180, 400, 700)
SIZE_EDGES = (2, 4, 8, 16, 64, 256, 1024)
BINS = 8
FEATURES = 1 + len(STATS) * BINS
#: Places of the model's value that are counted apart.
PLACES = 512
#: Ridge of the fit: this much, or with few positives so much divided by their number.
RIDGE, RIDGE_FEW = 1e-3, 20.0
THRESHOLD = 0.7

_CLASSES = np.zeros((256, 8), bool)
for _i, _chars in enumerate(("#*$%&<>@^~=_\\", "|", "!?", ",;:", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
    _CLASSES[[ord(c) for c in _chars], _i] = True
_CLASSES[0x80:, 6] = True
_CLASSES[[0x20, *range(0x09, 0x0E)], 7] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _count(texts: pa.Array) -> np.ndarray:
    """STATS of every text, one column each."""
    data, offsets = textscan.buffer(texts)
    n = len(offsets) - 1
    starts, ends, docs = textscan.words(data, offsets)
    per = lambda hit: np.bincount(docs[hit], minlength=n)
    share = lambda part, whole: part * 1000 // np.maximum(whole, 1)
    n_bytes, n_words, size = np.diff(offsets), np.bincount(docs, minlength=n), ends - starts
    out = [share(textscan.per_document(_CLASSES[data, i], offsets), n_bytes) for i in range(8)]

    first, last = data[starts], data[ends - 1]
    capital = (first >= 0x41) & (first <= 0x5A)
    odd = ~_LETTER[first] | ~(_LETTER[last] | np.isin(last, np.frombuffer(b".,;:!?", np.uint8)))
    out += [share(per(hit), n_words) for hit in (capital, odd, size <= 2, size >= 12)]

    ids = textscan.span_ids(data, starts, ends)
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (docs[1:] == docs[:-1])
    places = max(len(ids) - WINDOW + 1, 0)
    whole = np.flatnonzero(docs[:places] == docs[WINDOW - 1 :])
    windows = textscan.row_ids(docs[whole], *(ids[whole + i] for i in range(WINDOW)))
    repeated = np.bincount(docs[whole[np.bincount(windows)[windows] > 1]], minlength=n)
    own = textscan.row_ids(docs, ids)
    _, once, of, times = np.unique(own, return_index=True, return_inverse=True, return_counts=True)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, docs[once], times)
    out += [share(x, n_words) for x in (per(same), repeated, per(once), most)]

    breaks = np.concatenate([[-1], np.flatnonzero(data == 10), [len(data)]])
    after = np.searchsorted(breaks, starts)
    begin, at = np.unique(np.maximum(breaks[after - 1] + 1, offsets[docs]), return_index=True)
    line_docs = docs[at]
    stop = np.minimum(breaks[after[at]], offsets[line_docs + 1])
    lines = np.bincount(line_docs, minlength=n)
    distinct = np.bincount(np.unique(line_docs << 32 | textscan.span_ids(data, begin, stop)) >> 32, minlength=n)
    ending = np.isin(last, np.frombuffer(b".!?", np.uint8))
    last_word = np.concatenate([at[1:] - 1, [len(starts) - 1]])[: len(at)]
    open_lines = np.bincount(line_docs[~ending[last_word]], minlength=n)
    out += [share(lines - distinct, lines), share(open_lines, lines)]

    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, docs, size)
    quotient = lambda a, b: a // np.maximum(b, 1)
    out += [n_words, quotient(n_words, lines), quotient(n_words, per(ending)), quotient(np.bincount(docs, size, minlength=n).astype(np.int64), n_words), longest, lines]
    return np.stack(out, axis=1)


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the bin of each statistic, a byte each, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            counts = _count(batch.column("text"))
            bins = np.where(np.arange(len(STATS)) < len(SHARES), np.searchsorted(SHARE_EDGES, counts, side="right"), np.searchsorted(SIZE_EDGES, counts, side="right"))
            data = np.ascontiguousarray(bins.astype(np.uint8))
            places = (np.arange(len(bins) + 1) * len(STATS)).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(places), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], names=["doc_id", "bins"])

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, bins binary")


def _expanded(batch: pa.RecordBatch) -> np.ndarray:
    """Features of a batch of binned statistics: a constant, then a 1 in each statistic's bin."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, len(STATS))
    out = np.zeros((len(bins), FEATURES), np.float32)
    out[:, 0] = 1
    out[np.arange(len(bins))[:, None], 1 + np.arange(len(STATS)) * BINS + bins] = 1
    return out


def moments(binned: DataFrame) -> np.ndarray:
    """Sums of the products of all pairs of features, whole numbers: a matrix of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES, FEATURES), np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                x = _expanded(batch.slice(start, 8192))
                total += (x.T @ x).astype(np.int64)  # below 2^24, so exact
        place = np.flatnonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(total.ravel()[place])], names=["place", "n"])

    sums = binned.select("bins").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES * FEATURES)
    for row in sums:
        out[row.place] = row.n
    out = out.reshape(FEATURES, FEATURES)
    return out + np.triu(out, 1).T


@dataclass(frozen=True)
class Model:
    """weights of the features; scores of the PLACES of their sum; the estimated share of positives."""

    weights: tuple[float, ...]
    scores: tuple[float, ...]
    prior: float

    def values(self, batch: pa.RecordBatch) -> np.ndarray:
        return _expanded(batch).astype(np.float64) @ np.array(self.weights)

    def score(self, values: np.ndarray) -> np.ndarray:
        """Between the middles of neighbouring places; a hundredth of the score follows the value itself, so that pooled places keep its order."""
        place = np.clip((values + 0.5) / 2, 0, 1)
        return 0.99 * np.interp(place * PLACES - 0.5, np.arange(PLACES), self.scores) + 0.01 * place


def _ridge(positive: np.ndarray) -> float:
    return max(RIDGE, RIDGE_FEW / positive[0, 0])


def density_ratio(all_text: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights of the unbiased risk's solution up to the prior: the ratio of positives to all text. The constant isn't held down."""
    ridge = _ridge(positive) * np.diag(np.arange(FEATURES) > 0)
    return np.linalg.solve(all_text / all_text[0, 0] + ridge, positive[0] / positive[0, 0])


def non_negative(ratio: np.ndarray, all_text: np.ndarray, positive: np.ndarray, prior: float, steps: int = 400, rate: float = 0.02) -> np.ndarray:
    """Weights g with the least non-negative risk, as weights of the ratio (g + 1) / (2 prior).

    The unbiased solution is kept where its negative part is at least zero, as no other risk is lower there. Else
    steps go up on the negative part while it is below zero, and down on the whole risk otherwise.
    """
    u, p = all_text / all_text[0, 0], positive / positive[0, 0]
    one, ridge = np.eye(FEATURES)[0], _ridge(positive)
    loss = lambda m, g, sign: (1 - 2 * sign * g @ m[0] + g @ m @ g) / 4  # noqa: E731  of (1 - sign g)^2 / 4
    slope = lambda m, g, sign: (m @ g - sign * m[0]) / 2
    negative = lambda g: loss(u, g, -1) - prior * loss(p, g, -1)
    risk = lambda g: prior * loss(p, g, 1) + max(0.0, negative(g)) + ridge / 4 * g[1:] @ g[1:]
    g = best = 2 * prior * ratio - one
    if negative(g) < 0:
        for _ in range(steps):
            push = slope(u, g, -1) - prior * slope(p, g, -1)
            g = g + rate * push if negative(g) < 0 else g - rate * (prior * slope(p, g, 1) + push + ridge / 2 * g * (1 - one))
            best = min(best, g, key=risk)
    return (best + one) / (2 * prior)


def counted(binned: DataFrame, weights: np.ndarray) -> np.ndarray:
    """How many rows have a value in each of PLACES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PLACES, np.int64)
        for batch in batches:
            if batch.num_rows:
                place = np.clip((_expanded(batch).astype(np.float64) @ weights + 0.5) / 2 * PLACES, 0, PLACES - 1)
                total += np.bincount(place.astype(np.int64), minlength=PLACES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(PLACES)), pa.array(total)], names=["place", "n"])

    out = np.zeros(PLACES)
    for row in binned.select("bins").mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[row.place] = row.n
    return out


def class_prior(all_text: np.ndarray, positive: np.ndarray, error: float = 0.05) -> float:
    """The share of positives in all text, from counts per place: the least quotient of the shares above a cutoff.

    Deviations that both shares exceed with chance `error` only are added to its upper side, so that a few rows far up don't decide.
    """
    above = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()
    off = lambda n: np.sqrt(np.log(4 / error) / 2 / n.sum())
    least = above(positive) - off(positive)
    # with fewer than about ten positives no share is sure; then all that isn't refuted is kept
    return float(np.clip(np.min(((above(all_text) + off(all_text)) / np.where(least > 0, least, 1e-9))), 0.01, 0.99))


def pooled(all_text: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """prior * share of positives / share of all text at each place, pooled so that it never falls, 1 at most."""
    blocks: list[list[float]] = []  # positives, all, places
    for p, u in zip(prior * positive / positive.sum(), all_text / all_text.sum()):
        blocks.append([p, u, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, u, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + p, blocks[-1][1] + u, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), min(1.0, p / u) if u else 0.0) for p, u, n in blocks])


def train(binned: DataFrame, positives: DataFrame) -> Model:
    """A model of the documents in `binned`, of which those with a doc_id in `positives` are known to be good."""
    good = cut(binned.join(positives, "doc_id", "left_semi").select("bins", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("apart")))
    apart = good.where("apart")
    u, p = moments(binned), moments(good.where("NOT apart"))
    if not p[0, 0] or apart.isEmpty():
        return Model((0.0,) * FEATURES, (0.5,) * PLACES, 0.5)
    ratio = density_ratio(u, p)
    prior = class_prior(counted(binned, ratio), counted(apart, ratio))
    weights = non_negative(ratio, u, p, prior)
    return Model(tuple(weights.tolist()), tuple(pooled(counted(binned, weights), counted(apart, weights), prior).tolist()), prior)


def scored(binned: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(model.values(batch)))], names=["doc_id", "score"])

    return binned.select("doc_id", "bins").mapInArrow(run, f"doc_id {dict(binned.dtypes)['doc_id']}, score double")


def fold(doc_id: Column) -> Column:
    """0 to 3 by the CRC of the decimal id; null for null."""
    return F.crc32(doc_id.cast("string")) % 4


def trusted(labels: DataFrame) -> DataFrame:
    """doc_ids whose labels all say good."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of `documents`; labels of fold 2 are held out."""
    binned = cut(statistics(table(spark, sf_dir, "documents")))
    learned = trusted(table(spark, sf_dir, "labels")).where(fold(F.col("doc_id")) != 2)
    found = scored(binned, train(binned, learned))
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier}
#: Training is beyond SQL; tests measure accuracy on held-out labels and compare statistics and moments with plain counts.
ORACLE_SQL: dict[str, str] = {}
