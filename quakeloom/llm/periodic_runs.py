"""Periodic runs of words, found on each document's Re-Pair grammar.

The word ids of a document are compressed by Re-Pair: pairs of neighbours are replaced by a new symbol, the most
frequent first, in rounds until no pair is there twice. Within a round a place where two pairs overlap goes
to the more frequent one, so that a round replaces all pairs that nothing more frequent touches.

A run lies within the expansion of some lowest symbol and crosses the boundary between its two parts (or
a boundary of the final sequence). So the runs that cross a rule's boundary are computed once, at the rule's first
place in the text and within its expansion, and carried over to all positions where the rule was
derived. A run of four periods has two of them on one side of the boundary; the grams that start or end there, of
1, 2, 4, ... words, recur one period away, which gives the candidate periods. At the end, intervals within a
longer one of the same period (a symbol that ends inside a run sees a part of it) and multiples of a period go.
Repetitive texts have few boundaries; in other texts the grams that occur three times run out after a few words.
Memory is linear in the longest text.

Defined results: null text has no words, so no runs and the digest of empty texts; a run never leaves its document;
rows that share a doc_id, or have none, are separate documents; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.session import table

#: Fewest words of a run, and fewest periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
_ODD = np.int64(2654435761)


@dataclass
class Grammar:
    """Rules by the first place of their expansion in the text, all places of each, and where symbols of the final sequence start."""

    first: np.ndarray
    middle: np.ndarray
    end: np.ndarray
    rules: np.ndarray
    places: np.ndarray
    starts: np.ndarray


def re_pair(symbols: np.ndarray, docs: np.ndarray) -> Grammar:
    """The grammar of all documents of a batch. symbols: numbers that differ from document to document."""
    s, d, at, size = symbols.copy(), docs, np.arange(len(symbols)), np.ones(len(symbols), np.int64)
    fresh, made = int(symbols.max(initial=-1)) + 1, 0
    rules: list[tuple[np.ndarray, ...]] = []
    places: list[tuple[np.ndarray, np.ndarray]] = []
    again = np.ones(len(s), bool)  # pairs whose count may have changed, by their left symbol
    while len(s) > 1:
        live = np.flatnonzero(again[:-1] & (d[:-1] == d[1:]))
        keys = s[live] << 32 | s[live + 1]
        order = np.argsort(keys)
        ids = np.empty(len(live), np.int64)
        ids[order] = np.cumsum(np.concatenate([[False], np.diff(keys[order]) != 0])[: len(live)])
        # of overlapping equal pairs (a a a) every second one counts
        n = np.arange(len(live))
        heads = np.concatenate([[True], (ids[1:] != ids[:-1]) | (live[1:] != live[:-1] + 1)])[: len(live)]
        apart = (n - np.maximum.accumulate(np.where(heads, n, 0))) % 2 == 0
        count = np.bincount(ids[apart])
        often = count[ids] >= 2
        if not often.any():
            break
        rank = np.where(often & apart, count[ids] << 32 | (ids * _ODD & 0xFFFFFFFF), -1)
        around = np.full(len(s) + 1, -1)
        around[live + 1] = rank
        wins = (rank > around[live]) & (rank > around[live + 2])
        hits, of = live[wins], ids[wins]
        twice = np.bincount(of)[of] >= 2
        hits, (_, once, of) = hits[twice], np.unique(of[twice], return_index=True, return_inverse=True)
        middle = at[hits] + size[hits]
        end = middle + size[hits + 1]
        rules.append((at[hits][once], middle[once], end[once]))
        places.append((made + of, at[hits]))
        s[hits], size[hits] = fresh + of, end - at[hits]
        fresh, made = fresh + len(once), made + len(once)
        stay, new, repeated = np.ones(len(s), bool), np.zeros(len(s), bool), np.zeros(len(s), bool)
        stay[hits + 1], new[hits], repeated[live[often]] = False, True, True
        s, d, at, size, new, repeated = (x[stay] for x in (s, d, at, size, new, repeated))
        again = repeated | new
        again[:-1] |= new[1:]
    joined = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
    return Grammar(*(joined(rules, k) for k in range(3)), *(joined(places, k) for k in range(2)), at)


def _agree(w: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and from j on, in direction `step`, are the same, `most` at most."""
    done, block = 0, 32
    while done < most:
        n = min(block, most - done)
        if step > 0:
            same = w[i + done : i + done + n] == w[j + done : j + done + n]
        else:
            same = (w[i - done - n + 1 : i - done + 1] == w[j - done - n + 1 : j - done + 1])[::-1]
        if not same.all():
            return done + int(same.argmin())
        done, block = done + n, block * 4
    return done


class _Boundaries:
    """Places `b` that runs may cross, each with the words lo to hi that they lie in; collects what crosses."""

    def __init__(self, words: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray):
        self.words, self.b, self.lo, self.hi = words, b, lo, hi
        self.right, self.left = b.copy(), b.copy()  # how far runs found so far reach
        self.found: list[tuple[int, int, int, int]] = []

    def look(self, which: np.ndarray, side: int, width: int, names: np.ndarray, sorted_places: np.ndarray) -> None:
        """Runs with periods of `width` up to twice that, of which two periods lie right (1) or left (-1) of the boundary.

        names: of the gram of `width` words at each place, -1 if it is rare; sorted_places: name * len + place of the others.
        Candidates come from the nearest period on, as long as the two periods aren't inside a run that is known.
        """
        n = len(names)
        b, lo, hi = self.b[which], self.lo[which], self.hi[which]
        gram = b - 1 if side > 0 else b - width + 1
        room = (hi - b if side > 0 else b - lo) // 2
        known = (self.right[which] - b if side > 0 else b - self.left[which]) // 2 + 1
        nearest, furthest = np.maximum(width, known), np.minimum(2 * width - 1, room)
        base = names[np.clip(gram, 0, n - 1)] * n + gram
        index = np.searchsorted(sorted_places, base + nearest) if side > 0 else np.searchsorted(sorted_places, base - nearest, side="right") - 1
        open_ = np.flatnonzero((gram >= lo) & (gram + width <= hi) & (base >= gram) & (nearest <= furthest))
        while len(open_):
            i = index[open_]
            inside = (i >= 0) & (i < len(sorted_places))
            period = np.where(inside, (sorted_places[np.clip(i, 0, len(sorted_places) - 1)] - base[open_]) * side, -1)
            inside &= (period >= nearest[open_]) & (period <= furthest[open_])
            open_, period = open_[inside], period[inside]
            here, x = which[open_], b[open_]
            if side > 0:
                last, beyond = x + period - width, 2 * period > self.right[here] - x
            else:
                last, beyond = x - 2 * period, 2 * period > x - self.left[here]
            square = beyond & (names[last] >= 0) & (names[last] == names[last + period])
            for k, q in zip(here[square].tolist(), period[square].tolist()):
                self._extend(k, q, side)
            index[open_] += side
            nearest[open_] = period + 1

    def _extend(self, k: int, q: int, side: int) -> None:
        w, b, lo, hi = self.words, int(self.b[k]), int(self.lo[k]), int(self.hi[k])
        known = b - 1 if side > 0 else b - q  # w[known] is w[known + q]
        start = known - _agree(w, known - 1, known + q - 1, known - lo, -1)
        end = known + q + _agree(w, known, known + q, hi - known - q, 1)
        self.right[k], self.left[k] = max(self.right[k], end), min(self.left[k], start)
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q):
            self.found.append((k, start, end, q))


def runs(words: np.ndarray, docs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and period of all runs of a batch's words, ordered by start and period.

    words: numbers of words, docs: of documents, first: where each document's words start, and the end of all.
    """
    n = len(words)
    none = np.zeros(0, np.int64)
    if n < LEAST_WORDS:
        return none, none, none
    own = textscan.row_ids(docs, words)  # each document has numbers of its own
    g = re_pair(own, docs)
    inner = g.starts[first[docs[g.starts]] < g.starts]
    limits = first[docs[inner]], first[docs[inner] + 1]
    b, lo, hi = (np.concatenate(x) for x in ((g.middle, inner), (g.first, limits[0]), (g.end, limits[1])))
    owner = np.concatenate([np.arange(len(g.first)), np.full(len(inner), -1)])
    long = hi - lo >= LEAST_WORDS
    edges, owner = _Boundaries(words, b[long], lo[long], hi[long]), owner[long]

    which, width, names = np.arange(len(owner)), 1, own
    places = np.arange(n)
    while True:
        # a gram no longer than the period is in a run of four periods three times at least
        alive = np.full(n, -1)
        often = np.bincount(names)[names] >= 3
        places, names = places[often], names[often]
        alive[places] = names
        at = edges.b[which]
        which = which[(alive[at - 1] >= 0) | (alive[np.maximum(at - width + 1, 0)] >= 0)]
        if not len(which) or not len(places):
            break
        ordered = np.sort(names * n + places)
        for side in (1, -1):
            edges.look(which, side, width, alive, ordered)
        ahead = places + width
        ahead_name = np.where(ahead < n, alive[np.minimum(ahead, n - 1)], -1)
        whole = (ahead_name >= 0) & (docs[places] == docs[np.minimum(ahead, n - 1)])
        places = places[whole]
        names = textscan.row_ids(alive[places], ahead_name[whole])
        width *= 2
        if not len(places):
            break
    return _merged(np.array(edges.found, np.int64).reshape(-1, 4), owner, g)


def _merged(found: np.ndarray, owner: np.ndarray, g: Grammar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs at all derivation positions; maximal intervals with their smallest periods."""
    rule = owner[found[:, 0]]
    plain, ruled = found[rule < 0, 1:], np.flatnonzero(rule >= 0)
    order = np.argsort(g.rules, kind="stable")
    begin = np.searchsorted(g.rules[order], rule[ruled])
    count = np.searchsorted(g.rules[order], rule[ruled], side="right") - begin
    each = np.repeat(ruled, count)
    shift = g.places[order[textscan.ranges(begin, count)]] - g.first[rule[each]]
    moved = found[each, 1:] + np.stack([shift, shift, np.zeros_like(shift)], axis=1)
    start, end, period = np.concatenate([plain, moved]).T
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    place = end + period * (end.max(initial=0) + 1)  # ends, further on for each longer period
    inside = np.concatenate([[False], np.maximum.accumulate(place)[:-1] >= place[1:]])[: len(start)]
    start, end, period = start[~inside], end[~inside], period[~inside]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])[: len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _rows(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """The runs of each text of a batch, and its text without what a run repeats."""
    data, offsets = textscan.buffer(batch.column("text"))
    n_docs = len(offsets) - 1
    starts, ends, docs = textscan.words(data, offsets)
    first = np.searchsorted(docs, np.arange(n_docs + 1))
    begin, stop, period = runs(textscan.span_ids(data, starts, ends), docs, first)

    marks = np.zeros(len(starts) + 1, np.int64)
    np.add.at(marks, begin + period, 1)
    np.add.at(marks, stop, -1)
    kept = np.flatnonzero(np.cumsum(marks[:-1]) == 0)
    padded = np.concatenate([data, np.full(1, 0x20, np.uint8)])
    text = padded[textscan.ranges(starts[kept], ends[kept] + 1 - starts[kept])]
    stops = np.cumsum(ends[kept] + 1 - starts[kept])
    text[stops - 1] = 0x20
    upto = np.searchsorted(docs[kept], np.arange(n_docs + 1))
    bounds = np.concatenate([[0], stops])[upto]
    bodies = pa.array([text[a : max(a, z - 1)].tobytes().decode() for a, z in zip(bounds[:-1], bounds[1:])], pa.string())

    of = docs[begin]
    lists = np.searchsorted(of, np.arange(n_docs + 1)).astype(np.int32)
    fields = {"start": begin - first[of], "length": stop - begin, "period": period}
    return pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields.values()], list(fields))), bodies


def find(documents: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period of each, by start and period) and collapsed (the words that no run repeats) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_rows(batch)], names=["doc_id", "runs", "collapsed"])

    source = documents.select("doc_id", "text")
    return source.mapInArrow(run, f"doc_id {dict(source.dtypes)['doc_id']}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(documents: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth document, by the CRC of its id, words from some place on repeat with some period."""
    words = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    chosen = F.filter(F.split(F.when(F.col("h") % 10 == 0, F.col("text")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sized = words.withColumn("w", chosen).withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    placed = sized.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    periods = placed.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    repeated = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return periods.select("doc_id", F.when(F.col("a").isNotNull(), repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four periods or more in every whole text of `documents`, some of which are planted."""
    found = find(planted(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    digest = F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256)
    return found.withColumn("r", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("r.start")).alias("start"), F.col("r.length").alias("length"), (-F.col("r.period")).alias("period"),
        F.floor(F.col("r.length") * 1000 / -F.col("r.period")).alias("exponent_milli"), digest.alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
#: Grammars are beyond SQL; tests compare with all periods of all places.
ORACLE_SQL: dict[str, str] = {}
