"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-cased tokens (runs of ASCII letters and digits and of non-ASCII bytes).
Running Karp-Rabin keys of five tokens find the seeds that a document shares with a benchmark item;
seeds in a row on one diagonal are one match. The longest match is marked first, then the longest that
is left of the others, and so on (ties: earliest in the item, then in the document), until none of five
tokens is left. Marked tiles never overlap on either side, so that reordered passages count in full and
a repeated phrase counts once. A document is contaminated if tiles cover half of an item's tokens.

Documents and items meet by a join on seeds. Of each item the rarest seeds are enough to find its documents:
the most common ones are left out for as long as they cover less of the item than a contaminated document
must. For the documents and items found, the places of all shared seeds are joined, and each pair is tiled
by itself; matches are found from where they start, so that texts which repeat themselves make no grid of places.
Documents' seeds are shuffled only if a Bloom filter of the benchmark's seeds lets them pass; it
has a fixed largest size, beyond which more seeds pass. Texts aren't shuffled, and equal texts are tiled once.

Defined results: null or empty documents and items, and items of fewer than five tokens, match nothing;
repeated rows are each judged; repeated items each count; columns other than doc_id, text and item_id
are not read, and pass through when documents are filtered.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.session import cut, table

#: Tokens of the shortest tile, and percent of an item's tokens that tiles must cover.
LEAST, COVERAGE = 5, 50
#: Largest size of the filter in bits, a power of two; bits set per seed.
FILTER_BITS, FILTER_HASHES = 1 << 27, 4
#: So many contaminated texts at most are sent to all tasks; more meet the documents by a shuffle.
BROADCAST_TEXTS = 1_000_000

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys of the tokens of all texts, the text of each, and the number of texts."""
    data, offsets = textscan.buffer(texts)
    starts, ends, docs = textscan.spans(_TOKEN[data], offsets)
    return textscan.span_hashes(_LOWER[data], starts, ends), docs, len(offsets) - 1


def _ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For each power of two the rank of what starts at each place with that length, over places where all of it is there.

    Equal ranks mean equal stretches; places where an id is below zero are ends."""
    levels, size = [np.where(ids >= 0, ids, -1)], 1
    while 2 * size <= len(ids):
        last = levels[-1]
        both = (last[:-size] >= 0) & (last[size:] >= 0)
        if not both.any():
            break
        rank = np.full(len(ids), -1, np.int64)
        rank[: len(ids) - size][both] = np.unique(last[:-size][both] * (last.max() + 1) + last[size:][both], return_inverse=True)[1]
        levels.append(rank)
        size *= 2
    return levels


def matches(item: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the item, place in the document and length of every maximal run of equal seeds (numbers; -1: none).

    Runs are found from where they start, pairs of places whose predecessors differ, and measured by ranks of stretches:
    a seed that both texts repeat without end makes as many runs as there are places, not pairs of places."""
    before = [np.concatenate([[-1], x[:-1]]) if len(x) else x for x in (item, doc)]
    starts = [(np.zeros(0, np.int64),) * 2]
    grouped = [np.lexsort((p, x)) for p, x in zip(before, (item, doc))]
    grouped = [g[x[g] >= 0] for g, x in zip(grouped, (item, doc))]
    i_seeds, i_first, i_count = np.unique(item[grouped[0]], return_index=True, return_counts=True)
    j_seeds, j_first, j_count = np.unique(doc[grouped[1]], return_index=True, return_counts=True)
    _, i_at, j_at = np.intersect1d(i_seeds, j_seeds, return_indices=True)
    for m, n in zip(i_at, j_at):
        here, there = grouped[0][i_first[m] : i_first[m] + i_count[m]], grouped[1][j_first[n] : j_first[n] + j_count[n]]
        left, previous = before[0][here], before[1][there]
        # both sides are in the order of their predecessors
        edges = np.flatnonzero(np.diff(left)) + 1
        for part in np.split(here, edges):
            p = before[0][part[0]]
            low, high = (len(there), len(there)) if p < 0 else np.searchsorted(previous, [p, p + 1])
            others = np.concatenate([there[:low], there[high:]])
            if len(others):
                starts.append((np.repeat(part, len(others)), np.tile(others, len(part))))
    i, j = (np.concatenate(x) for x in zip(*starts))
    length, at, to = np.zeros(len(i), np.int64), i.copy(), j + len(item) + 1
    levels = _ranks(np.concatenate([item, [-1], doc]))
    for n in range(len(levels) - 1, -1, -1):
        rank = np.append(levels[n], -1)
        while True:  # more than once at the highest level only
            same = (rank[at] == rank[to]) & (rank[at] >= 0)
            step = np.where(same, 1 << n, 0)
            length, at, to = length + step, np.minimum(at + step, len(rank) - 1), np.minimum(to + step, len(rank) - 1)
            if n + 1 < len(levels) or not same.any():
                break
    return i, j, length


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item position, document position, length). item, doc: the number of the shared seed at each place, or -1."""
    i, j, length = matches(item, doc)
    length = length + least - 1
    order = np.lexsort((j, i, -length))
    used_item, used_doc = np.zeros(len(item) + least, bool), np.zeros(len(doc) + least, bool)
    heap, found, n, left = [], [], 0, len(item) + least - 1
    while (n < len(order) or heap) and left >= least:
        following = (-int(length[order[n]]), int(i[order[n]]), int(j[order[n]])) if n < len(order) else None
        if heap and (following is None or heap[0] < following):
            size, at, to = heapq.heappop(heap)
        else:
            (size, at, to), n = following, n + 1
        taken = used_item[at : at - size] | used_doc[to : to - size]
        if not taken.any():
            found.append((at, to, -size))
            used_item[at : at - size] = used_doc[to : to - size] = True
            left += size
            continue
        ends = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]])))
        for a, b in ends.reshape(-1, 2).tolist():  # what marks have left of the match
            if b - a >= least:
                heapq.heappush(heap, (a - b, at + a, to + a))
    return found


def _numbered(places: list[list[int]]) -> np.ndarray:
    """The number of the seed at each place, given all places of each seed; -1 elsewhere."""
    out = np.full(max((max(p) for p in places), default=-1) + 1, -1, np.int64)
    for n, p in enumerate(places):
        out[p] = n
    return out


def _seeds(keys: np.ndarray, owners: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running keys of `least` tokens, the text of each, and where it starts there in tokens."""
    seeds, first = textscan.gram_hashes(keys, owners, least)
    owner = owners[first]
    return seeds, owner, first - np.searchsorted(owners, owner)


def _listed(seeds: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Each text's distinct seeds, the text of each, and all its places there."""
    order = np.lexsort((place, seeds, owner))
    seeds, owner, place = seeds[order], owner[order], place[order]
    new = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (owner[1:] != owner[:-1])])[: len(seeds)])
    places = pa.ListArray.from_arrays(pa.array(np.append(new, len(seeds)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return seeds[new].view(np.int64), owner[new], places


def item_seeds(items: DataFrame, least: int = LEAST) -> DataFrame:
    """item, n_tokens, seed and positions (all its places in the item) of `items` (item, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            keys, owners, n = tokens(batch.column("text"))
            seeds, owner, places = _listed(*_seeds(keys, owners, least))
            sizes = np.bincount(owners, minlength=n)
            yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner)), pa.array(sizes[owner]), pa.array(seeds), places], names=["item", "n_tokens", "seed", "positions"])

    return items.mapInArrow(run, "item bigint, n_tokens bigint, seed bigint, positions array<int>")


def rare_seeds(seeds: DataFrame, least: int = LEAST, coverage: int = COVERAGE) -> DataFrame:
    """item and seed: all but the most common seeds, which together cover less than `coverage` percent of the item."""

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["items", "seed"], ascending=False)
        n, covered, count, left_out = int(rows["n_tokens"].iloc[0]), set(), 0, 0
        for positions in rows["positions"]:
            covered.update(p + k for p in positions for k in range(least))
            if len(covered) * 100 >= coverage * n:
                break
            left_out += 1
        return rows.iloc[left_out:][["item", "seed"]]

    frequency = seeds.groupBy("seed").agg(F.count("*").alias("items"))
    return seeds.join(frequency, "seed").groupBy("item").applyInPandas(choose, "item bigint, seed bigint")


def _bits(seeds: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of each seed in a filter of `size` bits."""
    return [(textscan.mix(seeds.view(np.uint64) + np.uint64((n + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(size - 1)).astype(np.int64) for n in range(FILTER_HASHES)]


def seed_filter(seeds: DataFrame) -> Broadcast:
    """A Bloom filter of the seeds, FILTER_BITS at most, in 64-bit words."""
    n = seeds.count()
    size = min(FILTER_BITS, max(1 << 10, 1 << (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(_bits(batch.column("seed").to_numpy(), size))))], names=["bit"])

    marked = seeds.select("seed").mapInArrow(run, "bit bigint")
    words = marked.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("bits")).toArrow()
    out = np.zeros(size >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return seeds.sparkSession.sparkContext.broadcast(out)


def _text_keys() -> list[Column]:
    """Two numbers that tell texts apart."""
    return [F.xxhash64("text").alias("k1"), F.octet_length("text").alias("k2")]


def seed_hits(documents: DataFrame, known: Broadcast, least: int = LEAST) -> DataFrame:
    """k1, k2, seed and places of the seeds of each text that the filter lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in textscan.chunks(batches):
            keys, owners, _ = tokens(batch.column("text"))
            seeds, owner, place = _seeds(keys, owners, least)
            hit = np.arange(len(seeds))
            for n in range(FILTER_HASHES):
                at = _bits(seeds[hit], len(words) * 64)[n]
                hit = hit[(words[at >> 6] >> (at & 63)) & 1 == 1]
            if len(hit):
                seeds, owner, places = _listed(seeds[hit], owner[hit], place[hit])
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(own), batch.column("k2").take(own), pa.array(seeds), places], names=["k1", "k2", "seed", "places"])

    return documents.select(*_text_keys(), "text").mapInArrow(run, "k1 bigint, k2 int, seed bigint, places array<int>")


def _tiled(pairs: DataFrame, least: int, coverage: int) -> DataFrame:
    """The contaminated ones of `pairs` (k1, k2, item, n_tokens, shared: positions and places of each shared seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for n, (size, shared) in enumerate(zip(batch.column("n_tokens").to_pylist(), batch.column("shared").to_pylist())):
                # each seed touches `least` tokens, and tiles cover no others
                if sum(len(s["positions"]) for s in shared) * least * 100 < coverage * size:
                    continue
                found = tiles(_numbered([s["positions"] for s in shared]), _numbered([s["places"] for s in shared]), least)
                covered = sum(x[2] for x in found)
                if covered * 100 >= coverage * size:
                    keep.append(n)
                    out.append((len(found), covered, size))
            if keep:
                numbers = [pa.array(np.array(x, np.int64)) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("k1", "k2", "item")] + numbers, names=["k1", "k2", "item", "n_tiles", "covered", "n_tokens"])

    return pairs.mapInArrow(run, "k1 bigint, k2 int, item bigint, n_tiles bigint, covered bigint, n_tokens bigint")


def _found(documents: DataFrame, benchmark: DataFrame, least: int, coverage: int) -> tuple[DataFrame, DataFrame]:
    """Contaminated texts (k1, k2) with their items, and the benchmark's rows (item, item_id)."""
    rows = benchmark.where("text IS NOT NULL").select("item_id", F.xxhash64("text").alias("item"), "text")
    seeds = cut(item_seeds(rows.select("item", "text").dropDuplicates(["item"]), least))
    rare = cut(rare_seeds(seeds, least, coverage))
    hits = cut(seed_hits(documents, seed_filter(seeds), least).groupBy("k1", "k2", "seed").agg(F.first("places").alias("places")))
    likely = hits.select("k1", "k2", "seed").join(rare, "seed").select("k1", "k2", "item").distinct()
    met = likely.join(seeds, "item").join(hits, ["k1", "k2", "seed"])
    # a group has as many rows as the item has seeds, at most
    shared = met.groupBy("k1", "k2", "item").agg(F.first("n_tokens").alias("n_tokens"), F.collect_list(F.struct("positions", "places")).alias("shared"))
    return cut(_tiled(shared, least, coverage)), rows.select("item", "item_id")


def _by_text(found: DataFrame) -> DataFrame:
    """`found`, to be sent to all tasks if it is small."""
    return F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found


def contaminated(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: int = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_tiles, covered and n_tokens of each document and item that it contains."""
    found, items = _found(documents, benchmark, least, coverage)
    named = cut(found.join(items, "item"))
    return documents.select("doc_id", *_text_keys()).join(_by_text(named), ["k1", "k2"]).select("doc_id", "item_id", "n_tiles", "covered", "n_tokens")


def clean(documents: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: int = COVERAGE) -> DataFrame:
    """The documents that aren't contaminated, with all their columns."""
    found, _ = _found(documents, benchmark, least, coverage)
    texts = _by_text(cut(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()))
    same = (F.xxhash64("text") == F.col("_k1")) & (F.octet_length("text") == F.col("_k2"))
    return documents.join(texts, same, "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contaminated document with the items that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE_SQL = {}
