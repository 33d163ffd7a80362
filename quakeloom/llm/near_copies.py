"""Near copies of the pipeline: SimHash groups joined further by exact Jaccard similarity.

Two texts are linked by the fingerprints of op10, or if their sets of five-word shingles (lower-cased
words; a shorter text is one shingle) have a Jaccard similarity of 0.8 or more. At that similarity
fingerprints differ in up to 14 bits, where no cells of bit counts prune anything, so those pairs are
looked for among the shingles themselves, exactly.

Candidates: in one order of all shingles, two sets of similarity 0.8 share one of the first
n - ceil(0.8 n) + 1 of each. Any order serves; here shingles that a sample shows to be common come last,
so that a passage of many texts makes few meetings. Which shingles the sample holds changes the work only.
A shingle that only one text has among its first makes no cell.

Dense cells: in first rounds a few members of each cell offer themselves, and each text is compared only
with the one of these that shares most of its first shingles; in the last round members of different groups so far are compared. Links found
this way give the same groups as all pairs.

Verification: a text's sketch holds the parity of its shingles per bucket, and two sketches never differ in
more buckets than the sets differ in shingles, which rules most chance pairs out. What is left is compared
by the whole texts.

Defined results: texts without words have an empty set and are like no other; null text counts as empty;
repeated rows and equal texts are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.llm import simhash, textscan
from quakeloom.llm.components import components, join_once
from quakeloom.session import cut

#: Similarity of near copies, as a fraction.
WORDS, PART, WHOLE = 5, 4, 5
#: One text in so many is sampled for common shingles; so often there is common; so many are told to tasks.
SAMPLED, OFTEN, MOST = 16, 8, 100_000
#: Least buckets of a sketch, in 64-bit words; a larger set has as many buckets as shingles, or more.
SKETCH = 16
#: Rounds in which each text is compared with one other, and members of a cell that offer themselves for it.
ROUNDS, HEADS = 2, 6
#: So many keys of texts at most are sent to all tasks; more meet the texts by a shuffle.
BROADCAST_TEXTS = 2_000_000


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text and the text of each, by text and hash."""
    data, offsets = textscan.buffer(texts)
    starts, ends, docs = textscan.words(data, offsets)
    keys = textscan.span_hashes(simhash._LOWER[data], starts, ends)
    grams, first = textscan.gram_hashes(keys, docs, WORDS)
    hashes, owners = [grams], [docs[first]]
    length = np.bincount(docs, minlength=len(offsets) - 1)
    for n in range(1, WORDS):
        short = length[docs] == n
        grams, first = textscan.gram_hashes(keys[short], docs[short], n)
        hashes.append(grams + np.uint64(n))
        owners.append(docs[short][first])
    hashes, owners = np.concatenate(hashes).view(np.int64), np.concatenate(owners)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
    return hashes[new], owners[new]


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.xxhash64("text").alias("text_key"), "text")


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch without repeated text_keys."""
    keys = batch.column("text_key").to_numpy()
    return batch.take(pa.array(np.sort(np.unique(keys, return_index=True)[1])))


def _placed(texts: DataFrame, common: np.ndarray | None) -> DataFrame:
    """text_key and token: the first shingles of each text, or all if `common` is None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, textscan.chunks(batches)):
            hashes, owners = shingles(batch.column("text"))
            if common is not None:
                sizes = np.bincount(owners, minlength=batch.num_rows)
                order = np.lexsort((hashes, np.isin(hashes, common), owners))
                hashes = hashes[order]
                rank = np.arange(len(owners)) - (np.cumsum(sizes) - sizes)[owners]
                first = rank <= sizes[owners] - -(-PART * sizes[owners] // WHOLE)
                hashes, owners = hashes[first], owners[first]
            yield pa.RecordBatch.from_arrays([batch.column("text_key").take(pa.array(owners)), pa.array(hashes)], names=["text_key", "token"])

    return texts.mapInArrow(run, "text_key bigint, token bigint")


def sketches(texts: DataFrame) -> DataFrame:
    """text_key, n (size of the set) and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_once, textscan.chunks(batches)):
            hashes, owners = shingles(batch.column("text"))
            sizes = np.bincount(owners, minlength=batch.num_rows)
            width = SKETCH << np.ceil(np.log2(np.maximum(sizes / (SKETCH * 64), 1))).astype(np.int64)
            ends = np.cumsum(width)
            bucket = textscan.mix(hashes.view(np.uint64)) & (width[owners] * 64 - 1).astype(np.uint64)
            odd = np.bincount(bucket.astype(np.int64) + ((ends - width) * 64)[owners], minlength=int(width.sum()) * 64) & 1
            words = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
            found = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(words))
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), pa.array(sizes.astype(np.int32)), found], names=["text_key", "n", "sketch"])

    return texts.mapInArrow(run, "text_key bigint, n int, sketch array<bigint>")


def common_shingles(documents: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample of the texts; a fixed number at most."""
    counts = _placed(_texts(documents).where(F.pmod("text_key", F.lit(SAMPLED)) == 0), None).groupBy("token").agg(F.count("*").alias("times"))
    rows = counts.where(F.col("times") >= OFTEN).orderBy(F.desc("times"), "token").limit(MOST).select("token").collect()
    return np.array([r.token for r in rows], np.int64)


def _fits(a: Column, b: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * WHOLE >= F.greatest(a, b) * PART


def _enough(times: Column, a: Column, b: Column) -> Column:
    """Whether sets of these sizes that share so many of their first shingles, or fewer, can be similar enough.

    Of the set whose first shingles end earlier in the order, no other than these are among the first of both,
    so that the sets share as many more as it has others, at most.
    """
    others = F.ceil(F.greatest(a, b) * PART / WHOLE) - 1
    return (times + others) * (WHOLE + PART) >= (a + b) * PART


def likely(pairs: DataFrame, drawn: DataFrame) -> DataFrame:
    """The pairs (a, b and more) of text_keys of sets of similar sizes that sketches don't rule out. drawn: all sketches."""
    of = lambda side: drawn.select(*(F.col(c).alias(side if c == "text_key" else f"{side}_{c}") for c in drawn.columns))
    # of similar sets, one may have twice as many buckets as the other: its halves are laid upon each other
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda u, v: u.bitwiseXOR(v))
    narrow = lambda x, y: F.when(F.size(x) > F.size(y), half(F.col(x))).otherwise(F.col(x))
    apart = F.aggregate(F.zip_with(narrow("a_sketch", "b_sketch"), narrow("b_sketch", "a_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    # similarity PART / WHOLE leaves sets this many shingles to differ in
    close = apart * (WHOLE + PART) <= (F.col("a_n") + F.col("b_n")) * (WHOLE - PART)
    return pairs.join(of("a"), "a").join(of("b"), "b").where(close).select(*pairs.columns)


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """part_a and part_b of the pairs (a, b, part_a, part_b) of text_keys whose whole texts are similar enough."""
    wanted = cut(pairs.select(F.col("a").alias("text_key")).unionByName(pairs.select(F.col("b").alias("text_key"))).distinct())
    if wanted.count() <= BROADCAST_TEXTS:
        wanted = F.broadcast(wanted)
    texts = _texts(documents).join(wanted, "text_key", "left_semi").dropDuplicates(["text_key"])
    of = lambda side: texts.select(F.col("text_key").alias(side), F.col("text").alias(f"text_{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches, "text_a"):
            sets = [shingles(batch.column(f"text_{side}")) for side in "ab"]
            sizes = [np.bincount(owners, minlength=batch.num_rows) for _, owners in sets]
            hashes, owners = (np.concatenate(x) for x in zip(*sets))
            order = np.lexsort((hashes, owners))
            same = (np.diff(hashes[order]) == 0) & (np.diff(owners[order]) == 0)
            both = np.bincount(owners[order][1:][same], minlength=batch.num_rows)
            keep = (both > 0) & (both * WHOLE >= (sizes[0] + sizes[1] - both) * PART)
            yield batch.select(["part_a", "part_b"]).filter(pa.array(keep))

    return pairs.join(of("b"), "b").join(of("a"), "a").select("part_a", "part_b", "text_a", "text_b").mapInArrow(run, "part_a bigint, part_b bigint")


def _joined(df: DataFrame, found: DataFrame, part: str) -> DataFrame:
    """`df` with its parts replaced by the components that they belong to."""
    named = found.select(F.col("node").alias(part), F.col("component").alias("_joined"))
    return df.join(named, part, "left").withColumn(part, F.coalesce("_joined", part)).drop("_joined").select(*df.columns)


def groups(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """`grouped` (doc_id, text_key, group) with groups joined wherever texts of two are similar."""
    drawn = cut(sketches(_texts(documents)).dropDuplicates(["text_key"]))
    parts = grouped.select("text_key", F.col("group").alias("part")).distinct().join(drawn.select("text_key", "n"), "text_key")
    placed = cut(_placed(_texts(documents), common_shingles(documents)))
    shared = placed.groupBy("token").agg(F.min("text_key").alias("lo"), F.max("text_key").alias("hi")).where("lo <> hi").select("token")
    cells = cut(join_once(placed, shared, "token").join(parts, "text_key").distinct())
    tried = None
    for number in range(ROUNDS):
        # a cell's heads: other texts in each round
        some = lambda i: F.min_by(F.struct("text_key", "n", "part"), F.xxhash64("text_key", F.lit(i)))
        heads = cells.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.array_distinct(F.array(*(some(number * HEADS + i) for i in range(HEADS)))).alias("heads"))
        cells = cut(join_once(cells, heads.where("lo <> hi").select("token", "heads"), "token"))
        offered = cells.select("text_key", "n", "part", F.explode("heads").alias("head")).where((F.col("part") != F.col("head.part")) & _fits(F.col("n"), F.col("head.n")))
        pairs = offered.groupBy(F.col("text_key").alias("a"), F.col("head.text_key").alias("b"), F.col("part").alias("part_a"), F.col("head.part").alias("part_b")).agg(F.count("*").alias("times"))
        # one pair a text before any sketch is looked up: a large group of near copies has many heads
        pairs = pairs.groupBy("a").agg(F.max_by(F.struct("b", "part_a", "part_b"), F.struct("times", "b")).alias("x")).select("a", "x.*")
        pairs = cut(likely(pairs, drawn))
        found = components(verified(pairs, documents), "part_a", "part_b")
        once = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tried = once if tried is None else tried.unionByName(once)
        cells = cut(_joined(cells.select("token", "text_key", "n", "part"), found, "part"))
        grouped = _joined(grouped, found, "group")

    sizes = cells.groupBy("token", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("token").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    still = cut(join_once(cells, main, "token"))
    one = lambda df, side: df.select("token", F.col("text_key").alias(side), F.col("n").alias(f"n_{side}"), F.col("part").alias(f"part_{side}"))
    pairs = one(still, "a").join(one(still.where("part <> main"), "b"), "token").where((F.col("part_a") != F.col("part_b")) & _fits(F.col("n_a"), F.col("n_b")))
    # both ways where both are outside the largest group
    swap = F.col("a") > F.col("b")
    either = lambda x, y, name: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(name)
    pairs = pairs.select(either("a", "b", "a"), either("b", "a", "b"), either("part_a", "part_b", "part_a"), either("part_b", "part_a", "part_b"), either("n_a", "n_b", "n_a"), either("n_b", "n_a", "n_b"))
    pairs = pairs.groupBy(*pairs.columns).agg(F.count("*").alias("times")).where(_enough(F.col("times"), F.col("n_a"), F.col("n_b"))).select("a", "b", "part_a", "part_b")
    pairs = cut(likely(pairs.join(tried, ["a", "b"], "left_anti"), drawn))
    return _joined(grouped, components(verified(pairs, documents), "part_a", "part_b"), "group")


def keep_one(documents: DataFrame) -> DataFrame:
    """One row per group of near copies: the one with the least doc_id (nulls last, then by text)."""
    grouped = cut(simhash.groups_of(cut(simhash.keyed(documents))).select("doc_id", "text_key", "group"))
    return simhash.survivors(documents, cut(groups(documents, grouped)))
