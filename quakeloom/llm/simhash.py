"""SimHash near-duplicates through a segment-popcount embedding.

Fingerprints: lower-cased words, shingles with repeats, XXH64, majority of each bit. Only distinct
fingerprints are compared; equal texts meet in one row first.

Embedding: the 64 bits are cut into 32 segments of two bits, and a fingerprint is mapped to the
segments' bit counts. Their Manhattan distance never exceeds the Hamming distance. Counts are written
in thermometer code (0: 00, 1: 01, 2: 11), which makes the Manhattan distance a popcount of an XOR.

Grid: the segments form groups. Two fingerprints at Manhattan distance 4 or less agree in all but 4 of
them at least, so each is put into the cells that these groups' counts name, for every choice of groups,
and pairs are looked for within cells only: an exact range join, then the exact Hamming check. The grid
is refined with the number of fingerprints: more groups mean more cells for each, and finer ones, in
which fewer others meet it by chance. The number of groups is the one with the least work of both kinds.

Dense cells: in a first round every member is compared with its cell's least fingerprint only, which
is linear and joins nearly all of a large group of near copies. In a second round, members of a cell's
largest component so far are compared with members of other components only. Links found this way
give the same components as all pairs.

Defined results: null text counts as empty; without words the fingerprint is zero and links like any
other; repeated rows each get a row; rows with a null doc_id are linked too, and component_id is the
least non-null doc_id (null where there is none). Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.llm import textscan
from quakeloom.llm.components import components, join_once
from quakeloom.session import cut, table

SHINGLE, SEED, DISTANCE = 4, 42, 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 16


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """The SimHash of every text, as unsigned 64-bit numbers."""
    data, offsets = textscan.buffer(texts)
    starts, ends, docs = textscan.words(data, offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(starts):
        return out
    # words stay, of the white space after a word one byte stays, as a space
    space = textscan._SPACE[data]
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.cumsum(keep) - 1
    line = np.where(space, 32, _LOWER[data]).astype(np.uint8)[keep].tobytes()
    starts, ends = place[starts], place[ends - 1] + 1

    first = np.flatnonzero(np.diff(docs, prepend=-1))
    count = np.diff(first, append=len(docs))
    short = first[count < shingle]
    whole = np.flatnonzero(docs[: len(docs) - shingle + 1] == docs[shingle - 1 :]) if len(docs) >= shingle else short[:0]
    at = np.concatenate([whole, short])
    last = np.concatenate([whole + shingle - 1, (first + count - 1)[count < shingle]])
    order = np.argsort(at, kind="stable")
    at, last = at[order], last[order]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in zip(starts[at].tolist(), ends[last].tolist())), np.uint64, len(at))

    owner = docs[at]
    ones = np.zeros((len(out), 64), np.int64)
    for i in range(0, len(hashes), _BLOCK):
        bits = np.unpackbits(hashes[i : i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[i : i + _BLOCK]
        edge = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    total = np.bincount(owner, minlength=len(out))
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprinted(documents: DataFrame, *keep: str, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the columns in `keep`, and fp (the 64 bits as bigint) of each whole text."""
    source = documents.select("doc_id", *keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textscan.chunks(batches):
            found = pa.array(fingerprints(batch.column("text"), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", *keep)] + [found], names=["doc_id", *keep, "fp"])

    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)] + ["fp bigint"]))


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


_LOW = _signed(0x5555555555555555)


def embedded(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, in thermometer code."""
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(_LOW)), 1))


def _group_masks(groups: int) -> list[int]:
    """64-bit masks of `groups` runs of two-bit segments, as even as they can be."""
    cuts = [32 * g // groups for g in range(groups + 1)]
    return [_signed(sum(3 << 2 * s for s in range(a, b))) for a, b in zip(cuts, cuts[1:])]


def grid_groups(n: int, distance: int = DISTANCE) -> int:
    """How many groups of segments make the least work for n fingerprints: cells of each, and chance partners there.

    Bits are taken as even and independent: counts of two bits then agree in 3 of 8 cases.
    """
    agree = lambda g: 0.375 ** (32 * (g - distance) / g)
    return min(range(distance + 1, 21), key=lambda g: math.comb(g, distance) * (1 + n * agree(g) / 2))


def cells(distinct: DataFrame, distance: int, groups: int) -> DataFrame:
    """fp and cell: a row for each choice of all but `distance` groups."""
    masks = _group_masks(groups)
    # a cell's name is hashed to one number; should two cells meet in it, they are searched together
    names = [F.xxhash64(F.lit(n), F.col("u").bitwiseAND(F.lit(reduce(int.__or__, some)))) for n, some in enumerate(combinations(masks, groups - distance))]
    # one row becomes many: they are dealt out before, as the few bytes here wouldn't call for many tasks
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.repartition(tasks, "fp").select("fp", embedded(F.col("fp")).alias("u")).select("fp", F.explode(F.array(*names)).alias("cell"))


def links(distinct: DataFrame, distance: int = DISTANCE, groups: int | None = None) -> DataFrame:
    """(node, component) of the fingerprints (column fp, distinct) with another within `distance`."""
    count = distinct.count()
    groups = groups or grid_groups(count, distance)
    placed = cells(distinct, distance, groups)
    # the XOR of two members tells their Hamming distance: most cells of two are chance meetings
    shared = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("head"), F.bit_xor("fp").alias("x"))
    shared = shared.where((F.col("n") > 2) | (F.col("n") == 2) & (F.bit_count("x") <= distance)).select("cell", "head")
    members = cut(join_once(placed, shared, "cell"))
    near = lambda a, b: (F.bit_count(embedded(F.col(a)).bitwiseXOR(embedded(F.col(b)))) <= distance) & (F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance)

    first = components(members.where(F.col("fp") != F.col("head")).where(near("fp", "head")).select("fp", "head"), "fp", "head")
    known = members.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("cell", "fp", F.coalesce("component", "fp").alias("part"))
    sizes = known.groupBy("cell", "part").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cell").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    mixed = cut(join_once(known, mixed, "cell"))
    minor = mixed.where("part <> main").select("cell", F.col("fp").alias("a"), F.col("part").alias("part_a"))
    found = minor.join(mixed.select("cell", F.col("fp").alias("b"), F.col("part").alias("part_b")), "cell")
    found = found.where(F.col("part_a") != F.col("part_b")).where(near("a", "b")).select(F.col("part_a").alias("a"), F.col("part_b").alias("b")).distinct()

    second = components(found, "a", "b")
    whole = second.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    inner = first.join(whole, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))
    return inner.unionByName(second.join(first.select("node"), "node", "left_anti"))


def groups_of(marked: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """`marked` (doc_id, fp and more) with group (a fingerprint) and component_id (least doc_id of the group)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = distinct.join(links(distinct.select("fp"), distance).withColumnRenamed("node", "fp"), "fp", "left")
    found = cut(found.select("fp", "least", F.coalesce("component", "fp").alias("group")))
    named = join_once(found.select("fp", "group"), found.groupBy("group").agg(F.min("least").alias("component_id")), "group")
    return join_once(marked, named, "fp")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    marked = cut(fingerprinted(table(spark, sf_dir, "documents")))
    return groups_of(marked).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text as it stands) and fp of every row."""
    return fingerprinted(documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text"), "text_key")


def survivors(documents: DataFrame, grouped: DataFrame) -> DataFrame:
    """One row of `documents` per group of `grouped` (doc_id, text_key, group): the one with the least
    doc_id (nulls last), then the least text_key. Only rows equal in both are the same row repeated."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")).alias("x")
    kept = grouped.groupBy("group").agg(first).select(F.col("x.doc_id").alias("kept_id"), F.col("x.text_key").alias("kept_key"))
    rows = documents.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.xxhash64("text") == F.col("kept_key")), "left_semi").select(*documents.columns)
    if grouped.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():
        return rows
    # rows that share doc_id and text; sorts the texts
    return rows.withColumn("__text_key", F.xxhash64("text")).dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")


def keep_one(documents: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row per group of near duplicates: the one with the least doc_id (nulls last, then by text)."""
    return survivors(documents, groups_of(cut(keyed(documents)), distance).select("doc_id", "text_key", "group"))


QUERIES = {"op10_simhash": op10_simhash}
ORACLE_SQL = {}
