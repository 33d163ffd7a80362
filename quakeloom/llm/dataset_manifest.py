"""Merkle manifest of a dataset, with octopus multiproofs.

Rows are leaves of one binary tree per group, in the order of their ids; the groups' roots are the leaves of a tree
above. A tree is built in blocks of 4096 neighbours: each block's task hashes its own 12 levels, and the blocks'
tops are the leaves of the next round, so that the largest group in a task is 4096 nodes whatever the data. All
nodes are kept by tree, level and index.

To prove leaves, each leaf partition (the wanted leaves of a block) computes the coordinates that all its
paths together lack: siblings on each level that neither are wanted nor follow from nodes below. Only
this minimal union is fetched, each coordinate once, by one join with the nodes. The partition then derives
the interiors that its paths share, and writes each leaf's own proof from them. What lies above
a group's root is the proof of that root in the upper tree, made once a group the same way.

A node alone at the end of its level is hashed by itself into the next one. Defined results: a null id comes first, a null
group before all others; rows with the same id are ordered by their leaf, and equal rows are leaves each; an empty
dataset has no root and no proofs; columns other than the key, the group and those asked for are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.session import cut, table

#: Levels that one task hashes: blocks of 2 ** 12 nodes.
BLOCK_BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, level int, index bigint, digest string"
_PROOF = "array<struct<digest:string,left:boolean>>"
#: Of proof steps from the upper tree, in the list of what a partition has fetched.
_UPPER = 1000


def leaf_digest(**instead: Column) -> Column:
    """Hex SHA-256 of a row's fields, each with its length in bytes; a null is a dash. instead: other values of fields."""
    parts = []
    for name in FIELDS:
        value = instead.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with index, their place within their tree by `order`, and size, the leaves of that tree.

    Rows are dealt out by ranges of (tree, order), so that equal shares of the largest tree lie side by side, and
    numbered within a share; what each share starts with is summed over the shares, not over rows.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    placed = cut(dealt.withColumns({"share": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    shares = placed.groupBy("tree", "share").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = shares.select("tree", "share", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("size"))
    return cut(placed.join(known, ["tree", "share"]).withColumn("index", F.col("at") + F.col("shift")).drop("share", "at", "shift"))


def _depth(size: int) -> int:
    return (size - 1).bit_length()


def _hash_pairs(digests: np.ndarray) -> np.ndarray:
    """The next level of neighbouring nodes whose first has an even index."""
    even = len(digests) // 2 * 2
    pairs = digests[:even].view("S128") if even else np.zeros(0, "S128")
    rest = [digests[-1]] if len(digests) % 2 else []
    return np.array([hashlib.sha256(x).hexdigest() for x in (*pairs.tolist(), *rest)], "S64")


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), "S64") if len(column) else np.zeros(0, "S64")


def _levels(base: int):
    """A function for applyInArrow: the nodes above a block of a tree's nodes of level `base`."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("index")
        tree, size, first = rows["tree"][0].as_py(), rows["size"][0].as_py(), rows["index"][0].as_py()
        digests, level, out = _bytes(rows["digest"]), base, []
        for level in range(base + 1, min(base + BLOCK_BITS, _depth(size)) + 1):
            digests = _hash_pairs(digests)
            first >>= 1
            n = len(digests)
            out.append(pa.table({"tree": [tree] * n, "level": pa.array([level] * n, pa.int32()), "index": np.arange(first, first + n), "digest": pa.array(digests.astype(str)), "size": [size] * n}))
        return pa.concat_tables(out)

    return run


def _nodes(leaves: DataFrame) -> DataFrame:
    """All nodes above the leaves (tree, index, size, digest), with the size of their tree."""
    deepest = _depth(max(leaves.agg(F.max("size")).first()[0] or 1, 1))
    found, now = None, leaves.select("tree", F.lit(0).alias("level"), "index", "digest", "size")
    every = leaves.sparkSession.createDataFrame([], _NODE + ", size bigint")
    for base in range(0, deepest, BLOCK_BITS):
        higher = now.where(F.col("size") > 1 << base)
        blocks = higher.groupBy("tree", F.shiftright("index", BLOCK_BITS).alias("block"))
        found = cut(blocks.applyInArrow(_levels(base), _NODE + ", size bigint"))
        every = every.unionByName(found)
        now = found.where(F.col("level") == base + BLOCK_BITS)
    return every


@dataclass(frozen=True)
class Manifest:
    """leaves (tree, index, size, digest and what was kept), nodes above them, and the manifest of the groups' roots, if any."""

    leaves: DataFrame
    nodes: DataFrame
    upper: Manifest | None = None

    def tops(self) -> DataFrame:
        """tree and digest of each tree's root."""
        lone = self.leaves.where("size = 1").select("tree", "digest")
        last = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1)))
        return lone.unionByName(self.nodes.where(F.col("level") == last).select("tree", "digest"))

    def root(self) -> str | None:
        """The root of all groups."""
        found = (self.upper or self).tops().first()
        return found.digest if found else None


def build(rows: DataFrame, group: Column, key: Column, leaf: Column, **keep: Column) -> Manifest:
    """The manifest of `rows`: leaves by `key` within `group`. keep: more columns of each leaf."""
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # null first, then by bytes
    hashed = rows.select(tree.alias("tree"), key.alias("key"), leaf.alias("digest"), *(c.alias(n) for n, c in keep.items()))
    leaves = numbered(cut(hashed.withColumn("row", F.monotonically_increasing_id())), "key", "digest", "row").drop("row")
    lower = Manifest(leaves, _nodes(leaves))
    roots = numbered(lower.tops().select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"), "key")
    return Manifest(leaves, lower.nodes, Manifest(roots, _nodes(roots)))


def missing(index: np.ndarray, size: int) -> list[tuple[int, np.ndarray]]:
    """Level and indices of the nodes that the paths of the leaves `index` lack together, of a tree of `size` leaves.

    A sibling is lacking if it exists and isn't on another of the paths.
    """
    out, index = [], np.unique(index)
    for level in range(_depth(size)):
        sibling = index ^ 1
        there = -(-size >> level)
        out.append((level, sibling[(sibling < there) & ~np.isin(sibling, index)]))
        index = np.unique(index >> 1)
    return out


def _lacking(key: tuple, rows: pa.Table) -> pa.Table:
    """A leaf partition's coordinates to fetch."""
    parts = missing(rows["index"].to_numpy(), rows["size"][0].as_py())
    level = np.concatenate([np.zeros(0, np.int32), *(np.full(len(i), k, np.int32) for k, i in parts)])
    index = np.concatenate([np.zeros(0, np.int64), *(i for _, i in parts)])
    n = len(level)
    return pa.table({"tree": pa.array([key[0].as_py()] * n, pa.string()), "block": pa.array([key[1].as_py()] * n, pa.int64()), "level": level.astype(np.int32), "index": index})


def _steps(n: int, levels: list[tuple[np.ndarray, ...]], more: list[dict]) -> pa.Array:
    """One list of steps for each of `n` leaves: sibling, whether there is one, whether it stands left, by level; `more` follow in every list."""
    levels = levels + [(np.full(n, m["digest"] or "", "S64"), np.full(n, m["digest"] is not None), np.full(n, m["index"] == 1)) for m in more]
    if not levels:
        return pa.array([[]] * n, pa.list_(pa.struct([("digest", pa.string()), ("left", pa.bool_())])))
    digest, there, left = (np.stack(x, axis=1).ravel() for x in zip(*levels))
    places = np.arange(n + 1, dtype=np.int32) * len(levels)
    return pa.ListArray.from_arrays(pa.array(places), pa.StructArray.from_arrays([pa.array(np.char.decode(digest), pa.string(), mask=~there), pa.array(left)], ["digest", "left"]))


def _expand(rows: pa.Table, fetched: pa.Table) -> pa.Table:
    """Each wanted leaf's proof and its tree's root, from a partition's leaves and what it has fetched."""
    size, got = rows["size"][0].as_py(), {}
    index = rows["index"].to_numpy()
    own, once = np.unique(index, return_index=True)
    nodes, of = _bytes(rows["digest"])[once], np.searchsorted(own, index)
    levels, places, digests = fetched["level"].to_numpy(), fetched["index"].to_numpy(), _bytes(fetched["digest"])
    for level in np.unique(levels):
        hit = levels == level
        order = np.argsort(places[hit])
        got[int(level)] = places[hit][order], digests[hit][order]
    steps = []
    for level in range(_depth(size)):
        others, other_digests = got.get(level, (np.zeros(0, np.int64), np.zeros(0, "S64")))
        known, known_digests = np.concatenate([own, others]), np.concatenate([nodes, other_digests])
        order = np.argsort(known)
        known, known_digests = known[order], known_digests[order]
        sibling = own ^ 1
        there = sibling < -(-size >> level)
        # the wanted nodes and their siblings are pairs side by side, but for one alone at the end
        found = np.where(there, known_digests[np.searchsorted(known, np.where(there, sibling, known[0]))], b"")
        steps.append((found[of], there[of], (sibling < own)[of]))
        nodes = _hash_pairs(known_digests)
        parents = np.unique(own >> 1)
        of, own = np.searchsorted(parents, own[of] >> 1), parents
    above = fetched.filter(pa.compute.greater_equal(fetched["level"], _UPPER)).sort_by("level").to_pylist()
    top = pa.array([nodes[0].decode()] * len(index), pa.string())
    return rows.drop_columns(["size"]).append_column("subroot", top).append_column("proof", _steps(len(index), steps, above))


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves' columns, subroot, and proof: the steps (digest of the sibling, null where a node is alone; whether it stands left)
    up to the root of all groups. wanted: leaves of the manifest to prove, all if none are given."""
    leaves = manifest.leaves if wanted is None else wanted
    kinds = dict(leaves.dtypes)
    block = F.shiftright("index", BLOCK_BITS).alias("block")
    lacking = cut(leaves.select("tree", "index", "size").groupBy("tree", block).applyInArrow(_lacking, "tree string, block bigint, level int, index bigint"))
    every = manifest.nodes.select("tree", "level", "index", "digest").unionByName(manifest.leaves.select("tree", F.lit(0).alias("level"), "index", "digest"))
    fetched = lacking.join(every, ["tree", "level", "index"]).select("tree", "block", "level", "index", "digest")
    if manifest.upper:
        upper = prove(manifest.upper).select(F.col("key").alias("tree"), F.posexplode("proof").alias("k", "step"))
        asked = leaves.select("tree", block).distinct()
        above = asked.join(cut(upper), "tree").select("tree", "block", (F.col("k") + _UPPER).alias("level"), F.col("step.left").cast("bigint").alias("index"), "step.digest")
        fetched = fetched.unionByName(above)
    columns = [c for c in leaves.columns if c != "size"]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + f", subroot string, proof {_PROOF}"
    return leaves.groupBy("tree", block).cogroup(fetched.groupBy("tree", "block")).applyInArrow(_expand, schema)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof's steps lead to."""

    def step(so_far: Column, s: Column) -> Column:
        pair = F.when(s["digest"].isNull(), so_far).when(s["left"], F.concat(s["digest"], so_far)).otherwise(F.concat(so_far, s["digest"]))
        return F.sha2(pair, 256)

    return F.aggregate(proof, leaf, step)


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows of `documents`, and what they lead to for rows of which some are tampered with."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf_digest(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
    manifest = build(table(spark, sf_dir, "documents"), F.col("lang"), F.col("doc_id"), leaf_digest(), tampered=tampered)
    root = F.lit(manifest.root()).cast("string")
    siblings = F.array_join(F.filter(F.col("proof.digest"), lambda d: d.isNotNull()), "")
    found = prove(manifest).select(
        F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings, 256).alias("proof_sha256"),
        fold(F.coalesce("tampered", "digest"), F.col("proof")).alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(({0})::VARCHAR) || ':' || ({0})::VARCHAR END"
_LEAF = lambda chars: "sha256(" + " || ".join(_VALUE.format(chars if f == "n_chars" else f) for f in FIELDS) + ")"
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS r, coalesce('=' || lang, '') AS tree, doc_id, {_LEAF("n_chars")} AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN {_LEAF("n_chars::HUGEINT + 1")} END AS tampered FROM documents, crc),
lv(tree, level, i, n, h) AS (
  SELECT tree, 0, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1, count(*) OVER (PARTITION BY tree), leaf FROM d
  UNION ALL SELECT tree, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM lv WHERE n > 1 GROUP BY tree, level, i // 2),
up(level, i, n, h, tree) AS (
  SELECT 0, row_number() OVER (ORDER BY tree) - 1, count(*) OVER (), h, tree FROM lv WHERE n = 1
  UNION ALL SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)), min(tree) FROM up WHERE n > 1 GROUP BY level, i // 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i FROM d),
steps AS (
  SELECT p.r, l.level, any_value(s.h) AS h, any_value(s.i < p.i >> l.level) AS before FROM placed p
    JOIN (SELECT DISTINCT tree, level FROM lv WHERE n > 1) l ON l.tree = p.tree LEFT JOIN lv s ON s.tree = p.tree AND s.level = l.level AND s.i = xor(p.i >> l.level, 1) GROUP BY p.r, l.level
  UNION ALL
  SELECT p.r, 1000 + l.level, any_value(s.h), any_value(s.i < u.i >> l.level) FROM placed p JOIN up u ON u.level = 0 AND u.tree = p.tree
    CROSS JOIN (SELECT DISTINCT level FROM up WHERE n > 1) l LEFT JOIN up s ON s.level = l.level AND s.i = xor(u.i >> l.level, 1) GROUP BY p.r, l.level),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY level) AS k FROM steps),
f(r, k, h) AS (
  SELECT r, 0::BIGINT, coalesce(tampered, leaf) FROM d
  UNION ALL SELECT f.r, f.k + 1, sha256(CASE WHEN n.h IS NULL THEN f.h WHEN n.before THEN n.h || f.h ELSE f.h || n.h END) FROM f JOIN numbered n ON n.r = f.r AND n.k = f.k + 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY level), '')) AS proof_sha256 FROM d LEFT JOIN steps USING (r) GROUP BY r),
ends AS (SELECT r, arg_max(h, k) AS folded_root FROM f GROUP BY r),
root AS (SELECT h AS root FROM up WHERE n = 1)
SELECT p.doc_id, p.leaf, t.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed p JOIN lv t ON t.tree = p.tree AND t.n = 1 JOIN proofs USING (r) JOIN ends USING (r) CROSS JOIN root"""

QUERIES = {"op11_dataset_manifest": op11_dataset_manifest}
ORACLE_SQL = {"op11_dataset_manifest": ORACLE}
