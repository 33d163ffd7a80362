"""The manifest's roots and proofs against a tree built by hand."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from quakeloom.llm import dataset_manifest as dm
from tests.llm.helpers import documents, empty, texts


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    out = []
    for name in dm.FIELDS:
        value = row[name]
        if name == "n_chars" and value is not None:
            value += more
        out.append("-" if value is None else f"{len(str(value).encode())}:{value}")
    return sha(*out)


def tree(leaves):
    """All levels from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return levels


def steps(levels, i):
    for level in levels[:-1]:
        yield (level[i ^ 1] if i ^ 1 < len(level) else None), bool(i & 1)
        i >>= 1


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    upper = tree([trees[g][-1][0] for g in names])
    root, out = upper[-1][0], []
    for g in names:
        for i, (_, _, digest, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = [*steps(trees[g], i), *steps(upper, names.index(g))]
            changed = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            now = leaf(row, 1) if changed else digest
            for sibling, left in path:
                now = sha(now) if sibling is None else sha(sibling, now) if left else sha(now, sibling)
            out.append((row["doc_id"], digest, trees[g][-1][0], root, sha(*(s for s, _ in path if s)), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def check(spark, tmp_path, df):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select(*dm.FIELDS).collect()]
    found = dm.op11_dataset_manifest(spark, str(tmp_path)).select(COLUMNS).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))
    return found


def test_awkward_rows(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "a"), (None, "a"), (None, None), (5, "again"), (5, "again"), (5, "other"), (-3, "neg"), (2**63 - 1, "é")]
    df = documents(spark, rows).withColumns({"n_chars": F.when(F.col("doc_id") % 4 != 1, F.when(F.col("doc_id") % 4 == 2, 2**63 - 1).otherwise(F.col("n_chars"))), "tree": F.lit(1), "level": F.lit(2)})
    df = df.withColumn("lang", F.when(F.col("doc_id") == 5, "").when(F.col("doc_id") == 7, "é").otherwise(F.col("lang")))
    found = check(spark, tmp_path, df)
    assert any(r.verified for r in found) and any(not r.verified for r in found)


def test_blocks(spark, tmp_path):
    """A group of three blocks, one of exactly one block, one of a block and a leaf, and a lone leaf."""
    size = F.when(F.col("id") < 9001, "a").when(F.col("id") < 9001 + 4096, "b").when(F.col("id") < 9001 + 4096 + 4097, "c").otherwise("d")
    check(spark, tmp_path, spark.range(9001 + 4096 + 4097 + 1).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), size.alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))


def test_one_document(spark, tmp_path):
    found = check(spark, tmp_path, documents(spark, [(3, "only")]))
    assert found[0].leaf == found[0].root


def test_empty(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert dm.op11_dataset_manifest(spark, str(tmp_path)).count() == 0


def test_chosen_leaves(spark):
    """Proofs of a few leaves fetch the nodes inside their block, too, and lead to the same root."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("lang"))
    manifest = dm.build(df, F.col("lang"), F.col("doc_id"), F.sha2(F.col("doc_id").cast("string"), 256))
    chosen = manifest.leaves.where("key % 97 = 5 OR key IN (0, 1, 2, 5999)")
    found = dm.prove(manifest, chosen).withColumn("end", dm.fold(F.col("digest"), F.col("proof"))).collect()
    assert len(found) == chosen.count() and {r.end for r in found} == {manifest.root()}


def test_union_of_missing_nodes_is_minimal():
    """Exactly the nodes next to a path that neither are on one nor exceed their level."""
    for size, wanted in ((1, [0]), (2, [1]), (13, [0, 1, 5]), (13, [12]), (64, list(range(64))), (100, [3, 50, 51, 99])):
        sizes = [size]
        while sizes[-1] > 1:
            sizes.append(-(-sizes[-1] // 2))
        on = [{i >> level for i in wanted} for level in range(len(sizes))]
        need = {(level, i ^ 1) for level in range(len(sizes) - 1) for i in on[level]}
        need = {(level, i) for level, i in need if i < sizes[level] and i not in on[level]}
        assert {(level, int(i)) for level, found in dm.missing(np.array(wanted), size) for i in found} == need
