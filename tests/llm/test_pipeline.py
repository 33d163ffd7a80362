"""The pipeline's stages in a row, each against what brute force makes of its own input."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quakeloom.llm import quality_rules, simhash
from tests.llm.helpers import documents, prose
from tests.llm.test_group_operators import brute_tiles, near_copies, tokens
from tests.llm.test_near_dedup import brute_groups
from tests.llm.test_text_operators import brute_pieces, brute_secrets, brute_stats


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, 30)) for i in range(3)]
    rows = near_copies()
    rows += [(1000 + i, prose(rng, 40) + " " + t + " " + prose(rng, 40)) for i, t in items] + [(2000, prose(rng, 50) + " password = abcdefghijklmn"), (None, prose(rng, 60))]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), items


def test_stages(spark, tables, tmp_path):
    folder, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, folder).write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        if n < 4:
            assert docs.columns == columns
            after = [(r.doc_id, r.text) for r in docs.collect()]
        if name == "quality rules":  # five labels certify no cutoff: the base rule alone decides
            failed = lambda t: (s := brute_stats(t))[0] < 10 or 100 * s[4] > 20 * s[0]
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if not failed(r[1]))
        elif name == "SimHash near-dedup":
            key = lambda i: i if i is not None else 10**9
            found, _ = brute_groups([(key(i), t) for i, t in before])
            assert sorted(key(i) for i, _ in after) == sorted(set(found.values()))
        elif name == "benchmark decontamination":
            leaks = {t for _, t in before for _, item in items if brute_tiles(tokens(item), tokens(t)) * 2 >= len(tokens(item))}
            assert leaks and sorted(map(repr, after)) == sorted(repr(r) for r in before if r[1] not in leaks)
        elif name == "secret scans":
            assert {i: t for i, t in before if not brute_secrets(t)}.items() <= dict(after).items()
            assert len(after) == len(before) and any("password = [SECRET]" in (t or "") for _, t in after) and not re.search("abcdefghijklmn", " ".join(t or "" for _, t in after))
        else:
            assert sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in docs.collect()) == sorted(repr((i, *p)) for i, t in before for p in brute_pieces(t, 1024))


def test_run_equals_stages(spark, tables):
    folder, _ = tables
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 0 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_rows_that_share_an_id_pass_all_stages(spark, tmp_path):
    """Null and repeated doc_ids of different texts: a row per group comes out, no text is lost."""
    import random

    rng = random.Random(31)
    rows = [(rng.choice([None, None, 3, 4, 5]), prose(rng, 80)) for _ in range(40)]
    documents(spark, rows + rows[:7]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in docs.collect()))) == sorted(map(repr, rows))


def test_empty_tables_pass_all_stages(spark, tmp_path):
    documents(spark, []).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_use_the_operators_defaults():
    assert simhash.keep_one.__defaults__ == (simhash.DISTANCE,) and quality_rules.RiskPlan() in quality_rules.keep.__defaults__
