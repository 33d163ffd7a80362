"""The classifier's statistics and moments against plain counts, and its accuracy on held-out labels."""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quakeloom.llm import quality_classifier as qc
from tests.llm.helpers import documents, empty, prose, texts


def corpus(n=1500, seed=2):
    """doc_id, text, and whether it is good: prose, or symbols, shouting and repeats."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text, kind = prose(rng, rng.randrange(20, 120)) + ".", rng.randrange(10)
        if kind == 0:
            text = " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in text.split())
        elif kind == 1:
            text = text.upper() + "!!"
        elif kind == 2:
            text = "again " * 60 + text
        rows.append((i, text, kind > 2))
    return rows


def pages(spark, tmp_path, rows, labels):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").withColumns({"lang": F.lit("x"), "score": F.lit(9), "toxic": F.lit(0)}).write.parquet(f"{tmp_path}/labels.parquet")
    return {r.doc_id: r for r in qc.op12_quality_classifier(spark, str(tmp_path)).collect()}


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus()
    found = pages(spark, tmp_path, [r[:2] for r in rows], [(i, int(good)) for i, _, good in rows if i % 3])
    held = [(found[i], good) for i, _, good in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    assert sum(r.predicted == good for r, good in held) >= 0.97 * len(held)
    assert min(r.score for r in found.values()) >= 0 and max(r.score for r in found.values()) <= 1
    assert all(r.predicted == (r.score >= 0.7) for r in found.values())
    bad = [r.score for r, good in held if not good]
    assert sum(r.score > s for r, good in held if good for s in bad) >= 0.99 * len(bad) * sum(good for _, good in held)


def test_held_out_and_negative_labels_teach_nothing(spark, tmp_path):
    rows = corpus(400)
    labels = [(i, int(good)) for i, _, good in rows]
    a = pages(spark, tmp_path / "a", [r[:2] for r in rows], labels)
    swapped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels if q or i % 2]
    b = pages(spark, tmp_path / "b", [r[:2] for r in rows], swapped)
    assert {i: r.score for i, r in a.items()} == {i: r.score for i, r in b.items()}


def test_awkward_rows(spark, tmp_path):
    rows = list(enumerate(texts())) + [(None, "null id"), (3, "same id"), (3, "same id"), (900, "\x00 \x7f"), (901, "😀" * 5000)]
    labels = [(i, 1) for i in range(20)] + [(None, 1), (3, None), (4, 0), (12345, 1)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    found = qc.op12_quality_classifier(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.held_out is not None for r in found)
    assert {r.doc_id for r in qc.trusted(spark.createDataFrame(labels, "doc_id long, quality int")).collect()} == set(range(20)) - {4} | {12345}


def test_without_positives_or_documents(spark):
    binned = qc.statistics(documents(spark))
    none = spark.createDataFrame([], "doc_id long")
    assert {r.score for r in qc.scored(binned, qc.train(binned, none)).collect()} <= {0.99 * 0.5 + 0.01 * 0.25}
    assert qc.scored(qc.statistics(empty(spark)), qc.train(qc.statistics(empty(spark)), none)).count() == 0


def test_statistics():
    rows = ["The cat sat.\nThe cat sat.\n\nABC ## a|b", None, "", "x x x x x x x x"]
    stats = [dict(zip(qc.STATS, map(int, r))) for r in qc._count(pa.array(rows))]
    a = stats[0]
    assert a["n_words"] == 9 and a["n_lines"] == 3 and a["dup_lines"] == 333 and a["lines_without_stop"] == 333
    n = len(rows[0])
    assert (a["symbols"], a["pipes"], a["upper"]) == (2000 // n, 1000 // n, 5000 // n)
    assert a["capital_words"] == 333 and a["new_words"] == 1000 * 6 // 9 and a["commonest_word"] == 222 and a["odd_words"] == 111
    assert set(stats[1].values()) == set(stats[2].values()) == {0}
    assert stats[3]["same_as_last"] == 875 and stats[3]["repeated_windows"] == 500 and stats[3]["commonest_word"] == 1000


def test_moments_are_counts_of_pairs(spark):
    binned = qc.statistics(documents(spark))
    x = np.concatenate([qc._expanded(pa.record_batch({"bins": pa.array([bytes(r.bins)], pa.binary())})) for r in binned.collect()]).astype(int)
    assert (qc.moments(binned) == x.T @ x).all()


def test_risk_stays_non_negative():
    """Where the unbiased risk's negative part is below zero, the fit moves to where the non-negative risk is less."""
    rng = np.random.default_rng(1)
    features = lambda n, p: np.concatenate([np.ones((n, 1)), rng.random((n, qc.FEATURES - 1)) < p], axis=1)
    u, p = features(300, 0.5), features(30, 0.55)
    u, p = u.T @ u, p.T @ p
    ratio, prior = qc.density_ratio(u, p), 0.9
    weights = qc.non_negative(ratio, u, p, prior)
    one = np.eye(qc.FEATURES)[0]

    def negative(w):
        g = 2 * prior * w - one
        loss = lambda m: (1 + 2 * g @ m[0] / m[0, 0] + g @ m @ g / m[0, 0]) / 4
        return loss(u) - prior * loss(p)

    assert negative(ratio) < 0 and negative(weights) > negative(ratio)


def test_prior_of_a_mixture():
    places = np.arange(qc.PLACES)
    good, bad = np.exp(-(((places - 380) / 30) ** 2)), np.exp(-(((places - 150) / 40) ** 2))
    for prior in (0.3, 0.6, 0.9):
        mixed = 1e6 * (prior * good / good.sum() + (1 - prior) * bad / bad.sum())
        assert abs(qc.class_prior(mixed, 1e6 * good / good.sum()) - prior) < 0.02
        scores = qc.pooled(mixed, 1e6 * good / good.sum(), prior)
        assert (np.diff(scores) >= 0).all() and scores[150] < 0.01 and scores[380] > 0.98
