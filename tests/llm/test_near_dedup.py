"""The pipeline's near-dedup stage: which rows stay, and which near copies are found."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from quakeloom.llm import near_copies as copies, simhash
from tests.llm.helpers import documents, prose
from tests.llm.test_group_operators import WORD, brute_components, brute_fingerprint, near_copies


def test_a_row_of_every_group_stays(spark):
    """Rows without a doc_id, or with one that others have too, stand for their own group only."""
    rows = [(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (None, "x y z"), (None, "u v w"), (None, "u v w"), (7, "k l m n"), (7, "a b c d e"), (7, "o p q r"), (9, None), (8, "")]
    for _ in range(2):
        kept = simhash.keep_one(documents(spark, rows)).select("doc_id", "text").collect()
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(3, "a b c d e"), (None, "x y z"), (None, "u v w"), (7, "k l m n"), (7, "o p q r"), (8, "")]))


def brute_groups(rows):
    """Ids joined by fingerprints within 4 bits, or by a five-word Jaccard similarity of 0.8."""
    parent = brute_components({i: brute_fingerprint(t) for i, t in rows})
    sets = {}
    for i, t in rows:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    links = 0
    for i in sets:
        for j in sets:
            if i < j and parent[i] != parent[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0:
                links += 1
                low, high = sorted((parent[i], parent[j]))
                parent = {k: low if p == high else p for k, p in parent.items()}
    return parent, links


@pytest.mark.parametrize("most", (2_000_000, 0))
def test_stage_joins_all_pairs_of_similarity(spark, monkeypatch, most):
    monkeypatch.setattr(copies, "BROADCAST_TEXTS", most)
    rng = random.Random(5)
    passage = prose(rng, 40)
    rows = near_copies() + [(500 + i, passage + " " + prose(rng, 60)) for i in range(40)] + [(600, "one two THREE"), (601, "One two three"), (602, "one two four")]
    long = prose(rng, 1600).split()
    rows += [(700, " ".join(long)), (701, " ".join(w if i % 80 else "other" for i, w in enumerate(long)))]
    groups, links = brute_groups(rows)
    kept = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").select("doc_id").collect()
    assert links > 0 and sorted(r.doc_id for r in kept) == sorted(set(groups.values()))


def test_sketches_bound_the_difference(spark):
    rng = random.Random(8)
    base = prose(rng, 3000).split()
    rows = [(i, " ".join(w for w in base[: 700 * i + 300] if rng.random() > 0.02 * i)) for i in range(6)] + [(9, None), (10, prose(rng, 4000))]
    drawn = {r.text_key: r for r in copies.sketches(copies._texts(documents(spark, rows))).collect()}
    keys = {i: k for i, k in documents(spark, rows).selectExpr("doc_id", "xxhash64(text)").collect()}
    sets = {i: set(copies.shingles(pa.array([t], pa.string()))[0].tolist()) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b]))]
    alike = [(a, b) for a, b in pairs if len(sets[a] ^ sets[b]) * 9 <= len(sets[a]) + len(sets[b])]
    asked = spark.createDataFrame([(keys[a], keys[b], a, b) for a, b in pairs], "a long, b long, part_a long, part_b long")
    left = {(r.part_a, r.part_b) for r in copies.likely(asked, spark.createDataFrame(list(drawn.values()))).collect()}
    assert {len(drawn[k].sketch) for k in drawn} > {16, 32} and set(alike) <= left
    assert all(drawn[keys[i]].n == len(s) for i, s in sets.items())


def test_planted_near_copies_are_found(spark):
    """Copies with a few words changed: nine in ten or more are caught, by hundreds of groups."""
    rng = random.Random(21)
    rows, n = [], 0
    for _ in range(150):
        words = prose(rng, rng.randrange(60, 300)).split()
        rows.append((n, " ".join(words)))
        for _ in range(2):
            n += 1
            changed = list(words)
            for _ in range(max(1, len(words) // 60)):
                changed[rng.randrange(len(words))] = f"other{rng.randrange(10**6)}"
            rows.append((n, " ".join(changed)))
        n += 1
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()}
    copies_left = sum(i in kept for i, _ in rows if i % 3)
    assert {i for i, _ in rows if i % 3 == 0} <= kept and copies_left <= 0.1 * 300


def test_grid_is_refined_with_the_number_of_fingerprints(spark):
    """Chance partners per fingerprint, and the rows it makes, grow by far less than the fingerprints."""
    from math import comb

    rng = random.Random(4)
    work = []
    for n in (4000, 40000):
        groups = simhash.grid_groups(n)
        distinct = spark.createDataFrame([(rng.getrandbits(64) - 2**63,) for _ in range(n)], "fp long")
        sizes = simhash.cells(distinct, simhash.DISTANCE, groups).groupBy("cell").count()
        pairs = sizes.selectExpr("sum(count * (count - 1) / 2) AS pairs").first().pairs
        work.append((pairs / n, comb(groups, simhash.DISTANCE)))
    assert sum(work[1]) < 10**0.6 * sum(work[0])
    # many more never bring back what grows with the square
    assert all(comb(g := simhash.grid_groups(10**k), 4) * (1 + 10**k * 0.375 ** (32 * (g - 4) / g) / 2) < 8 * 10 ** (0.4 * k) for k in range(3, 12))
