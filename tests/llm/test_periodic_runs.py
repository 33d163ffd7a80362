"""Periodic runs against all periods of all places, and the planted query against a reading of its rules."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quakeloom.llm import periodic_runs
from tests.llm.helpers import documents, empty, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """start, length, period of every run."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)  # the smallest period comes first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def repetitive(rng, n):
    letters = rng.choice([1, 2, 2, 3, 5])
    words = []
    while len(words) < n:
        words += [rng.randrange(letters) for _ in range(rng.randrange(1, 12))] * rng.randrange(1, 7)
        if rng.random() < 0.3:
            words += words[-30:]
    return words[:n]


@pytest.mark.parametrize("seed", range(8))
def test_runs_of_small_alphabets(seed):
    rng = random.Random(seed)
    for _ in range(60):
        docs = [repetitive(rng, rng.randrange(0, 120)) for _ in range(rng.randrange(1, 5))]
        words, of = np.array([x for w in docs for x in w], np.int64), np.array([i for i, w in enumerate(docs) for _ in w], np.int64)
        first = np.searchsorted(of, np.arange(len(docs) + 1))
        found = list(zip(*(x.tolist() for x in periodic_runs.runs(words, of, first))))
        for i, doc in enumerate(docs):
            assert [(s - first[i], e - s, q) for s, e, q in found if first[i] <= s < first[i + 1]] == brute(doc)


def test_grammar_gives_back_the_words():
    rng = random.Random(3)
    words = np.array(repetitive(rng, 400), np.int64)
    g = periodic_runs.re_pair(words, np.zeros(400, np.int64))
    for rule, place in zip(g.rules, g.places):  # every derivation position holds the rule's words
        length = g.end[rule] - g.first[rule]
        assert (words[place : place + length] == words[g.first[rule] : g.end[rule]]).all()
    assert np.bincount(g.rules).min() >= 2
    assert len(g.starts) + 2 * len(g.first) < 400


@pytest.mark.parametrize("words", [[0] * 100_000, [i % 101 for i in range(100_000)], ([0] * 100 + [1]) * 500], ids=["equal", "cycle", "nested"])
def test_long_repetitive_texts(words):
    w = np.array(words, np.int64)
    start, end, period = periodic_runs.runs(w, np.zeros(len(w), np.int64), np.array([0, len(w)]))
    assert (start[0], end[0]) == ((0, 100) if words[100:102] == [1, 0] else (0, len(w)))
    assert len(start) == (501 if words[100:102] == [1, 0] else 1) and (end - start >= 4 * period).all()


def expected(doc_id, text):
    words = WORD.findall(text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, t if t is None or len(t) < 20_000 else t[:20_000]) for i, t in enumerate(texts())]
    rows += [(1000 + i, " ".join(f"w{x}" for x in repetitive(rng, rng.randrange(1, 90)))) for i in range(150)]
    rows += [(None, "a b " * 8), (None, None), (7, "x\ty\x0bx\ny x  y x y x y"), (7, "é " * 9), (-1, "q " * 6), (2**62, "😀 " * 7 + "end")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = periodic_runs.op13_periodic_runs(spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(repr(expected(*r)) for r in rows)
    assert sum(r.n_runs > 0 for r in found) > 50


def test_spans_and_texts(spark):
    rows = [(1, "start a b a b a b a b end"), (2, None), (3, "z z z z z"), (4, "z z z z z z")]
    found = {r.doc_id: r for r in periodic_runs.find(documents(spark, rows)).collect()}
    assert [tuple(r) for r in found[1].runs] == [(1, 8, 2)] and found[1].collapsed == "start a b end"
    assert found[2].runs == [] and found[2].collapsed == ""
    assert found[3].runs == [] and found[4].collapsed == "z"


def test_empty(spark):
    assert periodic_runs.find(empty(spark)).count() == 0
