"""Tiling of repetitive texts against a brute-force version, and of very long ones."""

import time
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quakeloom.llm.decontamination import tiles

LEAST = 3


def numbered(item, doc):
    """Numbers of the seeds of LEAST tokens that both have."""
    grams = [[tuple(x[k : k + LEAST]) for k in range(len(x) - LEAST + 1)] for x in (item, doc)]
    shared = {g: n for n, g in enumerate(sorted(set(grams[0]) & set(grams[1])))}
    return [np.array([shared.get(g, -1) for g in each], np.int64) for each in grams]


def brute(item, doc):
    used_item, used_doc, found = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_item and j + n not in used_doc:
                    n += 1
                if n >= LEAST and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return found
        found.append(best)
        used_item.update(range(best[0], best[0] + best[2]))
        used_doc.update(range(best[1], best[1] + best[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=16), st.lists(st.integers(0, 2), max_size=20))
def test_equals_brute_force(item, doc):
    assert tiles(*numbered(item, doc), LEAST) == brute(item, doc)


@pytest.mark.parametrize("period", [1, 7])
def test_long_repetitive_texts(period):
    """100,000 words of one period against an item of 1,600: the grid would have 160 million places for period 1."""
    item, doc = (np.arange(n - LEAST + 1) % period for n in (1_600, 100_000))
    tracemalloc.start()
    start = time.perf_counter()
    assert tiles(item, doc, LEAST) == [(0, 0, 1_600)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and time.perf_counter() - start < 20


def test_long_texts_both():
    assert tiles(np.zeros(29_998, np.int64), np.zeros(99_998, np.int64), LEAST) == [(0, 0, 30_000)]
