"""Workers serve one stage of the pipeline after another, so what a stage holds and leaves behind adds up."""

import ctypes
import subprocess
import sys
import tracemalloc

import numpy as np
import pytest

from tallyloom.llm import quality_resampling as Q

LEFT = """
import psutil
from tallyloom.llm import common

def run(it):
    kept = []
    for n in it:
        freed = []
        for _ in range(n):
            freed.append(bytes(100_000))
            kept.append(bytes(600))  # lies between, so the heap's end never comes free
        del freed
        yield len(kept)
    last.extend(kept)

last = []
mb = lambda: psutil.Process().memory_info().rss / 1e6
before = mb()
assert list(common.tidy(run)([3000])) == [3000]
print(mb() - before)
"""


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="the C library has no malloc_trim")
def test_freed_memory_goes_back():
    done = subprocess.run([sys.executable, "-c", LEFT], capture_output=True, text=True, check=True, timeout=60, cwd=Q.__file__.rsplit("/tallyloom/", 1)[0])
    assert float(done.stdout) < 100  # of 300


def test_counts_by_text_hold_little_more_than_the_ngrams():
    r = np.random.default_rng(3)
    held = [np.unique(r.integers(0, 1 << 16, n).astype(np.uint64)) for n in r.integers(0, 2000, 500)] + [np.zeros(0, np.uint64)]
    good = [bool(x) for x in r.random(len(held)) < 0.6]
    every = np.concatenate(held)
    want, n = np.unique(every, return_counts=True)
    some, m = np.unique(np.concatenate([x for x, ok in zip(held, good) if ok]), return_counts=True)
    ok = np.zeros(len(want), np.int64)
    ok[np.searchsorted(want, some)] = m
    tracemalloc.start()
    got = Q.counted(held, good)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, (want, n, ok)))
    assert peak < 3 * every.nbytes and not held and not good
    assert [len(x) for x in Q.counted([], [])] == [0, 0, 0]
    assert [len(x) for x in Q.counted([np.zeros(0, np.uint64)], [True])] == [0, 0, 0]
