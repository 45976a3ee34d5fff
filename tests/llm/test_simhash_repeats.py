"""The near-duplicate stage compares sets of shingles: how often a text repeats a passage doesn't count."""

import random

import numpy as np

from chunkweave.llm import simhash


def pairs(n, unique, passage, times):
    rng = random.Random(3)
    for _ in range(n):
        own = [f"w{rng.getrandbits(40)}" for _ in range(unique)]
        part = [f"p{rng.getrandbits(40)}" for _ in range(passage)]
        yield " ".join(own + part), " ".join(own + part * times)


def test_repeats_stay_within_the_radius():
    for case in ((200, 30, 30), (300, 40, 10)):
        for a, b in pairs(50, *case):
            s, t = (simhash.shingle_set(x.encode(), 5) for x in (a, b))
            both = len(np.intersect1d(s, t))
            assert both / (len(s) + len(t) - both) > 0.8
            x, y = (simhash.signature(text.encode(), 5)[1] for text in (a, b))
            assert (x ^ y).bit_count() <= simhash.RADIUS


def test_documents_that_repeat_a_passage_are_alike(spark):
    rows = [(2 * i + j, text) for i, ab in enumerate(pairs(20, 200, 30, 30)) for j, text in enumerate(ab)]
    kept = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 40, 2))
