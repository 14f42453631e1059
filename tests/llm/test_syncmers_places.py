"""Anchors matched by their places."""

from collections import Counter

import numpy as np
from floodstats.llm import syncmers
from pyspark.sql import functions as F


def by_hand(a, b):
    first = lambda v: {x >> 32: x & 0xFFFFFFFF for x in reversed(v)}
    p, q = first(a), first(b)
    d = Counter(q[h] - p[h] for h in p.keys() & q.keys())
    n = max(d.values(), default=0)
    return n, min((s for s, m in d.items() if m == n), default=None)


def test_against_loops(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(120):
        a, b = (sorted(int(h) << 32 | int(p) for h, p in zip(r.integers(0, [3, 40, 2**31][i % 3], n), r.integers(0, [5, 2**31][i % 2], n))) for n in r.integers(0, 60, 2))
        rows.append((i, [a[j] for j in r.permutation(len(a))], [b[j] for j in r.permutation(len(b))]))
    order = lambda v: sorted(v, key=lambda x: x & 0xFFFFFFFF)
    rows = [(i, order(a), order(b)) for i, a, b in rows] + [(200, [], []), (201, [7 << 32], [7 << 32 | 5])]
    df = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    got = {x.i: tuple(x.m) for x in df.select("i", syncmers.aligned(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {i: by_hand(a, b) for i, a, b in rows}


def test_a_moved_passage_gives_its_shift(spark):
    word = lambda c, i: f"{c}{i * 7919 % 10007}"
    p = [word("p", i) for i in range(200)]
    texts = [p, [word("x", i) for i in range(37)] + p[50:] + [word("y", i) for i in range(90)], [word("z", i) for i in range(300)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = {x.doc_id: x for x in syncmers.edited_fingerprints(df).collect()}
    assert rows[0].next_shift == 37 - 50 and rows[0].next_aligned > 40 and (rows[1].next_aligned, rows[1].next_shift) == (0, None)
    assert all(x.edited_shift == 0 and x.edited_aligned > 0.6 * x.n_anchors for x in rows.values())


def test_places_are_symbol_numbers(spark):
    text = " ".join(f"w{i}" for i in range(300))
    tail = " ".join(f"w{i}" for i in range(120, 300))
    a, b = (x.packed for x in syncmers.fingerprints(spark.createDataFrame([(0, text), (1, tail)], "doc_id long, text string")).orderBy("doc_id").collect())
    at = {v >> 32: v & 0xFFFFFFFF for v in a}
    assert all(at[v >> 32] == (v & 0xFFFFFFFF) + 120 for v in b) and sorted(at.values()) == list(at.values())


def test_aligned_of_odd_rows(odd, docs):
    for x in syncmers.edited_fingerprints(odd).collect():
        assert 0 <= x.edited_aligned <= x.n_anchors and (x.edited_aligned == 0) == (x.edited_shift is None)
    rows = syncmers.edited_fingerprints(docs).collect()
    assert all(0 <= x.next_aligned <= x.n_anchors for x in rows) and np.mean([x.edited_shift == 0 for x in rows if x.n_chars > 400]) > 0.95
