"""Periodic runs against a scan word by word; odd rows; texts dealt by ranges of lags."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from floodstats.llm import runs


def plain(words, min_length=12):
    """{(start, length): smallest period} of every run, by trying every period at every word."""
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_length, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, p, n) for (s, n), p in out.items())


def want(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = [(s, m, p) for s, p, m in plain(words)]
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, m, p in found for i in range(s + p, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found).encode()
    return (doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_every_period(docs, texts):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in runs.run_digests(docs).collect()}
    short = [i for i, t in texts.items() if len((t or "").split()) < 400]
    assert len(got) == len(texts) and len(short) > 80
    assert sum(got[i][1] > 0 for i in short) > 3
    for i in short:
        assert got[i] == want(i, texts[i])


def test_odd_rows(odd, nothing):
    got = runs.run_digests(odd).collect()
    assert len(got) == 16
    rows = sorted((tuple(r[c] for c in COLUMNS) for r in got if r.doc_id != 6), key=repr)
    assert rows == sorted((want(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 6), key=repr)
    assert next(r for r in got if r.doc_id == 6).n_words == 90_000
    assert runs.run_digests(nothing).count() == 0


def test_scan_of_random_words():
    r = random.Random(5)
    for _ in range(1500):
        words = [b"%d" % r.randrange(r.choice([1, 2, 3])) for _ in range(r.randrange(70))]
        ids = runs.numbered(words)
        got = [(s, p, n) for s, n, p in runs.runs_of(ids).tolist()]
        assert got == plain(words)
        parts = runs.lag_ranges(len(ids), 4)
        assert not len(ids) // 2 or (parts[0][0] == 1 and parts[-1][1] == len(ids) // 2 + 1 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])))
        both = np.concatenate([np.zeros((0, 3), np.int64), *(runs.scan(ids, a, b) for a, b in parts)])
        assert (runs.smallest(both) == runs.runs_of(ids)).all()


def test_blocks_of_lags_end_where_rows_do(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 50)
    words = [b"a"] * 30 + [b"b", b"c"] * 20 + [b"d"] * 3
    assert [(s, p, n) for s, n, p in runs.runs_of(runs.numbered(words)).tolist()] == plain(words)


@pytest.mark.parametrize("least, exponent", [(12, 2), (4, 2), (1, 3)])
def test_long_texts_by_ranges_of_lags(spark, least, exponent):
    r = random.Random(7)
    rows = [(i, " ".join(str(r.randrange(3)) for _ in range(r.randrange(20, 200))) + " x y z" * (i % 9)) for i in range(12)] + [(3, "no runs in here"), (None, "again " * 60), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda x: sorted(map(repr, x.collect()))
    whole = runs.periodic_runs(df, least, exponent)
    dealt = runs.periodic_runs(df, least, exponent, long=10, words_of_a_range=40)
    assert key(whole) == key(dealt)
    assert any(len(x.runs) > 1 for x in dealt.collect())


def test_many_chance_matches_are_no_runs():
    r = np.random.default_rng(1)
    ids = r.integers(0, 3, 5000).astype(np.int16)
    assert [(s, p, n) for s, n, p in runs.runs_of(ids).tolist()] == plain(ids.tolist())
