import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from floodstats.llm import common, deleted

END = "\0end"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lower), END]


def rest(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def brute(rows):
    """Scores by plain counting, and by the model with weights that plain loops fit on the exact held-out counts."""
    docs = [(i, tokens(t)) for i, t in rows]
    uni, pair, uni0, pair0 = Counter(), Counter(), Counter(), Counter()
    begins = begins0 = 0
    for i, w in docs:
        if rest(i):
            uni.update(w)
            pair.update(zip(["\0begin", *w], w))
            begins += 1
            if rest(i) != 1:
                uni0.update(w)
                pair0.update(zip(["\0begin", *w], w))
                begins0 += 1
    n, v, n0 = sum(uni.values()), len(uni), sum(uni0.values())
    context = lambda c, u, b: b if c == "\0begin" else u[c]
    bucket = lambda c: 0 if c == 0 else min(deleted.BUCKETS - 1, 1 + int(math.log2(c)))
    exact = Counter()
    for i, w in docs:
        if rest(i) == 1:
            for c, t in zip(["\0begin", *w], w):
                k = context(c, uni0, begins0)
                exact[bucket(k), pair0[c, t] / k if k else 0.0, uni0[t] / max(n0, 1)] += 1
    weights = deleted._start().tolist()
    for k in {b for b, *_ in exact}:
        own = [(x[1], x[2], 1 / (v + 1), m) for x, m in exact.items() if x[0] == k]
        total, w = sum(x[3] for x in own), weights[k]
        for _ in range(600):
            sums = [0.0, 0.0, 0.0]
            for *p, m in own:
                parts = [a * b for a, b in zip(p, w)]
                every = sum(parts)
                sums = [s + m * x / every for s, x in zip(sums, parts)]
            new = [max(s / total, least) for s, least in zip(sums, (0 if k == 0 else 1e-9, 1e-9, 1e-6))]
            before, w = w, [x / sum(new) for x in new]
            if max(abs(a - b) for a, b in zip(before, w)) < 1e-9:
                break
        weights[k] = w
    out = []
    for i, w in docs:
        base = sum(math.log10((uni[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w)
        score = 0.0
        for c, t in zip(["\0begin", *w], w):
            k = context(c, uni, begins)
            a, b, d = weights[bucket(k)]
            score += math.log10(a * (pair[c, t] / k if k else 0) + b * uni[t] / max(n, 1) + d / (v + 1))
        out.append((i, (rest(i) == 0, len(w), sum(uni[t] > 0 for t in w), n, base, score)))
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_against_plain_counting(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(deleted, "PART_TOKENS", 20_000)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute(rows)
    got = deleted.lm_scores(df).collect()
    assert len(got) == len(rows) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    for r, w in zip(sorted(((r.doc_id, r.base_score, r) for r in got), key=order), sorted(((i, x[4], x) for i, x in want), key=order)):
        r, w = r[2], w[2]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-5), r.doc_id


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_two_legs_give_the_same(which, request, monkeypatch):
    df = request.getfixturevalue(which)
    monkeypatch.setattr(deleted, "PART_TOKENS", 9_000)
    monkeypatch.setattr(deleted, "CHUNK_BYTES", 30_000)
    gathered = common.stash(deleted.chunks(df.repartition(4), 30_000))
    assert gathered.count() > 3

    def rows(messages):
        monkeypatch.setattr(deleted, "MESSAGES", messages)
        answers, words = deleted._round_trip(gathered, 10)
        own = answers.toPandas()
        keys = own[["chunk", "fold"]].drop_duplicates().itertuples(index=False)
        look = lambda a, kind, *d: deleted._looked_up(a, kind, *d).tolist()
        return words, {(c, f, k): (look(a, k), look(a, k, True) if f else None) for c, f in keys for k in (0, 1) for a in [own[(own.chunk == c) & (own.fold == f)]]}

    one, two = rows(10**9), rows(0)
    assert one == two and one[0] > 0


def test_two_legs_share_what_was_asked(docs, plans, monkeypatch):
    """Its exchange is written once, and read for merging and for dealing out."""
    monkeypatch.setattr(deleted, "MESSAGES", 0)
    deleted._round_trip(common.stash(deleted.chunks(docs.repartition(4), 30_000)), 10)
    assert "ReusedExchange" in plans.text().split("FlatMapCoGroupsInPandas", 1)[1]


def test_no_rows(nothing):
    assert deleted.lm_scores(nothing).count() == 0


def test_words_of_long_texts_and_without_spaces():
    text = ("x" * 1_500_000 + " Y z\t" + "w " * 700_000).encode()
    h, n = deleted.tokens([text, b"", b"y"])
    assert n.tolist() == [700_004, 1, 2] and h[1] == h[-2] and h[-1] == deleted.END and len(set(h.tolist())) == 5


def test_weights_explain_held_out_counts_best():
    hist = np.array([[3, -4, -40, 90], [3, -999, -40, 10]], float)
    w = deleted.fit_weights(hist, 1e-6)[3]
    like = lambda w: 90 * math.log(w[0] * 0.5 + w[1] * 2**-10 + w[2] * 1e-6) + 10 * math.log(w[1] * 2**-10 + w[2] * 1e-6)
    assert w.sum() == pytest.approx(1) and all(like(w) >= like(np.array([a, 0.999 - a, 0.001])) - 0.05 for a in np.linspace(0, 0.99, 50))


def test_packing_is_lossless():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (deleted._unpack_sorted(deleted._pack_sorted(x), 1000) == x).all() and len(deleted._unpack_sorted(b"", 0)) == 0


@pytest.mark.parametrize("known, lone", [("a4303 b1366", "a19050 b1532"), ("a18885 b11522", "a19770 b6695"), ("a30639 b7968", "a15758 b6665")])
def test_bigrams_that_share_a_key(known, lone, spark):
    """Their keys have the first 56 bits in common: a deleted text's unseen context must not get the other's count."""
    one = next(i for i in range(40) if rest(i) == 1)
    rows = [(i, f"so and {lone if i == one else 'so'} x{i}" if rest(i) == 1 else f"so and {known} x{i}") for i in range(40)]
    want = dict(brute(rows))
    got = deleted.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][5], rel=1e-5), r.doc_id
