import numpy as np
import pytest
from floodstats.llm import shingles, simhash

WORDS = np.array([f"w{i}" for i in range(5000)])


def sets_of(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    """Smallest id that links of 0.8 or more shared five-word shingles reach, by comparing all pairs."""
    ids, s, root = sorted(texts), {i: sets_of(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            n = len(s[i] & s[j])
            if s[i] == s[j] or n * 9 >= 4 * (len(s[i]) + len(s[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def got(spark, texts, cell=shingles.CELL):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.component_id for r in shingles.jaccard_components(df, cell=cell).collect()}


@pytest.mark.parametrize("cell", [7, shingles.CELL])
def test_links_against_brute_force(spark, texts, cell):
    """Real texts, scattered and contiguous edits of every extent around 0.8, and a hot group next to texts that share its passage."""
    r = np.random.default_rng(2)
    say = lambda n: r.choice(WORDS, n).tolist()
    rows = [t for _, t in sorted(texts.items())][:60]
    for n in (6, 20, 60, 150, 300):
        for part in (0.02, 0.05, 0.1, 0.15, 0.2, 0.25):
            base, k = say(n), max(1, int(n * part))
            at = int(r.integers(0, n))
            scattered = list(base)
            for i in r.choice(n, max(1, k // 5), replace=False):
                scattered[i] = "changed"
            rows += map(" ".join, (base, scattered, base + say(k), say(k) + base, base[:at] + say(k) + base[at:], base[: n - k]))
    hot = say(60)
    for i in range(70):
        rows += [" ".join([*hot[:i % 60], f"c{i}", *hot[i % 60 + 1 :]]), " ".join(hot + say(30))]
    rows = dict(enumerate([*rows, "", " ", "A b c", "a B c"]))
    assert got(spark, rows, cell) == brute(rows)


def test_runs_that_span_batches():
    import pyarrow as pa

    r = np.random.default_rng(5)
    rows = np.sort(r.integers(0, 9, 300) * 100 + r.integers(0, 4, 300))
    cols = [rows // 100, rows % 100, np.arange(300)]
    edges = [0, 1, 2, 40, 41, 41, 150, 299, 300]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in cols], names=list("abc")) for a, b in zip(edges, edges[1:])]
    for by in (1, 2):
        parts = list(shingles._runs(iter(batches), by))
        assert (np.concatenate([p[2] for p in parts]) == cols[2]).all()
        seen = [set(zip(*(c.tolist() for c in p[:by]))) for p in parts]
        assert all(a.isdisjoint(b) for i, a in enumerate(seen) for b in seen[i + 1 :])


def linked(spark, edit, n, trials=20):
    r = np.random.default_rng(n)
    rows = {}
    for i in range(trials):
        base = r.choice(WORDS, n).tolist()
        rows |= {2 * i: " ".join(base), 2 * i + 1: " ".join(edit(base, r))}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    return trials * 2 - simhash.dedup_near(df).count()


SHAPES = {
    "appended": (100, lambda w, r: w + r.choice(WORDS, 20).tolist()),
    "appended to a long text": (1000, lambda w, r: w + r.choice(WORDS, 200).tolist()),
    "appended to a short text": (20, lambda w, r: [*w, "one", "two", "three", "four"]),
    "inserted": (200, lambda w, r: w[:90] + r.choice(WORDS, 30).tolist() + w[90:]),
    "put before": (300, lambda w, r: r.choice(WORDS, 45).tolist() + w),
    "truncated": (300, lambda w, r: w[:250]),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_contiguous_edits_are_found(spark, shape):
    n, edit = SHAPES[shape]
    assert linked(spark, edit, n) == 20


def test_equal_words_in_another_order_are_not_copies(spark):
    r = np.random.default_rng(8)
    base = r.choice(WORDS, 300)
    rows = [" ".join(base), " ".join(r.permutation(base)), *(" ".join(r.choice(WORDS[:200], 2000)) for _ in range(10))]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert simhash.dedup_near(df).count() == len(rows)
