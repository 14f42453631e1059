import numpy as np
import pytest
import xxhash
from floodstats.llm import common, simhash


def brute(fps, bits):
    """Smallest reachable id, by comparing all pairs."""
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64).reshape(len(ids), -1)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(f[a + 1 :] ^ f[a]).sum(1) <= bits):
            x, y = find(i), find(ids[a + 1 + b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def reference_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    votes = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def test_contract_against_brute_force(docs, texts):
    rows = simhash.simhash_components(docs).collect()
    want = {i: reference_fingerprint(t) for i, t in texts.items()}
    comp = brute(want, 4)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{want[i]:016x}", comp[i]) for i in texts}


def test_odd_rows(odd, nothing):
    rows = simhash.simhash_components(odd).collect()
    assert len(rows) == 16
    own = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert own[3].fingerprint == own[4].fingerprint == own[5].fingerprint == "0" * 16 and own[5].component_id == 3
    assert own[2].component_id == own[1].component_id == 1 and own[11].component_id == 10
    assert {r.component_id for r in rows if r.doc_id is None} == {None, 3}
    assert simhash.simhash_components(nothing).count() == 0


def test_rows_without_an_id_link_others(spark):
    rows = [(1, [0]), (None, [0b1111]), (2, [0b11111111]), (None, [-1]), (5, [-1]), (9, [0x5555 << 40]), (None, [0x5AAAA << 20])]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_components(spark.createDataFrame(rows, "doc_id long, fp array<long>")).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (2, 1), (None, 5), (5, 5), (9, 9), (None, None)], key=str)


def test_an_id_with_several_texts_loses_none_that_is_unique(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (7, a), (7, b), (7, b), (8, c), (8, b + " more"), (None, a)]
    kept = simhash.dedup_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, a), (7, b), (7, b), (8, c), (None, a)], key=str)


@pytest.mark.parametrize("cell", [4, 16384])
def test_hot_group_of_near_fingerprints(spark, cell):
    """A chain of near fingerprints under one key, in many cells, stays one component and makes few links."""
    r = np.random.default_rng(3)
    base = int(r.integers(0, 2**63))
    fps, x = {}, base
    for i in range(120):
        x ^= 1 << int(r.integers(0, 64))
        fps[i] = x
    fps |= {200 + i: int(r.integers(0, 2**63)) for i in range(50)}
    df = spark.createDataFrame([(i, [np.array([v], np.uint64).view(np.int64)[0].item()]) for i, v in fps.items()], "doc_id long, fp array<long>")
    got = {r.doc_id: r.component_id for r in simhash.near_components(df, cell=cell).collect()}
    assert got == brute(fps, 4)


def test_forest_connects_like_all_links():
    r = np.random.default_rng(7)
    for _ in range(30):
        n = 60
        f = (r.integers(0, 4, (n, 1)) * 0x1111 ^ (1 << r.integers(0, 12, (n, 1)))).astype(np.uint64)
        node = r.permutation(n)
        links = simhash._forest(node, f, 2)
        assert len(links) < 2 * n
        root = list(range(n))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        want = brute({int(k): int(v[0]) for k, v in zip(node, f)}, 2)
        assert {i: find(i) for i in range(n)} == want


def test_near_copies_go_and_others_stay(spark):
    r = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(r.choice(words, 150)) for _ in range(40)]
    copies = []
    for k in range(30):
        w = texts[k % 5].split()
        for i in r.choice(150, 2, replace=False):
            w[i] = "changed"
        copies.append(" ".join(w))
    rows = [(i, t, 1, "x") for i, t in enumerate([*texts, *copies, None, ""])]
    df = spark.createDataFrame(rows, "doc_id long, text string, _own_id int, fp string")
    kept = simhash.dedup_near(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [*range(40), 70]


def test_components_of_a_hub_and_of_swapped_rows(spark):
    """Hubs with the least and with the greatest id, and rounds that change rows without changing their number."""
    edges = [(0, i) for i in range(1, 400)] + [(10_000, 1000 + i) for i in range(400)] + [(5000 + i, 5000 + (i * 7 + 3) % 50) for i in range(50)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root if any(i in e and e[0] != e[1] for e in edges)}


def test_tables_of_a_scope_go(spark):
    from floodstats.sources.sinks import exists

    with common.scratch(spark) as own:
        df = common.stash(spark.range(3).toDF("a"))
        other = common.stash(spark.range(3).toDF("a"))
        path = own.pop()
        assert exists(spark, own[0]) and exists(spark, path)
        gone = own[0]
    assert not exists(spark, gone) and other.count() == 3 and df.columns == ["a"]
    common.delete(spark, [path])


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (7, 7), (200, 150)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 103: 100, 150: 150, 200: 150}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_hub_is_split(spark, small_skew, plans):
    """Half of all links are those of one node: the joins of a round deal them to several tasks."""
    edges = spark.range(1, 40_000).selectExpr("if(id % 2 = 0, 0, id - id % 7) AS a", "id AS b").repartition(16)
    comp = common.components(edges)
    assert comp.where("component = 0").count() > 15_000 and "skew=true" in plans.text()


def test_the_stage_takes_what_fingerprints_link(spark, monkeypatch):
    """Copies with a word changed go even if the join of rare shingles finds no pair; a linked pair is still verified."""
    from floodstats.llm import shingles

    words = [f"w{i * i % 7919}" for i in range(3000)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:1500], "other", *words[1501:]])), (3, " ".join(reversed(words))), (4, "a b"), (5, "a b"), (None, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.a, r.b) for r in simhash.fingerprint_pairs(df).collect()} == {(1, 2), (4, 5)}

    def none(least):
        def run(batches):
            for _ in batches:
                pass
            yield from ()

        return run

    monkeypatch.setattr(shingles, "_meetings", none)
    got = sorted((r.doc_id for r in simhash.dedup_near(df).collect()), key=str)
    assert got == [1, 3, 4, None]
