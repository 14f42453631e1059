import hashlib
import re

import numpy as np
import pytest
from floodstats.llm import mixing, spans, syncmers
from pyspark.sql import functions as F


def brute_spans(rows, floor=0):
    """(id, text without repeated runs) by comparing the runs themselves, smaller ids first."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        units = spans.sentences(text or "")
        words = [" ".join(w).lower() for _, w in units]
        gone, size = set(), len(units)
        total = np.cumsum([0, *(len(w) for _, w in units)])
        enough = lambda a, b: b - a >= 3 and total[b] - total[a] >= floor
        every = [(a, b) for a in range(size) for b in range(a + 1, size + 1) if enough(a, b)] if size < 120 else [(a, b) for a in range(size) for b in range(a + 1, min(size, a + 40) + 1) if enough(a, b)]
        least, most = {}, {}
        for a, b in every:
            least[a], most[b] = min(b, least.get(a, b)), max(a, most.get(b, a))
        shortest = sorted({*least.items()} | {(a, b) for b, a in most.items()})
        for a, b in shortest:
            run = tuple(words[a:b])
            if run in first and first[run] != (i, a):
                gone |= set(range(a, b))
            first.setdefault(run, (i, a))
        starts = [s for s, _ in units] + [len(text or "")]
        out[i] = text if not gone else text[: starts[0]] + "".join(text[starts[k] : starts[k + 1]] for k in range(len(units)) if k not in gone)
    return out


@pytest.mark.parametrize("floor", [0, 25])
def test_spans_against_brute_force(docs, texts, floor):
    got = spans.dedup_spans(docs, words=floor).collect()
    assert {r.doc_id: r.text for r in got} == brute_spans(texts.items(), floor)
    assert any(r.n_removed for r in got)


def test_short_sentences_and_shared_ids(spark):
    """Three sentences of a few words are a run; of two texts under one id, one keeps what they share."""
    own = lambda n: " ".join(f"Some {n} plain line number {n * 7 + i} here." for i in range(4))
    short, long = "It rains. The tide is in. We wait.", " ".join(f"Shared line {i} of six words." for i in range(6))
    rows = [(1, f"{own(1)} {short}"), (2, f"{own(2)} {short}"), (3, f"{own(3)} {long}"), (3, f"{own(4)} {long}"), (3, f"{own(4)} {long}")]
    got = [(r.doc_id, r.n_removed) for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got)[:2] == [(1, 0), (2, 3)] and sorted(n for i, n in got if i == 3) in ([0, 6, 6], [0, 0, 6])


def test_a_repeated_passage_goes_and_the_rest_stays(spark):
    r = np.random.default_rng(4)
    say = lambda n, k: " ".join(" ".join(f"w{x}" for x in r.integers(0, 9999, k)) + "." for _ in range(n))
    passage, own = say(6, 9), [say(5, 8) for _ in range(300)]
    texts = [f"{a}\n{passage}\n{a[::-1]}" if i % 3 == 0 else a for i, a in enumerate(own)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in spans.dedup_spans(df).collect():
        kept = passage in row.text
        assert kept == (row.doc_id == 0) and own[row.doc_id] in row.text.replace("\n", " ").strip() + row.text
        assert row.n_removed == (6 if row.doc_id % 3 == 0 and row.doc_id else 0)


def test_spans_of_odd_rows(odd, nothing):
    rows = spans.dedup_spans(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 16 and by[3].text is None and by[4].text == "" and by[1].n_removed == 0 and by[2].n_removed == by[2].n_sentences
    assert spans.dedup_spans(nothing).count() == 0


def test_sentences_keep_every_word():
    for text in ("A b. C d!\n\n e\tf? g " + "x " * 50, "", " . ", "no end"):
        units = spans.sentences(text)
        assert [w for _, u in units for w in u] == text.split() and all(text[s:].lstrip().startswith(u[0]) for s, u in units)


# Mixing


def test_marginals_meet_their_targets(spark, docs):
    rows = mixing.drawn(docs, keep=0.5, power=0.5).toPandas()
    assert len(rows) == docs.count()
    total = rows.n_tokens.sum()
    mass = rows.n_tokens * rows.weight
    for d in mixing.DIMS:
        have = mass.groupby(rows[d]).sum()
        want = rows.n_tokens.groupby(rows[d]).sum() ** 0.5
        assert np.allclose(have, want / want.sum() * total, rtol=2 * mixing.TOLERANCE)
    assert rows.miss.max() <= mixing.TOLERANCE
    expected = (rows.n_tokens * rows.probability).sum()
    assert expected == pytest.approx(0.5 * total, rel=1e-3) and rows.probability.between(0, 1).all()
    assert rows[rows.probability == 1].sampled.all()
    again = mixing.drawn(docs.repartition(5), keep=0.5, power=0.5).toPandas()
    assert set(again[again.sampled].doc_id) == set(rows[rows.sampled].doc_id)


def test_rake_against_plain_loops():
    r = np.random.default_rng(1)
    mass = r.random((3, 4, 2)) * 100
    idx = np.indices(mass.shape).reshape(3, -1)
    targets = [r.random(n) + 0.5 for n in mass.shape]
    targets = [t / t.sum() * mass.sum() for t in targets]
    got, miss = mixing.rake(mass.ravel(), list(idx), targets, 200, 0)
    assert miss < 1e-12
    want = mass.copy()
    for _ in range(200):
        for a, t in enumerate(targets):
            other = tuple(b for b in range(3) if b != a)
            want *= np.expand_dims(t / want.sum(other), other)
    assert np.allclose(got, want.ravel()) and np.allclose(want.sum((1, 2)), targets[0])


def test_many_cells_give_the_same_weights(spark, docs):
    cells = mixing.measured(docs).groupBy(*mixing.DIMS).agg(F.sum("n_tokens").alias("tokens"))
    few, one = mixing.weights(cells, 0.5, 0.7)
    many, two = mixing.weights(cells, 0.5, 0.7, max_cells=0)
    assert one and not two
    both = few.toPandas().merge(many.toPandas(), on=list(mixing.DIMS))
    assert len(both) == cells.count() and both.miss_x.max() <= mixing.TOLERANCE and both.miss_y.max() <= mixing.TOLERANCE
    for c in ("weight", "probability", "expected"):
        assert np.allclose(both[f"{c}_x"], both[f"{c}_y"], rtol=1e-9), c


def test_empty_texts_on_either_path(spark, nothing):
    empty = spark.createDataFrame([(i, "", "en", "s") for i in range(5)], "doc_id long, text string, lang string, source string")
    for df in (empty, nothing):
        one, two = (sorted(map(repr, mixing.drawn(df, max_cells=n).drop("weight", "expected", "probability", "miss").collect())) for n in (1000, 0))
        assert one == two
    assert {(r.probability, r.copies) for r in mixing.drawn(empty, max_cells=0).collect()} == {(1.0, 1)}


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = [("a", "en", "prose", 10), ("b", "de", "prose", 10)]  # each source has one language alone
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    aim = {"source": {"a": 3, "b": 1}, "lang": {"en": 1, "de": 1}}
    assert mixing.weights(cells, 0.5, 1.0, targets=aim)[0].first().miss > 0.3
    assert mixing.weights(cells, 0.5, 1.0, targets={"source": {"a": 3, "b": 1}, "lang": {"en": 3, "de": 1}})[0].first().miss < mixing.TOLERANCE


def test_topics_as_a_column_or_by_rules(spark):
    rows = [(i, "see chapter one" if i % 3 else "a recipe of soup", "en", "s", "t" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    assert {r.topic for r in mixing.drawn(df).collect()} == {"t", ""}
    own = mixing.drawn(df.drop("topic"), keep=1.0, rules=(("food", "recipe|soup"),), targets={"topic": {"food": 1, "prose": 1}}).toPandas()
    mass = (own.n_tokens * own.expected).groupby(own.topic).sum()
    assert mass["food"] == pytest.approx(mass["prose"], rel=3 * mixing.TOLERANCE) and set(own.topic) == {"food", "prose"}
    assert mixing.mix(df, targets={"topic": {"t": 1}}).where("topic is null").count() == 0


def test_mixing_odd_rows(odd, nothing):
    rows = mixing.drawn(odd).collect()
    assert len(rows) == 16 and all(0 <= r.probability <= 1 for r in rows)
    kept = mixing.mix(odd, keep=1.0)
    assert kept.columns == odd.columns and kept.count() == 16
    assert mixing.drawn(nothing).count() == mixing.mix(nothing).count() == 0


# Syncmers


def test_edited_texts(docs, texts):
    rows = {r.doc_id: r for r in syncmers.edited_fingerprints(docs).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    for i, j in zip(ids, ids[1:] + ids[:1]):
        x, q = texts[i], len(texts[i]) // 4
        edited = x[: len(x) - q] + texts[j][:q]
        r = rows[i]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_next <= 1 and (q or r.near_edited == 1) and 0 <= r.near_edited <= 1
        want = lambda a, b: len(a & b) / len(a | b)
        cut = lambda f: set(re.findall("........", f))
        assert r.near_edited == pytest.approx(want(cut(r.fingerprint), cut(r.edited_fingerprint)))
        assert r.near_next == pytest.approx(want(cut(r.fingerprint), cut(rows[j].fingerprint)))
    long = [r for i, r in rows.items() if r.n_chars > 1500]
    assert np.median([r.near_edited for r in long]) > 0.5 and np.median([r.near_next for r in long]) < 0.1
    by_text = {}
    assert all(by_text.setdefault(texts[i], r.fingerprint) == r.fingerprint for i, r in rows.items())


def test_anchors_by_definition(spark):
    words = [f"w{i * 7919 % 101}" for i in range(80)]
    text = " ".join(words)
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w string")
    h = [r.h for r in df.orderBy("i").select(F.xxhash64("w").alias("h")).collect()]
    two = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(h, h[1:]))], "i long, a long, b long")
    inner = [r.h for r in two.orderBy("i").select(F.xxhash64("a", "b").alias("h")).collect()]
    chosen = [i for i in range(len(words) - 5) if min(inner[i : i + 5]) in (inner[i], inner[i + 4])]
    runs = spark.createDataFrame([(k, inner[i], inner[i + 2], inner[i + 4]) for k, i in enumerate(chosen)], "k long, a long, b long, c long")
    want = [r.h & 0x7FFFFFFF for r in runs.orderBy("k").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
    got = spark.createDataFrame([(text,)], "text string").select(syncmers.anchors(F.col("text"))).first()[0]
    assert got == list(dict.fromkeys(want)) and max(np.diff(chosen)) <= 4


def test_anchors_do_not_depend_on_where_a_passage_stands(spark):
    a, b, p = (" ".join(f"{c}{i * 31 % 997}" for i in range(60)) for c in "abp")
    rows = spark.createDataFrame([(0, p), (1, f"{a} {p} {b}")], "doc_id long, text string")
    own = {r.doc_id: r.anchors for r in syncmers.fingerprints(rows).collect()}
    assert set(own[0]) <= set(own[1])


def test_fingerprints_of_odd_rows(odd, nothing):
    rows = syncmers.edited_fingerprints(odd).collect()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 16 and by[1].fingerprint == by[2].fingerprint and by[3].fingerprint == by[4].fingerprint == "" != by[5].fingerprint
    assert by[3].near_edited == by[3].near_next == 1.0 and by[1].near_next == 1.0 and len(by[6].fingerprint) > 10_000
    assert syncmers.edited_fingerprints(nothing).count() == 0
    one = odd.where("doc_id = 1")
    assert [r.near_next for r in syncmers.edited_fingerprints(one).collect()] == [1.0]


def test_next_over_many_buckets(spark):
    ids = [i * i for i in range(500)] + [-7, -7, 10**15]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string").repartition(7)
    got = sorted((r.doc_id, r.next_text) for r in syncmers.with_next(df, ["text"], per_bucket=10).collect())
    order = sorted(ids)
    assert got == sorted((i, str(j)) for i, j in zip(order, order[1:] + order[:1]))


def test_native_plan(docs):
    plan = syncmers.edited_fingerprints(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)
