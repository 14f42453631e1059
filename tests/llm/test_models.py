"""Quality classifier and language identification: held-out accuracy and what they may look at."""

import zlib

import numpy as np
from floodstats.llm import langid, quality
from pyspark.sql import functions as F


def test_quality_on_held_out_rows(spark, docs, labels):
    rows = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    held = [(rows[r.doc_id], r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    good, bad = [r.score for r, q in held if q == 1], [r.score for r, q in held if q == 0]
    assert good and bad and np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_quality_of_odd_rows(odd, nothing, labels):
    rows = quality.quality_scores(odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] and by[1] == by[2]
    assert quality.quality_scores(nothing, labels).count() == 0
    unlabelled = quality.quality_scores(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5} and {r.predicted for r in unlabelled} == {1}
    nulls = labels.withColumn("quality", F.lit(None).cast("int"))
    assert {r.score for r in quality.quality_scores(odd, nulls).collect()} == {0.5}
    kept = quality.keep_good(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == 16


def test_trees_against_walking_each_row():
    r = np.random.default_rng(2)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = quality.grow(x, y, trees=30)

    def walk(row):
        s = t.base
        for at in t.roots:
            while t.left[at]:
                at = t.left[at] + (row[t.feature[at]] > t.threshold[at])
            s += t.value[at]
        return 1 / (1 + np.exp(-s))

    got = t.scores(x)
    assert np.allclose(got[:200], [walk(row) for row in x[:200]]) and ((got > 0.5) == y).mean() > 0.97


def test_language_on_held_out_rows(docs):
    rows = {r.doc_id: r for r in langid.language_predictions(docs).collect()}
    held = [(r.lang, rows[r.doc_id].lang_pred) for r in docs.collect() if rows[r.doc_id].held_out]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())


def test_language_of_odd_rows(spark, odd, nothing):
    rows = langid.language_predictions(odd.unionByName(spark.createDataFrame([(50, "123 !? 4", None, None, 8, 0.0, "", 0, 0)], odd.schema))).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 17 and all(0 <= r.score <= 1 for r in rows)
    assert all(by[i].lang_pred == "und" for i in (3, 4, 5, 50)) and all(by[i].lang_pred in ("en", "de") for i in (1, 6, 7, 9))
    assert langid.language_predictions(nothing).count() == 0
    assert {r.lang_pred for r in langid.language_predictions(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_subwords_against_plain_loops():
    text = "Ab, çde f1g"
    clean = [" ", *(c if c.isalpha() else " " for c in text.lower()), " "]
    n = 0
    for size in (2, 3, 4):
        for i in range(len(clean) - size + 1):
            part = clean[i : i + size]
            n += " " not in part[1:-1] and any(c != " " for c in part)
    assert len(langid.subwords(text)) == n and len(langid.subwords("12 !")) == 0


def test_a_rare_language_is_learned(spark):
    r = np.random.default_rng(6)
    parts = {"aa": "ba ka ta ma".split(), "bb": "sol tir nek wub".split(), "cc": "zhu xio qing yue".split()}
    say = lambda lang: " ".join("".join(r.choice(parts[lang], 3)) for _ in range(30))
    rows = [(i, say(lang), lang) for i, lang in enumerate(["aa"] * 3000 + ["bb"] * 3000 + ["cc"] * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = {x.doc_id for x in langid.sampled(df.select("doc_id", "lang"), 300).collect()}
    n = {k: sum(rows[i][2] == k for i in ids) for k in parts}
    assert n == {"aa": 100, "bb": 100, "cc": 40}
    model = langid.train(df, 300)
    assert model.names == ["aa", "bb", "cc"] and all(model.predict(say(k))[0] == k for k in parts for _ in range(20))


def test_a_prediction_is_the_mean_of_the_table_in_plain_loops():
    r = np.random.default_rng(0)
    model = langid.LanguageModel(["x", "y"], r.normal(size=(langid.BUCKETS, 2)).astype(np.float32), np.array([0.1, -0.2]), 1.7, 0.6)
    for text in ("some text, with words", "Ü", "a b c " * 500):
        z = [sum(float(model.table[i][k]) for i in langid.subwords(text)) / len(langid.subwords(text)) + float(model.bias[k]) for k in (0, 1)]
        e = [np.exp(v / 1.7) for v in z]
        name, score, rejected = model.predict(text)
        k = int(z[1] > z[0])
        assert name == model.names[k] and abs(score - e[k] / sum(e)) < 1e-9 and rejected == (score < 0.6)


def test_a_tree_is_grown_by_the_best_split():
    """The first split of the first tree is the one that plain loops over all cuts find."""
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 3)).round(1)
    y = ((x[:, 1] > 0.3) ^ (r.random(300) < 0.1)).astype(float)
    t = quality.grow(x, y, trees=1, depth=1, bins=64, least=20)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = y - p, np.full(300, p * (1 - p))
    best = (0.0, None, None)
    for j in range(3):
        for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, j] <= cut
            if left.sum() >= 20 and (~left).sum() >= 20:
                gain = sum(g[m].sum() ** 2 / (h[m].sum() + 2) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 2)
                if gain > best[0] + 1e-12:
                    best = (gain, j, cut)
    assert (t.feature[0], t.threshold[0]) == best[1:]
    left = x[:, best[1]] <= best[2]
    assert np.allclose(t.value[1:], [0.15 * g[m].sum() / (h[m].sum() + 2) for m in (left, ~left)])


def test_statistics_against_plain_counting():
    text = "A cat. A cat!\n\nSat 12 times: ok?\n|x| naïve"
    s = quality.statistics(text)
    words = text.split()
    kinds = [sum(f(c) for c in text) / len(text) for f in (lambda c: c.isalpha() and not c.isupper(), str.isupper, str.isdigit, str.isspace)]
    assert np.allclose(s[:3], np.log1p([len(text), len(words), 3])) and np.allclose(s[4:8], kinds)
    size = [len(w) for w in words]
    assert np.allclose(s[10:13], [np.mean(size), np.std(size), max(size)])
    assert np.allclose(s[13:15], [len(set(words)) / len(words), 2 / len(words)])
    assert np.allclose(s[17:19], [0, len(set(zip(words, words[1:]))) / len(words)])
