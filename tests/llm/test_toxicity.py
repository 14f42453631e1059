"""Toxicity: automata against distances computed in full, contexts, the learned lexicon, held-out rows, odd rows."""

import random
import zlib

import numpy as np
import pytest
from floodstats.llm import toxicity as T
from pyspark.sql import functions as F


def distance(a, b):
    """Edits between a and b: insertions, deletions, substitutions, swaps of neighbours (each letter edited once)."""
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d


def plain(word, lexicon):
    best = None
    for k, t in enumerate(lexicon.terms):
        bare = t.removesuffix("*")
        d = distance(word, bare)[:, -1]
        e = d.min() if t[-1] == "*" else d[-1]
        if e == 0 or (e == 1 and len(bare) >= T.MISSPELLED_FROM):
            best = min(best or (9,), (int(e), -lexicon.weight[k], t, k))
    return best and (best[3], best[0])


def test_automata_against_distances():
    r = random.Random(3)
    lexicon = T.Lexicon(["abab", "abbabc", "bacca", "caba*", "ccabab*", "cabbage"], [3.0, 2.0, 5.0, 4.0, 1.0, 2.5], [1.0] * 6)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(6000)]
    got = [lexicon._within(w, 1) for w in words]
    assert got == [plain(w, lexicon) for w in words] and sum(g is not None and g[1] == 1 for g in got) > 100


@pytest.mark.parametrize("word, edits", [("idiot", 0), ("idoit", 1), ("idot", 1), ("idiiot", 1), ("id1ot", 1), ("IDIOT", 0), ("idiooooot", 1), ("1d!ot", None), ("id*iot", 1), ("idea", None), ("i", None), ("12345", None), ("loser", 0), ("l0$er", 1)])
def test_misspelled_terms(word, edits):
    lexicon = T.Lexicon(["idiot", "loser"], [5.0, 4.0], [3.0, 2.0])
    _, found = T.contexts(f"it is {word} here", lexicon)
    assert (found[0][3] if found else None) == edits


def test_contexts_tell_quotation_from_abuse():
    lexicon = T.Lexicon(["idiot", "moron"], [5.0, 4.0], [3.0, 2.0])
    hit = lambda text: T.contexts(text, lexicon)[1]
    assert [(m[4], round(m[5], 3)) for m in hit("a long line of plain words then idiot and nothing more of it")] == [(False, 5.0)]
    assert hit('the writer used "idiot" once in the play')[0][4] and hit("he said idiot to them")[0][4] and hit("sie nannte ihn idiot gestern")[0][4]
    assert not hit("you are an idiot")[0][4] and hit("you are an idiot")[0][5] > 5.0
    both = hit("such an idiot and moron here")
    assert [round(m[5], 3) for m in both] == [6.25, 5.0] and [(m[0], m[1]) for m in both] == [(8, 13), (18, 23)]
    x = T.features(lexicon, *T.contexts('he said "idiot" there', lexicon))
    assert x[0] == 0 and x[4] > 0
    assert T.features(lexicon, *T.contexts("", lexicon)) == [0.0] * T.WIDTH


def test_choice_of_terms():
    counts = [("foo", 60, 50, 0), ("foo*", 60, 50, 0), ("bar*", 80, 40, 4), ("barx", 30, 20, 1), ("ba*", 90, 45, 900), ("the", 900, 90, 9000), ("rare", 3, 3, 0)]
    terms, weight = T.chosen(counts, 10_000, 100_000, 5)
    assert terms == ["bar*", "foo"] and all(w > np.log(T.LEAST_RATIO) for w in weight)


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in T.toxicity_scores(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())
    held = [(rows[r.doc_id].score, r.toxic) for r in labels.collect() if r.toxic is not None and rows[r.doc_id].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.85
    assert np.mean([b < 0.7 for b in bad]) > 0.97


def test_misspelled_and_clean_rows(spark):
    r = random.Random(4)
    plain_words = ["river", "level", "gauge", "water", "storm", "tide", "crash", "mortar"]
    text = lambda *more: " ".join([r.choice(plain_words) + r.choice("abcdefgh") for _ in range(60)] + list(more))
    rows = [(i, text("trash") if i % 4 == 0 else text(), int(i % 4 == 0)) for i in range(400)]
    new = [(1000, text("trsah"), None), (1001, text("tr4sh"), None), (1002, text("trash"), None), (1003, text(), None)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + new], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {x.doc_id: x for x in T.toxicity_scores(docs, labels).collect()}
    assert [got[i].n_misspelled for i in (1000, 1001, 1002, 1003)] == [1, 1, 0, 0]
    assert min(got[i].score for i in (1000, 1001)) > got[1003].score and got[1002].predicted == 1 and got[1003].predicted == 0


def test_odd_rows(odd, nothing, labels):
    rows = T.toxicity_scores(odd, labels).collect()
    assert len(rows) == 16 and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert by[3] == by[4] and by[1] == by[2]
    assert T.toxicity_scores(nothing, labels).count() == 0
    assert {r.score for r in T.toxicity_scores(odd, labels.limit(0)).collect()} == {0.5}
    nulls = labels.withColumn("toxic", F.lit(None).cast("int"))
    assert {r.score for r in T.toxicity_scores(odd, nulls).collect()} == {0.5}
    one = T.toxicity_scores(odd, labels.withColumn("toxic", F.lit(1))).collect()
    assert len({r.score for r in one}) == 1 and one[0].score > 0.5
