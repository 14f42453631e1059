import corpus_pipeline as P
import pytest
from conftest import SF
from floodstats.llm import common, quality, secrets
from test_shingles import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in P.STAGES:
        docs = common.stash(f(spark, docs, SF))
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_each_stage_does_what_its_operator_says(spark, stages, docs, labels):
    good, one, clean, mixed, packed = stages
    assert all(s.columns == COLUMNS for s in stages[:-1])
    assert ids(good) == {r.doc_id for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    groups = brute({r.doc_id: r.text for r in good.collect()})
    assert ids(one) == {i for i, first in groups.items() if i == first}
    assert ids(clean) == ids(one)
    spans = {r.doc_id: r.spans for r in secrets.secret_spans(one).collect()}
    before = {r.doc_id: r.text for r in one.collect()}
    for r in clean.collect():
        assert (r.text == before[r.doc_id]) == (spans[r.doc_id] == "") and r.n_chars == len(r.text)
    assert ids(mixed) <= ids(clean) and len(ids(mixed)) > 0.75 * len(ids(clean))
    assert ids(packed) == ids(mixed)


def test_run_gives_the_same(spark, stages):
    rows = lambda df: sorted(tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert rows(P.run(spark, SF)) == rows(stages[-1])


@pytest.mark.parametrize("which", ["odd", "nothing"])
def test_stages_of_odd_rows(spark, which, request):
    df = request.getfixturevalue(which)
    before, seen = df.count(), []
    for name, f in P.STAGES:
        columns = df.columns
        df = common.stash(f(spark, df, SF))
        seen.append(df)
        if name != P.STAGES[-1][0]:
            assert df.columns == columns
    good, one, clean, mixed, packed = seen
    assert one.count() == clean.count() <= good.count() <= before
    kept = {r.doc_id for r in one.collect()}
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in mixed.collect()} <= kept
    if which == "nothing":
        assert packed.count() == 0
    else:
        texts = {r.doc_id: r.text for r in good.where("doc_id is not null").collect()}
        assert kept - {None} == {i for i, first in brute(texts).items() if i == first}
        assert (None in kept) == bool(good.where("doc_id is null").count())
