import numpy as np
import pytest
from floodstats.llm import mixing


def test_the_sample_meets_its_targets(docs):
    """At these values the clipped probabilities miss them."""
    rows = mixing.drawn(docs, keep=0.5, power=0.5).toPandas()
    total = rows.n_tokens.sum()
    for d in mixing.DIMS:
        want = rows.n_tokens.groupby(rows[d]).sum() ** 0.5
        have = (rows.n_tokens * rows.expected).groupby(rows[d]).sum()
        assert np.allclose(have, want / want.sum() * total * 0.5, rtol=2 * mixing.TOLERANCE)
    assert rows.expected.max() > 1 and ((rows.copies - rows.expected).abs() < 1).all()


def test_given_targets_and_drawn_copies(spark):
    rows = [(i, "word " * 20, "en", "big" if i % 10 else "small") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    aim = {"source": {"big": 1, "small": 3}}
    n = {r[0]: r[1] for r in mixing.drawn(df, keep=0.5, targets=aim).groupBy("source").sum("copies").collect()}
    assert n["small"] / 6000 == pytest.approx(0.375, rel=0.05) and n["big"] / 6000 == pytest.approx(0.125, rel=0.1)
    mixed = {r[0]: r[1] for r in mixing.mix(df, keep=0.5, repeats=True, targets=aim).groupBy("source").count().collect()}
    assert mixed == n
    with pytest.raises(ValueError):
        mixing.drawn(df, targets={"source": {"none": 1}})
    cells = spark.createDataFrame([("big", "en", "prose", 900), ("small", "en", "prose", 100)], "source string, lang string, topic string, tokens long")
    both = [{r.source: r.expected for r in mixing.weights(cells, 0.5, 0.5, m, aim)[0].collect()} for m in (10, 0)]
    assert both[0] == pytest.approx(both[1]) and both[0] == pytest.approx({"big": 0.125 / 0.9, "small": 3.75})
