import numpy as np
import pytest
from floodstats.llm import spans


def covered(size, stop, trials=100):
    """Shares of a passage's words that go from the second of two texts of 400 words, where it stands at random places."""
    r = np.random.default_rng(size)
    say = lambda n: [f"w{x}" for x in r.integers(0, 20_000, n)]
    out = []
    for _ in range(trials):
        passage, texts = say(size), []
        if stop:
            passage = [w + "." if i % stop == stop - 1 else w for i, w in enumerate(passage)]
        for _ in range(2):
            own, at = say(400), int(r.integers(0, 400))
            texts.append(" ".join(own[:at] + passage + own[at:]))
        seen = {h for h, _, _ in spans.runs(spans.sentences(texts[0]))}
        new = spans.without(texts[1], seen)[0]
        assert all(w in texts[1].split() for w in new.split())
        out.append(1 - len(set(new.split()) & set(passage)) / len(set(passage)))
    return np.array(out)


@pytest.mark.parametrize("size, stop, found, share", [(55, 0, 0.8, 0.5), (80, 0, 0.95, 0.7), (150, 0, 0.99, 0.85), (55, 30, 0.8, 0.5), (55, 15, 0.8, 0.5)])
def test_passages_in_mid_sentence(size, stop, found, share):
    got = covered(size, stop)
    print(size, stop, (got > 0.2).mean(), got.mean())
    assert (got > 0.2).mean() >= found and got.mean() >= share


def test_scripts_without_spaces():
    r = np.random.default_rng(5)
    say = lambda a, n: "".join(chr(a + x) for x in r.integers(0, 40, n))
    for a, stop in ((0x4E00, "\u3002"), (0x3042, "\uff01"), (0x0E01, "")):
        passage = stop.join(say(a, 20) for _ in range(5)) + stop
        one, two = say(a, 33) + passage + say(a, 50), say(a, 41) + passage + say(a, 50)
        new = spans.without(two, {h for h, _, _ in spans.runs(spans.sentences(one))})[0]
        assert len(two) - len(new) > 0.6 * len(passage) and new.startswith(two[:30]) and new.endswith(two[-30:])


def test_a_hot_run_is_split(spark, small_skew, plans):
    """Half of all texts hold one passage: the join of its hashes with their first places is dealt to several tasks."""
    common = "Here is the passage that all of them hold, in many words. It goes on for two more sentences of some length. Then it ends here with a last one."
    df = spark.range(6000).selectExpr("id AS doc_id", f"concat('Own text number ', id, ' begins here with words. ', if(id % 2 = 0, '{common}', concat('Nothing of it ', id, ' is said in here at all. Nor is it said in ', id, ' there, or so it seems. The end of ', id, ' comes with a last few words of its own.'))) AS text").repartition(16)
    got = {r.n_removed: r["count"] for r in spans.dedup_spans(df).groupBy("n_removed").count().collect()}
    assert got == {0: 3001, 3: 2999} and "skew=true" in plans.text()
