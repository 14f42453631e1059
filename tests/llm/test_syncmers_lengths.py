import numpy as np
from floodstats.llm import syncmers


def test_near_texts_on_either_side_of_256(spark):
    """In the contract's columns: 300 code points and a next text of 10 make an edited text of 235."""
    r = np.random.default_rng(1)
    texts = []
    for _ in range(20):
        texts += [" ".join(f"{x:05d}" for x in r.integers(0, 99_999, 60))[:300], "next text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = syncmers.edited_fingerprints(df).where("n_chars = 300").collect()
    assert len(rows) == 20 and min(x.near_edited for x in rows) > 0.4


def test_no_length_parts_near_texts(spark):
    words = [f"w{i * 7919 % 1009}" for i in range(60)]
    df = spark.createDataFrame([(n, " ".join(words[:n])) for n in range(3, 60)], "doc_id long, text string")
    own = {r.doc_id: set(r.anchors) for r in syncmers.fingerprints(df).collect()}
    assert all(own[n] & own[n + 1] and (n < 4 or own[n] & own[min(59, n * 5 // 4)]) for n in range(3, 59))


def test_a_hot_id_is_cut_at_its_texts(spark):
    """A third of the rows without an id, another under one id, in many buckets: each row's next is the next by id and hash."""
    from pyspark.sql import functions as F

    rows = [(None, f"n{i}") for i in range(300)] + [(50, f"f{i}") for i in range(300)] + [(i, f"t{i}") for i in range(100)] + [(None, "n1"), (50, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    bounds = syncmers._bounds(df.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64("text").alias("tie")), 10, 8)
    assert len([k for k, _ in bounds if k == -(2**63)]) > 20 and len([k for k, _ in bounds if k == 50]) > 20
    hashes = {(r.doc_id, r.text): r.h for r in df.select("*", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    want = sorted(((*a, b[1]) for a, b in zip(order, order[1:] + order[:1])), key=str)
    for hot in (8, 1):
        got = syncmers.with_next(df, ["text"], per_bucket=10, hot=hot).collect()
        assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str) == want
    assert set(bounds) <= {(-(2**63) if i is None else i, h) for (i, _), h in hashes.items()}
    sizes = [r["count"] for r in df.select(syncmers._bucket(F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text"), bounds).alias("b")).groupBy("b").count().collect()]
    assert max(sizes) < 40


def test_ids_beyond_exact_doubles(spark):
    base = 2**62 + 1
    df = spark.createDataFrame([(base + 3 * i, str(i)) for i in range(400)], "doc_id long, text string").repartition(3)
    got = {r.text: r.next_text for r in syncmers.with_next(df, ["text"], per_bucket=9).collect()}
    assert got == {str(i): str((i + 1) % 400) for i in range(400)}
