"""Language identification: averaged embeddings of hashed subwords with a linear softmax.

Subwords are runs of one to four letters of the lower-cased text, word boundaries included, hashed into BUCKETS. Embeddings
and softmax are trained together by stochastic gradient descent in numpy on at most MAX_ROWS documents (a documented bound),
each by its whole text; what comes to the driver are the counts of their buckets, not the texts. The sample is chosen by a hash of
the id, and each language has the same share of it, EACH documents at least (so more than MAX_ROWS where there are over
MAX_ROWS / EACH languages) or all that it has; so a rare language is learned too. For prediction the embedding and the linear layer are multiplied
out, and a document's logits are the mean over all subwords of the whole text. A temperature fitted on a tenth that is not
trained on calibrates the scores, and the same tenth gives the score below which a prediction is rejected.

Nulls: text that is null or has no letter is `und` with score 0, and rejected. A null lang is not learned from, and of several rows with one id
the least lang and text is. Rows with a
null id are predicted, and held out or not by the text ''. Without anything to learn from, all is `und`. An empty text has no letter; texts of
any length are read whole, a million code points at a time. Of languages that score alike the first by name is predicted; repeated rows are predicted alike. Columns other than those named
aren't read, so extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, rows_of, stash, with_columns

BUCKETS, DIM, MAX_ROWS, EACH = 1 << 15, 16, 4000, 20
#: Languages up to which their counts are broadcast.
FEW = 10_000
_letter: np.ndarray | None = None


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords; none if no letter."""
    global _letter
    if _letter is None:
        _letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    out = [np.zeros(0, np.int64)]
    for i in range(0, max(1, len(points) - 1), 1 << 20):
        part = points[i : i + (1 << 20) + 3]
        is_letter = _letter[part]
        c = np.where(is_letter, part, 0).astype(np.uint64)
        key, inside, some = c, np.ones(len(c), bool), is_letter
        for n in range(1, 5):
            if n > 1:
                key = key[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
                if n > 2:
                    inside = inside[:-1] & is_letter[n - 2 : -1]
                else:
                    inside = inside[:-1]
                some = some[:-1] | is_letter[n - 1 :]
            if n == 1 or not len(key):
                continue
            ok = (inside & some)[: 1 << 20]
            h = (key[: 1 << 20][ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((h >> np.uint64(49)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class LanguageModel:
    names: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        at = subwords(text)
        return self.table[at].mean(0, dtype=np.float64) + self.bias if len(at) and self.names else None

    def predict(self, text: str) -> tuple[str, float, bool]:
        z = self.logits(text)
        if z is None:
            return "und", 0.0, True
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        k = int(p.argmax())
        return self.names[k], float(p[k]), bool(p[k] < self.reject_below)


def shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's subwords and the share of each, in two and four bytes."""
    at, n = np.unique(subwords(text), return_counts=True)
    return at.astype("<u2"), (n / max(1, n.sum())).astype("<f4")


def fit(examples: list[tuple[np.ndarray, np.ndarray]], langs: list[str], epochs: int = 4, least_steps: int = 8000, rate: float = 0.5, seed: int = 1) -> LanguageModel:
    """examples: shares() of each text."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    data = [(at, share, names.index(y)) for (at, share), y in zip(examples, langs) if len(at)]
    emb, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names))
    learn = [d for i, d in enumerate(data) if i % 10] or data
    epochs = max(epochs, -(-least_steps // max(1, len(learn))))
    steps, done = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            at, share, y = learn[i]
            lr = rate * (1 - done / max(1, steps))
            done += 1
            mean = share @ emb[at]
            z = mean @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= lr * np.outer(mean, p)
            b -= lr * 0.1 * p
            emb[at] -= lr * 20 * share[:, None] * back
    model = LanguageModel(names, (emb @ w).astype(np.float32), b)
    aside = [d for i, d in enumerate(data) if i % 10 == 0]
    if aside and len(names) > 1:
        z = np.array([share @ (emb[at] @ w) + b for at, share, _ in aside])
        y = np.array([k for *_, k in aside])

        def softmax(t: float) -> np.ndarray:
            e = np.exp((z - z.max(1, keepdims=True)) / t)
            return e / e.sum(1, keepdims=True)

        grid = np.geomspace(0.25, 20, 60)
        model.temperature = float(grid[np.argmin([-np.log(softmax(t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid])])
        p = softmax(model.temperature)
        score, good = p.max(1), p.argmax(1) == y
        order = np.argsort(-score)
        right = np.cumsum(good[order]) / np.arange(1, len(y) + 1)
        if (right >= 0.99).any():
            model.reject_below = float(score[order][np.flatnonzero(right >= 0.99)[-1]])
    return model


def sampled(own: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id) of as many documents of each lang, those of the least hashes. Counts tell the hash below which enough lie, so
    only little more than the sample is sorted."""
    one = own.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    n = stash(one.groupBy("lang").agg(F.count("*").alias("n")))
    langs = n.count()
    quota = max(EACH, max_rows // max(1, langs))
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = one.join(F.broadcast(n) if langs <= FEW else n, "lang").withColumn("h", h).where(F.col("h") < F.lit(float(1 << 40)) * (2.0 * quota + 50) / F.col("n"))
    return near.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("i") <= quota).select("doc_id")


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learns from documents with a lang whose crc32(doc_id) mod 4 is not 2."""
    own = with_columns(docs, doc_id="long", text="string", lang="string").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), 4) != 2))
    ids = stash(sampled(own.select("doc_id", "lang"), max_rows))
    rows = own.join(F.broadcast(ids), own["doc_id"].eqNullSafe(ids["doc_id"])).select(own["doc_id"], "lang", "text").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            own = [shares(t) for t in b.column(2).to_pylist()]
            packed = [pa.array([x[i].tobytes() for x in own], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], names=["doc_id", "lang", "at", "share"])

    got = rows.mapInArrow(run, "doc_id long, lang string, at binary, share binary").toPandas().sort_values("doc_id")  # at most max_rows, of BUCKETS numbers each
    return fit([(np.frombuffer(a, "<u2"), np.frombuffer(s, "<f4")) for a, s in zip(got["at"], got["share"])], got["lang"].tolist())


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            cols = list(zip(*(model.predict(t or "") for t in b.column(1).to_pylist()))) or [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.float64(), pa.bool_())))], names=["doc_id", "lang_pred", "score", "rejected"])

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def language_predictions(docs: DataFrame) -> DataFrame:
    out = predict_languages(docs, train(docs))
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
