"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from the whole text. Trees are grown on the driver from at most MAX_ROWS labelled documents (a
documented bound, chosen by a hash of the id), flattened into arrays, and walked by numpy for all rows of a batch at once.

Nulls: a null text is empty; an empty text has the statistics 0 and gets a score like any other. Rows with a null id are
scored and held out or not by the text ''. Labels that are null are not learned from; of several labels of a document the
mean counts, 0.5 as 1, and of several texts with one id the least is learned from. Without labels, or with one class, every score is the prior (0.5 without any).
Texts of any length are read whole; repeated rows and ties score alike. Columns other than doc_id, text and quality aren't read
for a score, so extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import crc_mod, free_prefix, rows_of, small_batches, with_columns

MAX_ROWS, THRESHOLD = 20_000, 0.3
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """Of each code point: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence punctuation, 6 other ASCII sign."""
    global _classes
    if _classes is None:
        kinds = bytearray(0x110000)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                kinds[i] = 2 if c.isupper() else 1
            elif c.isdigit():
                kinds[i] = 3
            elif c.isspace():
                kinds[i] = 4
            elif c in ".,;:?'\"()-":
                kinds[i] = 5
            elif 32 < i < 127:
                kinds[i] = 6
        _classes = np.frombuffer(bytes(kinds), np.uint8)
    return _classes


def statistics(text: str) -> list[float]:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, nw, nl = max(1, len(points)), max(1, len(words)), max(1, len(lines))
    kind = np.bincount(_class_table()[points], minlength=7) / n
    size = np.array([len(w) for w in words] or [0])
    of = Counter(words)
    top = [c for _, c in of.most_common(3)] + [0, 0, 0]
    ends = np.bincount(_class_table()[[ord(w[-1]) for w in words]], minlength=7) / nw if words else np.zeros(7)
    pairs = len(set(zip(words, words[1:])))
    return [
        np.log1p(len(points)), np.log1p(len(words)), np.log1p(len(lines)), *kind, size.mean(), size.std(), size.max(), len(of) / nw, top[0] / nw, top[1] / nw, sum(top[:3]) / nw,
        sum(a == b for a, b in zip(words, words[1:])) / nw, pairs / nw, len(set(lines)) / nl, nw / nl, ends[5], ends[6], ends[2], sum(c for c in of.values() if c == 1) / nw,
        float((points[1:] == points[:-1]).mean()) if len(points) > 1 else 0.0, sum(c == 1 for c in size.tolist()) / nw, sum(x[-1] in ".!?" for x in map(str.rstrip, lines)) / nl,
    ]


WIDTH = len(statistics(""))


@dataclass
class Trees:
    """feature, threshold, left child (right is next; 0: a leaf) and value of every node of every tree, one after another."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.repeat(self.roots[None, :], len(x), 0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            left = self.left[at]
            step = left + (x[rows, self.feature[at]] > self.threshold[at])
            at = np.where(left > 0, step, at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, smooth: float = 2.0, least: int = 20) -> Trees:
    """Logistic loss; at each level, histograms of gradients over (node, bin) by feature, and the split of most gain."""
    prior = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
    base = float(np.log(prior / (1 - prior)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if len(y) == 0 or y.min() == y.max():
        trees = 0
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if trees else []
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1) if trees else x
    raw = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        roots.append(len(left))
        feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
        at = np.full(len(y), roots[-1])
        frontier = [roots[-1]]
        for level in range(depth + 1):
            local = np.full(len(left) + 1, -1)
            local[frontier] = np.arange(len(frontier))
            node = local[at]
            on = node >= 0
            gs, hs = (np.bincount(node[on], v[on], len(frontier)) for v in (g, h))
            for i, f in enumerate(frontier):
                value[f] = rate * float(gs[i] / (hs[i] + smooth))
            if level == depth:
                break
            gain, pick = np.full(len(frontier), 1e-3), np.full((len(frontier), 2), -1)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = node[on] * (len(c) + 1) + binned[on, j]
                gl, hl, nl = (np.cumsum(np.bincount(k, w, len(frontier) * (len(c) + 1)).reshape(len(frontier), -1), 1) for w in (g[on], h[on], None))
                gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
                better = gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - (gs**2 / (hs + smooth))[:, None]
                better[(nl < least) | (nr < least)] = 0
                top = better[:, :-1].argmax(1)
                most = better[np.arange(len(frontier)), top]
                up = most > gain
                gain[up] = most[up]
                pick[up] = np.stack([np.full(up.sum(), j), top[up]], 1)
            new = []
            for i, f in enumerate(frontier):
                j, b = pick[i]
                if j < 0:
                    continue
                feature[f], threshold[f], left[f] = int(j), float(cuts[j][b]), len(left)
                own = at == f
                at[own] = left[f] + (binned[own, j] > b)
                new += [len(left), len(left) + 1]
                for _ in range(2):
                    feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
            frontier = new
            if not frontier:
                break
        raw = raw + np.array(value)[at]
    pad = lambda v, t: np.array(v or [0], t)
    return Trees(base, np.array(roots, np.int64), pad(feature, np.int64), pad(threshold, float), pad(left, np.int64), pad(value, float), depth)


def _stats_frame(df: DataFrame, *keep: str) -> DataFrame:
    """keep columns, and x array<double>; the text is df's last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            x = [statistics(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.mapInArrow(run, StructType([*df.schema.fields[:-1], StructField("x", ArrayType(DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Trees:
    """Learns from labelled documents whose crc32(doc_id) mod 5 is not 0."""
    own = with_columns(labels, doc_id="long", quality="int").where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 0))
    own = own.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = with_columns(docs, doc_id="long", text="string").join(F.broadcast(own), "doc_id")  # at most max_rows
    rows = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("text").alias("text"))
    got = _stats_frame(rows, "doc_id", "y").toPandas().sort_values("doc_id")
    x = np.array(got["x"].tolist(), float).reshape(-1, WIDTH)
    return grow(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Trees, *keep: str, out: str = "quality_score") -> DataFrame:
    """keep columns and out, the score of every row."""
    small_batches(docs.sparkSession)
    kept = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(f"{free_prefix(docs)}text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            x = np.array([statistics(t or "") for t in b.column(b.num_columns - 1).to_pylist()]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(model.scores(x), pa.float64())], names=[*keep, out])

    return kept.mapInArrow(run, StructType([*kept.schema.fields[:-1], StructField(out, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = score(with_columns(docs, doc_id="long", text="string"), train(docs, labels), "doc_id")
    s = F.col("quality_score")
    return out.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that score THRESHOLD or more, with the columns of docs."""
    out = f"{free_prefix(docs)}score"
    return score(docs, train(docs, labels), *docs.columns, out=out).where(F.col(out) >= THRESHOLD).drop(out)
