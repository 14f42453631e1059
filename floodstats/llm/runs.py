"""Periodic runs: stretches of words that repeat themselves with a period, by an all-lag scan.

A text's words get numbers, and the array of numbers is compared with itself shifted by every lag up to its length divided by
MIN_EXPONENT, a block of lags in one numpy operation. A true stretch of the comparison is a run of that lag as its period, if it is
long enough. A run that several lags find (multiples of its period) keeps the least, which is its smallest period: a stretch of two
periods' length that has a shorter period too has one that divides the lag, and then both have the same ends.

The scan takes the square of a text's words. Texts of up to LONG code points are scanned whole where they are read, without a
shuffle. Longer ones are dealt out as ranges of lags, a range for every RANGE words, with equal numbers of comparisons; each
is a row of its own, which holds the word numbers and not the text. Their runs meet by document again; there are fewer runs than words.

Nulls: a null text is empty and has no words; rows with a null id are kept. Texts of any length are scanned whole. Ties and repeated
rows: each row is scanned by itself, whatever its id. Columns other than doc_id and text aren't read, so extra ones of any name
don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stash, utf8, with_columns

MIN_LENGTH, MIN_EXPONENT = 12, 2
LONG, RANGE, BLOCK = 400_000, 50_000, 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    return ids.astype(np.int16) if len(seen) < 1 << 15 else ids


def scan(ids: np.ndarray, low: int, high: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """(start, length, lag) of the runs of each lag from low to high - 1."""
    n, out, q = len(ids), [np.zeros((0, 3), np.int64)], low
    padded = np.concatenate([ids, np.full(high + 1, -1, ids.dtype)])
    while q < high:
        width = n - q + 1  # the last is beyond the text and differs, so that no stretch goes on in the next row
        upto = min(high, q + max(1, BLOCK // width))
        same = sliding_window_view(padded[q : upto - 1 + width], width) == padded[:width]
        lags = np.arange(q, upto)
        least = np.maximum(min_length - lags, (min_exponent - 1) * lags)
        same, wide = same.ravel(), 1
        while 2 * wide <= min(least.min(), 8):  # true from here on for `wide` words: of chance matches hardly any are left
            same = same[:-wide] & same[wide:]
            wide *= 2
        at = np.flatnonzero(same)
        first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        size = np.diff(first, append=len(at)) + wide - 1
        start = at[first]
        lag = q + start // width
        keep = size >= least[lag - q]
        if keep.any():
            out.append(np.stack([start % width, size + lag, lag], 1)[keep])
        q = upto
    return np.concatenate(out)


def smallest(runs: np.ndarray) -> np.ndarray:
    """By start and period; of the runs with the same ends the one with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (np.diff(runs[:, :2], axis=0) != 0).any(1))[: len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    return smallest(scan(ids, 1, len(ids) // min_exponent + 1, min_length, min_exponent))


def kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Of each word whether no run contains it after the run's first period."""
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(cover[:n]) == 0


def lag_ranges(n: int, pieces: int, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int]]:
    """Ranges of lags that cover all, with about the same number of comparisons in each: lag q takes n - q."""
    top = n // min_exponent
    done = np.cumsum(n - np.arange(1, top + 1))
    cuts = np.searchsorted(done, done[-1] * np.arange(1, pieces) / pieces) + 1 if top else []
    edges = sorted({1, top + 1, *map(int, cuts)})
    return list(zip(edges, edges[1:]))


def _lists(runs: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
    values = pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()), values)


def _texts(words: list[list[bytes]], runs: list[np.ndarray]) -> pa.Array:
    return pa.array([b" ".join([w for w, k in zip(ws, kept(len(ws), r)) if k] if len(r) else ws) for ws, r in zip(words, runs)], pa.binary()).cast(pa.string())


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, long: int = LONG, words_of_a_range: int = RANGE) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed): collapsed is the text of the words that no run repeats."""
    own = with_columns(docs, doc_id="long", text="string")
    out = f"doc_id long, n_words long, runs {RUNS}, collapsed string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            words = [t.split() for t in utf8(b.column(1))]
            runs = [runs_of(numbered(w), min_length, min_exponent) for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in words], pa.int64()), _lists(runs), _texts(words, runs)], names=["doc_id", "n_words", "runs", "collapsed"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1):
            ids = numbered(utf8(b.column(2))[0].split())
            for low, high in lag_ranges(len(ids), -(-len(ids) // words_of_a_range), min_exponent):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([low], pa.int64()), pa.array([high], pa.int64()), pa.array([ids.astype(np.int32).tobytes()], pa.binary())], names=["row", "low", "high", "ids"])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1):
            row, low, high, ids = (c[0].as_py() for c in b.columns)
            found = scan(np.frombuffer(ids, np.int32), low, high, min_length, min_exponent)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row)), *(pa.array(c) for c in found.T)], names=["row", "start", "length", "period"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches, 1):
            words = utf8(b.column(1))[0].split()
            flat = b.column(2).values.slice(b.column(2).offsets[0].as_py(), len(b.column(2)[0].as_py() or ()))
            runs = smallest(np.stack([flat.field(i).to_numpy(zero_copy_only=False) for i in range(3)], 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words)], pa.int64()), _lists([runs]), _texts([words], [runs])], names=["doc_id", "n_words", "runs", "collapsed"])

    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    short = own.where(~is_long).mapInArrow(whole, out)
    few = stash(own.where(is_long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    if few.isEmpty():
        return short
    dealt = few.mapInArrow(ranges, "row long, low long, high long, ids binary").repartition("row", "low")
    one = dealt.mapInArrow(scanned, "row long, start long, length long, period long").groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    per = one.groupBy("row").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    back = few.join(per, "row", "left").select("doc_id", "text", F.coalesce("runs", F.expr(f"cast(array() as {RUNS})")).alias("runs"))
    return short.union(back.mapInArrow(joined, out))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of one id in ten, by its checksum, the words from a place on repeat with a period, as the contract of the query sets."""

    def plant(h: int, text: bytes) -> bytes:
        words, g = text.split(), h // 10
        if h % 10 or not words:
            return text
        n = len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return b" ".join([*words[:a], *(words[a + i % p] for i in range(n - a))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            made = [plant(h, t) for h, t in zip(b.column(1).to_pylist(), utf8(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    own = with_columns(docs, doc_id="long", text="string")
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return own.select("doc_id", h.alias("h"), "text").mapInArrow(run, "doc_id long, text string")


def run_digests(docs: DataFrame) -> DataFrame:
    """The contract's columns over the planted texts; collapsed_words is how many words stay."""
    found = periodic_runs(planted(docs))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    found = found.withColumn("best", best)
    length = -F.col("best.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(F.lit(1000) * length / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )
