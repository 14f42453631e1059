"""Substring deduplication by sliding sentence spans.

Sentences end at a stop followed by white space, at a stop of scripts without spaces, or at a line's end. Those over CUT words are cut
at places that their content sets (`_cuts`). In scripts without spaces each code point counts as a word. Every run of RUN sentences
is hashed, lower-cased and with single spaces (with a floor of `words`, a parameter, every shortest run from a sentence on, and up to
one, that has so many). A run that any earlier place holds too (in a document of a smaller id, in one of the same id whose text has a
smaller hash, or earlier in its own) is a repetition, and the sentences it covers are removed. A document sends each different hash once, as 16 bytes; the count and the smallest id of a hash are
aggregated before the shuffle and written, so that the join back is one of two plain exchanges, whose hot hash adaptive
execution splits. Only texts with a repetition are cut into sentences a second time.

Nulls: a null text is empty and stays null. Null ids are told apart by their text and come after all others. Of rows that repeat
id and text all keep what the first keeps. Texts of any length are processed whole; equal texts under several ids are
emptied but for the first, if they are long enough for a run. Ties in order are rows with one id and text, which fare alike. Columns other than doc_id and text aren't read, so extra ones of
any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stash, with_columns

RUN, WORDS, CUT, REACH = 3, 0, 12, 4
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_BREAK = re.compile(r"(?<=[.!?\u061f\u06d4\u0964\u0965\u0589\u1362])\s+|(?<=[\u3002\uff01\uff1f\uff0e\uff61\u104b\u17d4])\s*|\s*\n\s*")
_NO_SPACES = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+")


_FAR = np.iinfo(np.int64).max


class _Hashes(dict):
    """63-bit hashes of lower-cased words, made when they are first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.lower().encode("utf-8", "surrogatepass"), 17) >> 1
        return h


_hashes = _Hashes()


def _cuts(units: list[list[str]]) -> list[list[int]]:
    """Of each unit the places to cut at: where the hash of a word and the next is the least within REACH words (the first of equal
    ones). They depend on nothing farther away, so a passage has the same ones wherever it stands. What repeats itself has none;
    there more than 3 CUT words are cut every CUT."""
    size = np.array([len(u) for u in units])
    end = np.cumsum(size)
    h = np.array(list(map(_hashes.__getitem__, chain.from_iterable(units))), np.int64).view(np.uint64)
    after = np.r_[h[1:], np.uint64(0)]
    after[end - 1] = 0
    z = h * np.uint64(0x9E3779B97F4A7C15) + after
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    v = ((z ^ (z >> np.uint64(32))) >> np.uint64(1)).view(np.int64)
    place = np.arange(len(v)) + REACH * (1 + np.repeat(np.arange(len(units)), size))
    wide = np.full(len(v) + REACH * (len(units) + 1), _FAR)
    wide[place] = v
    least = v < np.minimum.reduce([wide[place - d] for d in range(1, REACH + 1)])
    least &= v <= np.minimum.reduce([wide[place + d] for d in range(1, REACH + 1)])
    found = np.flatnonzero(least)
    edges = np.searchsorted(found, np.r_[0, end]).tolist()
    found = found.tolist()
    out = []
    for k, (n, first) in enumerate(zip(size.tolist(), (end - size).tolist())):
        own = [0]
        for c in [*(f - first for f in found[edges[k] : edges[k + 1]]), n]:
            if c - own[-1] > 3 * CUT:
                own += range(own[-1] + CUT, c, CUT)
            if 0 < c < n and c != own[-1]:
                own.append(c)
        out.append(own)
    return out


def sentences(text: str, cut: int = CUT, placed: bool = True) -> list[tuple[int, list[str]]]:
    """Start and words of each sentence; not placed: parts of a long one all have its start."""
    out: list[tuple[int, list[str]]] = []
    wide: list[tuple[int, str, list[str]]] = []  # (how many units are before it, piece, words)
    at, plain = 0, not _NO_SPACES.search(text)
    for m in [*_BREAK.finditer(text), None]:
        piece = text[at : m.start() if m else len(text)]
        words = piece.split() if plain else _WORD.findall(piece)
        if words:
            if len(words) > cut:
                wide.append((len(out), piece, words))
            out.append((at, words))
        at = m.end() if m else at
    if not wide:
        return out
    done, last = [], 0
    for (i, piece, words), places in zip(wide, _cuts([w for *_, w in wide])):
        done += out[last:i]
        if len(places) > 1:
            begin = out[i][0]
            starts = [w.start() for w in _WORD.finditer(piece)] if placed else [0] * len(words)
            done += [(begin + starts[a], words[a:b]) for a, b in zip(places, [*places[1:], len(words)])]
        else:
            done.append(out[i])
        last = i + 1
    return done + out[last:]


def runs(units: list[tuple[int, list[str]]], run: int = RUN, words: int = WORDS) -> list[tuple[int, int, int]]:
    """(hash, first sentence, one past the last) of the shortest run from each sentence on, and of that up to each sentence,
    in order of place and each once; so a passage is covered from its first sentence to its last."""
    h = [xxhash.xxh64_digest(" ".join(w).lower().encode("utf-8", "surrogatepass"), 11) for _, w in units]
    total = [0, *accumulate(len(w) for _, w in units)]
    n, places, end, start = len(units), set(), 0, 0
    for i in range(n):
        end = max(end, i + run)
        while end <= n and total[end] - total[i] < words:
            end += 1
        if end > n:
            break
        places.add((i, end))
    for j in range(run, n + 1):
        while start + 1 <= j - run and total[j] - total[start + 1] >= words:
            start += 1
        if total[j] - total[start] >= words:
            places.add((start, j))
    return [(xxhash.xxh64_intdigest(b"".join(h[i:j]), 13) - 2**63, i, j) for i, j in sorted(places)]


def without(text: str, repeated: set[int], run: int = RUN, words: int = WORDS) -> tuple[str, int, int]:
    """(text without the sentences of repeated runs and of runs seen earlier in it, sentences, removed ones)."""
    units = sentences(text)
    gone, seen = np.zeros(len(units) + 1, bool), set()
    for h, i, end in runs(units, run, words):
        if h in repeated or h in seen:
            gone[i:end] = True
        seen.add(h)
    if not gone.any():
        return text, len(units), 0
    starts = [s for s, _ in units] + [len(text)]
    kept = [text[starts[i] : starts[i + 1]] for i in range(len(units)) if not gone[i]]
    return "".join([text[: starts[0]], *kept]), len(units), int(gone.sum())


def _key(doc_id: Column, text: Column) -> Column:
    return F.coalesce(doc_id, F.lit(2**63 - 1) - F.pmod(F.xxhash64(text), F.lit(2**40)))


FOUND = "key long, text_hash long, n_sentences long, inside boolean, hashes array<long>"


def spans(keyed: DataFrame, length: int = RUN, words: int = WORDS) -> DataFrame:
    """keyed (key, text_hash, text) -> its sentences, whether a run occurs twice inside, and the hashes of its runs, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            n, inside, own = [], [], []
            for t in b.column(2).to_pylist():
                units = sentences(t or "", placed=False)
                h = [x for x, _, _ in runs(units, length, words)]
                distinct = np.unique(np.array(h, np.int64))
                n.append(len(units)), inside.append(len(distinct) < len(h)), own.append(distinct)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(inside, pa.bool_()), pa.array(own, pa.list_(pa.int64()))], names=[x.split()[0] for x in FOUND.split(", ")])

    return keyed.select("key", "text_hash", "text").mapInArrow(run, FOUND)


def dedup_spans(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """(doc_id, text, n_sentences, n_removed, n_chars_removed) of every row."""
    own = with_columns(docs, doc_id="long", text="string")
    keyed = own.withColumns({"key": _key(F.col("doc_id"), F.col("text")), "text_hash": F.xxhash64("text")})
    found = stash(spans(keyed, run, words))
    each = found.select("key", "text_hash", F.explode("hashes").alias("h"))
    first = stash(each.groupBy("h").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    again = each.join(first, "h").where("key > first").select("key", "text_hash", "h", F.lit(None).cast("long").alias("n_sentences"))
    shared = stash(found.groupBy("key").agg(F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low < high").select("key"))
    if not shared.isEmpty():  # ids of several texts
        mine = stash(found.join(shared, "key", "left_semi").select("key", "text_hash", F.explode("hashes").alias("h")))
        low = stash(mine.groupBy("key", "h").agg(F.min("text_hash").alias("low")))
        later = mine.join(low, ["key", "h"]).where("text_hash > low").select("key", "text_hash", "h", F.lit(None).cast("long").alias("n_sentences"))
        again = again.unionByName(later)
    told = again.unionByName(found.select("key", "text_hash", F.lit(None).cast("long").alias("h"), F.when(~F.col("inside"), F.col("n_sentences")).alias("n_sentences")))
    told = stash(told.groupBy("key", "text_hash").agg(F.collect_set("h").alias("again"), F.max("n_sentences").alias("n_sentences")))
    both = keyed.join(told, ["key", "text_hash"], "left").select("doc_id", "text", "again", "n_sentences")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            ids, texts, again, n = (c.to_pylist() for c in b.columns)
            done = [without(t or "", set(a or ()), run, words) if a or k is None else (t, k, 0) for t, a, k in zip(texts, again, n)]
            new = [None if t is None else d[0] for t, d in zip(texts, done)]
            gone = [len(t or "") - len(d[0] or "") for t, d in zip(texts, done)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(new, pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_sentences", "n_removed", "n_chars_removed"])

    return both.mapInArrow(clean, "doc_id long, text string, n_sentences long, n_removed long, n_chars_removed long")
