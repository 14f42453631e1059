"""Language-model scoring by deleted interpolation of word bigrams, unigrams and a uniform floor.

The maximum-likelihood estimates are mixed by weights that depend on how often the context occurs (buckets of powers of
two). The weights are learned by expectation-maximisation on held-out counts: one training document in ten is deleted
from the counts, and its tokens are what the mixture must explain. A first fit on the driver takes the estimates in steps of a
quarter octave, a bounded table; from there on each round is an aggregate over the exact counts, until no weight moves by
more than SETTLED or for ROUNDS rounds.

Counting and looking up are one round trip. Documents are gathered into chunks; a chunk sends its distinct word and bigram
keys, sorted and packed, to the key ranges they belong to, and gets the corpus's counts back in the same order. So a word that
is in every text is one key per chunk, nothing is broadcast, and what moves is a few bytes per distinct key of a chunk.
Where chunks times ranges would be over MESSAGES, the trip has two legs: chunks write to groups of ranges, and there the keys of many
chunks (a rack) are merged before they go to their ranges, and the counts dealt out again on the way back. So packets stay large, and
their number grows with the power 1.5 of the input.
Words are 64-bit hashes, bigrams 56-bit ones, exact but for collisions; no bigram counts for more than its context, and none whose
context is unseen counts at all, whatever has its key.

Nulls: a null text is empty, that is one end token. A null id counts as the text '', whose remainder is 0: held out. Repeated
rows count as often as they occur. Without training documents N and V are 0 and every token has the floor's probability. Texts of
any length are counted whole; of words that tie in count none is preferred. Columns other than doc_id and text aren't read, so
extra ones of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, rows_of, stash, utf8, with_columns

CHUNK_BYTES, PART_TOKENS = 6 << 20, 1_000_000
MESSAGES = 1_000_000
BUCKETS = 24
#: Steps of an octave in which the weights' first fit distinguishes probabilities.
FINE = 4
#: Rounds of the exact fit at most, and the greatest change of a weight at which it ends.
ROUNDS, SETTLED = 40, 1e-6
#: The least weight of each part, as nothing that was seen may be impossible.
LEAST = (1e-9, 1e-9, 1e-6)
_LOWER = np.frombuffer(ASCII_LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BYTES = np.random.default_rng(20240501).integers(0, 2**64, 256, dtype=np.uint64)
_R = 0x9E3779B97F4A7C15
END, BEGIN = np.uint64(0x1D872B41C3A7E5F1), np.uint64(0x7A3F5C9E21B4D687)
_powers: list[np.ndarray] = []


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _power(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, np.uint64(r))], dtype=np.uint64) for r in (_R, pow(_R, -1, 2**64))]
    return _powers


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words: a polynomial of random byte values over each, from prefix sums."""
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(text):
        end = min(len(text), at + (1 << 20))
        if end < len(text):
            cut = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
            end = cut if cut > at else min([i for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (i := text.find(c, end)) >= 0] or [len(text)])
        b = _LOWER[np.frombuffer(text, np.uint8, end - at, at)]
        up, down = _power(len(b) + 1)
        edge = np.diff(np.r_[0, ~_SPACE[b], 0].astype(np.int8))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.r_[np.uint64(0), np.cumsum(_BYTES[b] * up[: len(b)], dtype=np.uint64)]
        starts.append(s + at)
        hashes.append(_mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's words and then its end, and the tokens of each text."""
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    place, h = word_hashes(b"\n".join(texts))
    doc = np.searchsorted(begin, place, "right") - 1
    n = np.bincount(doc, minlength=len(texts))[: len(texts)] + 1
    out = np.full(n.sum(), END)
    out[np.arange(len(h)) + doc] = h
    return out, n


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if x.nbytes else b""


def _unpack(b: bytes, size: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(b, size * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype) if size else np.zeros(0, dtype)


def _pack_planes(x: np.ndarray) -> bytes:
    """Byte planes apart, so that the zero bytes vanish."""
    return _pack(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else b""


def _unpack_planes(b: bytes, size: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(_unpack(b, width * size, "u1").reshape(width, size).T).view(dtype).ravel() if size else np.zeros(0, dtype)


def _pack_sorted(x: np.ndarray) -> bytes:
    """Differences by byte planes."""
    return _pack_planes(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(b: bytes, size: int) -> np.ndarray:
    return np.cumsum(_unpack_planes(b, size, "u8"), dtype=np.uint64)


def _small(x: np.ndarray) -> tuple[bytes, str]:
    kind = next(t for t in ("u1", "u2", "u4", "i8") if not len(x) or x.max() <= np.iinfo(t).max)
    return _pack(x.astype(kind)), kind


CHUNKS = "chunk long, fold int, docs int, train_tokens long, train_docs long, tokens long, ids array<long>, lens array<int>, words int, vocabulary binary, seq binary"


def chunks(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Packed token sequences. fold 1: training documents that the fit of the weights deletes; fold 0: all others.
    ids are negative-free row ids; train is told by the sign of lens (negative: held out of training)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        held = {f: [[], [], [], 0] for f in (0, 1)}

        def flush(fold: int) -> pa.RecordBatch:
            nonlocal made
            ids, lens, hashes, _ = held[fold]
            held[fold] = [[], [], [], 0]
            n = np.concatenate(lens)
            vocabulary, seq = np.unique(np.concatenate(hashes), return_inverse=True)
            made += 1
            row = ((part << 24) + made, fold, len(n), int(n[n > 0].sum()), int((n > 0).sum()), int(np.abs(n).sum()), sum(ids, []), n.tolist(), len(vocabulary), _pack_sorted(vocabulary), _pack_planes(seq.astype("i4")))
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=schema)

        names = [x.split()[0] for x in CHUNKS.split(", ")]
        kinds = {"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary()}
        schema = pa.schema([(a, kinds[b]) for a, b in (x.split() for x in CHUNKS.split(", "))])
        for b in rows_of(batches):
            ids, texts = b.column(0).to_pylist(), utf8(b.column(1))
            rest = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % 10 for i in ids])
            for fold in (0, 1):
                own = np.flatnonzero((rest == 1) == bool(fold))
                if not len(own):
                    continue
                h, n = tokens([texts[i] for i in own])
                x = held[fold]
                x[0].append([ids[i] for i in own])
                x[1].append(np.where(rest[own] == 0, -n, n))
                x[2].append(h)
                x[3] += sum(len(texts[i]) for i in own)
                if x[3] >= chunk_bytes:
                    yield flush(fold)
        for fold in (0, 1):
            if held[fold][0]:
                yield flush(fold)

    return with_columns(docs, doc_id="long", text="string").mapInArrow(run, CHUNKS)


def _bigrams(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, seq, tokens of each text, sorted distinct bigram keys, key index of each token)."""
    vocabulary, n = _unpack_sorted(row.vocabulary, row.words), np.array(row.lens, np.int64)
    seq = _unpack_planes(row.seq, row.tokens, "i4")
    h = vocabulary[seq]
    before = np.r_[BEGIN, h[:-1]]
    before[np.r_[0, np.cumsum(np.abs(n))[:-1]]] = BEGIN
    keys, at = np.unique(_mix(before * np.uint64(0xD6E8FEB86659FD93) + h) >> np.uint64(64 - _BITS[1]), return_inverse=True)
    return vocabulary, seq, n, keys, at


KEYS = "part int, chunk long, fold int, kind int, n int, keys binary, counts binary, dtype string"


#: Bits of the keys of each kind.
_BITS = {0: 64, 1: 56}


def _cut(keys: np.ndarray, counts: np.ndarray, kind: int, parts: int) -> Iterator[tuple[int, int, bytes, bytes, str]]:
    """(part, n, keys, counts, dtype) of sorted keys, cut at the parts' bounds; parts without keys are left out."""
    bounds = np.array([-(-(j << _BITS[kind]) // parts) for j in range(1, parts)], np.uint64)
    edges = np.r_[0, np.searchsorted(keys, bounds), len(keys)].astype(int)
    for p in np.flatnonzero(np.diff(edges)).tolist():
        a, b = edges[p], edges[p + 1]
        yield p, b - a, _pack_sorted(keys[a:b]), *_small(counts[a:b])


def _ask(parts: int):
    """Each chunk's distinct keys with its training counts, cut at the parts' bounds. kind 0: words, 1: bigrams."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for row in f.itertuples():
                vocabulary, seq, n, keys, at = _bigrams(row)
                learn = np.repeat(n > 0, np.abs(n))
                out = []
                for kind, k, i in ((0, vocabulary, seq), (1, keys, at)):
                    c = np.bincount(i[learn], minlength=len(k))
                    out += [(p, row.chunk, row.fold, kind, *rest) for p, *rest in _cut(k, c, kind, parts)]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in KEYS.split(", ")])

    return run


def _merged(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of rows of KEYS, and the sums of their counts."""
    keys, at = np.unique(np.concatenate([_unpack_sorted(r.keys, r.n) for r in rows]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([_unpack(r.counts, r.n, r.dtype).astype(np.int64) for r in rows]), len(keys)).astype(np.int64)


def _gather(parts: int):
    """(rack, KEYS) of one rack and fold and group of ranges -> KEYS of the rack as one chunk, cut at the bounds of all ranges."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, g in f.groupby("kind"):
            keys, counts = _merged(list(g.itertuples()))
            out += [(p, int(f["rack"].iloc[0]), int(f["fold"].iloc[0]), kind, *rest) for p, *rest in _cut(keys, counts, kind, parts)]
        return pd.DataFrame(out, columns=[x.split()[0] for x in KEYS.split(", ")])

    return run


def _deal(_, asked: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """What a rack was answered, as answers to each of its chunks."""
    out = []
    for kind, g in asked.groupby("kind"):
        rows = list(g.itertuples())
        keys, _ = _merged(rows)
        every, deleted = _looked_up(answers, kind), _looked_up(answers, kind, True) if rows[0].fold else None
        known = answers.loc[answers.kind == kind, ["known", "known_less"]].sum().tolist()
        for r in rows:
            at = np.searchsorted(keys, _unpack_sorted(r.keys, r.n))
            out.append((r.chunk, r.fold, r.part, kind, r.n, *_small(every[at]), *(_small(deleted[at]) if r.fold else (b"", "u1")), *known))
            known = 0, 0
    return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])


ANSWERS = "chunk long, fold int, part int, kind int, n int, counts binary, dtype string, deleted binary, deleted_dtype string, known long, known_less long"


def _answer(f: pd.DataFrame) -> pd.DataFrame:
    """The corpus's counts of every chunk's keys in one part; deleted: those of fold 1 alone. known: distinct training keys."""
    out = []
    for kind, g in f.groupby("kind"):
        rows = list(g.itertuples())
        keys, at = np.unique(np.concatenate([_unpack_sorted(r.keys, r.n) for r in rows]), return_inverse=True)
        own = np.concatenate([_unpack(r.counts, r.n, r.dtype).astype(np.int64) for r in rows])
        fold = np.repeat([r.fold == 1 for r in rows], [r.n for r in rows])
        every = np.bincount(at, own, len(keys)).astype(np.int64)
        deleted = np.bincount(at[fold], own[fold], len(keys)).astype(np.int64)
        known, less, i = int((every > 0).sum()), int((every > deleted).sum()), 0
        for r in rows:
            k = at[i : i + r.n]
            i += r.n
            out.append((r.chunk, r.fold, r.part, kind, r.n, *_small(every[k]), *(_small(deleted[k]) if r.fold else (b"", "u1")), known, less))
            known = less = 0
    return pd.DataFrame(out, columns=[x.split()[0] for x in ANSWERS.split(", ")])


def _looked_up(answers: pd.DataFrame, kind: int, deleted: bool = False) -> np.ndarray:
    rows = answers[answers.kind == kind].sort_values("part").itertuples()
    return np.concatenate([np.zeros(0, np.int64), *(_unpack(r.deleted if deleted else r.counts, r.n, r.deleted_dtype if deleted else r.dtype).astype(np.int64) for r in rows)])


def _context(seq: np.ndarray, n: np.ndarray, words: np.ndarray, begins: int) -> np.ndarray:
    """How often each token's context occurs: its word, or the begin of a text."""
    c = np.r_[0, words[seq[:-1]]] if len(seq) else words[:0]
    c[np.r_[0, np.cumsum(np.abs(n))[:-1]]] = begins
    return c


def _bucket(context: np.ndarray) -> np.ndarray:
    """0: unseen context; else one more than the whole part of its log2."""
    return np.minimum(np.where(context > 0, 1 + np.log2(np.maximum(context, 1)).astype(int), 0), BUCKETS - 1)


HELD_OUT = "bucket int, pair long, context long, word long, n long"


def _held_out(begins: int):
    """Of a deleted chunk: numbers of tokens by bucket and the counts of the bigram, its context and the word among the others."""

    def run(_, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in HELD_OUT.split(", ")]
        if not len(chunk):
            return pd.DataFrame([], columns=names)
        row = next(chunk.itertuples())
        _, seq, n, _, at = _bigrams(row)
        words = _looked_up(answers, 0) - _looked_up(answers, 0, True)
        pairs = _looked_up(answers, 1) - _looked_up(answers, 1, True)
        c = _context(seq, n, words, begins)
        one = np.zeros(len(pairs), np.int64)
        one[at] = np.arange(len(at))  # a bigram's tokens have one context and word
        return pd.DataFrame({"bucket": _bucket(c[one]), "pair": np.minimum(pairs, c[one]), "context": c[one], "word": words[seq[one]], "n": np.bincount(at, minlength=len(pairs))})

    return run


def _start() -> np.ndarray:
    weights = np.tile([0.5, 0.4, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    return weights


def _bounded(w: np.ndarray) -> np.ndarray:
    """Shares of a bucket's tokens as weights; an unseen context has no bigram."""
    w = np.maximum(w, [LEAST * np.array([0, 1, 1]) if k == 0 else LEAST for k in range(BUCKETS)])
    return w / w.sum(1, keepdims=True)


def fit_weights(hist: np.ndarray, floor: float, rounds: int = 100) -> np.ndarray:
    """hist: rows (bucket, p2, p1, n), p2 and p1 in steps of an octave -> weights[bucket] of bigram, unigram and floor. Buckets
    without tokens keep the start."""
    weights = _start()
    p = [np.where(hist[:, i] > -999, 2.0 ** (hist[:, i] / FINE), 0) for i in (1, 2)]
    p = np.stack([*p, np.full(len(hist), floor)], 1)
    k, n = hist[:, 0].astype(int), hist[:, 3]
    total = np.bincount(k, n, BUCKETS)
    for _ in range(rounds):
        part = p * weights[k]
        part *= (n / part.sum(1))[:, None]
        sums = np.stack([np.bincount(k, c, BUCKETS) for c in part.T], 1)
        weights = np.where(total[:, None] > 0, _bounded(sums / np.maximum(total, 1)[:, None]), weights)
    return weights


def _ahead(before: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Where two rounds seem to lead, by the ratio of their steps (squared extrapolation, a bucket at a time); the second round's
    weights where that would leave the simplex."""
    r, v = one - before, two - 2 * one + before
    size = lambda x: np.sqrt((x * x).sum(1, keepdims=True))
    a = np.maximum(1.0, size(r) / np.maximum(size(v), 1e-300))
    far = before + 2 * a * r + a * a * v
    return np.where((far > 0).all(1, keepdims=True) & (size(v) > 0), far, two)


def fit_exactly(counts: DataFrame, weights: np.ndarray, total: int, floor: float, rounds: int = ROUNDS) -> np.ndarray:
    """counts: HELD_OUT. A round sums each part's share of the tokens by bucket; only these sums come to the driver. After every
    second round the next begins at what both lead to; the last one moves no weight by more than SETTLED."""

    def step(w: np.ndarray) -> np.ndarray:
        lam = [F.get(F.array(*[F.lit(float(x)) for x in w[:, i]]), F.col("bucket")) for i in range(3)]
        parts = [lam[0] * F.when(F.col("context") > 0, F.col("pair") / F.col("context")).otherwise(0.0), lam[1] * (F.col("word") / F.lit(float(max(total, 1)))), lam[2] * F.lit(floor)]
        named = counts.select("bucket", "n", *[c.alias(f"p{i}") for i, c in enumerate(parts)]).withColumn("all", F.col("p0") + F.col("p1") + F.col("p2"))
        got = np.array(named.groupBy("bucket").agg(F.sum("n"), *[F.sum(F.col("n") * F.col(f"p{i}") / F.col("all")) for i in range(3)]).collect(), float).reshape(-1, 5)
        new = w.copy()
        new[got[:, 0].astype(int)] = got[:, 2:] / got[:, 1:2]
        return np.where(np.isin(np.arange(BUCKETS), got[:, 0])[:, None], _bounded(new), w)

    path = [weights]
    for _ in range(rounds):
        path.append(step(path[-1]))
        if np.abs(path[-1] - path[-2]).max() <= SETTLED:
            break
        if len(path) == 3:
            path = [_ahead(*path)]
    return path[-1]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(total: int, vocabulary: int, begins: int, weights: np.ndarray):
    floor = 1 / (vocabulary + 1)

    def run(_, chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(chunk):
            return pd.DataFrame([], columns=[x.split()[0] for x in SCORES.split(", ")])
        row = next(chunk.itertuples())
        _, seq, n, _, at = _bigrams(row)
        words, pairs = _looked_up(answers, 0), _looked_up(answers, 1)
        c, w = _context(seq, n, words, begins), words[seq]
        lam = weights[_bucket(c)]
        p = lam[:, 0] * np.minimum(pairs[at], c) / np.maximum(c, 1) + lam[:, 1] * (w / max(total, 1)) + lam[:, 2] * floor
        first = np.r_[0, np.cumsum(np.abs(n))[:-1]]
        add = lambda x: np.add.reduceat(x, first)
        base = np.log10((words + 0.1) / (total + 0.1 * (vocabulary + 1)))[seq]
        return pd.DataFrame({"doc_id": pd.array(list(row.ids), "Int64"), "held_out": n < 0, "n_tokens": np.abs(n), "n_known": add((w > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(p))})

    return run


def _round_trip(gathered: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """ANSWERS to every chunk, and the number of distinct training words."""
    many = gathered.count()
    if many * parts <= MESSAGES:
        answers = gathered.mapInPandas(_ask(parts), KEYS).groupBy("part").applyInPandas(_answer, ANSWERS)
    else:
        groups, racks = math.isqrt(parts - 1) + 1, math.isqrt(many - 1) + 1
        each = -(-parts // groups)
        rack = F.pmod(F.xxhash64("chunk"), F.lit(racks)) * groups + F.col("part")
        # Both uses share one exchange, so what was asked is on disk once.
        asked = gathered.mapInPandas(_ask(groups), KEYS).withColumn("rack", rack).groupBy("rack", "fold")
        merged = asked.applyInPandas(_gather(groups * each), KEYS).groupBy("part").applyInPandas(_answer, ANSWERS)
        answers = asked.cogroup(merged.withColumnRenamed("chunk", "rack").groupBy("rack", "fold")).applyInPandas(_deal, ANSWERS)
    answers = stash(answers, packed=True, free=True)
    return answers, answers.where("kind = 0").agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]


def lm_scores(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    spark = docs.sparkSession
    gathered = stash(chunks(docs), packed=True)
    by_fold = {r.fold: r for r in gathered.groupBy("fold").agg(F.sum("train_tokens").alias("n"), F.sum("train_docs").alias("d"), F.sum("tokens").alias("t")).collect()}
    if not by_fold:
        return spark.createDataFrame([], SCORES)
    count = lambda what, *folds: sum(by_fold[f][what] for f in folds if f in by_fold)
    parts = max(4, -(-count("t", 0, 1) // PART_TOKENS))
    answers, vocabulary = _round_trip(gathered, parts)
    of = lambda f: f.groupBy("chunk")
    deleted = of(gathered.where("fold = 1")).cogroup(of(answers.where("fold = 1"))).applyInPandas(_held_out(count("d", 0)), HELD_OUT)
    counts = stash(deleted.groupBy("bucket", "pair", "context", "word").agg(F.sum("n").alias("n")), free=True)
    floor, rest = 1 / (vocabulary + 1), count("n", 0)
    step = lambda a, b: F.when(a > 0, F.round(FINE * F.log2(a / b))).otherwise(-999.0)
    coarse = counts.groupBy("bucket", step(F.col("pair"), F.col("context")).alias("p2"), step(F.col("word"), F.lit(float(max(rest, 1)))).alias("p1")).agg(F.sum("n").alias("n"))
    hist = np.array(coarse.collect(), float).reshape(-1, 4)  # bounded by the steps
    weights = fit_exactly(counts, fit_weights(hist, floor), rest, floor)
    return of(gathered).cogroup(of(answers)).applyInPandas(_scorer(count("n", 0, 1), vocabulary, count("d", 0, 1), weights), SCORES)
