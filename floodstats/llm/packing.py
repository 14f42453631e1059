"""Best-fit packing of tokenised documents by bin completion.

The problem is solved on the histogram of piece lengths, which has at most `capacity` rows however many documents there
are. Bin completion takes the largest length left and enumerates the undominated fillings of the rest of its sequence, each for
as many sequences as the counts allow and then for one only. The search keeps the best solution so far (a best-fit one at
first) and prunes whatever cannot beat it by the waste bound. Fillings are made when the search asks for them, so
open branches are iterators on the stack and none is given up: if the stack runs empty the solution is proved the best, and
so it is if it meets the lower bound. Half of the steps go to a first search that takes only the FIRST fullest fillings of each node,
which finds better incumbents sooner; the second takes all and alone proves. It ends after `steps` steps (the only
limit, a parameter), and the result says how many sequences it may be above the best.
Pieces get their places by rank within their length: salted ranks and a broadcast table of fillings, so neither the
number of documents nor a hot length meets one task.

Nulls: a null text is empty and packs as the separator alone; a null id keeps its pieces. Repeated rows are packed as often
as they occur, and pieces that tie in length are placed by a hash, then id, piece and contents. Texts of any length are tokenised
whole and only cut into pieces. Columns other than doc_id and text aren't read, so extra ones of any name don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_of, stash, with_columns

CAPACITY, SEPARATOR = 2048, 0
#: Steps of the search: one for each length tried in a filling, NODE for each node. Of fillings, WINDOW are made at a time (FIRST, if
#: one of them wastes nothing) and the fullest tried first; dominance by up to REPLACED pieces is looked for, in fillings of up to
#: CROWDED pieces (others are kept).
STEPS, NODE, WINDOW, FIRST, REPLACED, CROWDED = 1_200_000, 20, 200, 3, 3, 8
VOCABULARY = "byte_bpe_50k"
#: Where both libraries were compared on every code point; other texts go to the slower one.
_COMPARED = re.compile("[^\x00-ɏ]")
_encoders: dict[str, object] = {}


def encoder(vocabulary: str = VOCABULARY):
    """text -> ids, as the tokenizers library gives them for vocabulary.json; for Latin texts by the same vocabulary's
    ranks in tiktoken, which gives the same ids in a third of the time."""
    if vocabulary not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        whole = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))

        def encode(text: str) -> list[int]:
            if "<|" in text or _COMPARED.search(text):
                return whole.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[vocabulary] = encode
    return _encoders[vocabulary]


def pieces(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids and a separator; longer documents are cut, the first piece may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in rows_of(batches):
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), SEPARATOR], "<u4")
                ends = range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)
                start = 0
                for k, end in enumerate(ends):
                    out.append((doc, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return with_columns(df, doc_id="long", text="string").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: for each threshold k, lengths over capacity - k are alone or with pieces under k."""
    size = np.arange(len(count))
    total = -(-int((count * size).sum()) // capacity)
    n, mass = np.r_[0, np.cumsum(count)], np.r_[0, np.cumsum(count * size)]
    best = total
    for k in range(1, capacity // 2 + 1):
        alone = int(n[-1] - n[capacity - k + 1])
        half, middle = capacity // 2, capacity - k
        paired = int(n[middle + 1] - n[half + 1])
        room = paired * capacity - int(mass[middle + 1] - mass[half + 1])
        rest = int(mass[half + 1] - mass[k])
        best = max(best, alone + paired + max(0, -(-(rest - room) // capacity)))
    return best


class _Spent(Exception):
    pass


class _Budget:
    def __init__(self, steps: int):
        self.left = steps

    def spend(self, n: int = 1) -> None:
        self.left -= n
        if self.left < 0:
            raise _Spent


def _dominated(chosen: tuple[int, ...], slack: int, sizes: list[int], count: np.ndarray) -> bool:
    """Whether a piece left outside could take the place of some of the chosen ones, which then leave no less room elsewhere."""
    sums = {0: 0}
    for c in chosen:
        sums |= {s + c: k + 1 for s, k in sums.items() if k < REPLACED}
    for s, k in sums.items():
        i = bisect_right(sizes, s + slack) - 1 if k else -1
        while i >= 0 and sizes[i] >= s:
            if not (k == 1 and sizes[i] == s) and count[sizes[i]] > chosen.count(sizes[i]):
                return True
            i -= 1
    return False


def fillings(count: np.ndarray, room: int, budget: _Budget | None = None) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of room by lengths that are left, largest pieces first, made as they are asked for."""
    sizes = np.flatnonzero(count[: room + 1]).tolist()
    budget = budget or _Budget(2**62)

    def walk(chosen: tuple[int, ...], room: int, top: int) -> Iterator[tuple[int, ...]]:
        fits = bisect_right(sizes, room) - 1
        full = not any(count[sizes[i]] > chosen.count(sizes[i]) for i in range(fits + 1))
        if full:
            if len(chosen) > CROWDED or not _dominated(chosen, room, sizes, count):
                yield chosen
            return
        for i in range(min(fits, top), -1, -1):
            budget.spend()
            if count[sizes[i]] > chosen.count(sizes[i]):
                yield from walk((*chosen, sizes[i]), room - sizes[i], i)

    yield from walk((), room, len(sizes) - 1)


def _fullest_first(found: Iterator[tuple[int, ...]], room: int) -> Iterator[tuple[int, ...]]:
    """All of found, each WINDOW of them sorted by the room that they fill."""
    part: list[tuple[int, ...]] = []
    for filling in found:
        part.append(filling)
        if len(part) == WINDOW or len(part) >= FIRST and any(sum(c) == room for c in part):
            yield from sorted(part, key=lambda c: (-sum(c), [-s for s in c]))
            part = []
    yield from sorted(part, key=lambda c: (-sum(c), [-s for s in c]))


def _best_fit(count: np.ndarray, room: int) -> tuple[int, ...]:
    out: list[int] = []
    count = count.copy()
    while len(fit := np.flatnonzero(count[: room + 1])):
        out.append(int(fit[-1]))
        count[fit[-1]] -= 1
        room -= out[-1]
    return tuple(out)


def _apply(count: np.ndarray, large: int, filling: tuple[int, ...], most: int = 2**62) -> tuple[np.ndarray, int, tuple]:
    size, need = np.unique([large, *filling], return_counts=True)
    times = min(most, int((count[size] // need).min()))
    count = count.copy()
    count[size] -= need * times
    return count, times, tuple(zip(size[::-1].tolist(), need[::-1].tolist()))


@dataclass
class Packing:
    """patterns: (((length, pieces a sequence), ...), sequences); bound: sequences that any packing needs; proved: none has fewer."""

    patterns: list[tuple[tuple[tuple[int, int], ...], int]]
    sequences: int
    bound: int
    proved: bool


def search(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> Packing:
    """count[length] -> as few sequences as the search finds in its steps."""
    goal, size = lower_bound(count, capacity), np.arange(len(count))

    def largest(c: np.ndarray) -> int:
        left = np.flatnonzero(c)
        return int(left[-1]) if len(left) else 0

    def without(c: np.ndarray, large: int) -> np.ndarray:
        one = c.copy()
        one[large] -= 1
        return one

    def children(c: np.ndarray, large: int, budget: _Budget) -> Iterator[tuple]:
        one, room = without(c, large), capacity - large
        for filling in _fullest_first(fillings(one, room, budget), room):
            yield _apply(c, large, filling)
        for filling in fillings(one, room, budget):
            yield _apply(c, large, filling, 1)  # where it is good for more, fewer may be better

    best, c = [], count.copy()
    while large := largest(c):
        c, times, pattern = _apply(c, large, _best_fit(without(c, large), capacity - large))
        best.append((pattern, times))
    fewest, proved = sum(t for _, t in best), False
    for width, share in ((FIRST, 0.5), (None, 0.5)):
        budget, stack = _Budget(int(steps * share)), [(iter([(count, 0, ())]), 0, None)]
        try:
            while stack and fewest > goal:
                branch, used, plan = stack[-1]
                child = next(branch, None)
                if child is None:
                    stack.pop()
                    continue
                budget.spend(NODE)
                c, times, pattern = child
                now, then = used + times, (plan, (pattern, times)) if times else plan
                large = largest(c)
                if not large and now < fewest:
                    fewest, best = now, []
                    while then:
                        then, step = then
                        best.append(step)
                    best.reverse()
                elif large and now + -(-int((c * size).sum()) // capacity) < fewest:
                    stack.append((islice(children(c, large, budget), width), now, then))
            proved = width is None
        except _Spent:
            pass
    return Packing(best, fewest, goal, proved or fewest == goal)


def complete(count: np.ndarray, capacity: int = CAPACITY, steps: int = STEPS) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    return search(count, capacity, steps).patterns


def pack(tokens: DataFrame, capacity: int = CAPACITY, steps: int = STEPS) -> DataFrame:
    """tokens: pieces() written to a table; adds sequence_id, offset, and on every row over_bound (sequences above the lower
    bound) and proved (no packing has fewer sequences)."""
    spark = tokens.sparkSession
    hist = tokens.groupBy("length").count().collect()
    count = np.zeros(capacity + 1, np.int64)
    for length, n in hist:
        count[length] = n
    place, used, base = [], np.zeros(capacity + 1, np.int64), 0
    found = search(count, capacity, steps)
    for pattern, times in found.patterns:
        offset = 0
        for length, each in pattern:
            place.append((length, int(used[length]), int(used[length]) + each * times, base, offset, each))
            used[length] += each * times
            offset += length * each
        base += times
    places = spark.createDataFrame(place, "length long, lo long, hi long, base long, first long, each long")
    salts = int(min(4096, max(8, count.sum() // 50_000)))
    salted = tokens.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before.hint("merge"), ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    at = F.broadcast(places.withColumnRenamed("length", "len"))  # bounded by the number of lengths, not of documents
    placed = ranked.join(at, (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    k = F.col("rank") - F.col("lo")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("first") + (k % F.col("each")) * F.col("length")).alias("offset"), F.lit(found.sequences - found.bound).cast("long").alias("over_bound"), F.lit(found.proved).alias("proved"))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    return pack(stash(pieces(df, capacity, vocabulary)), capacity)
