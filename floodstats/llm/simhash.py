"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint has one or more words of 64 bits. Each word is split into `blocks`; two words that differ in at most
`word_bits` bits agree in at least blocks - word_bits of them, so both land under the key of some such choice of blocks.
Rows are joined on these keys and the Hamming distance of whole fingerprints is verified, so with one word no link is lost.
Linked fingerprints go through distributed connected components.

Equal fingerprints are one node from the start. Under a key, links are found against pivots and only a spanning
forest of them leaves a task, so a group of n near copies gives about n rows and not n². A key with more than
CELL fingerprints is cut into chunks, and each pair of chunks is a cell of its own: memory stays bounded and no link is lost.

Nulls: a null text is empty. Empty texts have fingerprint zero and link like any other. Rows with a null id are kept and link
others; they take the component of their fingerprint, null if it holds no id at all. Repeated rows, ties and equal ids with
different texts each go by their own fingerprint. Long texts are hashed whole. Only doc_id and text are read, so extra columns
of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, components, free_prefix, rows_of, stash, utf8, with_columns
from .shingles import LEAST, jaccard_components

CELL = 16384
#: Candidates that a fingerprint may be expected to meet under one key by chance; more blocks are used beyond.
BY_CHANCE = 0.25


def _majority(h: np.ndarray) -> np.uint64:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        ones += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]


def shingle_hash(text: bytes, size: int = 4, seed: int = 42) -> list[int]:
    """One word: XXH64 of every shingle of `size` lower-cased words, repeats included; fewer words: of the whole sequence."""
    words = text.translate(ASCII_LOWER).split()
    if not words:
        return [0]
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), seed) for i in range(max(1, len(words) - size + 1))]
    return [int(_majority(np.array(h, "<u8")))]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp array<long>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(batches):
            with np.errstate(over="ignore"):
                fp = np.array([shingle_hash(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(fp), pa.list_(pa.int64()))], names=["doc_id", "fp"])

    return with_columns(df, **{id_col: "long", text_col: "string"}).mapInArrow(run, "doc_id long, fp array<long>")


def _choices(blocks: int, word_bits: int) -> list[int]:
    """A mask for each choice of the blocks - word_bits blocks that agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - word_bits)]


def blocks_for(n: int, word_bits: int) -> int:
    """The fewest blocks under whose keys a fingerprint meets few others by chance. The links found are the same for any."""
    for blocks in range(word_bits + 2, 13):
        if n / 2 ** (64 * (blocks - word_bits) / blocks) <= BY_CHANCE:
            return blocks
    return 12


def _forest(node: np.ndarray, fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that connect what the links at `bits` or fewer differing bits connect."""
    order = np.argsort(node, kind="stable")
    node, fp = node[order], fp[order]
    far = lambda x, y: np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)
    left, pivots, balls, out = np.arange(len(node)), [], [], []
    while len(left):
        near = far(fp[left], fp[left[0]]) <= bits
        ball = left[near]
        pivots.append(ball[0])
        balls.append(ball)
        out += [(int(node[i]), int(node[ball[0]])) for i in ball[1:]]
        left = left[~near]
    root = list(range(len(pivots)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    p = fp[pivots]
    for i in range(len(pivots) - 1):
        for j in np.flatnonzero(far(p[i + 1 :], p[i]) <= 3 * bits) + i + 1:  # farther pivots have no two members that link
            if find(i) != find(j):
                small, large = sorted((balls[i], balls[j]), key=len)
                for x in small:
                    if len(hit := np.flatnonzero(far(fp[large], fp[x]) <= bits)):
                        out.append((int(node[x]), int(node[large[hit[0]]])))
                        root[find(i)] = find(j)
                        break
    return out


def _linker(width: int, bits: int):
    """Streams rows sorted by cell; a cell's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cell: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            out: list[tuple[int, int]] = []
            starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]) if len(cell) else np.zeros(0, int)
            size = np.diff(np.r_[starts, len(cell)])
            two = starts[size == 2]
            ok = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1) <= bits
            a = [node[two[ok]], node[two[ok] + 1]]
            for s, n in zip(starts[size > 2], size[size > 2]):
                out += _forest(node[s : s + n], fp[s : s + n], bits)
            more = np.array(out, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(np.r_[a[0], more[:, 0]]), pa.array(np.r_[a[1], more[:, 1]])], names=["a", "b"])

        kept = (np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint64))
        for b in batches:
            cell = np.stack([b.column(i).to_numpy() for i in range(3)], 1).astype(np.int64)
            fp = b.column(4).flatten().to_numpy().view(np.uint64).reshape(-1, width)
            now = tuple(np.concatenate(x) for x in zip(kept, (cell, b.column(3).to_numpy(), fp)))
            last = np.flatnonzero((now[0] != now[0][-1]).any(1))
            cut = last[-1] + 1 if len(last) else 0
            kept = tuple(x[cut:] for x in now)
            if cut:
                yield links(*(x[:cut] for x in now))
        if len(kept[0]):
            yield links(*kept)

    return run


def _links(fps: DataFrame, width: int, word_bits: int, bits: int, cell: int) -> tuple[DataFrame, DataFrame]:
    """Of fps (doc_id long, fp array<long>) the distinct fingerprints (fp, least: their smallest id, node), and links (a, b) of nodes that
    connect what all links connect."""
    node = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    linked = node.select("node", "fp")
    n = linked.count()
    masks = _choices(blocks_for(n, word_bits), word_bits)
    keys = F.array(*[F.xxhash64(F.lit(w * 1000 + i), F.expr(f"fp[{w}]").bitwiseAND(F.lit(m if m < 2**63 else m - 2**64))) for w in range(width) for i, m in enumerate(masks)])
    keyed = linked.select("node", F.explode(keys).alias("key"))
    met = stash(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))  # so that a hot key is a plain exchange on both sides, and split
    cells = keyed.join(met, "key").withColumn("t", F.ceil(F.col("n") / cell).cast("int")).withColumn("c", F.pmod(F.xxhash64("node"), F.col("t")).cast("int"))
    cells = cells.select("key", "node", "c", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("x"))
    cells = cells.select("key", F.least("c", "x").alias("i"), F.greatest("c", "x").alias("j"), "node")
    cells = cells.join(linked, "node").select("key", "i", "j", "node", "fp")
    return node, cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_linker(width, bits), "a long, b long")


def near_components(fps: DataFrame, width: int = 1, word_bits: int = 4, bits: int = 4, cell: int = CELL) -> DataFrame:
    """fps (doc_id long, fp array<long>) -> (doc_id, fp, component_id).

    Two fingerprints link if some of their words differ in at most word_bits bits and the whole in at most bits.
    """
    node, edges = _links(fps, width, word_bits, bits, cell)
    found = components(edges)
    whole = node.join(found, "node", "left").select("fp", "least", F.coalesce("component", "node").alias("component"))
    first = stash(whole.groupBy("component").agg(F.min("least").alias("component_id")))
    label = stash(whole.join(first, "component").select("fp", "component_id"))
    return fps.join(label, "fp").select("doc_id", "fp", "component_id")


def simhash_components(df: DataFrame) -> DataFrame:
    """Four-word shingles, one 64-bit word, links at 4 or fewer bits: (doc_id, fingerprint, component_id)."""
    out = near_components(stash(fingerprints(df)))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(df: DataFrame) -> DataFrame:
    """(a, b): pairs of ids that fingerprints link at 4 or fewer differing bits, so many that they connect what all such links connect; a
    row for each copy and not for each pair of copies. Rows with a null id take no part."""
    fps = stash(fingerprints(df).where("doc_id is not null"))
    node, edges = _links(fps, 1, 4, 4, CELL)
    least = lambda c: node.select(F.col("node").alias(c), F.col("least").alias(f"_{c}"))
    across = edges.distinct().join(least("a"), "a").join(least("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    same = fps.join(node.select("fp", "least"), "fp").where("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b"))
    return stash(across.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def dedup_near(df: DataFrame, least: tuple[int, int] = LEAST) -> DataFrame:
    """Keeps of each group of near copies the row with the smallest id (of rows with that id all).

    Near copies share `least` (a fraction, 4/5) or more of the distinct five-word shingles of both; groups are what such links
    connect. Pairs that SimHash fingerprints link come first; pairs with as many shingles in common may differ in more bits than a fingerprint
    allows, so an exact join of rare shingles adds those it can't see (see `shingles`). Both are verified on the texts. A row goes by its id and its text, so an id that stands for several texts loses only those in
    a group with a smaller id. Rows with a null id take no part and are kept.
    """
    found = jaccard_components(df, least, pairs=fingerprint_pairs(df))
    p = free_prefix(df)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(f"{p}id"), F.col("text_hash").alias(f"{p}hash")).distinct()
    same = (F.col("doc_id").cast("long") == F.col(f"{p}id")) & (F.xxhash64(F.col("text").cast("string")) == F.col(f"{p}hash"))
    return df.join(drop, same, "left_anti")
