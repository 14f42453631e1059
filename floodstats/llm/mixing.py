"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The cells' token masses are raked until their sums by source, by
language and by topic meet the targets; the raked mass by the cell's tokens is the weight of its tokens. The wanted share
times the weight is a document's expected number of copies: its whole part is taken, and one more by a hash of the id, so a
repeated run draws the same. The sums of this sample meet the targets, also where a name needs more tokens than it has.

Raking ends when no sum misses its target by more than TOLERANCE of it, when a round betters that by less than a hundredth of it, or after ROUNDS rounds; `miss` says how much the worst one
misses. Targets that no weights meet (names that only occur together, with shares that differ) leave a miss.

Targets are shares by name for any of the dimensions (`targets`); a dimension without takes its own shares to a power. Topics
are a column `topic` where the documents have one, else the first of the rules (name, pattern) that a text meets, a
parameter; the rules given here tell kinds of documents, not subjects.

Besides, `probability` and `sampled` give a sample that repeats nothing: the weights scaled to the same tokens and 1 at most. Where
that clips, its sums fall short of the targets, as no sample without repetition has them at that size.

Only the table of cells is iterated on. Up to MAX_CELLS cells that is done in numpy and the weights are broadcast (their
number is checked); beyond, the same steps to the same tolerance are DataFrame aggregates and joins, and the weights are joined.

Nulls: a null text is empty, null sources, languages and topics are the name ''. Empty documents have no tokens to weigh and get
probability 1 where all of their cell is empty. Null ids are drawn as one id; repeated rows share their fate, and there are no other ties: a document's draw is its own hash. Texts of any
length are counted whole. Only the columns named are read, so extra ones of any name don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import delete, free_prefix, scratch, stash, with_columns

DIMS = ("source", "lang", "topic")
MAX_CELLS, ROUNDS, TOLERANCE = 100_000, 100, 1e-6
Targets = dict[str, dict[str, float]] | None
Rules = tuple[tuple[str, str], ...]
#: First rule that holds names the topic; other texts are prose.
TOPICS: Rules = (("legal", "(?i)licen[sc]e|all rights reserved|copyright"), ("contact", "[A-Za-z0-9._]+@[A-Za-z0-9.-]+"), ("tabular", r" \| "))


def topic(text: Column, rules: Rules = TOPICS) -> Column:
    out = F.lit("prose")
    for name, rule in reversed(rules):
        out = F.when(text.rlike(rule), name).otherwise(out)
    return out


def _topics(docs: DataFrame, text: Column, rules: Rules) -> Column:
    return F.coalesce(F.col("topic").cast("string"), F.lit("")) if "topic" in docs.columns else topic(text, rules)


def measured(docs: DataFrame, rules: Rules = TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens): tokens are runs of anything but ASCII white space."""
    own = with_columns(docs, doc_id="long", text="string", source="string", lang="string", **({"topic": "string"} if "topic" in docs.columns else {}))
    text, name = F.coalesce("text", F.lit("")), lambda c: F.coalesce(c, F.lit("")).alias(c)
    return own.select("doc_id", name("source"), name("lang"), _topics(own, text, rules).alias("topic"), F.size(F.filter(F.split(text, "[ \t-\r]+"), lambda w: w != "")).cast("long").alias("n_tokens"))


def rake(mass: np.ndarray, keys: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(raked mass by cell, the worst miss of a target as a part of it). keys: each cell's index on each dimension; targets:
    wanted sums by index."""
    w = mass.astype(float).copy()

    def miss() -> float:
        return max((float(np.abs(np.bincount(k, w, len(t))[t > 0] / t[t > 0] - 1).max(initial=0)) for k, t in zip(keys, targets)), default=0.0)

    last = np.inf
    for _ in range(rounds):
        for k, t in zip(keys, targets):
            have = np.bincount(k, w, len(t))
            w *= np.divide(t, have, out=np.ones_like(t), where=have > 0)[k]
        before, last = last, miss()
        if last <= tolerance or before - last < tolerance / 100:
            break
    return w, miss()


def _scale(mass: np.ndarray, ratio: np.ndarray, want: float) -> float:
    """s with sum(mass * min(1, s * ratio)) = want."""
    low, high = 0.0, 1.0
    while (mass * np.minimum(1, high * ratio)).sum() < want and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (mass * np.minimum(1, mid * ratio)).sum() < want else (low, mid)
    return high


def _shares(targets: Targets, d: str) -> dict[str, float] | None:
    """The shares given for d; a name without one gets none."""
    if (own := (targets or {}).get(d)) is not None and min(own.values(), default=0) < 0:
        raise ValueError(f"negative share of {d}")
    return own


def weights(cells: DataFrame, keep: float, power: float, max_cells: int = MAX_CELLS, targets: Targets = None) -> tuple[DataFrame, bool]:
    """cells (source, lang, topic, tokens) -> (source, lang, topic, weight, probability, expected, miss), and whether they are few.

    Targets: for each dimension shares by name, or where it has none its own shares to `power`, under 1 to flatten what dominates.
    """
    spark, given = cells.sparkSession, targets
    schema = "source string, lang string, topic string, weight double, probability double, expected double, miss double"
    if (n := cells.count()) > max_cells:
        return _weights_by_joins(cells, keep, power, given), False
    if not n:
        return spark.createDataFrame([], schema), True
    got = cells.toPandas().sort_values(list(DIMS))
    mass = got["tokens"].to_numpy(float)
    keys, aims = [], []
    for d in DIMS:
        names, k = np.unique(got[d].to_numpy(object), return_inverse=True)
        t, own = np.bincount(k, mass) ** power, _shares(given, d)
        if own is not None:
            t = np.where(np.bincount(k, mass) > 0, [float(own.get(x, 0)) for x in names], 0.0)
            if mass.any() and not t.any():
                raise ValueError(f"no {d} with a share has tokens")
        keys.append(k)
        aims.append(t / max(t.sum(), 1e-300) * mass.sum())
    raked, miss = rake(mass, keys, aims)
    ratio = np.divide(raked, mass, out=np.ones_like(mass), where=mass > 0)
    s = _scale(mass, ratio, keep * mass.sum())
    got["weight"], got["probability"] = ratio, np.where(mass > 0, np.minimum(1, s * ratio), 1.0)
    got["expected"], got["miss"] = np.where(mass > 0, keep * ratio, 1.0), miss
    return spark.createDataFrame(got[[*DIMS, "weight", "probability", "expected", "miss"]], schema), True


def _weights_by_joins(cells: DataFrame, keep: float, power: float, given: Targets) -> DataFrame:
    """The same where cells are too many for the driver."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    w, aims = cells.withColumn("w", F.col("tokens").cast("double")), {}
    for d in DIMS:
        t, own = F.pow(F.sum("tokens").cast("double"), power), _shares(given, d)
        if own is not None:
            t = F.when(F.sum("tokens") > 0, F.coalesce(F.element_at(F.from_json(F.lit(json.dumps(own)), "map<string,double>"), F.col(d)), F.lit(0.0))).otherwise(0.0)
        t = cells.groupBy(d).agg(t.alias("t"))
        if own is not None and total and not t.agg(F.sum("t")).first()[0]:
            raise ValueError(f"no {d} with a share has tokens")
        every = t.agg(F.sum("t")).first()[0]
        aims[d] = stash(t.select(d, (F.col("t") * F.lit(total / every if every else 0.0)).alias("t")))
    miss, paths = float("inf"), []
    for _ in range(ROUNDS):
        for d in DIMS:
            have = w.groupBy(d).agg(F.sum("w").alias("have")).join(aims[d], d).select(d, F.when(F.col("have") > 0, F.col("t") / F.col("have")).otherwise(1.0).alias("f"))
            w = w.join(have, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        with scratch(cells.sparkSession) as own:
            w = stash(w)
            paths.append(own.pop())
        delete(cells.sparkSession, paths[:-1])
        del paths[:-1]
        off = [w.groupBy(d).agg(F.sum("w").alias("have")).join(aims[d], d).where("t > 0").agg(F.max(F.abs(F.col("have") / F.col("t") - 1))).first()[0] for d in DIMS]
        before, miss = miss, max((x for x in off if x is not None), default=0.0)
        if miss <= TOLERANCE or before - miss < TOLERANCE / 100:
            break
    w = w.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(1.0))
    low, high = 0.0, 1.0
    clipped = lambda g: F.coalesce(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.lit(float(g)) * F.col("weight"))), F.lit(0.0))
    while high < 1e18 and w.agg(clipped(high)).first()[0] < keep * total:
        high *= 2**20
    while total and high - low > 1e-14 * high:  # 64 parts a pass
        grid = np.linspace(low, high, 65)
        i = min(64, max(1, int(np.searchsorted(np.array(w.agg(*map(clipped, grid)).first(), float), keep * total))))
        if (grid[i - 1], grid[i]) == (low, high):
            break
        low, high = grid[i - 1], grid[i]
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(high)) * F.col("weight"))).otherwise(1.0)
    expected = F.when(F.col("tokens") > 0, F.lit(float(keep)) * F.col("weight")).otherwise(1.0)
    return w.select(*DIMS, "weight", p.alias("probability"), expected.alias("expected"), F.lit(float(miss)).alias("miss"))


def _copies(expected: Column, u: Column) -> Column:
    return (F.floor(expected) + (u < expected - F.floor(expected)).cast("long")).cast("long")


def drawn(docs: DataFrame, keep: float = 0.5, power: float = 0.5, seed: int = 7, max_cells: int = MAX_CELLS, targets: Targets = None, rules: Rules = TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled, expected, copies, miss) of every row."""
    own = stash(measured(docs, rules))
    cells = own.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))
    w, few = weights(stash(cells), keep, power, max_cells, targets)
    out = own.join(F.broadcast(w) if few else w, list(DIMS))
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return out.select("doc_id", *DIMS, "n_tokens", "weight", "probability", (u < F.col("probability")).alias("sampled"), "expected", _copies(F.col("expected"), u).alias("copies"), "miss")


def mix(docs: DataFrame, keep: float = 0.9, power: float = 0.9, seed: int = 7, repeats: bool = False, targets: Targets = None, rules: Rules = TOPICS) -> DataFrame:
    """The drawn rows of docs, with its columns; with `repeats` as often as they have copies. Documents are not joined with themselves but meet their cell's weight alone."""
    p, text, columns = free_prefix(docs), F.coalesce(F.col("text").cast("string"), F.lit("")), [F.col(f"`{c}`") for c in docs.columns]
    w, few = weights(stash(measured(docs, rules).groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens"))), keep, power, targets=targets)
    w = w.select(*[F.col(d).alias(f"{p}{d}") for d in DIMS], F.col("expected" if repeats else "probability").alias(f"{p}p"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    own = {f"{p}s": name("source"), f"{p}l": name("lang"), f"{p}t": _topics(docs, text, rules)}
    on = [F.col(a) == F.col(f"{p}{d}") for a, d in zip(own, DIMS)]
    out = docs.withColumns(own).join(F.broadcast(w) if few else w, on)
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    if repeats:
        each = F.explode(F.expr(f"array_repeat(0, cast(`{p}n` as int))")).alias(f"{p}k")
        return out.withColumn(f"{p}n", _copies(F.col(f"{p}p"), u)).select(*columns, each).drop(f"{p}k")
    return out.where(u < F.col(f"{p}p")).select(*columns)
