"""Flow networks as edge tables (id, next_id): each node drains to at most one other; pits have a null next_id.

Sums and labels along paths use pointer doubling: log2(depth) joins, each cut from its lineage by checkpoint().
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shared import shared_dir
from ..functions.ship import ship

# The direction codes and their steps (row, column).
LDD = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}
D8 = {32: (-1, -1), 64: (-1, 0), 128: (-1, 1), 16: (0, -1), 1: (0, 1), 8: (1, -1), 4: (1, 0), 2: (1, 1)}
LDD_PITS, D8_PITS, D8_PLUS_PITS = (5,), (0,), (0, -1)


def _cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def decode(grid: DataFrame, codes: dict[int, tuple[int, int]], pits: tuple[int, ...], cols: int, code: str = "code") -> DataFrame:
    """grid (row, col, code) to edges; id = row * cols + col. Unknown codes are no data and dropped."""
    step = F.create_map(*[x for k, (r, c) in codes.items() for x in (F.lit(k), F.array(F.lit(r), F.lit(c)))])
    own = (F.col("row").cast("long") * cols + F.col("col")).alias("id")
    s = F.try_element_at(step, F.col(code).cast("int"))
    nxt = F.when(~F.col(code).isin(list(pits)), (F.col("row") + s[0]).cast("long") * cols + F.col("col") + s[1])
    return grid.where(F.col(code).isin([*codes, *pits])).select(own, nxt.alias("next_id"))


def decode_next_xy(grid: DataFrame, cols: int, pits: tuple[int, ...] = (-9, -10), missing: int = -9999) -> DataFrame:
    """grid (row, col, nextx, nexty), from 1, to edges."""
    own = (F.col("row").cast("long") * cols + F.col("col")).alias("id")
    nxt = F.when(~F.col("nextx").isin(list(pits)), (F.col("nexty") - 1).cast("long") * cols + F.col("nextx") - 1)
    return grid.where(F.col("nextx") != missing).select(own, nxt.alias("next_id"))


def downstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes, "id").where("next_id is not null").select("id", "next_id")


def upstream(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, up_id): all nodes that drain straight into each given one."""
    return edges.select(F.col("id").alias("up_id"), F.col("next_id").alias("id")).join(nodes, "id").select("id", "up_id")


def pits(edges: DataFrame) -> DataFrame:
    return edges.where("next_id is null").select("id")


def flux(edges: DataFrame, state: DataFrame) -> DataFrame:
    """(id, state): one step; each node's state goes downstream, pits keep theirs."""
    return edges.join(state, "id").groupBy(F.coalesce("next_id", "id").alias("id")).agg(F.sum("state").alias("state"))


def _rounds(edges: DataFrame, rounds: int | None) -> int:
    return rounds if rounds is not None else max(1, edges.count()).bit_length() + 1


def accumulate(edges: DataFrame, state: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, state): the sum over all nodes upstream, and the node itself. After round k a node has the sum over those less than
    2^k steps away. Raises on a cycle."""
    f = _cut(edges.join(state, "id").select("id", F.col("next_id").alias("jump"), "state"))
    for _ in range(_rounds(edges, rounds)):
        if f.where("jump is not null").isEmpty():
            return f.select("id", "state")
        up = f.where("jump is not null").groupBy(F.col("jump").alias("id")).agg(F.sum("state").alias("_add"))
        on = f.select(F.col("id").alias("jump"), F.col("jump").alias("_then"))
        f = _cut(f.join(up, "id", "left").join(on, "jump", "left").select("id", F.col("_then").alias("jump"), (F.col("state") + F.coalesce("_add", F.lit(0))).alias("state")))
    if f.where("jump is not null").isEmpty():
        return f.select("id", "state")
    raise ValueError("the network has a cycle")


def basins(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, basin): the pit that each node drains to, or the node outside the table. Raises on a cycle."""
    f = _cut(edges.select("id", F.coalesce("next_id", "id").alias("basin")))
    for _ in range(_rounds(edges, rounds)):
        on = f.select(F.col("id").alias("basin"), F.col("basin").alias("_then"))
        then = F.coalesce("_then", "basin")
        g = _cut(f.join(on, "basin", "left").select("id", then.alias("basin"), (then != F.col("basin")).alias("_moved")))
        f = g.select("id", "basin")
        if g.where("_moved").isEmpty():
            inner = edges.where("next_id is not null").select(F.col("id").alias("basin"))
            if f.join(inner, "basin", "left_semi").isEmpty():  # a cycle whose length is a power of two comes to rest too
                return f
            break
    raise ValueError("the network has a cycle")


def catchments(edges: DataFrame, outlets: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, outlet): the first of the outlets downstream of each node, itself included; nodes that meet none are left out."""
    o = outlets.select("id", F.lit(True).alias("_o")).distinct()
    own = edges.join(o, "id", "left").select("id", F.when(F.col("_o"), None).otherwise(F.col("next_id")).alias("next_id"))
    return basins(own, rounds).join(outlets.select(F.col("id").alias("basin")).distinct(), "basin").select("id", F.col("basin").alias("outlet"))


def _jumps(edges: DataFrame, steps: int) -> list[DataFrame]:
    """(id, jump) of 1, 2, 4, ... steps, as far as `steps` needs them and some node has one; each is a join of the one before with itself."""
    out, jump = [], _cut(edges.where("jump is not null").select("id", "jump"))
    while not jump.isEmpty():
        out.append(jump)
        if 2 ** len(out) > steps:
            break
        jump = _cut(jump.join(jump.select(F.col("id").alias("jump"), F.col("jump").alias("_then")), "jump").select("id", F.col("_then").alias("jump")))
    return out


def _walk(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(start, step, id) along edges (id, jump). Powers of two from the greatest down: each round, every row of a path so far sends
    one more row 2^k steps on, so a path of n nodes takes log2(n) joins whose rows sum up to n."""
    at = starts.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("step"), "id")
    jumps = _jumps(edges, max(steps, 0)) if steps > 0 else []
    for k in range(len(jumps) - 1, -1, -1):
        ahead = at.join(jumps[k], "id").select("start", (F.col("step") + 2**k).alias("step"), F.col("jump").alias("id"))
        at = _cut(at.unionByName(ahead.where(F.col("step") <= steps)))
    return at.withColumn("step", F.col("step").cast("int"))


def path_downstream(edges: DataFrame, starts: DataFrame, steps: int, stops: DataFrame | None = None) -> DataFrame:
    """(start, step, id): from each start at most `steps` nodes down, to a pit or the first stop, which is part of the path."""
    own = edges.select("id", F.col("next_id").alias("jump"))
    if stops is not None:
        s = stops.select("id", F.lit(True).alias("_s")).distinct()
        own = own.join(s, "id", "left").select("id", F.when(F.col("_s"), None).otherwise(F.col("jump")).alias("jump"))
    return _walk(own, starts, steps)


def path_upstream(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(start, step, id): up from each start until a node has not just one node above it."""
    single = edges.where("next_id is not null").groupBy("next_id").agg(F.count("*").alias("_n"), F.min("id").alias("_up")).where("_n = 1").select(F.col("next_id").alias("id"), F.col("_up").alias("jump"))
    return _walk(single, starts, steps)


def outlets(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Pits with the attributes of their cells (id, ...)."""
    return pits(edges).join(cells, "id", "left")


def _local(own: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a tile's nodes (id, next_id): the place of the next one inside the tile or -1, that of the last one downstream inside it, and an order
    in which every node comes after all that drain to it."""
    ids = own["id"].to_numpy(np.int64)
    order = np.argsort(ids)
    nxt = own["next_id"].to_numpy(float)
    known = np.where(np.isnan(nxt), -1, nxt).astype(np.int64)
    at = np.minimum(np.searchsorted(ids[order], known), max(0, len(ids) - 1))
    down = np.where((ids[order][at] == known) & ~np.isnan(nxt), order[at], -1)
    last, depth = np.where(down >= 0, down, np.arange(len(ids))), (down >= 0).astype(np.int64)
    for _ in range(max(1, len(ids)).bit_length() + 1):
        step = depth[last]
        if not step.any():
            return down, last, np.argsort(-depth, kind="stable")
        depth, last = depth + step, last[last]
    raise ValueError("the network has a cycle")


def _summed(own: pd.DataFrame, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over all nodes of the tile that drain to each, the last node downstream)."""
    down, last, order = _local(own)
    total, to = state.astype(float).tolist(), down.tolist()
    for i in order.tolist():
        if to[i] >= 0:
            total[to[i]] += total[i]
    return np.array(total), last


def accumulate_tiles(edges: DataFrame, state: DataFrame, tile: Column) -> DataFrame:
    """`accumulate` where nodes lie in tiles that drain mostly within themselves (blocks of a grid, say): each tile is solved in its task, then
    the network of the nodes that leave a tile, and then the tiles again with what comes in. So what is shuffled more than once are
    the borders. tile: a number for each id; a tile must fit a task. Raises on a cycle."""
    ship(edges.sparkSession)
    own = _cut(edges.join(state, "id").select(tile.alias("_tile"), "id", "next_id", F.col("state").cast("double").alias("state")))

    def ends(part: pd.DataFrame) -> pd.DataFrame:
        total, last = _summed(part, part["state"].to_numpy())
        out = np.flatnonzero(last == np.arange(len(last)))
        return pd.DataFrame({"id": part["id"].to_numpy()[out], "next_id": part["next_id"].to_numpy()[out], "state": total[out]})

    def exits(part: pd.DataFrame) -> pd.DataFrame:
        ids, last = part["id"].to_numpy(), _local(part)[1]
        hit = part["_in"].to_numpy(bool)
        return pd.DataFrame({"entry": ids[hit], "exit": ids[last[hit]]})

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": part["id"], "state": _summed(part, (part["state"] + part["_add"].fillna(0.0)).to_numpy())[0]})

    out = _cut(own.groupBy("_tile").applyInPandas(ends, "id long, next_id long, state double"))
    entries = out.where("next_id is not null").select(F.col("next_id").alias("id")).distinct().withColumn("_in", F.lit(True))
    marked = own.join(entries, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    ways = _cut(marked.groupBy("_tile").applyInPandas(exits, "entry long, exit long"))
    border = out.join(ways, out["next_id"] == ways["entry"], "left").select("id", F.col("exit").alias("next_id"), "state")
    done = accumulate(border.select("id", "next_id"), border.select("id", "state"))
    comes = out.where("next_id is not null").select("id", "next_id").join(done, "id").groupBy(F.col("next_id").alias("id")).agg(F.sum("state").alias("_add"))
    return own.join(comes, "id", "left").groupBy("_tile").applyInPandas(whole, "id long, state double")
