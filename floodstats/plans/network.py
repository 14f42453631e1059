"""Queries over flow networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as N
from .data import TREE, table, tree
from .registry import query

REACH = f"WITH RECURSIVE {TREE}, r(id, anc, step) AS (SELECT id, id, 0 FROM n UNION ALL SELECT r.id, n.next_id, r.step + 1 FROM r JOIN n ON r.anc = n.id WHERE n.next_id IS NOT NULL)"


def some(spark, sf, mod: int, rest: int):
    return tree(spark, sf)[0].select("id").where(F.col("id") % mod == rest)


@query(f"WITH {TREE} SELECT id, next_id FROM n WHERE next_id IS NOT NULL AND id % 7 = 3")
def net_downstream(spark, sf):
    return N.downstream(tree(spark, sf)[0], some(spark, sf, 7, 3))


@query(f"WITH {TREE} SELECT next_id AS id, id AS up_id FROM n WHERE next_id % 7 = 3")
def net_upstream(spark, sf):
    return N.upstream(tree(spark, sf)[0], some(spark, sf, 7, 3))


@query("SELECT p_partkey AS id FROM part WHERE p_partkey < 90 AND p_partkey % 9 = 0")
def net_pits(spark, sf):
    return N.pits(chain(spark, sf))


@query(f"WITH {TREE} SELECT coalesce(next_id, id) AS id, CAST(sum(state) AS BIGINT) AS state FROM n GROUP BY 1")
def net_flux(spark, sf):
    return N.flux(*tree(spark, sf))


@query(f"{REACH} SELECT r.anc AS id, CAST(sum(n.state) AS BIGINT) AS state FROM r JOIN n ON n.id = r.id GROUP BY 1")
def net_accuflux(spark, sf):
    return N.accumulate(*tree(spark, sf))


@query(f"{REACH} SELECT r.anc AS id, CAST(sum(n.state) AS DOUBLE) AS state FROM r JOIN n ON n.id = r.id GROUP BY 1")
def net_accuflux_tiles(spark, sf):
    return N.accumulate_tiles(*tree(spark, sf), F.floor(F.col("id") / 300).cast("long"))


@query(f"{REACH} SELECT id AS start, CAST(step AS INT) AS step, anc AS id FROM r WHERE r.id % 50 = 0 AND step <= 4")
def net_path_down(spark, sf):
    return N.path_downstream(tree(spark, sf)[0], some(spark, sf, 50, 0), 4)


CHAIN = "ch AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 9 > 0 THEN p_partkey - 1 WHEN p_partkey >= 90 THEN p_partkey - 90 END AS next_id FROM part)"


def chain(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(k.alias("id"), F.when(k % 9 > 0, k - 1).when(k >= 90, k - 90).alias("next_id"))


@query(
    f"""WITH RECURSIVE {CHAIN}, u AS (SELECT next_id AS id, min(id) AS up FROM ch WHERE next_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
r(start, step, id) AS (SELECT id, 0, id FROM ch WHERE id % 9 = 2 UNION ALL SELECT r.start, r.step + 1, u.up FROM r JOIN u ON u.id = r.id WHERE r.step < 12) SELECT start, CAST(step AS INT) AS step, id FROM r"""
)
def net_path_up(spark, sf):
    c = chain(spark, sf)
    return N.path_upstream(c, c.where("id % 9 = 2").select("id"), 12)


@query(f"{REACH}, o AS (SELECT id, arg_min(anc, step) AS outlet FROM r WHERE anc % 13 = 5 GROUP BY 1) SELECT id, outlet FROM o")
def net_catchment(spark, sf):
    return N.catchments(tree(spark, sf)[0], some(spark, sf, 13, 5))


@query(f"WITH RECURSIVE {CHAIN}, r(id, anc) AS (SELECT id, id FROM ch UNION ALL SELECT r.id, ch.next_id FROM r JOIN ch ON ch.id = r.anc WHERE ch.next_id IS NOT NULL) SELECT r.id, r.anc AS basin FROM r JOIN ch ON ch.id = r.anc WHERE ch.next_id IS NULL")
def net_basins(spark, sf):
    return N.basins(chain(spark, sf))


@query("SELECT p_partkey AS id, p_brand, p_size FROM part WHERE p_partkey < 90 AND p_partkey % 9 = 0")
def net_outlets(spark, sf):
    return N.outlets(chain(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size"))


def _decode(name: str, codes: dict, pits: tuple, sql_pits: str):
    listed = [*codes, *pits]

    def run(spark, sf):
        k = F.col("p_partkey")
        code = F.array(*map(F.lit, listed))
        g = table(spark, sf, "part").select((F.floor(k / 40) + 1).cast("int").alias("row"), (k % 40 + 1).cast("int").alias("col"), F.element_at(code, (k * 7 % len(listed) + 1).cast("int")).alias("code"))
        return N.decode(g, codes, pits, 50)

    step = " ".join(f"WHEN {c} THEN {r * 50 + d}" for c, (r, d) in codes.items())
    query(
        f"WITH g AS (SELECT (p_partkey // 40 + 1) * 50 + p_partkey % 40 + 1 AS id, ({listed})[CAST(p_partkey * 7 % {len(listed)} AS INT) + 1] AS code FROM part) SELECT id, CASE WHEN code NOT IN {sql_pits} THEN id + CASE code {step} END END AS next_id FROM g",
        name=name,
        whole=("next_id",),
    )(run)


_decode("d8_decode", N.D8, N.D8_PITS, "(0)")
_decode("ldd_decode", N.LDD, N.LDD_PITS, "(5)")
_decode("d8plus_decode", N.D8, N.D8_PLUS_PITS, "(0, -1)")


@query("SELECT (p_partkey // 40) * 40 + p_partkey % 40 AS id, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey // 40) * 40 + p_partkey % 40 - 1 END AS next_id FROM part WHERE p_partkey % 40 <> 0", whole=("next_id",))
def nextxy_decode(spark, sf):
    k = F.col("p_partkey")
    g = table(spark, sf, "part").where(k % 40 != 0).select(F.floor(k / 40).cast("int").alias("row"), (k % 40).cast("int").alias("col"), F.when(k % 11 != 0, k % 40).otherwise(-9).cast("int").alias("nextx"), F.when(k % 11 != 0, F.floor(k / 40) + 1).otherwise(-9).cast("int").alias("nexty"))
    return N.decode_next_xy(g, 40)


@query("SELECT p_size AS value, count(*) AS n FROM part GROUP BY 1")
def value_groups(spark, sf):
    return table(spark, sf, "part").groupBy(F.col("p_size").alias("value")).agg(F.count("*").alias("n"))
