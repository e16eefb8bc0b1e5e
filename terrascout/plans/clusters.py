"""Queries over distance graphs (G)."""

from __future__ import annotations

from terrascout.operators import cluster, tiles
from terrascout.plans.fixtures import DIST, LAT0, query, r6, rounded, sql
from terrascout.plans.joins import knn_sql


@query("G1_dedupe_sites", sql("sites", """
select unnest(kept) as site_id from (select kept from walk order by i desc limit 1)""",
                              f"nb as (select a.site_id, list(b.site_id) as near from fx_sites a join fx_sites b on {DIST} <= 150 and b.site_id < a.site_id group by 1)",
                              "seq as (select site_id, near, row_number() over (order by site_id) as i from fx_sites left join nb using (site_id))",
                              """walk as (select 0::bigint as i, []::bigint[] as kept union all select s.i,
 case when list_has_any(w.kept, coalesce(s.near, []::bigint[])) then w.kept else list_append(w.kept, s.site_id) end from walk w join seq s on s.i = w.i + 1)"""))
def g1(fx):
    """Greedy thinning of the sites at 150 km in id order."""
    return cluster.dedupe_sites(fx.sites, 150.0, order_col="site_id", lat0=LAT0).select("site_id")


def _reach(points: str, edges: str) -> tuple[str, str]:
    """CTEs of the smallest reachable id."""
    return (f"reach as (select id, id as lab from {points} union select e.dst, r.lab from reach r join {edges} e on e.src = r.id)",
            "comp as (select id, min(lab) as component from reach group by 1)")


@query("G2_single_link", sql("cells", "select id as cell_id, component from comp",
                             f"edges as (select a.cell_id as src, b.cell_id as dst from fx_cells a join fx_cells b on a.cell_id <> b.cell_id and {DIST} <= 30)",
                             *_reach("(select cell_id as id from fx_cells)", "edges")))
def g2(fx):
    return cluster.single_link(fx.cells, 30.0, id_col="cell_id", lat0=LAT0)


def dbscan_ctes(points: str, eps: float, least: int) -> tuple[str, ...]:
    """CTEs ending in ``labelled(id, cluster, is_core)`` over ``points(id, x, y)``."""
    return (f"eds as (select a.id as src, b.id as dst from {points} a join {points} b on a.id <> b.id and {DIST} <= {eps})",
            f"core as (select id, x, y from {points} left join (select src, count(*) as deg from eds group by 1) on src = id where coalesce(deg, 0) + 1 >= {least})",
            "ceds as (select src, dst from eds where src in (select id from core) and dst in (select id from core))",
            *_reach("core", "ceds"),
            "num as (select id, dense_rank() over (order by component) - 1 as cluster from comp)",
            f"""labelled as (select id, cluster, true as is_core from num union all
 select p.id, coalesce(min(n.cluster), -1), false from {points} p left join eds on src = p.id left join num n on n.id = dst where p.id not in (select id from core) group by 1)""")


@query("G3_dbscan", sql("scores", "select id as cell_id, cluster, is_core from labelled",
                        "pts as (select cell_id as id, x, y from fx_scores)", *dbscan_ctes("pts", 20.0, 3)))
def g3(fx):
    """Density clusters of all cells."""
    return cluster.dbscan(fx.scores, 20.0, 3, id_col="cell_id", lat0=LAT0)


@query("G4_neighbour_table", sql("cells", f"select cell_id as src, dst, cast(rk as integer) as rank, {r6('d')} as dist_km from nn",
                                 "other as (select cell_id as dst, x, y from fx_cells)",
                                 knn_sql("fx_cells", "other", "cell_id", "dst", 8, where="a.cell_id <> b.dst")))
def g4(fx):
    """Eight nearest other cells."""
    out = tiles.knn(fx.cells.withColumnRenamed("cell_id", "src"), fx.cells.withColumnRenamed("cell_id", "dst"), 8,
                    q_id="src", t_id="dst", lat0=LAT0, exclude_self=True)
    return rounded(out, "dist_km")


@query("G5_morans_i", sql("cells", f"""
select (select count(*) from fx_cells) as n, {r6('sum((a.bal - m) * (b.bal - m)) / max(v) / 8')} as morans_i, {r6('sum((a.bal - m) * (b.bal - m)) / max(v)')} as raw
from nn join fx_cells a on a.cell_id = nn.cell_id join fx_cells b on b.cell_id = nn.dst cross join (select avg(bal) as m, var_pop(bal) * count(*) as v from fx_cells)""",
                          "other as (select cell_id as dst, x, y from fx_cells)",
                          knn_sql("fx_cells", "other", "cell_id", "dst", 8, where="a.cell_id <> b.dst")))
def g5(fx):
    edges = tiles.knn(fx.cells.withColumnRenamed("cell_id", "src"), fx.cells.withColumnRenamed("cell_id", "dst"), 8,
                      q_id="src", t_id="dst", lat0=LAT0, exclude_self=True)
    return rounded(cluster.morans_i(fx.cells, edges, id_col="cell_id", value="bal"), "morans_i", "raw")
