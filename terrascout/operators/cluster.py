"""Clustering on a distance graph: components, DBSCAN, greedy thinning.

No operator lists the edges of a dense spot.  Points are grouped in tiles small
enough that all points of one tile are neighbours, so a component is a component
of the tile graph; degrees and borders are radius aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.operators import rank, tiles
from terrascout.operators.joins import frequent, frequent_keys, look_up, share_of
from terrascout.session import cut, steps


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id",
                         src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) with component = smallest id reachable (G2 on any graph).

    Every round each vertex hooks to the neighbour that comes first in the order of a hash,
    which keeps chains short on any graph; chains are shortened twice, and the
    graph is contracted to the vertices that remain.  Neighbours of a hub are combined
    before the shuffle and looked up in parts (``joins.look_up``), never in one group.
    """
    def order(column: str):
        return F.struct(F.xxhash64(column).alias("h"), F.col(column).alias("v"))

    def named(hook: DataFrame, v: str, p: str) -> DataFrame:
        return hook.select(F.col("v").alias(v), F.col("p").alias(p))

    def follow(step: DataFrame, via: DataFrame, hot: DataFrame | None) -> DataFrame:
        return look_up(step, "p", named(via, "p", "_g"), hot).select("v", F.coalesce("_g", "p").alias("p"))

    def ordered(a: str, b: str) -> list:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    moves: list[DataFrame] = []
    with steps(nodes.sparkSession) as own:
        e = cut(edges.select(*ordered(src, dst)).filter(F.col("a") != F.col("b")).distinct())
        while n := e.count():
            both = e.union(e.select("b", "a"))
            first = both.groupBy(F.col("a").alias("v")).agg(F.min(order("b")).alias("m"), F.count(F.lit(1)).alias("_n"))
            hook = cut(first.select("v", F.least("m", order("v"))["v"].alias("p"), "_n"))
            # No vertex is looked up more often than it has neighbours.
            hubs = frequent(hook, "v", share_of(n, e))
            hot = {c: hubs and hubs.withColumnRenamed("v", c) for c in "abp"}
            jump = follow(hook.select("v", "p"), hook, hot["p"])
            jump = cut(follow(jump, jump, hot["p"]))
            moves.append(jump)
            # Each vertex and its target were neighbours, so both stay linked wherever they move.
            half = look_up(e, "a", named(jump, "a", "_pa"), hot["a"])
            moved = look_up(half, "b", named(jump, "b", "_pb"), hot["b"])
            e = cut(moved.select(*ordered("_pa", "_pb")).filter(F.col("a") != F.col("b")).distinct())
        if not moves:
            return own.keep(nodes.select(F.col(id_col), F.col(id_col).alias("component")).distinct())
        # Composed from the last and smallest contraction back to the first.
        label = moves[-1]
        for jump in reversed(moves[:-1]):
            label = follow(jump, label, frequent_keys(jump, "p"))
        assign = cut(nodes.select(F.col(id_col).alias("v")).distinct().join(label, "v", "left")
                     .select("v", F.coalesce("p", "v").alias("p")))
        low = assign.groupBy("p").agg(F.min("v").alias("_low"))
        found = look_up(assign, "p", low, frequent_keys(assign, "p"))
        return own.keep(found.select(F.col("v").alias(id_col), F.col("_low").alias("component")))


def _tile_graph(points: DataFrame, eps: float, cap: int):
    """Tiles whose points are all neighbours, and which tiles touch.

    ``points`` has id, x, y.  Returns points with their tile's node id, and the
    edges between nodes.
    """
    side = eps / math.sqrt(2.0) * (1.0 - 1e-9)
    spots = cut(points.groupBy("x", "y").agg(F.min("id").alias("id")))

    def own(df: DataFrame, size: float, a: str, b: str) -> DataFrame:
        return df.withColumns({a: F.floor(F.col("x") / F.lit(size)).cast("bigint"),
                               b: F.floor(F.col("y") / F.lit(size)).cast("bigint")})

    cells = cut(own(spots, side, "cx", "cy").groupBy("cx", "cy")
                .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("_n")))
    half = F.expr("array(" + ",".join(f"named_struct('i',{i}L,'j',{j}L)" for j in range(3)
                                      for i in range(-2, 3) if j > 0 or i > 0) + ")")
    other = cells.select(F.col("cx").alias("dx"), F.col("cy").alias("dy"), F.col("node").alias("b"))
    pairs = (cells.withColumn("_o", F.explode(half))
             .select(F.col("node").alias("a"), "cx", "cy",
                     (F.col("cx") + F.col("_o.i")).alias("dx"), (F.col("cy") + F.col("_o.j")).alias("dy"))
             .join(other, ["dx", "dy"]))

    # Sub-tile pairs (a,b,ax,ay,bx,by) that may still hold two points within eps.
    open_pairs = pairs.select("a", "b", F.col("cx").alias("ax"), F.col("cy").alias("ay"),
                              F.col("dx").alias("bx"), F.col("dy").alias("by"))
    edges, size, depth = None, side, 0
    level = cells.select("cx", "cy", "_n")
    quarter = tiles.offsets(range(2), range(2))
    while int(level.agg(F.max("_n")).first()[0] or 0) > cap and depth < tiles.MAX_DEPTH:
        size, depth = size / 2, depth + 1
        level = own(spots, size, "cx", "cy").groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("_n"))
        there = level.select("cx", "cy")
        split = (open_pairs.withColumn("_o", F.explode(quarter))
                 .select("a", "b", "bx", "by", (F.col("ax") * 2 + F.col("_o.i")).alias("cx"),
                         (F.col("ay") * 2 + F.col("_o.j")).alias("cy"))
                 .join(there, ["cx", "cy"])
                 .withColumnsRenamed({"cx": "ax", "cy": "ay"})
                 .withColumn("_o", F.explode(quarter))
                 .select("a", "b", "ax", "ay", (F.col("bx") * 2 + F.col("_o.i")).alias("cx"),
                         (F.col("by") * 2 + F.col("_o.j")).alias("cy"))
                 .join(there, ["cx", "cy"])
                 .withColumnsRenamed({"cx": "bx", "cy": "by"}))
        gx, gy = F.abs(F.col("ax") - F.col("bx")), F.abs(F.col("ay") - F.col("by"))
        s = F.lit(size)
        far2 = (gx + 1) * (gx + 1) * s * s + (gy + 1) * (gy + 1) * s * s
        mx, my = F.greatest(gx - 1, F.lit(0)), F.greatest(gy - 1, F.lit(0))
        near2 = mx * mx * s * s + my * my * s * s
        state = cut(split.filter(near2 <= F.lit((eps + tiles.SLACK) ** 2))
                    .withColumn("_sure", far2 <= F.lit((eps - tiles.SLACK) ** 2)))
        sure = state.filter("_sure").select("a", "b").distinct()
        edges = sure if edges is None else edges.union(sure)
        open_pairs = state.drop("_sure").join(sure, ["a", "b"], "left_anti")
    here = own(spots, size, "_tx", "_ty")
    left = here.select(F.col("_tx").alias("ax"), F.col("_ty").alias("ay"),
                       F.col("x").alias("_qx"), F.col("y").alias("_qy"))
    right = here.select(F.col("_tx").alias("bx"), F.col("_ty").alias("by"),
                        F.col("x").alias("_tx"), F.col("y").alias("_ty"))
    close = (open_pairs.join(left, ["ax", "ay"]).join(right, ["bx", "by"])
             .filter(tiles._distance() <= F.lit(float(eps))).select("a", "b").distinct())
    edges = close if edges is None else edges.union(close)
    tagged = own(points, side, "cx", "cy").join(cells.drop("_n"), ["cx", "cy"]).drop("cx", "cy")
    return tagged, edges


def _components_xy(points: DataFrame, eps: float, cap: int) -> DataFrame:
    """(id, component) of the graph d <= eps over points with id, x, y."""
    tagged, edges = _tile_graph(points, eps, cap)
    comp = connected_components(tagged.select("node"), edges, "node", "a", "b")
    joined = tagged.select("id", "node").join(comp, "node")
    # A node is named by the smallest id of its tile, so the component is too.
    return joined.select("id", "component")


def single_link(points: DataFrame, eps: float, *, id_col: str, lat0: float, cap: int = 64) -> DataFrame:
    """Single-link clusters at distance ``eps`` (G2): (id_col, component)."""
    xy = tiles.planar(points, lat0).select(F.col(id_col).alias("id"), "x", "y")
    return _components_xy(xy, eps, cap).withColumnRenamed("id", id_col)


def dbscan(points: DataFrame, eps: float, min_points: int, *, id_col: str, lat0: float,
           cap: int = 64) -> DataFrame:
    """Density clusters (G3): (id_col, cluster, is_core); cluster -1 is noise.

    ``min_points`` counts the point itself.  Clusters are numbered from 0 by
    their lowest core id; a border point joins the lowest-numbered cluster it
    touches.  Fewer than ``min_points`` points in all are all noise, which the
    degree rule gives by itself.
    """
    xy = cut(tiles.planar(points, lat0).select(F.col(id_col).alias("id"), "x", "y"))
    degree = tiles.radius_aggregate(xy, xy.withColumnRenamed("id", "_t"), eps,
                                    {"deg": ("count", None)}, q_id="id")
    core = cut(xy.join(degree.filter(F.col("deg") >= min_points).select("id"), "id"))
    comp = _components_xy(core, eps, cap)
    order = rank.cumulate(comp.select("component").distinct(), "component", "component")
    comp = cut(comp.join(order.select("component", (F.col("rn") - 1).alias("cluster")), "component")
               .select("id", "cluster"))
    cored = core.join(comp, "id")
    rest = xy.join(comp, "id", "left_anti")
    border = tiles.radius_aggregate(rest, cored.withColumnRenamed("id", "_t"), eps,
                                    {"cluster": ("min", "cluster")}, q_id="id")
    labelled = (comp.withColumn("is_core", F.lit(True))
                .unionByName(border.withColumn("is_core", F.lit(False))))
    return (xy.select("id").join(labelled, "id", "left")
            .select(F.col("id").alias(id_col),
                    F.coalesce("cluster", F.lit(-1)).cast("bigint").alias("cluster"),
                    F.coalesce("is_core", F.lit(False)).alias("is_core")))


THIN_ROWS = 20_000  # sites of a tile that one task thins in order
_KEPT, _DROPPED, _OPEN = 1, 2, 0


def _thin_tile(ids: np.ndarray, xy: np.ndarray, sheltered: np.ndarray, radius: float) -> np.ndarray:
    """What the sequential loop does with the sites of one tile, as far as the tile can tell.

    A site with a kept earlier one nearby is dropped.  One without is kept if no undecided
    earlier site is nearby and nothing outside the tile can be (``sheltered``).
    """
    status = np.zeros(len(ids), np.int32)
    near = radius + 5e-10  # distances count to 1e-9 km
    square = np.floor(xy / near).astype(np.int64)
    held: dict[tuple[int, int], list[list[int]]] = {}  # square -> kept, undecided

    def any_near(i: int, kind: int) -> bool:
        a, b = int(square[i, 0]), int(square[i, 1])
        for key in ((a + s, b + t) for s in (0, -1, 1) for t in (0, -1, 1)):
            if key in held and held[key][kind]:
                gap = xy[held[key][kind]] - xy[i]
                if (np.sqrt((gap ** 2).sum(1)) < near).any():
                    return True
        return False

    for i in np.argsort(ids, kind="stable").tolist():
        if any_near(i, 0):
            status[i] = _DROPPED
            continue
        keep = sheltered[i] and not any_near(i, 1)
        status[i] = _KEPT if keep else _OPEN
        held.setdefault((int(square[i, 0]), int(square[i, 1])), [[], []])[0 if keep else 1].append(i)
    return status


def _tile_pass(sites: DataFrame, radius: float, start: dict[str, float], tile_rows: int) -> DataFrame:
    """(id, x, y, status) after one pass over tiles from ``start`` on, as large as hold ``tile_rows`` sites.

    Tiles are squares of a quadtree over cells of eight radii.  Sites in cells with more
    sites than that stay open.
    """
    side = 8.0 * radius
    placed = sites.withColumns({f"_c{c}": F.floor((F.col(c) - F.lit(start[c])) / F.lit(side)) for c in "xy"})
    cells = cut(placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n")).withColumn("_level", F.when(F.col("_n") <= tile_rows, F.lit(0))))
    level, more = 0, True
    while more:
        level += 1
        up = {f"_{c}": F.shiftright(c, level) for c in ("_cx", "_cy")}
        whole = cells.withColumns(up).groupBy(*up).agg(F.sum("_n").alias("_m")).filter(F.col("_m") <= tile_rows)
        cells = cut(cells.withColumns(up).join(whole, list(up), "left")
                    .withColumn("_level", F.when(F.col("_m").isNotNull(), level).otherwise(F.col("_level"))).drop("_m"))
        squares, grown = cells.agg(F.count_distinct(*up), F.count_if(F.col("_level") == level)).first()
        more = squares > 1 and grown > 0
        cells = cells.drop(*up)
    tiled = placed.join(cells.drop("_n"), ["_cx", "_cy"], "left")
    size = F.expr("cast(shiftleft(1L, _level) as double)") * F.lit(side)
    corner = {c: F.expr(f"cast(shiftright(_c{c}, _level) as double)") * size + F.lit(start[c]) for c in "xy"}
    margin = F.least(*[F.least(F.col(c) - corner[c], corner[c] + size - F.col(c)) for c in "xy"])
    solid = tiled.filter("_level is not null").select(
        "id", "x", "y", F.expr("concat_ws(' ', _level, shiftright(_cx, _level), shiftright(_cy, _level))").alias("tile"),
        (margin > F.lit(radius + tiles.SLACK)).alias("sheltered"))

    def thin(frame: pd.DataFrame) -> pd.DataFrame:
        status = _thin_tile(frame["id"].to_numpy(), frame[["x", "y"]].to_numpy(), frame["sheltered"].to_numpy(), radius)
        return frame[["id", "x", "y"]].assign(status=status)

    kind = dict(sites.dtypes)["id"]
    done = solid.groupBy("tile").applyInPandas(thin, f"id {kind}, x double, y double, status int")
    return done.unionByName(tiled.filter("_level is null").select("id", "x", "y", F.lit(_OPEN).alias("status")))


def _open_pass(sites: DataFrame, radius: float) -> DataFrame:
    """(id, x, y, status): sites with no earlier open one nearby are kept, what lies around them is dropped."""
    as_target = sites.withColumn("_o", F.col("id")).withColumnRenamed("id", "_t")
    first = tiles.radius_aggregate(sites, as_target, radius, {"low": ("min", "_o")}, q_id="id")
    winners = cut(sites.join(first.filter(F.col("low") == F.col("id")).select("id"), "id"))
    hit = tiles.radius_aggregate(sites, winners.withColumnRenamed("id", "_t"), radius, {"hits": ("count", None)}, q_id="id")
    status = F.when(F.col("_w").isNotNull(), _KEPT).when(F.col("hits").isNotNull(), _DROPPED).otherwise(_OPEN)
    return sites.join(winners.select("id", F.lit(1).alias("_w")), "id", "left").join(hit, "id", "left") \
        .select("id", "x", "y", status.alias("status"))


def dedupe_sites(sites: DataFrame, radius: float, *, order_col: str, lat0: float, tile_rows: int = THIN_ROWS) -> DataFrame:
    """Greedy thinning in input order (G1): a kept site drops later sites within ``radius``.

    Tiles of at most ``tile_rows`` sites are thinned in order, each by one task; sites that
    depend on what lies beyond their tile stay open, and the next pass moves the tiles by
    half a cell.  Where a spot is too crowded for a tile, a pass over all
    open sites keeps those without earlier neighbours.  A chain of sites that each block
    the next takes as many passes as it crosses tiles.
    """
    if radius <= 0:
        raise ValueError("the radius must be above 0")
    with steps(sites.sparkSession) as own:
        left = cut(tiles.planar(sites, lat0).select(F.col(order_col).alias("id"), "x", "y"))
        x, y, count = left.agg(F.min("x"), F.min("y"), F.count(F.lit(1))).first()
        kept, turn = left.limit(0), 0
        while count:
            # Every site lies well inside its tile in one of four passes.
            start = {"x": x - radius * (2 + 4 * (turn % 2)), "y": y - radius * (2 + 4 * (turn // 2 % 2))}
            done = cut(_tile_pass(left, radius, start, tile_rows))
            if done.filter(F.col("status") != _OPEN).isEmpty():
                done = cut(_open_pass(left, radius))
            kept = kept.unionByName(done.filter(F.col("status") == _KEPT).drop("status"))
            left = cut(done.filter(F.col("status") == _OPEN).drop("status"))
            count, turn = left.count(), turn + 1
        return own.keep(sites.join(kept.select(F.col("id").alias(order_col)), order_col, "left_semi"))


def morans_i(values: DataFrame, edges: DataFrame, *, id_col: str, value: str,
             src: str = "src", dst: str = "dst") -> DataFrame:
    """Spatial autocorrelation on neighbour edges.

    ``morans_i`` weighs the edges of one source 1/k (k = edges per source);
    ``raw`` is k times that.  NULL when the variance is 0.
    """
    head = values.agg(F.avg(value), F.count(value)).first()
    mean, n = float(head[0] or 0.0), int(head[1])
    centred = values.select(F.col(id_col).alias("_id"), (F.col(value) - F.lit(mean)).alias("_v"))
    spread = float(centred.agg(F.sum(F.col("_v") * F.col("_v"))).first()[0] or 0.0)
    a = centred.withColumnsRenamed({"_id": src, "_v": "_a"})
    b = centred.withColumnsRenamed({"_id": dst, "_v": "_b"})
    total = (edges.select(src, dst).join(a, src).join(b, dst)
             .agg(F.sum(F.col("_a") * F.col("_b")).alias("_c"), F.count(F.lit(1)).alias("_m")))
    raw = F.when(F.lit(spread > 0), F.col("_c") / F.lit(spread or 1.0))
    return total.select(F.lit(n).cast("bigint").alias("n"),
                        (raw / F.nullif(F.col("_m") / F.lit(float(max(n, 1))), F.lit(0.0))).alias("morans_i"),
                        raw.alias("raw"))


def neighbour_mean(vectors: DataFrame, edges: DataFrame, alpha: float, *, id_col: str, vec: str,
                   src: str = "src", dst: str = "dst") -> DataFrame:
    """(1 - alpha) * z + alpha * mean of the neighbours' vectors.

    ``vec`` is an array of numbers; a row without neighbours keeps its vector.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    own = vectors.select(F.col(id_col).alias(src), F.col(vec).cast("array<double>").alias("_z"))
    if alpha == 0:
        return own.select(F.col(src).alias(id_col), F.col("_z").alias(vec))
    theirs = own.select(F.col(src).alias(dst), array_to_vector("_z").alias("_v"))
    mean = (edges.select(src, dst).join(theirs, dst)
            .groupBy(src).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_m")))
    mixed = F.when(F.col("_m").isNull(), F.col("_z")).otherwise(
        F.zip_with("_z", "_m", lambda z, m: z * F.lit(1.0 - alpha) + m * F.lit(float(alpha))))
    return own.join(mean, src, "left").select(F.col(src).alias(id_col), mixed.alias(vec))
