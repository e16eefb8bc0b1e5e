"""Distance joins on square tiles.

Spark would run a raw distance predicate as a nested loop.  Every operator here
turns it into equi-joins on tile coordinates and refines only where the data is
dense:

* ``within``            all pairs inside a radius
* ``radius_aggregate``  mergeable aggregates inside a radius, without pairs for
                        tiles that lie wholly inside it
* ``knn``               exact k nearest neighbours

Coordinates are kilometres in an equirectangular plane around ``lat0``.
Distances are rounded to 1e-9 km so that ties do not depend on the last bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascout.functions.portable import rounding
from terrascout.session import cut

KM_PER_DEGREE = 111.32
SLACK = 1e-6  # km, guards tile tests against the last bit
HOT_ROWS = 100_000  # rows of one tile that one task should handle
TASK_PAIRS = 10_000_000  # pairs of rows that one task of a join should compare
MAX_PARTS = 20_000  # tasks of a join
MAX_DEPTH = 20


def planar(df: DataFrame, lat0: float, lat: str = "lat", lon: str = "lon",
           x: str = "x", y: str = "y") -> DataFrame:
    """Equirectangular kilometres around ``lat0``."""
    shrink = math.cos(math.radians(lat0))
    return df.withColumns({
        x: F.col(lon) * F.lit(KM_PER_DEGREE) * F.lit(shrink),
        y: F.col(lat) * F.lit(KM_PER_DEGREE),
    })


def _tile(value: str, size: float) -> Column:
    return F.floor(F.col(value) / F.lit(float(size))).cast("bigint")


def offsets(x: range, y: range) -> Column:
    """Constant array of (i, j) pairs, written as SQL text to keep plans cheap to build."""
    pairs = ",".join(f"named_struct('i',{i}L,'j',{j}L)" for i in x for j in y)
    return F.expr(f"array({pairs})")


def _spread(df: DataFrame, x: str, y: str, size: float, reach: int) -> DataFrame:
    """One row per tile of the (2*reach+1)^2 block around the row's own tile."""
    return (df.withColumn("_o", F.explode(offsets(range(-reach, reach + 1), range(-reach, reach + 1))))
            .withColumns({"_bx": _tile(x, size) + F.col("_o.i"),
                          "_by": _tile(y, size) + F.col("_o.j")})
            .drop("_o"))


def _own(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    return df.withColumns({"_bx": _tile(x, size), "_by": _tile(y, size)})


def _square(a: Column) -> Column:
    return a * a


def _gap2(size: float) -> Column:
    """Squared distance from (_qx,_qy) to the nearest edge of tile (_bx,_by)."""
    def gap(p: str, b: str) -> str:
        return f"greatest({b} * {size!r}D - {p}, 0D, {p} - ({b} + 1) * {size!r}D)"

    return F.expr(f"pow({gap('_qx', '_bx')}, 2D) + pow({gap('_qy', '_by')}, 2D)")


def _far(size: float) -> Column:
    """Distance from (_qx,_qy) to the farthest corner of tile (_bx,_by)."""
    def far(p: str, b: str) -> str:
        return f"greatest(abs({p} - {b} * {size!r}D), abs({p} - ({b} + 1) * {size!r}D))"

    return F.expr(f"sqrt(pow({far('_qx', '_bx')}, 2D) + pow({far('_qy', '_by')}, 2D))")


def _raw2() -> Column:
    return F.expr("(_qx - _tx) * (_qx - _tx) + (_qy - _ty) * (_qy - _ty)")


def _distance() -> Column:
    return rounding(F.sqrt(_raw2()), 9)


def _inside(radius: float) -> Column:
    """Rounded distance <= ``radius``; only a pair on the very edge is rounded."""
    raw = _raw2()
    edge = (raw <= F.lit((radius + SLACK) ** 2)) & (_distance() <= F.lit(float(radius)))
    return (raw <= F.lit(max(radius - SLACK, 0.0) ** 2)) | edge


def _children(df: DataFrame) -> DataFrame:
    return (df.withColumn("_o", F.explode(offsets(range(2), range(2))))
            .withColumns({"_bx": F.col("_bx") * 2 + F.col("_o.i"),
                          "_by": F.col("_by") * 2 + F.col("_o.j")})
            .drop("_o"))


def _largest(tiles: DataFrame) -> int:
    return int(tiles.agg(F.max("_n")).first()[0] or 0)


def _plane(df: DataFrame, lat0: float | None, x: str, y: str, cols: Iterable[str]) -> DataFrame:
    """Keep ``cols`` and the plane coordinates; rows without a place drop out."""
    if lat0 is not None:
        df = planar(df, lat0, x="_px", y="_py")
    else:
        df = df.withColumnsRenamed({"x": "_px", "y": "_py"})
    return (df.select(*cols, F.col("_px").alias(x), F.col("_py").alias(y))
            .filter(F.col(x).isNotNull() & F.col(y).isNotNull()))


def salted(many: DataFrame, few: DataFrame, keys: Sequence[str], many_id: str, few_id: str,
           hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``keys`` with ``_salt`` columns that split hot keys.

    A key with more than ``hot_rows`` rows on either side becomes a grid of parts of
    about that many rows: each row takes one part of its own side and meets all parts
    of the other.  The limit is the same at every size.

    Few bytes can make many pairs.  Both sides are therefore dealt over as many
    partitions as their pairs need, whatever their bytes.
    """
    none = {"_salt": F.lit(0), "_salt2": F.lit(0)}
    if many.isStreaming or few.isStreaming:  # micro-batches are small, and can't be counted ahead
        return many.withColumns(none), few.withColumns(none)
    n = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    m = few.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    met = cut(n.join(m, list(keys)))
    is_hot = (F.col("_n") > hot_rows) | (F.col("_m") > hot_rows)
    work = met.agg(F.sum(F.col("_n").cast("double") * F.col("_m")), F.count_if(is_hot)).first()
    parts = min(MAX_PARTS, math.ceil((work[0] or 0.0) / TASK_PAIRS))

    def dealt(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
        if parts <= 1:
            return a, b
        return tuple(d.repartition(parts, *keys, "_salt", "_salt2") for d in (a, b))

    if not work[1]:
        return dealt(many.withColumns(none), few.withColumns(none))
    hot = met.filter(is_hot).select(
        *keys, *[F.ceil(F.col(c) / F.lit(hot_rows)).cast("int").alias(f"{c}p") for c in ("_n", "_m")])

    def side(df: DataFrame, id_col: str, own: str, own_parts: str, other: str, other_parts: str) -> DataFrame:
        parts, rest = (F.coalesce(F.col(c), F.lit(1)) for c in (own_parts, other_parts))
        return (df.join(hot, list(keys), "left").withColumn(own, F.pmod(F.xxhash64(F.col(id_col)), parts).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), rest - 1))).drop("_np", "_mp"))

    return dealt(side(many, many_id, "_salt", "_np", "_salt2", "_mp"), side(few, few_id, "_salt2", "_mp", "_salt", "_np"))


def within(queries: DataFrame, targets: DataFrame, radius: float, *, q_id: str, t_id: str,
           lat0: float | None = None, q_cols: Sequence[str] = (), t_cols: Sequence[str] = (),
           strict: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All (query, target) pairs with distance <= radius (``<`` when strict).

    ``lat0=None`` means both sides already carry plane columns ``x`` and ``y``.
    Column names of the two sides must differ.  A tile is two radii wide: a query is sent
    to the tiles that its circle meets, 3.8 on average, where tiles of one radius took 9.
    """
    q = _plane(queries, lat0, "_qx", "_qy", [q_id, *q_cols])
    t = _plane(targets, lat0, "_tx", "_ty", [t_id, *t_cols])
    size = 2.0 * radius
    q = _spread(q, "_qx", "_qy", size, 1).filter(_gap2(size) <= F.lit((radius + SLACK) ** 2))
    t = _own(t, "_tx", "_ty", size)
    t, q = salted(t, q, ["_bx", "_by"], t_id, q_id, hot_rows)
    limit = F.lit(float(radius))
    ok = F.col("dist_km") < limit if strict else F.col("dist_km") <= limit
    return (q.join(t, ["_bx", "_by", "_salt", "_salt2"])
            .filter(_raw2() <= F.lit((radius + SLACK) ** 2))
            .withColumn("dist_km", _distance()).filter(ok)
            .select(q_id, t_id, "dist_km", *q_cols, *t_cols))


# ------------------------------------------------------------------ aggregates

def _partials(aggs: dict[str, tuple[str, str | None]]):
    """Per-location columns, how to merge them, and the final expressions."""
    first, merge, final = {}, {}, {}
    for name, (kind, col) in aggs.items():
        if kind == "count":
            first[f"{name}_n"] = F.count(F.lit(1))
            merge[f"{name}_n"] = F.sum(f"{name}_n")
            final[name] = F.col(f"{name}_n")
        elif kind in ("sum", "avg"):
            first[f"{name}_s"] = F.sum(col)
            first[f"{name}_n"] = F.count(col)
            merge[f"{name}_s"] = F.sum(f"{name}_s")
            merge[f"{name}_n"] = F.sum(f"{name}_n")
            final[name] = (F.col(f"{name}_s") if kind == "sum"
                           else F.col(f"{name}_s") / F.nullif(F.col(f"{name}_n"), F.lit(0)))
        elif kind in ("max", "min"):
            how = F.max if kind == "max" else F.min
            first[f"{name}_v"] = how(col)
            merge[f"{name}_v"] = how(f"{name}_v")
            final[name] = F.col(f"{name}_v")
        else:
            raise ValueError(f"unknown aggregate {kind!r}")
    return first, merge, final


def _named(exprs: dict[str, Column]) -> list[Column]:
    return [c.alias(n) for n, c in exprs.items()]


def radius_aggregate(queries: DataFrame, targets: DataFrame, radius: float,
                     aggs: dict[str, tuple[str, str | None]], *, q_id: str,
                     lat0: float | None = None, t_by: Sequence[str] = (), cap: int = 256) -> DataFrame:
    """Aggregate the targets within ``radius`` (inclusive) of every query.

    ``aggs`` maps an output name to ``(kind, column)`` with kind one of count,
    sum, avg, min, max; NULLs are skipped.  Queries without a hit are absent.
    ``t_by`` groups the result by target columns as well.

    Targets are first merged per location.  Where a tile still holds more than
    ``cap`` locations it is quartered: quarters inside the circle add their
    merged values, quarters outside vanish, and only those on the rim go on.
    A hot spot therefore costs a few tiles per query and never all its rows.
    """
    first, merge, final = _partials(aggs)
    by = list(t_by)
    cols = [c for _, c in aggs.values() if c]
    q = _plane(queries, lat0, "_qx", "_qy", [q_id])
    t = _plane(targets, lat0, "_tx", "_ty", list(dict.fromkeys([*by, *cols])))
    places = cut(t.groupBy("_tx", "_ty", *by).agg(*_named(first)))

    def crowd(size: float) -> DataFrame:
        return (_own(places, "_tx", "_ty", size).groupBy("_bx", "_by")
                .agg(F.count(F.lit(1)).alias("_n")))

    def merged(size: float) -> DataFrame:
        return _own(places, "_tx", "_ty", size).groupBy("_bx", "_by", *by).agg(*_named(merge))

    def rim(frontier: DataFrame, size: float) -> DataFrame:
        asked, held = salted(frontier, _own(places, "_tx", "_ty", size), ["_bx", "_by"], q_id, "_tx", HOT_ROWS)
        return (asked.join(held, ["_bx", "_by", "_salt", "_salt2"])
                .filter(_inside(radius)).select(q_id, *by, *first))

    size = float(radius)
    frontier = _spread(q, "_qx", "_qy", size, 1).filter(_gap2(size) <= F.lit((radius + SLACK) ** 2))
    pieces = []
    for depth in range(MAX_DEPTH + 1):
        level = crowd(size)
        if depth == MAX_DEPTH or _largest(level) <= cap:
            pieces.append(rim(frontier, size))
            break
        state = cut(frontier.join(level, ["_bx", "_by"])
                    .withColumn("_in", _far(size) <= F.lit(radius - SLACK)))
        pieces.append(state.filter("_in").join(merged(size), ["_bx", "_by"]).select(q_id, *by, *first))
        pieces.append(rim(state.filter(~F.col("_in") & (F.col("_n") <= cap))
                          .select(q_id, "_qx", "_qy", "_bx", "_by"), size))
        size /= 2
        frontier = (_children(state.filter(~F.col("_in") & (F.col("_n") > cap))
                              .select(q_id, "_qx", "_qy", "_bx", "_by"))
                    .filter(_gap2(size) <= F.lit((radius + SLACK) ** 2)))
    hits = pieces[0]
    for piece in pieces[1:]:
        hits = hits.unionByName(piece)
    return (hits.groupBy(q_id, *by).agg(*_named(merge))
            .select(q_id, *by, *[c.alias(n) for n, c in final.items()]))


# ------------------------------------------------------------------ neighbours

def knn(queries: DataFrame, targets: DataFrame, k: int, *, q_id: str, t_id: str,
        lat0: float | None = None, t_cols: Sequence[str] = (), exclude_self: bool = False,
        limit_km: float | None = None, cap: int | None = None) -> DataFrame:
    """The ``k`` nearest targets of every query: (q_id, t_id, dist_km, rank, *t_cols).

    Exact; ties go to the smaller id.  ``limit_km`` drops targets farther away
    (inclusive bound).  ``exclude_self`` leaves out the target whose id equals
    the query's.

    1. Each query finds the tile size at which the 3x3 block around it holds
       enough targets; that bounds the distance it has to look.
    2. Only tiles touching that circle are visited.  Tiles with more than
       ``cap`` targets are quartered, which also tightens the bound, until few
       enough remain; a dense spot never sends all its rows to one query.
    """
    want = k + 1 if exclude_self else k
    cap = cap or max(64, 16 * want)
    q = _plane(queries, lat0, "_qx", "_qy", [q_id])
    t = _plane(targets, lat0, "_tx", "_ty", [t_id, *t_cols])
    # Copies of one location: only the first few ids can ever be neighbours.
    spot = Window.partitionBy("_tx", "_ty").orderBy(t_id)
    t = cut(t.withColumn("_c", F.row_number().over(spot)).filter(F.col("_c") <= want).drop("_c"))

    box = t.agg(F.count(F.lit(1)), F.min("_tx"), F.max("_tx"), F.min("_ty"), F.max("_ty")).first()
    total = int(box[0])
    out_cols = [q_id, t_id, "dist_km", "rank", *t_cols]
    if total == 0:
        empty = t.withColumns({q_id: F.lit(None).cast(q.schema[q_id].dataType),
                               "dist_km": F.lit(0.0), "rank": F.lit(0)})
        return empty.select(*out_cols).filter(F.lit(False))
    qbox = q.agg(F.min("_qx"), F.max("_qx"), F.min("_qy"), F.max("_qy")).first()
    if qbox[0] is None:
        qbox = box[1:]
    reach = max(max(box[2], qbox[1]) - min(box[1], qbox[0]),
                max(box[4], qbox[3]) - min(box[3], qbox[2]), 1e-3) + 2 * SLACK
    area = max(box[2] - box[1], 1e-3) * max(box[4] - box[3], 1e-3)
    base = math.sqrt(area * want / total)
    if limit_km is not None:
        base = min(base, limit_km)
    need = min(want, total)

    def counts(level: int) -> DataFrame:
        size = base * 2.0 ** level
        if level <= 0:
            return (_own(t, "_tx", "_ty", size).groupBy("_bx", "_by")
                    .agg(F.count(F.lit(1)).alias("_n")))
        factor = 2 ** level
        return (ground.groupBy(F.floor(F.col("_bx") / F.lit(factor)).alias("_bx"),
                               F.floor(F.col("_by") / F.lit(factor)).alias("_by"))
                .agg(F.sum("_n").alias("_n")))

    ground = cut(counts(0))

    # Nearest of the block's (at most nine) tiles that together hold enough targets.
    enough = (f"aggregate(_l, named_struct('c', 0L, 'u', 0D), (a, e) -> "
              f"if(a.c >= {need}L, a, named_struct('c', a.c + e._n, 'u', e._f)), a -> a.u)")

    # Step 1: the tile size of every query.
    started: dict[int, DataFrame] = {}
    open_q, level = q, 0
    while True:
        size = base * 2.0 ** level
        last = size >= reach or (limit_km is not None and size >= limit_km)
        level_counts = ground if level == 0 else counts(level)
        seen = (_spread(open_q, "_qx", "_qy", size, 1).join(level_counts, ["_bx", "_by"])
                .withColumn("_f", _far(size))
                .groupBy(q_id, "_qx", "_qy")
                .agg(F.sum("_n").alias("_sum"), F.array_sort(F.collect_list(F.struct("_f", "_n"))).alias("_l"))
                .withColumn("_u", F.expr(enough)).drop("_l"))
        if limit_km is not None:
            seen = seen.withColumn("_u", F.least(F.col("_u"), F.lit(float(limit_km))))
        if last:
            started[level] = seen.drop("_sum")
            break
        seen = cut(open_q.join(seen.filter(F.col("_sum") >= need).select(q_id, "_u"), q_id, "left"))
        started[level] = seen.filter(F.col("_u").isNotNull())
        open_q = seen.filter(F.col("_u").isNull()).drop("_u")
        if open_q.isEmpty():
            break
        level += 1

    # How fine the tiles must get before none of them is crowded.
    crowded = {0: _largest(ground) > cap}
    floor_level = 0
    while crowded[floor_level] and floor_level > -MAX_DEPTH:
        floor_level -= 1
        crowded[floor_level] = _largest(counts(floor_level)) > cap

    # Step 2: from coarse to fine.
    pieces, frontier = [], None
    for level in range(max(started), floor_level - 1, -1):
        size = base * 2.0 ** level
        edge = _gap2(size) <= _square(F.col("_u") + F.lit(SLACK))
        if level in started:
            fresh = _spread(started[level].select(q_id, "_qx", "_qy", "_u"),
                            "_qx", "_qy", size, 3).filter(edge)
            frontier = fresh if frontier is None else frontier.unionByName(fresh)
        if frontier is None:
            continue
        if level not in crowded:
            crowded[level] = _largest(counts(level)) > cap
        if level > floor_level and crowded[level]:
            sure = F.min(F.when(F.col("_n") >= want, F.col("_f"))).over(Window.partitionBy(q_id))
            state = cut(frontier.join(ground if level == 0 else counts(level), ["_bx", "_by"])
                        .withColumn("_f", _far(size))
                        .withColumn("_u", F.least(F.col("_u"), sure))
                        .filter(edge).drop("_f"))
            leaf = state.filter(F.col("_n") <= cap).drop("_n")
            finer = size / 2
            frontier = (_children(state.filter(F.col("_n") > cap).drop("_n"))
                        .filter(_gap2(finer) <= _square(F.col("_u") + F.lit(SLACK))))
        else:
            leaf, frontier = frontier, None
        pieces.append(leaf.join(_own(t, "_tx", "_ty", size), ["_bx", "_by"])
                      .filter(_raw2() <= _square(F.col("_u") + F.lit(SLACK)))
                      .select(q_id, t_id, _distance().alias("dist_km"), *t_cols))
    found = pieces[0]
    for piece in pieces[1:]:
        found = found.unionByName(piece)
    if exclude_self:
        found = found.filter(F.col(q_id) != F.col(t_id))
    if limit_km is not None:
        found = found.filter(F.col("dist_km") <= F.lit(float(limit_km)))
    if k == 1:
        best = F.min(F.struct("dist_km", t_id, *t_cols)).alias("_b")
        return (found.groupBy(q_id).agg(best)
                .select(q_id, f"_b.{t_id}", "_b.dist_km", F.lit(1).alias("rank"),
                        *[f"_b.{c}" for c in t_cols]))
    order = Window.partitionBy(q_id).orderBy("dist_km", t_id)
    return (found.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k).select(*out_cols))


def nearest(queries: DataFrame, targets: DataFrame, *, q_id: str, t_id: str,
            lat0: float | None = None, t_cols: Sequence[str] = (),
            limit_km: float | None = None) -> DataFrame:
    """The nearest target of every query: (q_id, t_id, dist_km, *t_cols)."""
    return knn(queries, targets, 1, q_id=q_id, t_id=t_id, lat0=lat0, t_cols=t_cols,
               limit_km=limit_km).drop("rank")


def exclude_within(queries: DataFrame, targets: DataFrame, radius: float, *, q_id: str,
                   lat0: float | None = None, strict: bool = True) -> DataFrame:
    """Queries farther than ``radius`` from every target.

    ``strict=True`` keeps ``d > radius``; otherwise ``d >= radius``.
    """
    near = radius_aggregate(queries, targets, radius if strict else math.nextafter(radius, 0.0),
                            {"_hits": ("count", None)}, q_id=q_id, lat0=lat0)
    return queries.join(near.select(q_id), q_id, "left_anti")
