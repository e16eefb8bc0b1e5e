"""From scored cells to candidate sites, and checks against known places."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.functions.portable import fixed
from terrascout.operators import cluster, rank, tiles


def candidates(df: DataFrame, p: float = 0.7, spread: float = 0.15, inclusive: bool = False,
               score: str = "p_mean", std: str = "p_std") -> DataFrame:
    """Cells scoring above ``p`` with a spread below ``spread``."""
    if inclusive:
        return df.filter((F.col(score) >= p) & (F.col(std) <= spread))
    return df.filter((F.col(score) > p) & (F.col(std) < spread))


def summarise_clusters(cells: DataFrame, res_km: float = 4.0, id_name: str = "discovery_id") -> DataFrame:
    """Area, centre and score per cluster (A4); noise is left out."""
    return (cells.filter(F.col("cluster") >= 0).groupBy(F.col("cluster").alias(id_name))
            .agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"),
                 (F.count(F.lit(1)) * F.lit(res_km * res_km)).alias("area_km2"),
                 F.avg("p_mean").alias("p_mean"), F.avg("p_std").alias("p_std"),
                 F.count(F.lit(1)).alias("n_cells"), F.max("p_mean").alias("p_max")))


def plausibility(sites: DataFrame, faults: DataFrame | None, volcanoes: DataFrame | None, *, id_col: str,
                 lat0: float, min_slip: float | None = None) -> DataFrame:
    """Add ``plausibility``: an active province, a line < 50 km or a volcano < 100 km away.

    ``min_slip`` counts only line points with a larger ``slip``.
    """
    def close(targets: DataFrame, km: float, name: str) -> DataFrame:
        hits = tiles.radius_aggregate(sites, targets, math.nextafter(km, 0.0), {name: ("count", None)},
                                      q_id=id_col, lat0=lat0)
        return out.join(hits, id_col, "left")

    out = sites
    ok = geo.province(F.col("lat"), F.col("lon")).isin(*geo.ACTIVE_PROVINCES)
    if faults is not None:
        if min_slip is not None:
            faults = faults.filter(F.col("slip") > min_slip)
        out, ok = close(faults, 50.0, "_nf"), ok | F.col("_nf").isNotNull()
    if volcanoes is not None:
        out, ok = close(volcanoes, 100.0, "_nv"), ok | F.col("_nv").isNotNull()
    return out.withColumn("plausibility", F.when(ok, "plausible").otherwise("implausible")).drop("_nf", "_nv")


def discover(cells: DataFrame, known: DataFrame, *, lat0: float, p: float = 0.7, spread: float = 0.15,
             exclusion_km: float = 25.0, eps_km: float = 15.0, min_cells: int = 3, res_km: float = 4.0,
             faults: DataFrame | None = None, volcanoes: DataFrame | None = None,
             inclusive: bool = False) -> DataFrame:
    """The whole chain P3, J5, G3, A4, P7, J14 over ``cell_id, lat, lon, p_mean, p_std``."""
    picked = candidates(cells, p, spread, inclusive)
    far = tiles.cut(tiles.exclude_within(picked, known, exclusion_km, q_id="cell_id", lat0=lat0))
    groups = cluster.dbscan(far, eps_km, min_cells, id_col="cell_id", lat0=lat0)
    found = tiles.cut(summarise_clusters(far.join(groups, "cell_id"), res_km))
    found = found.withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    return plausibility(found, faults, volcanoes, id_col="discovery_id", lat0=lat0)


def consensus(a: DataFrame, b: DataFrame, radius: float = 25.0, *, lat0: float,
              id_col: str = "discovery_id", plausible_only: bool = True) -> DataFrame:
    """Sites of ``a`` with a site of ``b`` closer than ``radius``.

    Adds ``matched``, ``nearest_max_id`` and ``dist_to_max_km``.
    """
    if plausible_only:
        a, b = (d.filter(F.col("plausibility") == "plausible") for d in (a, b))
    other = b.select(F.col(id_col).alias("nearest_max_id"), "lat", "lon")
    near = tiles.nearest(a, other, q_id=id_col, t_id="nearest_max_id", lat0=lat0, limit_km=radius)
    return (a.join(near.withColumnRenamed("dist_km", "dist_to_max_km"), id_col)
            .filter(F.col("dist_to_max_km") < radius).withColumn("matched", F.lit(True)))


def novel(df: DataFrame, known: DataFrame, km: float = 5.0, *, id_col: str, known_id: str, lat0: float) -> DataFrame:
    """Add ``nearest_known_km`` and ``is_novel`` (farther than ``km``)."""
    near = tiles.nearest(df, known, q_id=id_col, t_id=known_id, lat0=lat0)
    return (df.join(near.select(id_col, F.col("dist_km").alias("nearest_known_km")), id_col, "left")
            .withColumn("is_novel", F.coalesce(F.col("nearest_known_km") > km, F.lit(True))))


def fold_audit(sites: DataFrame, tests: DataFrame, cells: DataFrame, radius: float = 25.0, role: str = "train", *,
               site_id: str, cell_id: str = "cell_id", lat0: float) -> DataFrame:
    """Folds with a cell of the given role near each site: their number and their list.

    ``tests`` holds the test rows per fold; every other labelled cell of
    ``cells`` trains the fold.  A fold has no training cell near a site exactly
    when all the site's near cells are its test cells, so the long training
    table is never built.
    """
    # Counts per site and fold come from tiles; no (site, cell) pairs are built.
    placed = tests.select("fold_id", cell_id).distinct().join(cells.select(cell_id, "lat", "lon"), cell_id)
    held = tiles.radius_aggregate(sites, placed, radius, {"_held": ("count", None)}, q_id=site_id, lat0=lat0,
                                  t_by=["fold_id"])
    folds = tests.select("fold_id").distinct()
    if role == "test":
        touched = held.select(site_id, "fold_id")
        n = touched.groupBy(site_id).agg(F.count(F.lit(1)).alias("n_folds"))
    else:
        around = tiles.radius_aggregate(sites, cells, radius, {"_near": ("count", None)}, q_id=site_id, lat0=lat0)
        missing = held.join(around, site_id).filter(F.col("_held") == F.col("_near")).select(site_id, "fold_id")
        n_folds = folds.count()
        lost = missing.groupBy(site_id).agg(F.count(F.lit(1)).alias("_lost"))
        n = around.join(lost, site_id, "left").select(
            site_id, (F.lit(n_folds) - F.coalesce("_lost", F.lit(0))).alias("n_folds"))
        # All folds but the missing ones: as many rows as the result lists.
        ordered = rank.cumulate(folds, "fold_id", "fold_id").select("fold_id", "rn")
        span = n.select(site_id, F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(n_folds).cast("bigint"))).alias("rn"))
        touched = (span.join(ordered, "rn").select(site_id, "fold_id")
                   .join(missing, [site_id, "fold_id"], "left_anti"))
    head = touched.groupBy(site_id).agg(F.array_sort(F.collect_list("fold_id")).alias("_f"))
    return (sites.select(site_id).join(n, site_id, "left").join(head, site_id, "left")
            .select(site_id, F.coalesce("n_folds", F.lit(0)).cast("bigint").alias("n_folds"),
                    F.coalesce(F.array_join(F.col("_f").cast("array<string>"), ","), F.lit("")).alias("fold_indices")))


def permit_label(permit: str, well: str, operator: str, county: str, dist: str):
    """``permit well (operator) county @ 1.2km``."""
    number = F.coalesce(F.col(permit).cast("string"), F.lit("permit?"))
    return F.concat(number, F.lit(" "), F.col(well).cast("string"), F.lit(" ("), F.col(operator).cast("string"),
                    F.lit(") "), F.col(county).cast("string"), F.lit(" @ "), fixed(dist, 1),
                    F.lit("km"))


def field_check(sites: DataFrame, permits: DataFrame, radius: float = 25.0, after_date: str | None = None,
                *, site_id: str, permit_id: str, lat0: float, date_col: str = "filed",
                label_cols: Sequence[str] | None = None, listed: int = 5) -> DataFrame:
    """Permits near each site: count, nearest distance, and the nearest ones as text.

    All permits count; the text is a label that names the ``listed`` nearest.
    """
    if after_date is not None:
        permits = permits.filter(F.col(date_col) > F.lit(after_date).cast("date"))
    cols = list(label_cols or [])
    five = tiles.knn(sites, permits, listed, q_id=site_id, t_id=permit_id, lat0=lat0, t_cols=cols)
    if cols:
        text = permit_label(*cols, "dist_km")
    else:
        text = F.concat(F.col(permit_id).cast("string"), F.lit(" @ "), fixed("dist_km", 1), F.lit("km"))
    near = F.when(F.col("dist_km") <= radius, F.struct("rank", text.alias("text")))
    out = five.groupBy(site_id).agg(
        F.min("dist_km").alias("nearest_permit_km"),
        F.array_join(F.transform(F.array_sort(F.collect_list(near)), lambda s: s["text"]), "; ").alias("_t"))
    count = tiles.radius_aggregate(sites, permits, radius, {"_all": ("count", None)}, q_id=site_id, lat0=lat0)
    out = out.join(count, site_id, "left").withColumn("n_permits", F.coalesce("_all", F.lit(0)))
    return (sites.join(out, site_id, "left")
            .withColumns({"n_permits": F.coalesce("n_permits", F.lit(0)).cast("bigint"),
                          "nearest_permits": F.when(F.col("_t") == "", "—").otherwise(
                              F.coalesce("_t", F.lit("—")))})
            .drop("_t", "_all"))


def site_lookup(sites: DataFrame, cells: DataFrame, known: DataFrame | None, *, site_id: str, cell_id: str = "cell_id",
                known_id: str = "known_id", score: str = "score", lat0: float) -> DataFrame:
    """Score, percentile and top flags of each site's nearest cell."""
    scored = rank.pct_strict(cells, score, "percentile")
    near = tiles.nearest(sites, scored, q_id=site_id, t_id=cell_id, lat0=lat0, t_cols=[score, "percentile"])
    near = geo.percentile_flags(near.withColumnRenamed("dist_km", "cell_km"), "percentile")
    if known is not None:
        field = tiles.nearest(sites, known, q_id=site_id, t_id=known_id, lat0=lat0)
        near = near.join(field.select(site_id, F.col("dist_km").alias("nearest_known_km")), site_id, "left")
    return near


def recovery(sites: DataFrame, cells: DataFrame, share: float = 0.75, *, site_id: str, cell_id: str = "cell_id",
             score: str = "score", lat0: float) -> DataFrame:
    """Share of sites whose nearest cell scores at least the given quantile (M4)."""
    mark = rank.quantiles(cells, score, [share], names=["mark"]).first()[0]
    near = tiles.nearest(sites, cells, q_id=site_id, t_id=cell_id, lat0=lat0, t_cols=[score])
    return near.agg(F.count(F.lit(1)).alias("n_sites"), F.lit(mark).alias("mark"),
                    F.avg((F.col(score) >= F.lit(mark)).cast("double")).alias("recovered"))


def domain_join(cells: DataFrame, external: DataFrame, radius: float = 8.0, *, cell_id: str = "cell_id",
                external_id: str, cols: Sequence[str], lat0: float) -> DataFrame:
    """Cells with the columns of their nearest external cell closer than ``radius``."""
    near = tiles.nearest(cells, external, q_id=cell_id, t_id=external_id, lat0=lat0, t_cols=list(cols), limit_km=radius)
    return near.filter(F.col("dist_km") < radius)


def by_province(df: DataFrame, value: str | None = None, by: str = "province") -> DataFrame:
    """Rows, and the sum of ``value``, per province (A5)."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias(f"sum_{value}")] if value else [])
    return df.groupBy(by).agg(*aggs)
