"""Cell features from points, lines and volcanoes; coverage and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascout.functions import thermal
from terrascout.operators import tiles, vicinity

CHEMISTRY_COLUMNS = ["n_springs", "max_spring_t", "mean_chalcedony_t", "mean_nak_t", "max_bht",
                     "mean_gradient", "n_samples", "max_li", "mean_cl"]
SKEWED_COLUMNS = ["n_springs", "n_samples", "max_li", "mean_cl"]
FAR_KM = 1000.0  # distance reported when a source has no rows


def attach(cells: DataFrame, features: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join by key; a missing or NULL feature takes its default."""
    joined = cells.join(features, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def point_features(cells: DataFrame, springs: DataFrame | None, chemistry: DataFrame | None,
                   wells: DataFrame | None, radius: float = 50.0, *, id_col: str = "cell_id",
                   lat0: float) -> DataFrame:
    """Nine chemistry features and the coverage flag per cell (A1).

    Expected columns: springs ``spring_t``; chemistry ``sio2, na, k, li, cl``;
    wells ``bht, gradient``.  Empty or all-NULL neighbourhoods give 0.
    """
    out = cells.select(id_col, "lat", "lon")
    flags = []

    def add(source: DataFrame, aggs: dict, flag: str) -> DataFrame:
        hits = tiles.radius_aggregate(cells, source, radius, {**aggs, flag: ("count", None)},
                                      q_id=id_col, lat0=lat0)
        flags.append(flag)
        return out.join(hits, id_col, "left")

    if springs is not None:
        out = add(springs, {"n_springs": ("count", None), "max_spring_t": ("max", "spring_t")}, "_f1")
    if chemistry is not None:
        chemistry = chemistry.withColumns({
            "t_chalcedony": thermal.chalcedony_t(F.col("sio2")),
            "t_nak": thermal.nak_t(F.col("na"), F.col("k"))})
        out = add(chemistry, {"mean_chalcedony_t": ("avg", "t_chalcedony"), "mean_nak_t": ("avg", "t_nak"),
                              "n_samples": ("count", None), "max_li": ("max", "li"), "mean_cl": ("avg", "cl")}, "_f2")
    if wells is not None:
        out = add(wells, {"max_bht": ("max", "bht"), "mean_gradient": ("avg", "gradient")}, "_f3")
    covered = F.lit(False)
    for flag in flags:
        covered = covered | F.col(flag).isNotNull()
    have = set(out.columns)
    return out.select(
        id_col, covered.alias("covered"),
        *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)).alias(c)
          for c in CHEMISTRY_COLUMNS])


def line_features(cells: DataFrame, samples: DataFrame | None, tips: DataFrame | None = None, *,
                  id_col: str = "cell_id", lat0: float, step_km: float = 2.0) -> DataFrame:
    """Line density and slip within 25 km, nearest line, tips within 10 km (A2).

    ``samples`` are ``line_samples`` points with ``slip``; ``tips`` are the
    ``tip_pairs`` midpoints in the same plane (x, y), or their counts (id_col, n_tips)
    around the cells.
    """
    out = cells.select(id_col)
    if samples is not None:
        around = tiles.cut(vicinity.survey(cells, samples, 25.0, id_col=id_col, value="slip", lat0=lat0)
                           .withColumnsRenamed({"n": "_n", "top": "max_slip", "dist_km": "nearest_km"}))
        # Only the cells without a sample there look farther.
        far = tiles.cut(cells.select(id_col, "lat", "lon").filter(F.col(id_col).isNotNull() & vicinity.finite("lat", "lon"))
                        .join(around.select(id_col), id_col, "left_anti"))
        if not far.isEmpty():
            near = tiles.nearest(far, samples.filter(vicinity.finite("lat", "lon")).withColumn("_sid", F.xxhash64("lon", "lat")),
                                 q_id=id_col, t_id="_sid", lat0=lat0)
            around = around.unionByName(near.select(id_col, F.col("dist_km").alias("nearest_km")), allowMissingColumns=True)
        out = out.join(around, id_col, "left")
    else:
        out = out.withColumns({"nearest_km": F.lit(None).cast("double"), "_n": F.lit(None).cast("bigint"),
                               "max_slip": F.lit(None).cast("double")})
    if tips is not None and "n_tips" in tips.columns:
        out = out.join(tips.select(id_col, "n_tips"), id_col, "left")
    elif tips is not None:
        crossing = tiles.radius_aggregate(tiles.planar(cells, lat0), tips, 10.0,
                                          {"n_tips": ("count", None)}, q_id=id_col)
        out = out.join(crossing, id_col, "left")
    else:
        out = out.withColumn("n_tips", F.lit(None).cast("bigint"))
    return out.select(id_col, (F.coalesce("_n", F.lit(0)) * F.lit(step_km)).alias("density_km"),
                      F.coalesce("nearest_km", F.lit(FAR_KM)).alias("nearest_km"),
                      F.coalesce("max_slip", F.lit(0.0)).alias("max_slip"),
                      F.coalesce("n_tips", F.lit(0)).cast("bigint").alias("n_tips"))


def volcano_features(cells: DataFrame, volcanoes: DataFrame | None, *, id_col: str = "cell_id",
                     volcano_id: str = "volcano_id", lat0: float) -> DataFrame:
    """Nearest volcano and how many lie within 100 km (A3)."""
    if volcanoes is None:
        return cells.select(id_col, F.lit(FAR_KM).alias("nearest_km"), F.lit(0).cast("bigint").alias("n_100km"))
    near = tiles.nearest(cells, volcanoes, q_id=id_col, t_id=volcano_id, lat0=lat0)
    count = tiles.radius_aggregate(cells, volcanoes, 100.0, {"n_100km": ("count", None)}, q_id=id_col, lat0=lat0)
    out = (cells.select(id_col).join(near.select(id_col, F.col("dist_km").alias("nearest_km")), id_col, "left")
           .join(count, id_col, "left"))
    return out.select(id_col, F.coalesce("nearest_km", F.lit(FAR_KM)).alias("nearest_km"),
                      F.coalesce("n_100km", F.lit(0)).cast("bigint").alias("n_100km"))


# --------------------------------------------------------------------- scaling

def norm_stats(df: DataFrame, cols: Sequence[str], fit_on: Column | None = None,
               modality: str = "features") -> DataFrame:
    """(modality, feature, mean, std): population std, 0 counts as 1.

    One aggregation for all columns; ``fit_on`` restricts the rows.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    wide = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}.mean").alias("mean"),
                               F.col(f"{c}.std").alias("std")) for c in cols])
    std = F.coalesce(F.nullif(F.col("_e.std"), F.lit(0.0)), F.lit(1.0))
    return wide.select(F.explode(pairs).alias("_e")).select(
        F.lit(modality).alias("modality"), "_e.feature",
        F.coalesce(F.col("_e.mean"), F.lit(0.0)).alias("mean"), std.alias("std"))


def zscore(df: DataFrame, stats: DataFrame, fill: str | float | None = None, eps: float = 0.0) -> DataFrame:
    """Scale the features listed in ``stats``.

    ``fill`` replaces NULL first: a number, ``"mean"``, or None to keep NULL.
    The statistics are one small row per feature and become literals.
    """
    scaled = {}
    for row in stats.select("feature", "mean", "std").collect():
        value = F.col(row["feature"])
        if fill == "mean":
            value = F.coalesce(value, F.lit(row["mean"]))
        elif fill is not None:
            value = F.coalesce(value, F.lit(float(fill)))
        scaled[row["feature"]] = (value - F.lit(row["mean"])) / F.lit(row["std"] + eps)
    return df.withColumns(scaled)


def coverage_rates(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Share of covered cells per flag and the mean number of sources per cell."""
    count = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n"),
                  *[F.avg(F.col(f).cast("double")).alias(f"rate_{f}") for f in flags],
                  F.avg(count).alias("mean_sources"))


def sources_per_cell(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    count = sum((F.col(f).cast("int") for f in flags), F.lit(0))
    return df.groupBy(count.alias("n_sources")).agg(F.count(F.lit(1)).alias("n_cells"))


def class_ratio(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives, negatives and negatives per positive."""
    pos = F.count_if(F.col(label) == 1)
    neg = F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"), (neg / F.nullif(pos, F.lit(0))).alias("ratio"))


def tabular_features(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Assemble the model's feature vector (P13); NULL counts as 0."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f"_x_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return (VectorAssembler(inputCols=[f"_x_{c}" for c in cols], outputCol=out).transform(filled)
            .drop(*[f"_x_{c}" for c in cols]))
