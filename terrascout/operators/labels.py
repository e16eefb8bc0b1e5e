"""Labels, negatives, folds, cohorts and samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrascout.functions.portable import uniform
from terrascout.operators import tiles
from terrascout.operators import rank
from terrascout.operators.rank import cumulate

BOX = (31.0, 49.0, -125.0, -103.0)


def union_sites(frames: Sequence[DataFrame], box: tuple | None = BOX) -> DataFrame:
    """Site sources one after another, placeless and outside rows dropped."""
    sites = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    sites = sites.dropna(subset=["lat", "lon"])
    if box:
        sites = sites.filter(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))
    return sites


def label_positive(cells: DataFrame, sites: DataFrame, radius: float = 5.0, *, cell_id: str = "cell_id",
                   site_id: str = "site_id", lat0: float) -> DataFrame:
    """(cell_id, label, field_id): cells within ``radius`` of their nearest site."""
    near = tiles.nearest(cells, sites, q_id=cell_id, t_id=site_id, lat0=lat0, limit_km=radius)
    return (cells.select(cell_id).join(near.select(cell_id, F.col(site_id).alias("field_id")), cell_id, "left")
            .select(cell_id, F.col("field_id").isNotNull().cast("int").alias("label"), "field_id"))


def negative_candidates(cells: DataFrame, mode: str = "coverage", min_km: float = 50.0,
                        spring_km: float = 25.0, max_heat_flow: float = 60.0) -> DataFrame:
    """Cells that may serve as negatives.

    ``cells`` carries ``site_km`` (NULL when there is no site at all).
    ``"coverage"`` also asks for no chemistry coverage (``covered``);
    ``"documented"`` asks for ``spring_km`` and heat flow limits instead.
    """
    far = F.coalesce(F.col("site_km") >= min_km, F.lit(True))
    if mode == "coverage":
        return cells.filter(far & ~F.col("covered"))
    if mode == "documented":
        no_spring = F.coalesce(F.col("spring_km") > spring_km, F.lit(True))
        cool = F.coalesce(F.col("heat_flow") < max_heat_flow, F.lit(True))
        return cells.filter(far & no_spring & cool)
    raise ValueError(f"unknown mode {mode!r}")


def stratified_negatives(candidates: DataFrame, n_pos: int, ratio: int = 5, *, by: str = "province",
                         id_col: str = "cell_id", seed: int = 42) -> DataFrame:
    """A proportional sample per stratum, at most ``n_pos * ratio`` in all.

    Each stratum gives max(1, floor(target * size / pool)) rows; the strata are
    taken in name order until the target is full.
    """
    keyed = candidates.withColumn("_u", uniform(F.col(id_col), seed))
    ranked = cumulate(keyed, "_u", id_col, by=[by])
    sizes = candidates.groupBy(by).agg(F.count(F.lit(1)).alias("_size"))  # one row per stratum
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_pool", F.sum("_size").over(everything))
    sizes = sizes.withColumn("_target", F.least(F.lit(n_pos * ratio), F.col("_pool")))
    take = F.greatest(F.lit(1), F.floor(F.col("_target").cast("double") * F.col("_size") / F.col("_pool")))
    sizes = sizes.withColumn("_take", F.least(F.col("_size"), take))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_take").over(before), F.lit(0)))
    plan = sizes.select(by, "_take", "_before", "_target")
    chosen = ranked.join(plan, by).filter(
        (F.col("rn") <= F.col("_take")) & (F.col("_before") + F.col("rn") <= F.col("_target")))
    return chosen.drop("_u", "rn", "n", "_take", "_before", "_target")


def random_split(df: DataFrame, *, id_col: str, seed: int = 42, shares: tuple[float, float] = (0.7, 0.15),
                 by: Sequence[str] = ()) -> DataFrame:
    """Add ``split`` train/val/test by a seeded permutation, per group of ``by``."""
    ranked = cumulate(df.withColumn("_u", uniform(F.col(id_col), seed)), "_u", id_col, by=by)
    n_train = F.floor(F.lit(shares[0]) * F.col("n"))
    n_val = F.floor(F.lit(shares[1]) * F.col("n"))
    split = (F.when(F.col("rn") <= n_train, "train")
             .when(F.col("rn") <= n_train + n_val, "val").otherwise("test"))
    return ranked.withColumn("split", split).drop("_u", "rn", "n")


def holdout_split(df: DataFrame, *, id_col: str, seed: int = 42) -> DataFrame:
    """Two-way split: validation takes max(50, n // 5) rows."""
    ranked = cumulate(df.withColumn("_u", uniform(F.col(id_col), seed)), "_u", id_col)
    n_val = F.greatest(F.lit(50), F.floor(F.col("n") / 5))
    return ranked.withColumn("split", F.when(F.col("rn") <= n_val, "val").otherwise("train")).drop("_u", "rn", "n")


def group_folds(labelled: DataFrame, *, max_neg: int, cell_id: str = "cell_id", label: str = "label",
                cluster: str = "cluster", seed: int = 42) -> DataFrame:
    """Test rows of leave-one-cluster-out folds: (fold_id, cell_id, label).

    A fold tests its cluster's positives and min(n_neg // 5, max_neg) negatives;
    every other labelled row trains it, so training rows need not be stored.
    Each fold draws places of a seeded permutation of the negatives by hashes of its
    own until it has enough different ones: folds x (4 max_neg + 20) rows.
    """
    positives = labelled.filter((F.col(label) == 1) & F.col(cluster).isNotNull())
    negatives = cumulate(labelled.filter(F.col(label) == 0).select(cell_id)
                         .withColumn("_u", uniform(F.col(cell_id), seed)), "_u", cell_id)
    negatives = negatives.select(cell_id, (F.col("rn") - 1).alias("_pos"))
    n_neg = int(negatives.count())
    take = min(n_neg // 5, max_neg)
    tests = positives.select(F.col(cluster).alias("fold_id"), cell_id, F.lit(1).alias("label"))
    if take == 0:
        return tests
    # Of 4 take + 20 draws from at least 5 take places, fewer than take differ with a chance below 1e-15.
    draw = uniform(F.concat(F.col("fold_id").cast("string"), F.lit("/"), F.col("_i").cast("string")), seed)
    slots = (positives.select(F.col(cluster).alias("fold_id")).distinct()
             .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(4 * take + 19))))
             .groupBy("fold_id", F.floor(draw * n_neg).cast("bigint").alias("_pos")).agg(F.min("_i").alias("_i")))
    order = Window.partitionBy("fold_id").orderBy("_i")
    slots = slots.withColumn("_rk", F.row_number().over(order)).filter(F.col("_rk") <= take).select("fold_id", "_pos")
    return tests.unionByName(slots.join(negatives, "_pos")
                             .select("fold_id", cell_id, F.lit(0).alias("label")))


def fold_roles(tests: DataFrame, labelled: DataFrame, fold_id: int, cell_id: str = "cell_id") -> DataFrame:
    """All labelled rows with their ``role`` in one fold."""
    held = tests.filter(F.col("fold_id") == fold_id).select(cell_id, F.lit("test").alias("role"))
    return labelled.join(held, cell_id, "left").withColumn("role", F.coalesce("role", F.lit("train")))


def transfer_split(df: DataFrame, train: Sequence[str], test: Sequence[str], by: str = "province",
                   min_train: int = 100, min_test: int = 50) -> DataFrame:
    """Train on some provinces, test on others; fails when either is too small."""
    role = F.when(F.col(by).isin(*train), "train").when(F.col(by).isin(*test), "test")
    out = df.withColumn("split", role).filter(F.col("split").isNotNull())
    sizes = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    if sizes.get("train", 0) < min_train or sizes.get("test", 0) < min_test:
        raise ValueError(f"too few rows to transfer: {sizes}")
    return out


def split_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and positives per split."""
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"),
                                   F.sum((F.col(label) == 1).cast("bigint")).alias("n_pos"))


# Cohort boxes (lat_min, lat_max, lon_min, lon_max).
PLATEAU = (36, 40, -111, -108)
EASTERN_BASIN = (38, 42, -116, -113)
PLATFORM = (44, 48, -110, -103)


# The limits of the rules below are fixed values too.
def cohorts(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """One row per cell and cohort it belongs to (P4), in one pass.

    Needs ``lat, lon, site_km, covered`` and, for NC4-NC6, ``hf_z``.
    """
    def box(b: tuple) -> Column:
        return F.col("lat").between(b[0], b[1]) & F.col("lon").between(b[2], b[3])

    d, dry = F.col("site_km"), ~F.col("covered")
    hf = F.col("hf_z") if "hf_z" in cells.columns else F.lit(None).cast("double")
    deep = (d > 100) & dry
    rules = {
        "NC1_colorado_plateau": box(PLATEAU) & (d > 200),
        "NC2_eastern_basin": box(EASTERN_BASIN) & (d > 100) & dry,
        "NC3_random_deep": deep,
        "NC4_cratonic_low_HF": deep & (hf < -1.0) & (d > 150),
        "NC5_colorado_plateau_strict": box(PLATEAU) & (hf < -0.5) & (d > 75),
        "NC6_montana_wyoming_platform": box(PLATFORM) & (hf < -0.3) & (d > 75),
    }
    wanted = names or list(rules)
    hits = F.array_compact(F.array(*[F.when(rules[n], n) for n in wanted]))
    return cells.withColumn("cohort", F.explode(hits))


def cohort_sample(df: DataFrame, n: int, *, by: str = "cohort", id_col: str = "cell_id",
                  seed: int = 42) -> DataFrame:
    """At most ``n`` rows per cohort in a seeded order.

    Spark keeps only the first n rows per cohort on the map side.
    """
    order = Window.partitionBy(by).orderBy("_u", id_col)
    return (df.withColumn("_u", uniform(F.col(id_col), seed))
            .withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_u", "_rn"))


def class_weights(df: DataFrame, weight: float, label: str = "label") -> DataFrame:
    """``weight`` for positives, 1 for the rest."""
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(weight))).otherwise(1.0))


def oversample(df: DataFrame, times: int, label: str = "label") -> DataFrame:
    """Positives repeated ``times``; the copies carry ``copy`` 0..."""
    copies = F.when(F.col(label) == 1, F.lit(times)).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))


def far_low_negatives(spark: SparkSession, positives: DataFrame, stations: DataFrame, n: int, *,
                      box: tuple, lat0: float, min_km: float = 50.0, max_heat_flow: float = 55.0,
                      seed: int = 42, id_col: str = "site_id", station_id: str = "station_id",
                      places: int | None = None) -> DataFrame:
    """The first ``n`` random places far from positives with low heat flow.

    Places come from a hash of a running number; the batch doubles until enough
    places pass.  ``places`` ends the search after that many: where positives lie
    so close that hardly a place is far from them, those that pass are the result.
    """
    from terrascout.operators.stats import idw

    batch, start = max(2 * n, 200), 0
    kept = None
    # A place beyond all stations takes the stations' median, as a typical value.
    median = rank.quantiles(stations, "hf", [0.5]).first()
    while True:
        if places is not None:
            batch = min(batch, places - start)
        ids = spark.range(start, start + batch)
        lat_min, lat_max, lon_min, lon_max = box
        points = ids.select(
            F.col("id").alias("point_id"),
            (F.lit(lat_min) + uniform(F.col("id"), seed) * F.lit(lat_max - lat_min)).alias("lat"),
            (F.lit(lon_min) + uniform(F.col("id"), seed + 1) * F.lit(lon_max - lon_min)).alias("lon"))
        far = tiles.exclude_within(points, positives, min_km, q_id="point_id", lat0=lat0)
        heat = idw(far, stations, q_id="point_id", t_id=station_id, lat0=lat0)
        heat = heat.withColumn("heat_flow", F.coalesce("value", F.lit(median[0] if median else None).cast("double")))
        good = far.join(heat.filter(F.col("heat_flow") < max_heat_flow).select("point_id", "heat_flow"), "point_id")
        kept = good if kept is None else kept.unionByName(good)
        kept = tiles.cut(kept)
        found = kept.count()
        if found >= n or (places is not None and start + batch >= places):
            return kept.orderBy("point_id").limit(n)
        if places is None and start + batch > 1000 * max(n, 200):
            raise ValueError(f"only {found} of {n} places pass among {start + batch}; loosen the limits")
        start, batch = start + batch, batch * 2
