"""Interpolation, tests and reports."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrascout.functions.portable import low_halves, uniform
from terrascout.operators import rank, tiles

SIGN_ROWS = 1000  # rows whose signs of all rounds are held at once


# -------------------------------------------------------------- interpolation

def idw(queries: DataFrame, stations: DataFrame, k: int = 5, cutoff_km: float = 200.0, *, q_id: str,
        t_id: str, lat0: float, value: str = "hf", exclude_self: bool = False) -> DataFrame:
    """(q_id, value, nearest_km): weights 1/(d+1) over k neighbours.

    NULL when the nearest station is farther than ``cutoff_km``.
    """
    pairs = tiles.knn(queries, stations, k, q_id=q_id, t_id=t_id, lat0=lat0, t_cols=[value],
                      exclude_self=exclude_self)
    w = 1.0 / (F.col("dist_km") + 1.0)
    out = pairs.groupBy(q_id).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("_v"),
                                  F.min("dist_km").alias("nearest_km"))
    return out.select(q_id, F.when(F.col("nearest_km") <= cutoff_km, F.col("_v")).alias("value"), "nearest_km")


def idw_loo(stations: DataFrame, k: int = 5, cutoff_km: float = 200.0, *, id_col: str, lat0: float,
            value: str = "hf") -> DataFrame:
    """Leave-one-out interpolation: (id, observed, predicted, residual)."""
    targets = stations.withColumnRenamed(id_col, "_tid")
    guess = idw(stations, targets, k, cutoff_km, q_id=id_col, t_id="_tid", lat0=lat0, value=value,
                exclude_self=True)
    return (stations.select(id_col, F.col(value).alias("observed")).join(guess, id_col)
            .filter(F.col("value").isNotNull())
            .select(id_col, "observed", F.col("value").alias("predicted"),
                    (F.col("observed") - F.col("value")).alias("residual")))


def residual_report(df: DataFrame, observed: str = "observed", predicted: str = "predicted",
                    bands: Sequence[int] = (10, 20, 30, 50)) -> DataFrame:
    """n, RMSE, MAE, bias, R2 and the share within each band, one aggregation."""
    r = F.col(observed) - F.col(predicted)
    within = [(100.0 * F.avg((F.abs(r) <= b).cast("double"))).alias(f"pct_within_{b}") for b in bands]
    return df.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(r * r)).alias("rmse"), F.avg(F.abs(r)).alias("mae"),
                  F.avg(r).alias("bias"),
                  (1.0 - F.sum(r * r) / F.nullif(F.var_pop(observed) * F.count(observed), F.lit(0.0))).alias("r2"),
                  *within)


# ----------------------------------------------------------------------- tests

def normal_cdf(z: Column) -> Column:
    """Standard normal CDF with a relative error near 1e-7 in both tails.

    Rational Chebyshev fit of the complementary error function.
    """
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    # Coefficients of the fit, highest power first.
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196,
              1.00002368, -1.26551223):
        poly = poly * t + F.lit(c)
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z <= 0, tail).otherwise(1.0 - tail)


def mann_whitney(df: DataFrame, value: str, group: str, first: object, alternative: str = "less") -> DataFrame:
    """U of the ``first`` group and the one-sided normal p-value, medians.

    Tie- and continuity-corrected.  Ranks come from the per-value table.  Without rows on one
    side nothing speaks against equality: p is 1.
    """
    table = rank.score_table(df.withColumn("_first", (F.col(group) == F.lit(first)).cast("int")),
                             value, "_first")
    others = F.col("cnt") - F.col("pos")
    t3 = F.col("cnt").cast("double")
    agg = table.agg(
        F.sum(F.col("pos") * ((F.col("below") - F.col("pos_below")) + others / 2)).cast("double").alias("u"),
        F.max("n_pos").cast("double").alias("n1"), (F.max("n") - F.max("n_pos")).cast("double").alias("n2"),
        F.sum(t3 * t3 * t3 - t3).alias("ties"))
    n = F.col("n1") + F.col("n2")
    # One row has no spread of ties; a side without rows, or one value throughout, has no spread of ranks.
    ties = F.when(n > 1, F.col("ties") / F.nullif(n * (n - 1.0), F.lit(0.0))).otherwise(F.lit(float("nan")))
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * ((n + 1.0) - ties))
    shift = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    above = shift + 0.5 if alternative == "less" else -(shift - 0.5)
    z = F.when(sd == 0, F.lit(float("inf"))).otherwise(above / F.nullif(sd, F.lit(0.0)))
    medians = rank.quantiles(df, value, [0.5], by=[group], names=["median"])
    med = medians.agg(F.max(F.when(F.col(group) == F.lit(first), F.col("median"))).alias("median_first"),
                      F.max(F.when(F.col(group) != F.lit(first), F.col("median"))).alias("median_other"))
    return (agg.select(F.lit(1).alias("_j"), "u", F.col("n1").cast("bigint").alias("n_first"),
                       F.col("n2").cast("bigint").alias("n_other"), normal_cdf(z).alias("p"))
            .join(med.withColumn("_j", F.lit(1)), "_j").drop("_j"))


def paired_t(df: DataFrame, a: str, b: str, by: Sequence[str] = (), min_pairs: int = 5) -> DataFrame:
    """n, mean difference and t per group; groups with too few pairs drop out."""
    d = F.col(a) - F.col(b)
    stats = df.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("delta_mean"), F.stddev_samp(d).alias("_s"))
    t = F.col("delta_mean") / F.nullif(F.col("_s") / F.sqrt(F.col("n").cast("double")), F.lit(0.0))
    return stats.filter(F.col("n") >= min_pairs).select(*by, "n", "delta_mean", t.alias("t_stat"))


def _spread(df: DataFrame) -> int:
    """Partitions for rows that cost one hash a round each, however few bytes they have."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _matrix(column: pa.ListArray, rounds: int) -> np.ndarray:
    """Arrays of one length as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, rounds)


def sign_flip_p(df: DataFrame, a: str, b: str, id_col: str, by: Sequence[str] = (), rounds: int = 999,
                seed: int = 42) -> DataFrame:
    """Two-sided p-value of the mean difference by random sign flips.

    A task draws the signs of all rounds for many rows at once, adds them up and hands on one
    vector for each group, so rows are never multiplied by rounds.  Pairs lacking a side drop out.
    """
    by = list(by)
    seeds = range(seed + 1, seed + rounds + 1)
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
        *by, group.alias("_g"), (F.col(a) - F.col(b)).cast("double").alias("_d"), F.col(id_col).cast("string").alias("_id")) \
        .repartition(_spread(df), "_id")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        firsts: dict[str, pa.RecordBatch] = {}
        for batch in batches:
            names, at = np.unique(np.array(batch.column("_g").to_pylist(), object), return_inverse=True)
            d, ids = batch.column("_d").to_numpy(zero_copy_only=False), batch.column("_id").to_pylist()
            for k, name in enumerate(names):
                own = np.flatnonzero(at == k)
                # The sum without flips comes first.
                part = np.concatenate([[d[own].sum()], np.zeros(rounds)])
                for i in range(0, len(own), SIGN_ROWS):
                    some = own[i:i + SIGN_ROWS]
                    part[1:] += d[some] @ (2.0 * low_halves([ids[j] for j in some], seeds) - 1.0)
                if name in sums:
                    sums[name] += part
                else:
                    sums[name], firsts[name] = part, batch.slice(int(own[0]), 1)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([*[firsts[name].column(c) for c in by], pa.array([total.tolist()])], names=[*by, "_t"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by]
    parts = rows.mapInArrow(add_up, ", ".join([*kinds, "_t array<double>"]))
    if by:
        parts = parts.repartition(*by)
    sums = parts.select(*by, F.posexplode("_t").alias("_r", "_v")).groupBy(*by, "_r").agg(F.abs(F.sum("_v")).alias("_t"))
    real = sums.filter("_r = 0").select(*by, F.col("_t").alias("_t0"))
    drawn = sums.filter("_r > 0")
    if by:
        joined = drawn.join(real, [drawn[c].eqNullSafe(real[c]) for c in by]).select(*[drawn[c] for c in by], "_t", "_t0")
    else:
        joined = drawn.withColumn("_j", F.lit(1)).join(real.withColumn("_j", F.lit(1)), "_j")
    hit = F.count_if(F.col("_t") >= F.col("_t0") - 1e-12)
    return joined.groupBy(*by).agg(((hit + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"))


def poisson_steps(n: int) -> list[float]:
    """Chances of at most 0, 1, ... n - 1 under Poisson(1)."""
    steps, p, total = [], math.exp(-1.0), 0.0
    for count in range(n):
        total += p
        steps.append(total)
        p /= count + 1
    return steps


def _same(x: np.ndarray, y: np.ndarray | float) -> np.ndarray:
    return (x == y) | (np.isnan(x) & np.isnan(y))


def bootstrap_auroc(df: DataFrame, score: str, label: str, id_col: str, rounds: int = 200,
                    alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Mean and interval of AUROC over resamples with replacement.

    Each row weighs Poisson(1) per resample; one-class resamples are skipped.  Rows are ordered
    once and carry their weights as a vector.  A range of scores hands on three rows: its
    least and its greatest score, which others may share, and all between.  NULL scores
    drop out, NaN is above all numbers, and a label that is not 1 counts as negative.
    """
    numbers = F.transform(F.sequence(F.lit(1), F.lit(rounds)),
                          lambda r: uniform(F.concat(F.col("_id"), F.lit("/"), r.cast("string")), seed))
    weights = F.transform(numbers, lambda u: sum(((u >= x).cast("int") for x in poisson_steps(12)), F.lit(0)).cast("tinyint"))
    rows = (df.select(F.col(score).cast("double").alias("_s"), F.col(id_col).cast("string").alias("_id"),
                      F.coalesce(F.col(label) == 1, F.lit(False)).alias("_y"))
            .filter("_s is not null").repartitionByRange(_spread(df), "_s", "_id").sortWithinPartitions("_s")
            .select("_s", "_y", weights.alias("_w")))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(rounds)
        first = last = low = None  # (score, positives, negatives) of the least and the greatest score so far
        pos, neg, won = zero.copy(), zero.copy(), zero.copy()
        for batch in batches:
            if not batch.num_rows:
                continue
            s, w = batch.column("_s").to_numpy(), _matrix(batch.column("_w"), rounds).astype(float)
            y = batch.column("_y").to_numpy(zero_copy_only=False)[:, None]
            starts = np.concatenate([[0], np.flatnonzero(~_same(s[1:], s[:-1])) + 1])
            ties = [[s[i], p, n] for i, p, n in zip(starts, np.add.reduceat(w * y, starts), np.add.reduceat(w * ~y, starts))]
            if last is not None:
                if _same(np.array([last[0]]), ties[0][0])[0]:
                    ties[0][1:] = ties[0][1] + last[1], ties[0][2] + last[2]
                else:
                    ties.insert(0, last)
            for at, p, n in ties[:-1]:
                if first is None:
                    first = at, p, n
                else:
                    low = at if low is None else low
                    won += p * (neg + n / 2)
                    pos, neg = pos + p, neg + n
            last = ties[-1]
        made = [(*e, zero, True) for e in (first, last) if e is not None]
        if low is not None:
            made.append((low, pos, neg, won, False))
        for at, p, n, c, edge in made:
            yield pa.RecordBatch.from_arrays([pa.array([float(at)]), pa.array([edge]), *[pa.array([v.tolist()]) for v in (p, n, c)]],
                                             names=["lo", "edge", "pos", "neg", "won"])

    spans = rows.mapInArrow(sweep, "lo double, edge boolean, pos array<double>, neg array<double>, won array<double>")
    per = (spans.select("lo", "edge", F.posexplode(F.arrays_zip("pos", "neg", "won")).alias("_r", "_v"))
           .groupBy("_r", "lo").agg(F.max("edge").alias("edge"), *[F.sum(f"_v.{c}").alias(c) for c in ("pos", "neg", "won")])
           .withColumn("won", F.when(F.col("edge"), F.col("pos") * F.col("neg") / 2).otherwise(F.col("won"))))
    before = Window.partitionBy("_r").orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    runs = (per.withColumn("_before", F.coalesce(F.sum("neg").over(before), F.lit(0.0))).groupBy("_r")
            .agg(F.sum(F.col("won") + F.col("pos") * F.col("_before")).alias("u"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter("pos > 0 and neg > 0").select((F.col("u") / (F.col("pos") * F.col("neg"))).alias("auroc")))
    # One number per resample.
    return runs.agg(F.count(F.lit(1)).alias("rounds"), F.avg("auroc").alias("mean"),
                    F.percentile("auroc", alpha / 2).alias("ci_low"),
                    F.percentile("auroc", 1 - alpha / 2).alias("ci_high"))


# --------------------------------------------------------------------- reports

def _edges(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def _binned(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """``_bin`` 0..bins-1; bins are [a, b), the last one closed; outside rows drop."""
    inside = df.filter(F.col(col).between(low, high)).withColumn("_bv", F.col(col).cast("double"))
    return (Bucketizer(splits=_edges(low, high, bins), inputCol="_bv", outputCol="_bd").transform(inside)
            .withColumn("_bin", F.col("_bd").cast("int")).drop("_bv", "_bd"))


def _bin_table(df: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    e = _edges(low, high, bins)
    return df.sparkSession.createDataFrame([(i, e[i], e[i + 1]) for i in range(bins)],
                                           "_bin int, bin_low double, bin_high double")


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Reliability table: every bin, empty ones with NULL."""
    y = (F.col(label) == 1).cast("double")
    got = (_binned(df, p, 0.0, 1.0, bins).groupBy("_bin")
           .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("obs_freq")))
    return (_bin_table(df, 0.0, 1.0, bins).join(got, "_bin", "left")
            .select("bin_low", "bin_high", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
                    "mean_pred", "obs_freq"))


def calibration_summary(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """Brier score and expected calibration error (A14), from one pass of sums per bin."""
    y = (F.col(label) == 1).cast("double")
    q = F.col(p)
    per = (_binned(df, p, 0.0, 1.0, bins).groupBy("_bin")
           .agg(F.count(F.lit(1)).alias("n"), F.sum(q).alias("sp"), F.sum(y).alias("sy"),
                F.sum((q - y) * (q - y)).alias("sq")))
    return per.agg((F.sum("sq") / F.sum("n")).alias("brier"),
                   (F.sum(F.abs(F.col("sp") - F.col("sy"))) / F.sum("n")).alias("ece"),
                   F.sum("n").cast("bigint").alias("n"), F.sum("sy").cast("bigint").alias("n_pos"))


def histogram_density(df: DataFrame, col: str, low: float, high: float, bins: int,
                      by: Sequence[str] = ()) -> DataFrame:
    """Density-normalised histogram per group; empty bins are absent."""
    width = (high - low) / bins
    got = _binned(df, col, low, high, bins).groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n"))
    size = got.groupBy(*by).agg(F.sum("n").alias("_t")) if by else got.agg(F.sum("n").alias("_t"))
    joined = got.join(size, list(by)) if by else got.withColumn("_j", F.lit(1)).join(
        size.withColumn("_j", F.lit(1)), "_j")
    return (joined.join(_bin_table(df, low, high, bins), "_bin")
            .select(*by, "bin_low", "n", (F.col("n") / (F.col("_t") * F.lit(width))).alias("density")))


def score_distribution(df: DataFrame, score: str, above: Sequence[float] = (0.5,)) -> DataFrame:
    """n, mean, exact median and the share above thresholds."""
    head = df.agg(F.count(score).alias("n"), F.avg(score).alias("mean"),
                  *[(F.count_if(F.col(score) > t) / F.count(score)).alias(f"frac_above_{t:g}".replace(".", "_"))
                    for t in above]).withColumn("_j", F.lit(1))
    mid = rank.quantiles(df, score, [0.5], names=["median"]).withColumn("_j", F.lit(1))
    return head.join(mid, "_j").drop("_j")


def quantile_summary(df: DataFrame, col: str, threshold: float) -> DataFrame:
    """P10, P50, P90, quartiles, range and the share at or above a threshold."""
    head = df.agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"),
                  (F.count_if(F.col(col) >= threshold) / F.count(col)).alias("share_at_least")).withColumn("_j", F.lit(1))
    q = rank.quantiles(df, col, [0.10, 0.25, 0.50, 0.75, 0.90], names=["p10", "q25", "p50", "q75", "p90"])
    return (head.join(q.withColumn("_j", F.lit(1)), "_j").drop("_j")
            .withColumn("iqr", F.col("q75") - F.col("q25")))


def summarise_runs(df: DataFrame, metrics: Sequence[str], by: str = "model", sample: bool = False) -> DataFrame:
    """mean and std of each metric per model, NaN ignored, with a printed form (A10)."""
    spread = F.stddev_samp if sample else F.stddev_pop
    clean = df.select(by, *[F.when(~F.isnan(F.col(m)), F.col(m)).alias(m) for m in metrics])
    out = clean.groupBy(by).agg(*[e for m in metrics for e in (
        F.avg(m).alias(f"{m}_mean"), spread(m).alias(f"{m}_std"), F.count(m).alias(f"{m}_n"))])
    return out.withColumns({f"{m}_text": F.format_string("%.3f +/- %.3f", f"{m}_mean", f"{m}_std") for m in metrics})


def cohort_table(df: DataFrame, score: str = "score", pct: str = "pct", by: str = "cohort") -> DataFrame:
    """Per cohort: n, mean/median score and percentile, share > 50 and > 90."""
    df = tiles.cut(df.select(by, score, pct))
    head = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_p"), F.avg(pct).alias("mean_percentile"),
        F.avg((F.col(pct) > 50).cast("double")).alias("frac_above_50pct"),
        F.avg((F.col(pct) > 90).cast("double")).alias("frac_above_90pct"))
    mid_p = rank.quantiles(df, score, [0.5], by=[by], names=["median_p"])
    mid_q = rank.quantiles(df, pct, [0.5], by=[by], names=["median_percentile"])
    return head.join(mid_p, by, "left").join(mid_q, by, "left")


def hard_negative_table(df: DataFrame, available: DataFrame, score: str = "score", pct: str = "pct") -> DataFrame:
    """Per cohort: pool size, sample size, shares below 10/5 and at least 50/90, means.

    ``available`` holds all members of the cohorts, ``df`` the sampled ones.
    """
    got = df.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n_sample"), F.avg(score).alias("mean_p"), F.avg(pct).alias("mean_pct"),
        F.avg((F.col(pct) < 10).cast("double")).alias("frac_below_10pct"),
        F.avg((F.col(pct) < 5).cast("double")).alias("frac_below_5pct"),
        F.avg((F.col(pct) >= 50).cast("double")).alias("frac_above_50pct"),
        F.avg((F.col(pct) >= 90).cast("double")).alias("frac_above_90pct"),
        F.avg("hf_z").alias("mean_hf_z"), F.avg("site_km").alias("mean_site_km"))
    pool = available.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_available"))
    return pool.join(got, "cohort", "left")


def separation_gap(df: DataFrame, label: str, cohort_flag: str, score: str, pct: str,
                   by: Sequence[str] = ()) -> DataFrame:
    """Mean percentile of positives minus that of the control cohort."""
    pos = F.avg(F.when(F.col(label) == 1, F.col(pct)))
    neg = F.avg(F.when(F.col(cohort_flag), F.col(pct)))
    return df.groupBy(*by).agg(pos.alias("pos_mean_pct"), neg.alias("nc3_mean_pct"), (pos - neg).alias("separation_gap"),
                               F.avg((F.col(score) > 0.5).cast("double")).alias("score_frac_above_50"))


def before_after(a: DataFrame, b: DataFrame, key: str, metrics: Sequence[str]) -> DataFrame:
    """Two reports side by side with differences."""
    left = a.select(key, *[F.col(m).alias(f"{m}_before") for m in metrics])
    right = b.select(key, *[F.col(m).alias(f"{m}_after") for m in metrics])
    return left.join(right, key).withColumns(
        {f"{m}_delta": F.col(f"{m}_after") - F.col(f"{m}_before") for m in metrics})


def group_means(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(key).agg(*[F.avg(c).alias(c) for c in cols])


def share_within(df: DataFrame, col: str, limit: float) -> Column:
    """Percent of rows with ``col`` <= limit, as an aggregate."""
    return 100.0 * F.avg((F.col(col) <= limit).cast("double"))


def paired_folds(a: DataFrame, b: DataFrame, metric: str = "auroc") -> DataFrame:
    """Two models' fold metrics side by side, folds lacking either dropped."""
    def good(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).select("fold_id", F.col(metric).alias(name))

    return good(a, "first").join(good(b, "second"), "fold_id")


def proximity_test(places: DataFrame, lines: DataFrame, known: DataFrame, cells: DataFrame, *,
                   place_id: str, line_id: str, cell_id: str, lat0: float, known_lat0: float | None = None,
                   n_background: int, min_km: float = 50.0, seed: int = 42,
                   bands: Sequence[float] = (5, 10, 25, 50)) -> DataFrame:
    """Distances to lines: candidate places against far background cells."""
    far = tiles.exclude_within(cells, known, min_km, q_id=cell_id,
                               lat0=lat0 if known_lat0 is None else known_lat0)
    background = (far.withColumn("_u", uniform(F.col(cell_id), seed)).orderBy("_u", cell_id)
                  .limit(n_background))

    def near(df: DataFrame, id_col: str, name: str) -> DataFrame:
        return (tiles.nearest(df, lines, q_id=id_col, t_id=line_id, lat0=lat0)
                .select(F.lit(name).alias("side"), "dist_km"))

    both = near(places, place_id, "place").unionByName(near(background, cell_id, "background"))
    both = tiles.cut(both)
    test = mann_whitney(both, "dist_km", "side", "place").withColumn("_j", F.lit(1))
    shares = both.agg(*[(100.0 * F.avg(F.when(F.col("side") == s, (F.col("dist_km") <= b).cast("double"))))
                        .alias(f"within_{b:g}_km_{s}") for b in bands for s in ("place", "background")])
    return test.join(shares.withColumn("_j", F.lit(1)), "_j").drop("_j")
