"""Recoverable resource: Monte-Carlo quantiles, sensitivity, totals, cost."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascout.functions import thermal
from terrascout.functions.portable import fraction, normals, uniform

# Steps of a four-dimensional additive sequence of low discrepancy: powers of 1/g,
# where g is the real root of g^5 = g + 1.
ROOT = 1.1673039782614187
STEPS = tuple(ROOT ** -(j + 1) for j in range(4))


def draws(sites: DataFrame, n: int, seed: int, *, id_col: str, area: str, temperature: str) -> DataFrame:
    """Sites times n sampled inputs and powers, one row a draw: ``k, t, h, rf, eta, mwe`` (MC1).

    A draw is a point of the sequence, shifted by the site's own numbers, so results
    do not depend on partitioning, and nothing is shuffled.  Columns are made in
    steps, so that no draw computes a value twice.
    """
    shifted = sites.withColumns({f"_s{j}": uniform(F.col(id_col), seed + j) for j in range(4)})
    rows = shifted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    u = [fraction(F.col("k").cast("double") * F.lit(step) + F.col(f"_s{j}")) for j, step in enumerate(STEPS)]
    rows = rows.withColumns({f"_u{j}": x for j, x in enumerate(u)})
    z1, z2 = normals(1.0 - F.col("_u0"), F.col("_u1"))
    z3, _ = normals(1.0 - F.col("_u2"), F.col("_u3"))
    rows = rows.withColumns({"t": thermal.clamp(F.col(temperature) + 20.0 * z1, 50, 320),
                             "h": thermal.clamp(F.exp(F.lit(math.log(250.0)) + 0.55 * z2), 60, 1000), "_z": z3})
    centre = F.when(F.col("t") < 150, 0.08).when(F.col("t") < 220, 0.12).otherwise(0.17)
    rows = rows.withColumns({"rf": F.exp(F.log(centre) + 0.30 * F.col("_z")), "eta": thermal.efficiency(F.col("t"))})
    mwe = thermal.volumetric_mwe(F.col(area), *[F.col(c) for c in ("t", "h", "rf", "eta")])
    return rows.withColumn("mwe", mwe).drop("_z", *[f"_{x}{j}" for x in "su" for j in range(4)])


def monte_carlo(sites: DataFrame, n: int = 2000, seed: int = 42, *, id_col: str = "discovery_id",
                area: str = "area_km2", temperature: str = "t_res", keys: Sequence[str] = ()) -> DataFrame:
    """P10/P50/P90, mean and mean inputs per site (MC1); site ids (with keys) are unique.

    Sites are few and their draws many: sites are dealt out by their ids first, over a set number
    of partitions (adaptive execution would put so few rows in one task).  Draws appear after
    that shuffle and are aggregated on the same keys, so they never move.
    """
    spark = sites.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = sites.select(F.col(id_col), *keys, F.col(area).alias("_area"), F.col(temperature).alias("_t0")) \
        .repartition(parts, id_col, *keys)
    drawn = draws(spread, n, seed, id_col=id_col, area="_area", temperature="_t0")
    found = drawn.groupBy(id_col, *keys, "_area", "_t0").agg(
        F.percentile("mwe", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("_q"),
        *[F.avg(c).alias(name) for c, name in (("mwe", "mwe_mean"), ("t", "t_res_mean_draws"), ("h", "thickness_mean_m"),
                                               ("rf", "rf_mean"), ("eta", "eta_mean"))])
    return found.select(
        id_col, *keys, *[F.col("_q")[i].alias(f"mwe_{q}") for i, q in enumerate(("p10", "p50", "p90"))],
        "mwe_mean", F.col("_t0").alias("t_res_central"), "t_res_mean_draws", "thickness_mean_m", "rf_mean", "eta_mean")


def shift_name(delta: int) -> str:
    return f"t{'plus' if delta > 0 else 'minus' if delta < 0 else 'zero'}{abs(delta) or ''}"


def sensitivity(sites: DataFrame, deltas: Sequence[int] = (-40, -20, 0, 20, 40), n: int = 2000, seed: int = 42, *,
                id_col: str = "discovery_id", area: str = "area_km2", temperature: str = "t_res") -> DataFrame:
    """Quantiles per site for shifted temperatures, one row per site (MC2)."""
    shifted = (sites.withColumn("delta", F.explode(F.array(*[F.lit(d) for d in deltas])))
               .withColumn("_t", thermal.clamp(F.col(temperature) + F.col("delta"), 50, 320)))
    runs = monte_carlo(shifted, n, seed, id_col=id_col, area=area, temperature="_t", keys=["delta"])
    aggs = [F.max(F.when(F.col("delta") == d, F.col(f"mwe_{q}"))).alias(f"{shift_name(d)}_{q}")
            for d in deltas for q in ("p10", "p50", "p90")]
    return runs.groupBy(id_col).agg(*aggs)


def sensitivity_totals(wide: DataFrame, deltas: Sequence[int] = (-40, -20, 0, 20, 40)) -> DataFrame:
    """Sums per shift and the percent change per 20 degrees (MC2)."""
    sums = [F.sum(f"{shift_name(d)}_{q}").alias(f"sum_{shift_name(d)}_{q}") for d in deltas for q in ("p10", "p50", "p90")]
    out = wide.agg(*sums)
    up, down, mid = (F.col(f"sum_{shift_name(d)}_p50") for d in (20, -20, 0))
    return out.withColumn("pct_per_20c", (up - down) / F.nullif(2 * mid, F.lit(0.0)) * 100)


def policy_totals(df: DataFrame, temperature: str = "t_res_central") -> DataFrame:
    """Total resource, generation, CO2 and shares of the policy marks, one row."""
    base = thermal.lcoe_value("base")
    factor = thermal.COST_CASES["base"][3]
    eligible = thermal.meets_target(F.col(temperature), F.lit(base))
    sums = df.agg(*[F.sum(f"mwe_{q}").alias(f"mwe_{q}") for q in ("p10", "p50", "p90")],
                  F.coalesce(F.sum(F.when(eligible, F.col("mwe_p50"))), F.lit(0.0)).alias("mwe_eligible"))

    def twh(q: str):
        return F.col(f"mwe_{q}") * F.lit(thermal.HOURS_PER_YEAR * factor / 1e6)

    def co2(q: str):
        return twh(q) * F.lit(thermal.GRID_CO2_G_PER_KWH * 1e-3)

    return sums.withColumns({
        "lcoe_base": F.lit(base), "lcoe_cheap": F.lit(thermal.lcoe_value("cheap")),
        "lcoe_expensive": F.lit(thermal.lcoe_value("expensive")),
        "fraction_eligible": F.col("mwe_eligible") / F.greatest(F.col("mwe_p50"), F.lit(1.0)),
        "vision_fraction_p50": F.col("mwe_p50") / thermal.VISION_MWE,
        "vision_fraction_p90": F.col("mwe_p90") / thermal.VISION_MWE,
        "capacity_multiplier_p50": F.col("mwe_p50") / thermal.INSTALLED_MWE,
        **{f"twh_{q}": twh(q) for q in ("p10", "p50", "p90")},
        "co2_mt_per_yr_p50": co2("p50"),
        **{f"co2_mt_30yr_{q}": co2(q) * 30 for q in ("p10", "p50", "p90")}})


def cost_table(df: DataFrame) -> DataFrame:
    """Sites times the fixed cost cases with their cost of energy (F16)."""
    cases = F.array(*[F.struct(F.lit(name).alias("case"), *[F.lit(float(v)).alias(f) for f, v in zip(
        ("capex", "fixed_om", "variable_om", "factor", "rate", "years"), row)])
        for name, row in thermal.COST_CASES.items()])
    out = df.withColumn("_c", F.explode(cases)).select("*", "_c.*").drop("_c")
    return out.withColumn("lcoe", thermal.lcoe(*[F.col(c) for c in (
        "capex", "fixed_om", "variable_om", "factor", "rate", "years")]))
