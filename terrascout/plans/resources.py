"""Queries over resource estimates and totals (MC, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import thermal
from terrascout.functions.portable import uniform_sql
from terrascout.operators import resource
from terrascout.plans.fixtures import query, r6, rounded, sql
from terrascout.plans.scalars import _mwe_sql

DRAWS = 2000
RESOURCE_SQL = "rs as (select site_id as discovery_id, lat, lon, 16.0::double * (3 + site_id % 20) as area_km2, 120 + bal / 100 as t_res from fx_sites)"


def resource_sites(fx):
    return fx.sites.select(F.col("site_id").alias("discovery_id"), "lat", "lon", (16.0 * (3 + F.col("site_id") % 20)).alias("area_km2"),
                           (120 + F.col("bal") / 100).alias("t_res"))


def mc_ctes(source: str, t: str, keys: str = "") -> tuple[str, ...]:
    """CTEs ending in ``mc`` with the quantiles per site."""
    ids = f"discovery_id{keys}"
    return (
        f"""dr0 as (select {ids}, area_km2, {t} as tc, {', '.join(f"k * {step!r}::double + {uniform_sql('discovery_id', 42 + j)} as s{j + 1}"
                                                                   for j, step in enumerate(resource.STEPS))} from {source} cross join range({DRAWS}) r(k))""",
        f"""dr1 as (select {ids}, area_km2, tc, least(greatest(tc + 20 * sqrt(-2 * ln(1 - (s1 - floor(s1)))) * cos(2 * pi() * (s2 - floor(s2))), 50), 320) as t,
 least(greatest(exp(ln(250.0::double) + 0.55 * sqrt(-2 * ln(1 - (s1 - floor(s1)))) * sin(2 * pi() * (s2 - floor(s2)))), 60), 1000) as h,
 sqrt(-2 * ln(1 - (s3 - floor(s3)))) * cos(2 * pi() * (s4 - floor(s4))) as z3 from dr0)""",
        """dr2 as (select *, exp(ln(case when t < 150 then 0.08 when t < 220 then 0.12 else 0.17 end) + 0.30 * z3) as rf,
 least(greatest(0.45 * (greatest(t - 90, 0) / (t + 273.15)), 0), 0.18) as eta from dr1)""",
        f"""mc as (select {ids}, quantile_cont(m, 0.1) as p10, quantile_cont(m, 0.5) as p50, quantile_cont(m, 0.9) as p90, avg(m) as mean, max(tc) as tc, avg(t) as t, avg(h) as h,
 avg(rf) as rf, avg(eta) as eta from (select *, {_mwe_sql('t', 'h', 'rf', 'eta', 'area_km2')} as m from dr2) group by {ids})""")


@query("MC1_monte_carlo", sql("sites", f"""
select discovery_id, {r6('p10')} as mwe_p10, {r6('p50')} as mwe_p50, {r6('p90')} as mwe_p90, {r6('mean')} as mwe_mean, {r6('tc')} as t_res_central,
 {r6('t')} as t_res_mean_draws, {r6('h')} as thickness_mean_m, {r6('rf')} as rf_mean, {r6('eta')} as eta_mean from mc""", RESOURCE_SQL, *mc_ctes("rs", "t_res")))
def mc1(fx):
    out = resource.monte_carlo(resource_sites(fx), DRAWS)
    return rounded(out, *[c for c in out.columns if c != "discovery_id"])


_DELTAS = (-40, -20, 0, 20, 40)
_SHIFTED = "sh as (select *, least(greatest(t_res + delta, 50), 320) as ts from rs cross join (values (-40), (-20), (0), (20), (40)) v(delta))"


@query("MC2_mc_sensitivity", sql("sites", "select discovery_id, " + ", ".join(
    f"{r6(f'max(case when delta = {d} then {q} end)')} as {resource.shift_name(d)}_{q}" for d in _DELTAS for q in ("p10", "p50", "p90")) +
    " from mc group by 1", RESOURCE_SQL, _SHIFTED, *mc_ctes("sh", "ts", ", delta")))
def mc2(fx):
    out = resource.sensitivity(resource_sites(fx), n=DRAWS)
    return rounded(out, *[c for c in out.columns if c != "discovery_id"])


@query("MC2_sensitivity_totals", sql("sites", "select " + ", ".join(
    f"{r6(f'sum(case when delta = {d} then {q} end)', 4)} as sum_{resource.shift_name(d)}_{q}" for d in _DELTAS for q in ("p10", "p50", "p90")) +
    f", {r6('(sum(case when delta = 20 then p50 end) - sum(case when delta = -20 then p50 end)) / (2 * sum(case when delta = 0 then p50 end)) * 100')} as pct_per_20c from mc",
                                     RESOURCE_SQL, _SHIFTED, *mc_ctes("sh", "ts", ", delta")))
def mc2t(fx):
    out = resource.sensitivity_totals(resource.sensitivity(resource_sites(fx), n=DRAWS))
    return rounded(rounded(out, *[c for c in out.columns if c.startswith("sum")], digits=4), "pct_per_20c")


def _lcoe(case: str) -> str:
    return repr(thermal.lcoe_value(case)) + "::double"


@query("A18_totals_policy", sql("sites", f"""
select {r6('p10', 4)} as mwe_p10, {r6('p50', 4)} as mwe_p50, {r6('p90', 4)} as mwe_p90, {r6('e', 4)} as mwe_eligible, {r6(_lcoe('base'))} as lcoe_base,
 {r6(_lcoe('cheap'))} as lcoe_cheap, {r6(_lcoe('expensive'))} as lcoe_expensive, {r6('e / greatest(p50, 1)')} as fraction_eligible, {r6('p50 / 60000')} as vision_fraction_p50,
 {r6('p90 / 60000')} as vision_fraction_p90, {r6('p50 / 3800')} as capacity_multiplier_p50, {', '.join(f"{r6(f'{q} * 8760 * 0.93 / 1e6')} as twh_{q}" for q in ('p10', 'p50', 'p90'))},
 {r6('p50 * 8760 * 0.93 / 1e6 * 0.386')} as co2_mt_per_yr_p50, {', '.join(f"{r6(f'{q} * 8760 * 0.93 / 1e6 * 0.386 * 30', 4)} as co2_mt_30yr_{q}" for q in ('p10', 'p50', 'p90'))}
from (select sum(p10) as p10, sum(p50) as p50, sum(p90) as p90, sum(case when tc >= 180 then p50 else 0 end) as e from mc)""", RESOURCE_SQL, *mc_ctes("rs", "t_res")))
def a18(fx):
    out = resource.policy_totals(resource.monte_carlo(resource_sites(fx), DRAWS))
    wide = [c for c in out.columns if c.startswith(("mwe", "co2_mt_30"))]
    return rounded(rounded(out, *wide, digits=4), *[c for c in out.columns if c not in wide])
