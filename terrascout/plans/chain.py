"""Queries over whole chains, manifests, rules and streams (M, ST2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.operators import discovery, manifest, rank
from terrascout.plans.clusters import dbscan_ctes
from terrascout.plans.fixtures import DIST, FROZEN, LAT0, query, r6, rounded, sql
from terrascout.plans.joins import CENTRES_SQL, LINES_SQL, fault_centres, knn_sql
from terrascout.plans.resources import RESOURCE_SQL, resource_sites
from terrascout.plans.sources import PROVINCE_SQL, volcano_values
from terrascout.session import scratch_path
from terrascout.sources import tables
from terrascout.streaming import jobs

_DISCOVER = ("far as (select s.cell_id as id, s.x, s.y, s.lat, s.lon, s.p_a, s.p_std from fx_scores s left join (select distinct a.cell_id from fx_scores a join fx_sites b on "
             + DIST + " <= 25) n using (cell_id) where p_a > 0.05 and p_std < 0.20 and n.cell_id is null)",
             *dbscan_ctes("far", 25.0, 3),
             """sums as (select cluster as discovery_id, avg(lat) as lat, avg(lon) as lon, count(*) * 16.0::double as area_km2, avg(p_a) as p_mean, avg(p_std) as p_std,
 count(*) as n_cells, max(p_a) as p_max from far join labelled using (id) where cluster >= 0 group by 1)""",
             "sxy as (select *, lon * 111.32 * cos(radians(40.0)) as x, lat * 111.32 as y from sums)")


def discoveries(fx):
    cells = fx.scores.withColumnRenamed("p_a", "p_mean")
    return discovery.discover(cells, fx.sites, lat0=LAT0, p=0.05, spread=0.20, eps_km=25.0,
                              faults=fault_centres(fx), volcanoes=tables.dim_table(fx.spark, "volcanoes"))


@query("G3_discovery_chain", sql("scores sites faults", f"""
select discovery_id, {r6('lat', 9)} as lat, {r6('lon', 9)} as lon, area_km2, {r6('p_mean')} as p_mean, {r6('p_std', 9)} as p_std, n_cells, {r6('p_max')} as p_max, province,
 case when province in ('Basin_and_Range', 'Cascades', 'Snake_River_Plain', 'Salton_Trough') or fd < 50 or vd < 100 then 'plausible' else 'implausible' end as plausibility
from (select *, {PROVINCE_SQL} as province from sxy)
left join (select discovery_id, min({DIST}) as fd from sxy a cross join centres b group by 1) using (discovery_id)
left join (select discovery_id, min({DIST}) as vd from sxy a cross join volc b group by 1) using (discovery_id)""", LINES_SQL, CENTRES_SQL, volcano_values(), *_DISCOVER))
def chain(fx):
    """Filter, exclude, cluster, summarise and judge the whole scored table."""
    out = discoveries(fx)
    return rounded(rounded(out, "p_mean", "p_max", "area_km2"), "lat", "lon", "p_std", digits=9)


_FROZEN = """fz as (select discovery_id, lat, lon, area_km2, t_res as t_res_central, area_km2 / 10 as mwe_p10, area_km2 / 4 as mwe_p50, area_km2 / 2 as mwe_p90, PROV as province,
 case when discovery_id % 3 = 0 then 'implausible' else 'plausible' end as plausibility from rs)""".replace("PROV", PROVINCE_SQL)
_LINE = ("concat_ws(',', discovery_id, printf('%.6f', lat), printf('%.6f', lon), printf('%.6f', area_km2), printf('%.6f', t_res_central), printf('%.6f', mwe_p10), "
         "printf('%.6f', mwe_p50), printf('%.6f', mwe_p90), province, plausibility)")
_HASH = f"""chunks as (select (rn - 1) // 32 as c, sha256(string_agg(l, chr(10) order by rn)) as h from (select {_LINE} as l, row_number() over (order by discovery_id) as rn from fz) group by 1),
hash as (select sha256(string_agg(h, chr(10) order by c)) as sha256 from chunks)"""


def frozen_sites(fx):
    s = resource_sites(fx)
    return s.select("discovery_id", "lat", "lon", "area_km2", F.col("t_res").alias("t_res_central"), (F.col("area_km2") / 10).alias("mwe_p10"),
                    (F.col("area_km2") / 4).alias("mwe_p50"), (F.col("area_km2") / 2).alias("mwe_p90"), geo.province(F.col("lat"), F.col("lon")).alias("province"),
                    F.when(F.col("discovery_id") % 3 == 0, "implausible").otherwise("plausible").alias("plausibility"))


@query("M1_manifest_hash", sql("sites", "select (select count(*) from fz) as n_rows, sha256 from hash", RESOURCE_SQL, _FROZEN, _HASH))
def m1(fx):
    """The manifest's hash with chunks of 32 rows."""
    return manifest.table_hash(frozen_sites(fx), manifest.MANIFEST_COLUMNS, "discovery_id", chunk_rows=32)


@query("M1_manifest", sql("sites", f"""
select count(*) as n_sites, {r6('sum(mwe_p10)')} as mwe_p10, {r6('sum(mwe_p50)')} as mwe_p50, {r6('sum(mwe_p90)')} as mwe_p90,
 count(*) filter (plausibility = 'plausible') as plausible_count, (select string_agg(t, ',' order by t) from (select province || ':' || count(*) as t from fz group by province)) as provinces,
 (select sha256(string_agg(h, chr(10) order by c)) from (select (rn - 1) // 10000 as c, sha256(string_agg(l, chr(10) order by rn)) as h from (
  select {_LINE} as l, row_number() over (order by discovery_id) as rn from fz) group by 1)) as sha256 from fz""", RESOURCE_SQL, _FROZEN))
def m1b(fx):
    return rounded(manifest.manifest(frozen_sites(fx)), "mwe_p10", "mwe_p50", "mwe_p90")


@query("M2_verify_manifest", sql("sites", """
select (select sha256(sha256(string_agg(l, chr(10) order by discovery_id))) from (select discovery_id, LINE as l from fz)) as sha256, true as matches""".replace("LINE", _LINE), RESOURCE_SQL, _FROZEN))
def m2(fx):
    """A manifest checked against its own recorded hash."""
    sites = frozen_sites(fx)
    recorded = manifest.table_hash(sites, manifest.MANIFEST_COLUMNS, "discovery_id").first()["sha256"]
    return manifest.verify(sites, recorded)


@query("M3_quality_checks", sql("scores sites", """
select 'label_values' as rule, count(*) filter (label not in (0, 1)) as violations from fx_scores
union all select 'score_range', count(*) filter (p_a < 0 or p_a > 1) from fx_scores
union all select 'inside_box', count(*) filter (lat < 32 or lat > 48) from fx_scores
union all select 'wide_spread', count(*) filter (p_std > 0.2) from fx_scores
union all select 'unknown_cells', (select count(*) from events where user_id not in (select c_custkey from customer))"""))
def m3(fx):
    """Rules over all scores, and users unknown to the customer table."""
    got = manifest.quality_checks(fx.scores, {
        "label_values": ~F.col("label").isin(0, 1), "score_range": (F.col("p_a") < 0) | (F.col("p_a") > 1),
        "inside_box": (F.col("lat") < 32) | (F.col("lat") > 48), "wide_spread": F.col("p_std") > 0.2})
    lost = manifest.dangling(fx.table("events").select("user_id"), "user_id", fx.table("customer"), "c_custkey", "unknown_cells")
    return got.unionByName(lost)


@query("M4_recovery_check", sql("sites scores", f"""
select count(*) as n_sites, {r6('max(m)')} as mark, {r6('avg(cast(p_a >= m as double))')} as recovered from nn cross join (select quantile_cont(p_a, 0.75) as m from fx_scores)""",
                                knn_sql("fx_sites", "fx_scores", "site_id", "cell_id", 1, "b.p_a,")))
def m4(fx):
    return rounded(discovery.recovery(fx.sites, fx.scores, 0.75, site_id="site_id", score="p_a", lat0=LAT0), "mark", "recovered")


@query("M5_summary_card", sql("scores sites", f"""
select (select count(*) from fx_scores) as n_cells, (select sum(label) from fx_scores)::bigint as n_positive, (select {r6('median(p_a)')} from fx_scores) as median_score,
 (select count(*) from fx_sites) as n_sites, (select {r6('sum(bal)', 2)} from fx_sites) as sum_bal"""))
def m5(fx):
    cells = fx.scores.agg(F.count(F.lit(1)).alias("n_cells"), F.sum("label").alias("n_positive"))
    middle = rank.quantiles(fx.scores, "p_a", [0.5], names=["median_score"])
    sites = fx.sites.agg(F.count(F.lit(1)).alias("n_sites"), F.sum("bal").alias("sum_bal"))
    return rounded(rounded(manifest.summary_card([cells, middle, sites]), "median_score"), "sum_bal", digits=2)


_OUTCOMES = f"""
select outcome_id, site_id, case when outcome = 'success' then 'verified' else 'falsified' end as status, {r6('d')} as dist_km from (
 select outcome_id, site_id, outcome, ts, {DIST} as d from fx_outcomes a cross join fx_sites b)
where ts > timestamp '{FROZEN}' and (outcome = 'success' and d <= 25 or outcome = 'dry' and d <= 5)"""


@query("ST2_outcome_monitor", sql("outcomes sites", _OUTCOMES))
def st2(fx):
    """The event table as a stream, matched with the sites and stored."""
    reader = fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.folder}/events*.parquet")
    from terrascout.plans.fixtures import TABLES

    rows = reader.selectExpr(*[f"{e} as {c}" for c, e in TABLES["outcomes"][1].items()]).withColumn("ts", F.col("ts").cast("timestamp"))
    out = scratch_path(fx.spark, "st2")
    jobs.monitor(rows, fx.sites, FROZEN, out, scratch_path(fx.spark, "st2-state"), lat0=LAT0)
    return rounded(jobs.monitored(fx.spark, out).drop("ts"), "dist_km")


@query("ST2_outcome_batch", sql("outcomes sites", _OUTCOMES))
def st2b(fx):
    """The same job over the table."""
    return rounded(jobs.outcomes(fx.outcomes, fx.sites, FROZEN, lat0=LAT0).drop("ts"), "dist_km")
