"""Queries over projections, filters and scalar functions (P, F)."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from terrascout.functions import geo, thermal
from terrascout.operators import discovery, features, labels, resource, tiles
from terrascout.plans.fixtures import DIST, LAT0, query, r6, rounded, sql
from terrascout.plans.sources import PROVINCE_SQL
from terrascout.sources import tables


@query("P1_bbox", sql("cells", """
select cell_id, lat > 36 and lat < 45 and lon > -120 and lon < -110 as strictly from fx_cells
where lat between 36 and 45 and lon between -120 and -110"""))
def p1(fx):
    strict = (F.col("lat") > 36) & (F.col("lat") < 45) & (F.col("lon") > -120) & (F.col("lon") < -110)
    return geo.bbox(fx.cells, 36, 45, -120, -110).select("cell_id", strict.alias("strictly"))


@query("P2_sentinel_filter", sql("stations", f"select station_id, {r6('hf')} as hf from fx_stations where hf > 10 and hf < 300"))
def p2(fx):
    return rounded(geo.plausible_value(fx.stations, "hf", 10, 300).select("station_id", "hf"), "hf")


@query("P3_candidate_filter", sql("scores", """
select cell_id, 'strict' as rule from fx_scores where p_a > 0.5 and p_std < 0.15
union all select cell_id, 'inclusive' from fx_scores where p_a >= 0.5 and p_std <= 0.15"""))
def p3(fx):
    df = fx.scores
    strict = discovery.candidates(df, 0.5, 0.15, score="p_a").select("cell_id", F.lit("strict").alias("rule"))
    loose = discovery.candidates(df, 0.5, 0.15, True, score="p_a").select("cell_id", F.lit("inclusive").alias("rule"))
    return strict.unionByName(loose)


SITE_KM = f"""near as (select a.cell_id, min({DIST}) as site_km from fx_scores a cross join fx_sites b group by 1),
cov as (select s.*, near.site_km, s.label = 1 as covered, (s.p_b - 0.5) * 4 as hf_z from fx_scores s join near using (cell_id)),
coh as (
 select *, 'NC1_colorado_plateau' as cohort from cov where lat between 36 and 40 and lon between -111 and -108 and site_km > 200
 union all select *, 'NC2_eastern_basin' from cov where lat between 38 and 42 and lon between -116 and -113 and site_km > 100 and not covered
 union all select *, 'NC3_random_deep' from cov where site_km > 100 and not covered
 union all select *, 'NC4_cratonic_low_HF' from cov where site_km > 100 and not covered and hf_z < -1.0 and site_km > 150
 union all select *, 'NC5_colorado_plateau_strict' from cov where lat between 36 and 40 and lon between -111 and -108 and hf_z < -0.5 and site_km > 75
 union all select *, 'NC6_montana_wyoming_platform' from cov where lat between 44 and 48 and lon between -110 and -103 and hf_z < -0.3 and site_km > 75)"""


def covered_cells(fx):
    """Scored cells with site distance, a coverage flag and a heat-flow z."""
    near = tiles.nearest(fx.scores, fx.sites, q_id="cell_id", t_id="site_id", lat0=LAT0)
    return (fx.scores.join(near.select("cell_id", F.col("dist_km").alias("site_km")), "cell_id")
            .withColumns({"covered": F.col("label") == 1, "hf_z": (F.col("p_b") - 0.5) * 4}))


@query("P4_cohort_predicates", sql("scores sites", f"select cell_id, cohort, {r6('site_km')} as site_km from coh", SITE_KM))
def p4(fx):
    return rounded(labels.cohorts(covered_cells(fx)).select("cell_id", "cohort", "site_km"), "site_km")


@query("P5_project_xy", sql("cells", f"select cell_id, {r6('x')} as x, {r6('y')} as y from fx_cells"))
def p5(fx):
    return rounded(geo.project_xy(fx.cells, LAT0).select("cell_id", "x", "y"), "x", "y")


@query("P6_haversine", sql("cells", f"""
select cell_id, {r6('2 * 6371.0088 * asin(sqrt(least(1.0, h)))')} as km from (select cell_id,
 sin(radians(36.05 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(36.05)) * sin(radians(-117.8 - lon) / 2) ** 2 as h from fx_cells)"""))
def p6(fx):
    km = geo.haversine(F.col("lat"), F.col("lon"), F.lit(36.05), F.lit(-117.8))
    return rounded(fx.cells.select("cell_id", km.alias("km")), "km")


@query("P7_province_bin", sql("cells", f"""
select cell_id, {PROVINCE_SQL} as province, case when lat > 31 and lat < 35 and lon > -116 and lon < -113 then 'Salton_Trough'
 else {PROVINCE_SQL} end as specific from fx_cells"""))
def p7(fx):
    la, lo = F.col("lat"), F.col("lon")
    return fx.cells.select("cell_id", geo.province(la, lo).alias("province"), geo.province(la, lo, True).alias("specific"))


def _setting_sql() -> str:
    rules = " ".join(f"when lat between {a} and {b} and lon between {c} and {d} then '{n}'" for n, a, b, c, d in geo.SETTINGS)
    return f"case {rules} else 'other' end"


@query("P8_setting_label", sql("cells", f"select cell_id, {_setting_sql()} as setting from fx_cells"))
def p8(fx):
    return fx.cells.select("cell_id", geo.setting(F.col("lat"), F.col("lon")).alias("setting"))


GRADE_SQL = """case when t >= 200 then 'flash-plant grade (>=200 deg C)' when t >= 180 then 'binary-cycle grade (180-200 deg C)'
 when t >= 130 then 'binary low-T (130-180 deg C)' when t >= 90 then 'district heating (90-130 deg C)' else 'direct-use (<90 deg C)' end"""


@query("P9_temperature_class", sql("springs", f"select spring_id, case when t is not null then {GRADE_SQL} end as grade from (select spring_id, spring_t * 3 as t from fx_springs)"))
def p9(fx):
    return fx.springs.select("spring_id", geo.temperature_class(F.col("spring_t") * 3).alias("grade"))


@query("P10_dist_to_flags", sql("cells sites", f"""
select cell_id, d <= 5 as within_5_km, d <= 25 as within_25_km, d <= 50 as within_50_km, d >= 99 as in_top_1pct, d >= 95 as in_top_5pct,
 d >= 90 as in_top_10pct, d >= 75 as in_top_25pct from (select cell_id, min({DIST}) as d from fx_cells a cross join fx_sites b group by 1)"""))
def p10(fx):
    near = tiles.nearest(fx.cells, fx.sites, q_id="cell_id", t_id="site_id", lat0=LAT0)
    return geo.percentile_flags(geo.distance_flags(near, "dist_km", [5, 25, 50]), "dist_km").drop("site_id", "dist_km")


@query("P11_novel_flag", sql("permits sites", f"""
select permit_id, {r6('d')} as nearest_known_km, d > 50 as is_novel from (
 select permit_id, min({DIST}) as d from fx_permits a cross join fx_sites b group by 1)"""))
def p11(fx):
    out = discovery.novel(fx.permits, fx.sites, 50.0, id_col="permit_id", known_id="site_id", lat0=LAT0)
    return rounded(out.select("permit_id", "nearest_known_km", "is_novel"), "nearest_known_km")


@query("P12_earthshot_flag", sql("springs", """
select spring_id, spring_t * 3 >= 180 as eligible from fx_springs"""))
def p12(fx):
    cost = F.lit(thermal.lcoe_value("base"))
    return fx.springs.select("spring_id", thermal.meets_target(F.col("spring_t") * 3, cost).alias("eligible"))


@query("P13_tabular_features", sql("chem", f"""
select sample_id, {r6('sio2')} as f0, {r6('na')} as f1, {r6('k')} as f2, {r6('li')} as f3, {r6('cl')} as f4 from fx_chem"""))
def p13(fx):
    """Five columns assembled to a vector and taken apart again."""
    vec = features.tabular_features(fx.chem, ["sio2", "na", "k", "li", "cl"])
    arr = vector_to_array("features")
    return rounded(vec.select("sample_id", *[arr[i].alias(f"f{i}") for i in range(5)]), *[f"f{i}" for i in range(5)])


# ------------------------------------------------------------------- functions

@query("F1_parse_coord", sql("sites", f"""
select site_id, {r6("(floor(lat) + round((lat - floor(lat)) * 60, 2) / 60) * case when site_id % 2 = 0 then 1 else -1 end", 5)} as lat,
 {r6('-(floor(-lon) + round((-lon - floor(-lon)) * 60, 2) / 60)', 5)} as lon, {r6('lat', 5)} as plain, cast(null as double) as bad from fx_sites"""))
def f1(fx):
    """Degree-minute text written from decimal places and parsed back."""
    def dms(col, hemi):
        return F.concat(F.floor(col).cast("string"), F.lit("-"), F.format_string("%.2f", (col - F.floor(col)) * 60), F.lit(" "), hemi)

    lat, lon = F.col("lat"), -F.col("lon")
    text = fx.sites.select("site_id", dms(lat, F.when(F.col("site_id") % 2 == 0, "N").otherwise("S")).alias("la"),
                           dms(lon, F.lit("W")).alias("lo"), lat.cast("string").alias("pl"), F.concat(F.lit("site "), "name").alias("no"))
    out = text.select("site_id", *[geo.parse_coord(F.col(c)).alias(n) for c, n in (("la", "lat"), ("lo", "lon"), ("pl", "plain"), ("no", "bad"))])
    return rounded(out, "lat", "lon", "plain", digits=5)


@query("F2_to_number", """select o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) as double) as level,
 try_cast(split_part(o_orderpriority, '-', 2) as double) as word from orders""")
def f2(fx):
    parts = F.split("o_orderpriority", "-")
    return fx.table("orders").select("o_orderkey", geo.to_number(parts[0]).alias("level"), geo.to_number(parts[1]).alias("word"))


SLIP_SQL = "case fault_id % 5 when 0 then 0.1 when 1 then 0.6 when 2 then 3.0 when 3 then 0.0 else 0.7 end::double"


@query("F3_slip_rate", sql("faults", f"select fault_id, seq, {SLIP_SQL} as slip from fx_faults"))
def f3(fx):
    return fx.faults.select("fault_id", "seq", geo.slip_rate(F.col("slip_text")).alias("slip"))


@query("F4_lith_flags", sql("rings", """
select poly_id, seq, cast(poly_id % 4 = 0 as integer) as rock_volcanic, cast(poly_id % 4 = 1 as integer) as rock_intrusive,
 cast(poly_id % 4 = 2 as integer) as rock_sedimentary, cast(poly_id % 4 = 3 as integer) as rock_quaternary from fx_rings"""))
def f4(fx):
    return fx.rings.select("poly_id", "seq", *[c.alias(n) for n, c in geo.lith_flags(F.col("lith")).items()])


CHALC_SQL = "1032.0::double / nullif(4.69::double - log10(nullif(greatest(sio2, 0), 0)), 0) - 273.15"
NAK_SQL = "1217.0::double / nullif(log10(na / k) + 1.483::double, 0) - 273.15"


@query("F5_chalcedony", sql("chem", f"select sample_id, {r6('case when t > 20 and t < 350 then t end')} as t from (select sample_id, {CHALC_SQL} as t from fx_chem)"))
def f5(fx):
    return rounded(fx.chem.select("sample_id", thermal.chalcedony_t(F.col("sio2")).alias("t")), "t")


@query("F6_nak", sql("chem", f"select sample_id, {r6('case when t > 20 and t < 400 then t end')} as t from (select sample_id, {NAK_SQL} as t from fx_chem)"))
def f6(fx):
    return rounded(fx.chem.select("sample_id", thermal.nak_t(F.col("na"), F.col("k")).alias("t")), "t")


@query("F7_temp_at_depth", sql("stations", f"""
select station_id, {r6('15 + hf * 0.001 / 2.5 * 3500 - 2.5e-6 * 3500 * 3500 / 5.0')} as t35,
 {r6('15 + hf * 0.001 / 2.5 * 6500 - 2.5e-6 * 6500 * 6500 / 5.0')} as t65 from fx_stations"""))
def f7(fx):
    hf = F.col("hf")
    out = fx.stations.select("station_id", thermal.temperature_at_depth(hf, 3.5).alias("t35"), thermal.temperature_at_depth(hf, 6.5).alias("t65"))
    return rounded(out, "t35", "t65")


@query("F8_log1p_clip", sql("cells", f"select cell_id, {r6('ln(1 + greatest(bal, 0))')} as v from fx_cells"))
def f8(fx):
    return rounded(fx.cells.select("cell_id", thermal.log1p_clip(F.col("bal")).alias("v")), "v")


@query("F9_zscore", sql("chem", f"""
select sample_id, {r6('(sio2 - ms) / ss')} as sio2, {r6('(li - ml) / sl')} as li from fx_chem cross join (
 select avg(sio2) as ms, stddev_pop(sio2) as ss, avg(li) as ml, stddev_pop(li) as sl from fx_chem where cl > 100)"""))
def f9(fx):
    stats = features.norm_stats(fx.chem, ["sio2", "li"], fit_on=F.col("cl") > 100)
    return rounded(features.zscore(fx.chem, stats).select("sample_id", "sio2", "li"), "sio2", "li")


@query("F10_nan_safe", sql("springs", f"select spring_id, {r6('coalesce(spring_t, 0.0)')} as t from fx_springs"))
def f10(fx):
    """Missing temperatures carried as NaN and made 0."""
    holey = fx.springs.select("spring_id", F.coalesce("spring_t", F.lit(float("nan"))).alias("v"))
    return rounded(holey.select("spring_id", geo.finite(F.col("v"), F.lit(0.0)).alias("t")), "t")


@query("F11_reservoir_temp", sql("scores", f"""
select cell_id, {r6("case when a > 1 or b > 1 then least(150 + 35 * greatest(a, b), 280) else least(greatest(80 + 30 * c, 50), 220) end")} as t,
 case when a > 1 or b > 1 then 'geothermometer' else 'heat_flow_proxy' end as source
from (select cell_id, p_a * 4 - 1 as a, p_b * 4 - 2 as b, (p_b - 0.5) * 4 as c from fx_scores)"""))
def f11(fx):
    t, source = thermal.reservoir_t(F.col("p_a") * 4 - 1, F.col("p_b") * 4 - 2, (F.col("p_b") - 0.5) * 4)
    return rounded(fx.scores.select("cell_id", t.alias("t"), source.alias("source")), "t")


@query("F12_reservoir_temp_hf", sql("stations", f"""
select station_id, {r6('least(greatest(15 + 50 * (case when hf > 1 then hf else 55 end / 60), 50), 220)')} as t from fx_stations"""))
def f12(fx):
    hf = F.when(F.col("hf") > 1, F.col("hf"))
    return rounded(fx.stations.select("station_id", thermal.reservoir_t_from_heat_flow(hf).alias("t")), "t")


@query("F13_efficiency", sql("stations", f"""
select station_id, {r6('least(greatest(0.45 * (greatest(hf - 90, 0) / (hf + 273.15)), 0), 0.18)')} as eta from fx_stations"""))
def f13(fx):
    return rounded(fx.stations.select("station_id", thermal.efficiency(F.col("hf")).alias("eta")), "eta")


def _mwe_sql(t: str, h: str, rf: str, ce: str, area: str = "area") -> str:
    return (f"({area} * 1e6 * {h} * 2700.0 * 1000.0 * greatest({t} - 90.0, 0) * {rf} * {ce} / (30.0 * 365.25 * 86400.0) / 1e6)")


@query("F14_volumetric_mwe", sql("scores", f"""
select cell_id, {r6(_mwe_sql('t', '250.0', '0.10', '0.10'), 4)} as mwe, {r6(_mwe_sql('(t - 25.0)', '250.0', '0.05', '0.05'), 4)} as mwe_low,
 {r6(_mwe_sql('(t + 25.0)', '250.0', '0.15', '0.15'), 4)} as mwe_high from (select cell_id, 16.0::double * (1 + cell_id % 9) as area, 80 + 200 * p_a as t from fx_scores)"""))
def f14(fx):
    area, t = 16.0 * (1 + F.col("cell_id") % 9), 80 + 200 * F.col("p_a")
    out = fx.scores.select("cell_id", *[c.alias(n) for n, c in thermal.screening_mwe(area, t).items()])
    return rounded(out, "mwe", "mwe_low", "mwe_high", digits=4)


@query("F15_thermal_power", sql("scores", f"""
select cell_id, {r6('h', 3)} as p_th_mw, {r6('h * 0.5', 3)} as p_th_mw_half, {r6('h * 0.2', 3)} as p_th_mw_fifth,
 {r6('h * 0.45 * (t - 15) / (t + 273.15)', 3)} as p_el_mw from (select cell_id, t, area * 1e6 * 250.0 * 2700.0 * 1000.0 *
 greatest(t - 15.0, 0) * 0.10 / (30.0 * 365.25 * 86400.0) / 1e6 as h from (select cell_id, 16.0::double * (1 + cell_id % 9) as area, 80 + 200 * p_a as t from fx_scores))"""))
def f15(fx):
    area, t = 16.0 * (1 + F.col("cell_id") % 9), 80 + 200 * F.col("p_a")
    cols = thermal.thermal_mw(area, t)
    return rounded(fx.scores.select("cell_id", *[c.alias(n) for n, c in cols.items()]), *cols, digits=3)


@query("F16_lcoe", sql("sites", f"""
select site_id, "case", {r6('(rate * power(1 + rate, years) / (power(1 + rate, years) - 1) * capex + fom) / (8.76 * cf) + vom')} as lcoe
from fx_sites cross join (values ('base', 5000.0::double, 130.0::double, 1.10::double, 0.93::double, 0.07::double, 30.0::double),
 ('cheap', 4000.0, 110.0, 1.10, 0.95, 0.07, 30.0), ('expensive', 7500.0, 180.0, 1.10, 0.88, 0.07, 30.0)) v("case", capex, fom, vom, cf, rate, years)"""))
def f16(fx):
    return rounded(resource.cost_table(fx.sites).select("site_id", "case", "lcoe"), "lcoe")


@query("F20_date_parse", sql("permits", "select permit_id, filed from fx_permits where filed > date '1996-06-30'"))
def f20(fx):
    """Dates written as M/D/YYYY text, parsed and filtered."""
    text = fx.permits.select("permit_id", F.date_format("filed", "M/d/yyyy").alias("date"))
    return geo.filed_after(text, "date", "1996-06-30").select("permit_id", geo.parse_date(F.col("date")).alias("filed"))


@query("F21_json_summary", sql("cells", """
select '{"segment":"' || segment || '","n":' || count(*) || '}' as json from fx_cells group by segment"""))
def f21(fx):
    return tables.summary_json(fx.cells.groupBy("segment").agg(F.count(F.lit(1)).alias("n")))
