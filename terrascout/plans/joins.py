"""Queries over distance and attribute joins (J, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import geo, thermal
from terrascout.functions.portable import rounding
from terrascout.operators import discovery, features, labels, rank, stats, tiles
from terrascout.plans.fixtures import DIST, LAT0, query, r6, rounded, sql
from terrascout.plans.sources import PROVINCE_SQL, raster_bounds, volcano_values
from terrascout.sources import raster, shapes, tables


def knn_sql(q: str, t: str, q_id: str, t_id: str, k: int, extra: str = "", where: str = "true", name: str = "nn") -> str:
    """CTE with the k nearest targets by brute force."""
    return (f"{name} as (select * from (select a.{q_id}, b.{t_id}, {extra} {DIST} as d, row_number() over "
            f"(partition by a.{q_id} order by {DIST}, b.{t_id}) as rk from {q} a cross join {t} b where {where}) where rk <= {k})")


@query("J1_nearest", sql("cells sites", f"select cell_id, site_id, {r6('d')} as dist_km from nn", knn_sql("fx_cells", "fx_sites", "cell_id", "site_id", 1)))
def j1(fx):
    return rounded(tiles.nearest(fx.cells, fx.sites, q_id="cell_id", t_id="site_id", lat0=LAT0), "dist_km")


@query("J1_nearest_large", sql("cells springs", f"select cell_id, spring_id, {r6('d')} as dist_km from nn", knn_sql("fx_cells", "fx_springs", "cell_id", "spring_id", 1)))
def j1_large(fx):
    return rounded(tiles.nearest(fx.cells, fx.springs, q_id="cell_id", t_id="spring_id", lat0=LAT0), "dist_km")


@query("J2_knn", sql("cells stations", f"select cell_id, station_id, cast(rk as integer) as rank, {r6('d')} as dist_km from nn",
                     knn_sql("fx_cells", "fx_stations", "cell_id", "station_id", 5)))
def j2(fx):
    return rounded(tiles.knn(fx.cells, fx.stations, 5, q_id="cell_id", t_id="station_id", lat0=LAT0), "dist_km")


@query("J3_radius_join", sql("cells springs", f"""
select cell_id, spring_id, {r6('d')} as dist_km from (select cell_id, spring_id, {DIST} as d from fx_cells a cross join fx_springs b) where d <= 25"""))
def j3(fx):
    pairs = tiles.within(fx.cells, fx.springs, 25.0, q_id="cell_id", t_id="spring_id", lat0=LAT0)
    return pairs.withColumn("dist_km", rounding(F.col("dist_km"), 6))


@query("J4_buffer_label", sql("cells sites", """
select cell_id, cast(d <= 25 as integer) as label, case when d <= 25 then site_id end as field_id from nn""",
                              knn_sql("fx_cells", "fx_sites", "cell_id", "site_id", 1)))
def j4(fx):
    return labels.label_positive(fx.cells, fx.sites, 25.0, lat0=LAT0)


@query("J5_exclusion", sql("cells sites", f"""
select cell_id, d > 100 as beyond from (select cell_id, min({DIST}) as d from fx_cells a cross join fx_sites b group by 1) where d > 25"""))
def j5(fx):
    far = tiles.exclude_within(fx.cells, fx.sites, 25.0, q_id="cell_id", lat0=LAT0)
    beyond = tiles.exclude_within(far, fx.sites, 100.0, q_id="cell_id", lat0=LAT0).select("cell_id", F.lit(True).alias("beyond"))
    return far.select("cell_id").join(beyond, "cell_id", "left").select("cell_id", F.coalesce("beyond", F.lit(False)).alias("beyond"))


@query("J6_domain_join", sql("cells scores", f"""
select cell_id, external_id, {r6('d')} as dist_km, {r6('p_a')} as p_a, {r6('p_b')} as p_b from nn where d < 8""",
                             "ext as (select cell_id as external_id, p_a, p_b, x, y from fx_scores)",
                             knn_sql("fx_cells", "ext", "cell_id", "external_id", 1, "b.p_a, b.p_b,")))
def j6(fx):
    external = fx.scores.withColumnRenamed("cell_id", "external_id")
    out = discovery.domain_join(fx.cells, external, 8.0, external_id="external_id", cols=["p_a", "p_b"], lat0=LAT0)
    return rounded(out, "dist_km", "p_a", "p_b")


@query("J7_point_in_polygon", sql("cells rings", """
select cell_id, min(poly_id) as poly_id from (select c.cell_id, e.poly_id from fx_cells c cross join edges e
 where (e.lat > c.lat) <> (e.lat1 > c.lat) and c.lon < e.lon + (c.lat - e.lat) * (e.lon1 - e.lon) / (e.lat1 - e.lat)
 group by 1, 2 having count(*) % 2 = 1) group by 1""",
                                  """edges as (select a.poly_id, a.lat, a.lon, b.lat as lat1, b.lon as lon1 from fx_rings a
 join fx_rings b on a.poly_id = b.poly_id and b.seq = (a.seq + 1) % 8)"""))
def j7(fx):
    return shapes.point_in_polygon(fx.cells, shapes.polygons(fx.rings), id_col="cell_id")


PIXEL_SQL = """geo as (select max(prow) + 1 as ny from fx_pixels),
spots as (select c.*, ny, cast(floor((lon + 125.0) / 22.0 * 50) as integer) as pc, cast(floor((49.0 - lat) / 18.0 * ny) as integer) as pr from fx_cells c cross join geo)"""


@query("J8_raster_sample", sql("cells pixels", f"""
select cell_id, {r6('coalesce(value, -1.0)')} as value from spots left join fx_pixels p
 on p.pcol = greatest(0, least(49, pc)) and p.prow = greatest(0, least(ny - 1, pr))""", PIXEL_SQL))
def j8(fx):
    out = raster.sample(fx.cells, fx.pixels, raster_bounds(fx), default=-1.0)
    return rounded(out.select("cell_id", "value"), "value")


FOCAL_SQL = """foc as (select w.cell_id, avg(p.value) as regional from (select *,
 cast(floor(60.0::double * (1 / (111.32::double * greatest(0.2, cos(radians(lat))))) / 22.0 * 50) as integer) as dx,
 cast(floor(60.0::double / 111.32::double / 18.0 * ny) as integer) as dy from spots) w
 join fx_pixels p on p.prow between greatest(0, pr - dy) and least(ny - 1, pr + dy) and p.pcol between greatest(0, pc - dx) and least(49, pc + dx)
 group by 1)"""


@query("J9_raster_focal_mean", sql("cells pixels", f"select cell_id, {r6('regional')} as regional from fx_cells left join foc using (cell_id)", PIXEL_SQL, FOCAL_SQL))
def j9(fx):
    out = raster.focal_mean(fx.cells, fx.pixels, raster_bounds(fx), 60.0, id_col="cell_id")
    return rounded(out.select("cell_id", "regional"), "regional")


@query("F17_gravity_thickness", sql("cells pixels", f"""
select cell_id, {r6('greatest(0, -(value - regional) * 50)')} as thickness_m from spots left join foc using (cell_id) left join fx_pixels p
 on p.pcol = greatest(0, least(49, pc)) and p.prow = greatest(0, least(ny - 1, pr)) where value is not null""", PIXEL_SQL, FOCAL_SQL))
def f17(fx):
    bounds = raster_bounds(fx)
    both = raster.focal_mean(raster.sample(fx.cells, fx.pixels, bounds, clamp=True), fx.pixels, bounds, 60.0, id_col="cell_id")
    out = both.filter("value is not null").select("cell_id", thermal.gravity_thickness(F.col("value"), F.col("regional")).alias("thickness_m"))
    return rounded(out, "thickness_m")


LINES_SQL = """ln as (select * from (select *, row_number() over (partition by fault_id, part order by seq) - 1 as rn,
 count(*) over (partition by fault_id, part) as n from fx_faults) where n >= 2)"""
TIPS_SQL = """tips as (select concat_ws('/', fault_id, part, case when rn = 0 then 0 else 1 end) as k, fault_id, x, y from ln where rn = 0 or rn = n - 1)"""


@query("J10_pairs_diff_owner", sql("faults", f"""
select a.k as a_key, b.k as b_key, {r6(DIST)} as dist_km, {r6('(a.x + b.x) * 0.5')} as x, {r6('(a.y + b.y) * 0.5')} as y
from tips a join tips b on a.k < b.k and a.fault_id <> b.fault_id where {DIST} <= 10""", LINES_SQL, TIPS_SQL))
def j10(fx):
    tips = shapes.line_endpoints(shapes.lines(fx.faults))
    return rounded(shapes.tip_pairs(tips, 10.0, LAT0), "dist_km", "x", "y")


@query("J11_attach_by_id", """
select s_suppkey as site_id, coalesce(n, 0) as n_lines, coalesce(q, 0.0) as quantity from supplier left join (
 select l_suppkey, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by 1) on l_suppkey = s_suppkey""")
def j11(fx):
    got = (fx.table("lineitem").groupBy(F.col("l_suppkey").alias("site_id"))
           .agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity")))
    return features.attach(fx.sites.select("site_id"), got, "site_id", {"n_lines": 0, "quantity": 0.0}).withColumn(
        "n_lines", F.col("n_lines").cast("bigint"))


@query("J12_lookup_unit_link", """
select c_custkey as cell_id, n_name as unit, r_name as lith from customer left join nation on c_nationkey = n_nationkey
left join region on n_regionkey = r_regionkey""")
def j12(fx):
    """Unit and rock text through two link tables."""
    units = fx.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("unit"), "n_regionkey")
    rocks = fx.table("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("lith"))
    return (fx.table("customer").join(units, "c_nationkey", "left").join(rocks, "n_regionkey", "left")
            .select(F.col("c_custkey").alias("cell_id"), "unit", "lith"))


@query("J13_semi_filter", """
select c_custkey as cell_id from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 400000)""")
def j13(fx):
    owners = fx.table("orders").filter("o_orderstatus = 'F' and o_totalprice > 400000").select(F.col("o_custkey").alias("cell_id"))
    return fx.cells.select("cell_id").join(owners, "cell_id", "left_semi")


CENTRES_SQL = "centres as (select fault_id, avg(lon) as lon, avg(lat) as lat, avg(x) as x, avg(y) as y, max(case fault_id % 5 when 0 then 0.1 when 1 then 0.6 when 2 then 3.0 when 3 then 0.0 else 0.7 end) as slip from ln group by 1)"
PLAUSIBLE_SQL = f"""flagged as (select c.*, case when {PROVINCE_SQL} in ('Basin_and_Range', 'Cascades', 'Snake_River_Plain', 'Salton_Trough')
 or fd < 50 or vd < 100 then 'plausible' else 'implausible' end as plausibility from fx_cells c
 left join (select cell_id, min({DIST}) as fd from fx_cells a cross join (select * from centres where slip > 1.0) b group by 1) using (cell_id)
 left join (select cell_id, min({DIST}) as vd from fx_cells a cross join volc b group by 1) using (cell_id))"""


def fault_centres(fx):
    line = shapes.lines(fx.faults, extra=["slip_text"])
    slip = line.groupBy("fault_id").agg(F.max(geo.slip_rate(F.col("slip_text"))).alias("slip"))
    return shapes.line_centroids(line).join(slip, "fault_id")


def flagged_cells(fx):
    return discovery.plausibility(fx.cells, fault_centres(fx), tables.dim_table(fx.spark, "volcanoes"), id_col="cell_id", lat0=LAT0, min_slip=1.0)


@query("J14_plausibility", sql("cells faults", "select cell_id, plausibility from flagged", LINES_SQL, CENTRES_SQL, volcano_values(), PLAUSIBLE_SQL))
def j14(fx):
    return flagged_cells(fx).select("cell_id", "plausibility")


@query("J15_consensus", sql("cells sites", f"""
select discovery_id, nearest_max_id, {r6('d')} as dist_to_max_km, true as matched from nn where d < 25""",
                            """aa as (select cell_id as discovery_id, x, y from fx_cells where bal > 0),
bb as (select site_id as nearest_max_id, x, y from fx_sites where bal > 0)""",
                            knn_sql("aa", "bb", "discovery_id", "nearest_max_id", 1)))
def j15(fx):
    flag = F.when(F.col("bal") > 0, "plausible").otherwise("implausible").alias("plausibility")
    a = fx.cells.select(F.col("cell_id").alias("discovery_id"), "lat", "lon", flag)
    b = fx.sites.select(F.col("site_id").alias("discovery_id"), "lat", "lon", flag)
    out = discovery.consensus(a, b, 25.0, lat0=LAT0)
    return rounded(out.select("discovery_id", "nearest_max_id", "dist_to_max_km", "matched"), "dist_to_max_km")


# Folds over the scored cells: fold = key % 10; positives of a fold are its test rows.
_TESTS = "tests as (select cast(cell_id % 10 as bigint) as fold_id, cell_id from fx_scores where label = 1 or p_b > 0.9)"
_NEAR = f"near as (select b.site_id, a.cell_id from fx_sites b join fx_scores a on {DIST} <= 25)"


def _audit_sql(role: str) -> str:
    member = "join tests t on t.cell_id = n.cell_id" if role == "test" else (
        "cross join (select distinct fold_id from tests) t where not exists (select 1 from tests u where u.fold_id = t.fold_id and u.cell_id = n.cell_id)")
    return sql("scores sites", """
select s.site_id, coalesce(n, 0) as n_folds, coalesce(f, '') as fold_indices from fx_sites s left join (
 select site_id, count(*) as n, array_to_string(list_sort(list(fold_id)), ',') as f from touched group by 1) using (site_id)""",
               _TESTS, _NEAR, f"touched as (select distinct n.site_id, t.fold_id from near n {member})")


def _audit(fx, role):
    tests = fx.scores.filter("label = 1 or p_b > 0.9").select((F.col("cell_id") % 10).alias("fold_id"), "cell_id")
    return discovery.fold_audit(fx.sites, tests, fx.scores, 25.0, role, site_id="site_id", lat0=LAT0)


@query("J16_fold_buffer_audit", _audit_sql("train"))
def j16(fx):
    return _audit(fx, "train")


@query("J16_fold_buffer_audit_test", _audit_sql("test"))
def j16t(fx):
    return _audit(fx, "test")


def _permit_sql(n: str, where: str) -> str:
    return sql("sites permits", f"""
select s.site_id, {n} as n_permits, {r6('near_km')} as nearest_permit_km, coalesce(t, '—') as nearest_permits from fx_sites s
left join (select site_id, min(d) as near_km, count(*) filter (d <= 25) as top, string_agg(permit_id || ' @ ' || printf('%.1f', d) || 'km', '; ' order by rk) filter (d <= 25) as t
 from nn group by 1) using (site_id)
left join (select site_id, count(*) as every from fx_sites a join pm b on {DIST} <= 25 group by 1) using (site_id)""",
               f"pm as (select * from fx_permits where {where})", knn_sql("fx_sites", "pm", "site_id", "permit_id", 5))


def _permits(fx, **kw):
    out = discovery.field_check(fx.sites, fx.permits, 25.0, site_id="site_id", permit_id="permit_id", lat0=LAT0, **kw)
    return rounded(out.select("site_id", "n_permits", "nearest_permit_km", "nearest_permits"), "nearest_permit_km")


@query("J17_permit_check", _permit_sql("coalesce(every, 0)", "filed > date '1996-01-01'"))
def j17(fx):
    """All permits filed after a day within 25 km."""
    return _permits(fx, after_date="1996-01-01")


@query("F18_format_label", sql("permits", """
select permit_id, coalesce(nullif(status, 'P'), 'permit?') || ' ' || permit_id || ' (' || priority || ') ' || status || ' @ ' || printf('%.1f', lat) || 'km' as label from fx_permits"""))
def f18(fx):
    p = fx.permits.withColumn("number", F.nullif("status", F.lit("P")))
    return p.select("permit_id", discovery.permit_label("number", "permit_id", "priority", "status", "lat").alias("label"))


def auc_sql(src: str, score: str, by: str) -> str:
    """AUROC per group from average ranks."""
    return f"""(select {by}, (sum(case when label = 1 then r end) - max(np) * (max(np) + 1) / 2.0) / nullif(max(np) * (max(n) - max(np)), 0) as auroc from (
 select {by}, label, rank() over (partition by {by} order by {score}) + (count(*) over (partition by {by}, {score}) - 1) / 2.0 as r,
 sum(label) over (partition by {by}) as np, count(*) over (partition by {by}) as n from {src}) group by {by})"""


def fold_scores(fx):
    return fx.scores.withColumn("fold_id", F.col("cell_id") % 20)


FOLD_SCORES = "fs as (select *, cell_id % 20 as fold_id from fx_scores)"


@query("J18_paired_folds", sql("scores", f"""
select a.fold_id, {r6('a.auroc')} as first, {r6('b.auroc')} as second from {auc_sql('fs', 'p_a', 'fold_id')} a join {auc_sql('fs', 'p_b', 'fold_id')} b using (fold_id)""", FOLD_SCORES))
def j18(fx):
    a, b = (rank.auroc(fold_scores(fx), s, "label", ["fold_id"]) for s in ("p_a", "p_b"))
    return rounded(stats.paired_folds(a, b), "first", "second")


@query("J19_site_lookup", sql("sites scores cells", f"""
select site_id, cell_id, {r6('nn.d')} as cell_km, {r6('p_a')} as p_a, {r6('pct')} as percentile, pct >= 99 as in_top_1pct, pct >= 95 as in_top_5pct,
 pct >= 90 as in_top_10pct, pct >= 75 as in_top_25pct, {r6('kd')} as nearest_known_km from nn
 join (select site_id, min({DIST}) as kd from fx_sites a cross join fx_cells b group by 1) using (site_id)""",
                              "sc as (select *, 100.0::double * (rank() over (order by p_a) - 1) / count(*) over () as pct from fx_scores)",
                              knn_sql("fx_sites", "sc", "site_id", "cell_id", 1, "b.p_a, b.pct,")))
def j19(fx):
    known = fx.cells.withColumnRenamed("cell_id", "known_id")
    out = discovery.site_lookup(fx.sites, fx.scores, known, site_id="site_id", score="p_a", lat0=LAT0)
    return rounded(out, "cell_km", "p_a", "percentile", "nearest_known_km")


@query("I1_idw_knn", sql("cells stations", f"""
select cell_id, {r6('case when min(d) <= 20 then sum(hf / (d + 1)) / sum(1 / (d + 1)) end')} as value, {r6('min(d)')} as nearest_km from nn group by 1""",
                         knn_sql("fx_cells", "fx_stations", "cell_id", "station_id", 5, "b.hf,")))
def i1(fx):
    """Five stations per cell, nothing beyond 20 km."""
    return rounded(stats.idw(fx.cells, fx.stations, 5, 20.0, q_id="cell_id", t_id="station_id", lat0=LAT0), "value", "nearest_km")


# Stations meet stations of the 3 x 3 tiles around them; a tile holds 27 stations on average,
# so the five nearest of a station lie closer than one tile.
LOO_SQL = f"""st as (select *, cast(floor(x / tile) as bigint) as bx, cast(floor(y / tile) as bigint) as by_ from fx_stations
 cross join (select sqrt(1.01e8 / count(*)) as tile from fx_stations)),
st9 as (select st.*, bx + i as jx, by_ + j as jy from st cross join range(-1, 2) a(i) cross join range(-1, 2) b(j)),
nn as (select * from (select a.station_id, a.hf as observed, b.hf as other, {DIST} as d, row_number() over (partition by a.station_id order by {DIST}, b.station_id) as rk
 from st9 a join st b on b.bx = a.jx and b.by_ = a.jy and b.station_id <> a.station_id) where rk <= 5),
loo as (select station_id, max(observed) as observed, sum(other / (d + 1)) / sum(1 / (d + 1)) as predicted from nn group by 1 having min(d) <= 200)"""


@query("I2_idw_loo", sql("stations", f"select station_id, {r6('observed')} as observed, {r6('predicted')} as predicted, {r6('observed - predicted')} as residual from loo", LOO_SQL))
def i2(fx):
    return rounded(stats.idw_loo(fx.stations, id_col="station_id", lat0=LAT0), "observed", "predicted", "residual")
