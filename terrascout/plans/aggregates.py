"""Queries over aggregates and reports (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.functions.portable import uniform_sql
from terrascout.operators import cluster, discovery, features, labels, rank, stats, tiles
from terrascout.plans.fixtures import DIST, LAT0, X_SQL, Y_SQL, query, r6, rounded, sql
from terrascout.plans.joins import (CENTRES_SQL, FOLD_SCORES, LINES_SQL, LOO_SQL, TIPS_SQL, auc_sql, fault_centres,
                                    fold_scores)
from terrascout.plans.scalars import CHALC_SQL, NAK_SQL, SITE_KM, SLIP_SQL, covered_cells
from terrascout.plans.sources import PROVINCE_SQL, volcano_values
from terrascout.sources import shapes, tables
from terrascout.session import cut, written


@query("A1_radius_features", sql("cells springs chem stations", f"""
select cell_id, coalesce(s.n, c.n, w.n) is not null as covered, coalesce(s.n, 0)::double as n_springs, {r6('coalesce(s.m, 0)')} as max_spring_t,
 {r6('coalesce(c.ch, 0)')} as mean_chalcedony_t, {r6('coalesce(c.nk, 0)')} as mean_nak_t, {r6('coalesce(w.b, 0)')} as max_bht,
 {r6('coalesce(w.g, 0)')} as mean_gradient, coalesce(c.n, 0)::double as n_samples, {r6('coalesce(c.li, 0)')} as max_li, {r6('coalesce(c.cl, 0)', 7)} as mean_cl
from fx_cells left join (select cell_id, count(*) as n, max(spring_t) as m from fx_cells a join fx_springs b on {DIST} <= 50 group by 1) s using (cell_id)
left join (select cell_id, count(*) as n, avg(case when tc > 20 and tc < 350 then tc end) as ch, avg(case when tn > 20 and tn < 400 then tn end) as nk,
 max(li) as li, avg(cl) as cl from fx_cells a join (select *, {CHALC_SQL} as tc, {NAK_SQL} as tn from fx_chem) b on {DIST} <= 50 group by 1) c using (cell_id)
left join (select cell_id, count(*) as n, max(hf) as b, avg(sqrt(hf)) as g from fx_cells a join fx_stations b on {DIST} <= 50 group by 1) w using (cell_id)"""))
def a1(fx):
    """Nine chemistry features within 50 km of every cell."""
    wells = fx.stations.select("lat", "lon", F.col("hf").alias("bht"), F.sqrt("hf").alias("gradient"))
    out = features.point_features(fx.cells, fx.springs, fx.chem, wells, 50.0, lat0=LAT0)
    return rounded(rounded(out, *[c for c in features.CHEMISTRY_COLUMNS if c != "mean_cl"]), "mean_cl", digits=7)


SAMPLES_SQL = f"""seg as (select a.fault_id, a.part, a.rn, a.lon as lon0, a.lat as lat0, b.lon as lon1, b.lat as lat1,
 sqrt((b.lon - a.lon) * (b.lon - a.lon) + (b.lat - a.lat) * (b.lat - a.lat)) as len from ln a join ln b on a.fault_id = b.fault_id and a.part = b.part and b.rn = a.rn + 1),
run as (select *, coalesce(sum(len) over w - len, 0) as c0, sum(len) over w as c1, sum(len) over (partition by fault_id) as total,
 row_number() over w as k, count(*) over (partition by fault_id) as m from seg window w as (partition by fault_id order by part, rn)),
cnt as (select distinct fault_id, total, greatest(2, cast(floor(total / (2.0::double / 111.32::double)) as integer)) as n from run),
pos as (select fault_id, total, n, i as sample, total * i / (n - 1) as at_ from cnt cross join range(0, (select max(n) from cnt)) r(i) where i < n),
smp as (select fault_id, sample, lon, lat, {X_SQL} as x, {Y_SQL} as y, {SLIP_SQL} as slip from (
 select p.fault_id, p.sample, r.lon0 + f * (r.lon1 - r.lon0) as lon, r.lat0 + f * (r.lat1 - r.lat0) as lat from (
  select p.*, r.k, case when r.len > 0 then least(1.0, greatest(0.0, (p.at_ - r.c0) / r.len)) else 0.0 end as f,
   row_number() over (partition by p.fault_id, p.sample order by r.k) as first_ from pos p join run r on r.fault_id = p.fault_id
   and p.at_ <= r.c1 + 1e-9 or r.fault_id = p.fault_id and r.k = r.m) p join run r on r.fault_id = p.fault_id and r.k = p.k where first_ = 1))"""


@query("R5_line_samples", sql("faults", f"select fault_id, cast(sample as bigint) as sample, {r6('lon', 5)} as lon, {r6('lat', 5)} as lat from smp", LINES_SQL, SAMPLES_SQL))
def r5(fx):
    return rounded(shapes.line_samples(shapes.lines(fx.faults)), "lon", "lat", digits=5)


@query("R6_line_endpoints", sql("faults", f"""
select fault_id, part, 0 as tip, {r6('lon')} as lon, {r6('lat')} as lat from ln where rn = 0
union all select fault_id, part, 1, {r6('lon')}, {r6('lat')} from ln where rn = n - 1""", LINES_SQL))
def r6q(fx):
    return rounded(shapes.line_endpoints(shapes.lines(fx.faults)), "lon", "lat")


@query("R7_line_centroid", sql("faults", f"select fault_id, {r6('lon')} as lon, {r6('lat')} as lat from centres", LINES_SQL, CENTRES_SQL))
def r7(fx):
    return rounded(shapes.line_centroids(shapes.lines(fx.faults)), "lon", "lat")


@query("A2_line_features", sql("cells faults", f"""
select cell_id, coalesce(n, 0) * 2.0::double as density_km, {r6('coalesce(d, 1000)')} as nearest_km, coalesce(slip, 0.0)::double as max_slip, coalesce(tips_, 0) as n_tips from fx_cells
left join (select cell_id, min({DIST}) as d, count(*) filter ({DIST} <= 25) as n, max(slip) filter ({DIST} <= 25) as slip from fx_cells a cross join smp b group by 1) using (cell_id)
left join (select cell_id, count(*) as tips_ from fx_cells a join mids b on {DIST} <= 10 group by 1) using (cell_id)""", LINES_SQL, SAMPLES_SQL, TIPS_SQL,
                               f"mids as (select (a.x + b.x) * 0.5 as x, (a.y + b.y) * 0.5 as y from tips a join tips b on a.k < b.k and a.fault_id <> b.fault_id where {DIST} <= 10)"))
def a2(fx):
    """Line density, distance, slip and crossing tips (tips pair up within 10 km here)."""
    def made():
        line = written(fx.spark, lambda: shapes.lines(fx.faults, extra=["slip_text"])
                       .withColumn("slip", geo.slip_rate(F.col("slip_text"))).drop("slip_text"))
        tips = shapes.tip_pairs(shapes.line_endpoints(line), 10.0, LAT0, around=fx.cells, near_km=10.0)
        out = features.line_features(fx.cells, shapes.line_samples(line, keep="slip"), tips, lat0=LAT0)
        return rounded(out, "density_km", "nearest_km", "max_slip")

    return written(fx.spark, made)


@query("A3_volcano_features", sql("cells", f"""
select cell_id, {r6(f'min({DIST})')} as nearest_km, count(*) filter ({DIST} <= 100) as n_100km from fx_cells a cross join volc b group by 1""", volcano_values()))
def a3(fx):
    return rounded(features.volcano_features(fx.cells, tables.dim_table(fx.spark, "volcanoes"), lat0=LAT0), "nearest_km")


@query("A4_cluster_summary", sql("scores", f"""
select cast(floor(lat) * 100 + floor(lon) + 200 as bigint) as discovery_id, {r6('avg(lat)', 9)} as lat, {r6('avg(lon)', 9)} as lon, count(*) * 16.0::double as area_km2,
 {r6('avg(p_a)')} as p_mean, {r6('avg(p_std)', 9)} as p_std, count(*) as n_cells, {r6('max(p_a)')} as p_max from fx_scores group by 1"""))
def a4(fx):
    """Clusters given by degree squares."""
    square = (F.floor("lat") * 100 + F.floor("lon") + 200).cast("bigint")
    out = discovery.summarise_clusters(fx.scores.withColumnRenamed("p_a", "p_mean").withColumn("cluster", square))
    return rounded(rounded(out, "p_mean", "p_max", "area_km2"), "lat", "lon", "p_std", digits=9)


@query("A5_province_counts", sql("cells sites", f"""
select {PROVINCE_SQL} as province, count(*) as n_cells, sum(cast(d <= 25 as bigint))::bigint as n_positive
from fx_cells join (select cell_id, min({DIST}) as d from fx_cells a cross join fx_sites b group by 1) using (cell_id) group by 1"""))
def a5(fx):
    """Label every cell by its nearest site and count positives per province."""
    labelled = labels.label_positive(fx.cells, fx.sites, 25.0, lat0=LAT0)
    cells = fx.cells.join(labelled, "cell_id").withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    out = discovery.by_province(cells, "label")
    return out.select("province", F.col("n").alias("n_cells"), F.col("sum_label").cast("bigint").alias("n_positive"))


@query("A6_coverage_rates", sql("cells springs chem", f"""
select count(*) as n, {r6('avg(f1)')} as rate_springs, {r6('avg(f2)')} as rate_chem, {r6('avg(f1 + f2)')} as mean_sources from (
 select cell_id, cast(s is not null as integer) as f1, cast(c is not null as integer) as f2 from fx_cells
 left join (select distinct cell_id, 1 as s from fx_cells a join fx_springs b on {DIST} <= 10) using (cell_id)
 left join (select distinct cell_id, 1 as c from fx_cells a join fx_chem b on {DIST} <= 10) using (cell_id))"""))
def a6(fx):
    def near(source, name):
        return tiles.radius_aggregate(fx.cells, source, 10.0, {name: ("count", None)}, q_id="cell_id", lat0=LAT0)

    cells = fx.cells.select("cell_id").join(near(fx.springs, "s"), "cell_id", "left").join(near(fx.chem, "c"), "cell_id", "left")
    cells = cells.select(F.col("s").isNotNull().alias("springs"), F.col("c").isNotNull().alias("chem"))
    return rounded(features.coverage_rates(cells, ["springs", "chem"]), "rate_springs", "rate_chem", "mean_sources")


@query("A6_sources_per_cell", sql("scores", """
select cast(p_a > 0.2 as integer) + cast(p_b > 0.5 as integer) + label as n_sources, count(*) as n_cells from fx_scores group by 1"""))
def a6b(fx):
    flags = fx.scores.select((F.col("p_a") > 0.2).alias("a"), (F.col("p_b") > 0.5).alias("b"), (F.col("label") == 1).alias("c"))
    return features.sources_per_cell(flags, ["a", "b", "c"])


@query("A6_class_ratio", sql("scores", f"""
select count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg, {r6('count(*) filter (label = 0) / count(*) filter (label = 1)')} as ratio from fx_scores"""))
def a6c(fx):
    return rounded(features.class_ratio(fx.scores), "ratio")


@query("A7_norm_stats", sql("chem", " union all ".join(
    f"select 'chem' as modality, '{c}' as feature, {r6(f'avg({c})')} as mean, {r6(f'coalesce(nullif(stddev_pop({c}), 0), 1)')} as std from fx_chem"
    for c in ("sio2", "na", "k", "li", "cl", "zero")).replace("fx_chem", "(select *, 0.0::double as zero from fx_chem)")))
def a7(fx):
    return rounded(features.norm_stats(fx.chem.withColumn("zero", F.lit(0.0)), ["sio2", "na", "k", "li", "cl", "zero"], modality="chem"), "mean", "std")


PCT_SQL = "pct as (select cell_id, 100.0::double * (rank() over (order by p_a) - 1) / count(*) over () as pct from fx_scores)"


@query("A8_cohort_table", sql("scores sites", f"""
select cohort, count(*) as n, {r6('avg(p_a)')} as mean_p, {r6('median(p_a)')} as median_p, {r6('avg(pct)')} as mean_percentile, {r6('median(pct)')} as median_percentile,
 {r6('avg(cast(pct > 50 as double))')} as frac_above_50pct, {r6('avg(cast(pct > 90 as double))')} as frac_above_90pct from coh join pct using (cell_id) group by 1""", SITE_KM, PCT_SQL))
def a8(fx):
    cohorts = labels.cohorts(rank.pct_strict(covered_cells(fx), "p_a"))
    out = stats.cohort_table(cohorts, "p_a", "pct")
    return rounded(out, "mean_p", "median_p", "mean_percentile", "median_percentile", "frac_above_50pct", "frac_above_90pct")


@query("A8_hard_negatives", sql("scores sites", f"""
select cohort, n_available, count(*) as n_sample, {r6('avg(p_a)')} as mean_p, {r6('avg(o)')} as mean_pct, {r6('avg(cast(o < 10 as double))')} as frac_below_10pct,
 {r6('avg(cast(o < 5 as double))')} as frac_below_5pct, {r6('avg(cast(o >= 50 as double))')} as frac_above_50pct, {r6('avg(cast(o >= 90 as double))')} as frac_above_90pct,
 {r6('avg(hf_z)')} as mean_hf_z, {r6('avg(site_km)')} as mean_site_km from (select *, count(*) over (partition by cohort) as n_available,
  row_number() over (partition by cohort order by {uniform_sql('cell_id', 42)}, cell_id) as rn from coh) join ord using (cell_id) where rn <= 100 group by 1, 2""", SITE_KM,
                                "ord as (select cell_id, 100.0::double * (row_number() over (order by p_a, cell_id) - 1) / (count(*) over () - 1) as o from fx_scores)"))
def a8h(fx):
    """A hundred cells per cohort against ordinal percentiles."""
    cohorts = cut(labels.cohorts(rank.pct_ordinal(covered_cells(fx), "p_a", "cell_id")))
    out = stats.hard_negative_table(labels.cohort_sample(cohorts, 100), cohorts, "p_a", "pct")
    return rounded(out, *[c for c in out.columns if c.startswith(("mean", "frac"))])


@query("A9_separation_gap", sql("scores sites", f"""
select m as model, {r6('avg(case when label = 1 then pct end)')} as pos_mean_pct, {r6('avg(case when nc3 then pct end)')} as nc3_mean_pct,
 {r6('avg(case when label = 1 then pct end) - avg(case when nc3 then pct end)')} as separation_gap, {r6('avg(cast(p > 0.5 as double))')} as score_frac_above_50
from (select 'a' as m, label, site_km > 100 and not covered as nc3, p_a as p, 100.0::double * (rank() over (order by p_a) - 1) / count(*) over () as pct from cov
 union all select 'b', label, site_km > 100 and not covered, p_b, 100.0::double * (rank() over (order by p_b) - 1) / count(*) over () from cov) group by 1""", SITE_KM))
def a9(fx):
    cells = covered_cells(fx).withColumn("nc3", (F.col("site_km") > 100) & ~F.col("covered"))
    runs = None
    for name in ("a", "b"):
        one = rank.pct_strict(cells.withColumn("p", F.col(f"p_{name}")), "p").select(F.lit(name).alias("model"), "label", "nc3", "p", "pct")
        runs = one if runs is None else runs.unionByName(one)
    out = stats.separation_gap(runs, "label", "nc3", "p", "pct", by=["model"])
    return rounded(out, "pos_mean_pct", "nc3_mean_pct", "separation_gap", "score_frac_above_50")


@query("A10_mean_std_report", sql("scores", f"""
select model, {r6('avg(auroc)')} as auroc_mean, {r6('stddev_pop(auroc)')} as auroc_std, count(auroc) as auroc_n,
 printf('%.3f +/- %.3f', avg(auroc), stddev_pop(auroc)) as auroc_text from (
 select 'a' as model, auroc from {auc_sql('fs', 'p_a', 'fold_id')} union all select 'b', auroc from {auc_sql('fs', 'p_b', 'fold_id')}) group by 1""", FOLD_SCORES))
def a10(fx):
    runs = [rank.auroc(fold_scores(fx), f"p_{m}", "label", ["fold_id"]).withColumn("model", F.lit(m)) for m in ("a", "b")]
    return rounded(stats.summarise_runs(runs[0].unionByName(runs[1]), ["auroc"]), "auroc_mean", "auroc_std")


@query("A11_quantile_summary", sql("stations", f"""
select count(*) as n, min(hf) as min, max(hf) as max, {r6('avg(cast(hf >= 60 as double))')} as share_at_least, {r6('quantile_cont(hf, 0.1)')} as p10,
 {r6('quantile_cont(hf, 0.25)')} as q25, {r6('quantile_cont(hf, 0.5)')} as p50, {r6('quantile_cont(hf, 0.75)')} as q75, {r6('quantile_cont(hf, 0.9)')} as p90,
 {r6('quantile_cont(hf, 0.75) - quantile_cont(hf, 0.25)')} as iqr from fx_stations"""))
def a11(fx):
    return rounded(stats.quantile_summary(fx.stations, "hf", 60.0), "share_at_least", "p10", "q25", "p50", "q75", "p90", "iqr")


VECTOR_SQL = """vec as (select vec_id, i as pos, cast(embedding[i + 1] as double) as v from embeddings cross join range(64) r(i)),
eds as (select vec_id as src, (vec_id + k) % (select count(*) from embeddings) as dst from embeddings cross join (values (1), (2), (3), (4)) o(k))"""


def vector_edges(fx):
    """Each vector's next four by number."""
    n = fx.table("embeddings").count()
    return fx.table("embeddings").select(F.col("vec_id").alias("src"), F.explode(F.expr("sequence(1L, 4L)")).alias("k")).select(
        "src", ((F.col("src") + F.col("k")) % n).alias("dst"))


@query("A12_neighbour_mean", f"""
with {VECTOR_SQL} select z.vec_id, {r6('sum((0.7 * z.v + 0.3 * m) * (z.pos + 1))', 4)} as checksum, {r6('max(0.7 * z.v + 0.3 * m)', 4)} as top from vec z
join (select src, pos, avg(v) as m from eds join vec on dst = vec_id group by 1, 2) n on n.src = z.vec_id and n.pos = z.pos group by 1""")
def a12(fx):
    """Smoothed vectors, checked by a weighted sum and the largest entry."""
    out = cluster.neighbour_mean(fx.table("embeddings"), vector_edges(fx), 0.3, id_col="vec_id", vec="embedding")
    weighted = F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("vec_id", weighted.alias("checksum"), F.array_max("embedding").alias("top")), "checksum", "top", digits=4)


@query("J20_neighbour_gather", f"""
with {VECTOR_SQL} select src as vec_id, dst, {r6('sum(v * (pos + 1))', 4)} as checksum from eds join vec on dst = vec_id group by 1, 2""")
def j20(fx):
    """The neighbours' vectors of every vector."""
    vecs = fx.table("embeddings").select(F.col("vec_id").alias("dst"), F.col("embedding").cast("array<double>").alias("z"))
    out = vector_edges(fx).join(vecs, "dst")
    weighted = F.aggregate(F.transform("z", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select(F.col("src").alias("vec_id"), "dst", weighted.alias("checksum")), "checksum", digits=4)


@query("A13_group_means", sql("scores", f"select {PROVINCE_SQL} as province, {r6('avg(p_a)')} as p_a, {r6('avg(p_b)')} as p_b, {r6('avg(p_std)')} as p_std from fx_scores group by 1"))
def a13(fx):
    cells = fx.scores.withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    return rounded(stats.group_means(cells, "province", ["p_a", "p_b", "p_std"]), "p_a", "p_b", "p_std")


_EDGES10 = [i * 0.1 for i in range(10)] + [1.0]
_BIN_SQL = "case " + " ".join(f"when p_a >= {_EDGES10[i]!r}::double then {i}" for i in range(9, -1, -1)) + " end"
_BINS_SQL = "bins as (select * from (values " + ", ".join(f"({i}, {_EDGES10[i]!r}::double, {_EDGES10[i + 1]!r}::double)" for i in range(10)) + ") v(b, bin_low, bin_high))"


@query("A14_calibration", sql("scores", f"""
select bin_low, bin_high, coalesce(n, 0) as n, {r6('mp')} as mean_pred, {r6('obs')} as obs_freq from bins left join (
 select {_BIN_SQL} as b, count(*) as n, avg(p_a) as mp, avg(label) as obs from fx_scores group by 1) using (b)""", _BINS_SQL))
def a14(fx):
    return rounded(stats.calibration(fx.scores, "p_a", "label"), "mean_pred", "obs_freq")


@query("A14_calibration_summary", sql("scores", f"""
select {r6('sum(sq) / sum(n)')} as brier, {r6('sum(abs(sp - sy)) / sum(n)')} as ece, sum(n)::bigint as n, sum(sy)::bigint as n_pos from (
 select {_BIN_SQL} as b, count(*) as n, sum(p_a) as sp, sum(label) as sy, sum((p_a - label) * (p_a - label)) as sq from fx_scores group by 1)"""))
def a14s(fx):
    return rounded(stats.calibration_summary(fx.scores, "p_a", "label"), "brier", "ece")


@query("A15_score_distribution", sql("scores", f"""
select count(p_a) as n, {r6('avg(p_a)')} as mean, {r6('avg(cast(p_a > 0.1 as double))')} as frac_above_0_1, {r6('avg(cast(p_a > 0.5 as double))')} as frac_above_0_5,
 {r6('median(p_a)')} as median from fx_scores"""))
def a15(fx):
    out = stats.score_distribution(fx.scores, "p_a", [0.1, 0.5])
    return rounded(out, "mean", "median", "frac_above_0_1", "frac_above_0_5")


@query("A16_histogram_density", sql("scores", f"""
select label, {r6('b * 2.0::double')} as bin_low, count(*) as n, {r6('count(*) / (sum(count(*)) over (partition by label) * 2.0)')} as density
from (select label, cast(floor(least(pct, 99.9999) / 2) as integer) as b from (
 select label, 100.0::double * (rank() over (order by p_a) - 1) / count(*) over () as pct from fx_scores)) group by label, b"""))
def a16(fx):
    """Percentiles in 50 bins per label."""
    out = stats.histogram_density(rank.pct_strict(fx.scores, "p_a"), "pct", 0.0, 100.0, 50, by=["label"])
    return rounded(out, "bin_low", "density")


_REPORT = f"""count(*) as n, {r6('sqrt(avg(r * r))')} as rmse, {r6('avg(abs(r))')} as mae, {r6('avg(r)')} as bias,
 {r6('1 - sum(r * r) / (var_pop(observed) * count(*))')} as r2, {r6('100 * avg(cast(abs(r) <= 10 as double))')} as pct_within_10,
 {r6('100 * avg(cast(abs(r) <= 20 as double))')} as pct_within_20, {r6('100 * avg(cast(abs(r) <= 30 as double))')} as pct_within_30,
 {r6('100 * avg(cast(abs(r) <= 50 as double))')} as pct_within_50"""


@query("A17_residual_report", sql("stations", f"select {_REPORT} from (select *, observed - predicted as r from loo)", LOO_SQL))
def a17(fx):
    """Leave-one-out interpolation errors of the whole station table."""
    out = stats.residual_report(stats.idw_loo(fx.stations, id_col="station_id", lat0=LAT0))
    return rounded(out, *[c for c in out.columns if c != "n"])


@query("A19_before_after", sql("scores", f"""
select province, {r6('a')} as score_before, {r6('b')} as score_after, {r6('b - a')} as score_delta from (
 select {PROVINCE_SQL} as province, avg(p_a) as a, avg(p_b) as b from fx_scores group by 1)"""))
def a19(fx):
    cells = fx.scores.withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    a, b = (cells.groupBy("province").agg(F.avg(c).alias("score")) for c in ("p_a", "p_b"))
    return rounded(stats.before_after(a, b, "province", ["score"]), "score_before", "score_after", "score_delta")


@query("A20_fold_positive_counts", sql("scores", f"""
select split, count(*) as n, sum(label)::bigint as n_pos from (select label, case when p in ('Rocky_Mountain', 'Other') then 'train'
 when p in ('Basin_and_Range') then 'test' end as split from (select label, {PROVINCE_SQL} as p from fx_scores)) where split is not null group by 1"""))
def a20(fx):
    cells = fx.scores.withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    return labels.split_counts(labels.transfer_split(cells, ["Rocky_Mountain", "Other"], ["Basin_and_Range"], min_train=10, min_test=5))


@query("A21_share_within", sql("cells faults", f"""
select {r6('100 * avg(cast(fd <= 5 as double))')} as near_line, {r6('100 * avg(cast(vd <= 50 as double))')} as near_volcano
from (select cell_id, min({DIST}) as fd from fx_cells a cross join centres b group by 1) join (select cell_id, min({DIST}) as vd from fx_cells a cross join volc b group by 1) using (cell_id)""",
                               LINES_SQL, CENTRES_SQL, volcano_values()))
def a21(fx):
    lines = tiles.nearest(fx.cells, fault_centres(fx), q_id="cell_id", t_id="fault_id", lat0=LAT0)
    volcanoes = tiles.nearest(fx.cells, tables.dim_table(fx.spark, "volcanoes"), q_id="cell_id", t_id="volcano_id", lat0=LAT0)
    both = lines.select("cell_id", F.col("dist_km").alias("fd")).join(volcanoes.select("cell_id", F.col("dist_km").alias("vd")), "cell_id")
    return rounded(both.agg(stats.share_within(both, "fd", 5).alias("near_line"), stats.share_within(both, "vd", 50).alias("near_volcano")),
                   "near_line", "near_volcano")
