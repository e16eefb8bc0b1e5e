"""Queries over ranks, metrics, sorts and set operations (W, L, U, T5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.operators import labels, rank, stats
from terrascout.plans.fixtures import query, r6, rounded, sql
from terrascout.plans.joins import FOLD_SCORES, auc_sql, fold_scores, raster_bounds
from terrascout.plans.sources import PROVINCE_SQL
from terrascout.sources import raster


@query("W1_pct_strict", sql("scores", f"select cell_id, {r6('100.0::double * (rank() over (order by p_a) - 1) / count(*) over ()')} as pct from fx_scores"))
def w1(fx):
    return rounded(rank.pct_strict(fx.scores, "p_a").select("cell_id", "pct"), "pct")


@query("W2_pct_ordinal", sql("scores", f"select cell_id, {r6('100.0::double * (row_number() over (order by p_a, cell_id) - 1) / (count(*) over () - 1)')} as pct from fx_scores"))
def w2(fx):
    return rounded(rank.pct_ordinal(fx.scores, "p_a", "cell_id").select("cell_id", "pct"), "pct")


def _capture_sql(f: float, how: str) -> str:
    return f"sum(case when rn <= greatest(1, {how}(round({f}::double * n, 9))) then label else 0 end) / greatest(sum(label), 1)"


_FRACTIONS = ((0.01, "1"), (0.05, "5"), (0.10, "10"), (0.25, "25"))


@query("W3_capture_at_top", sql("scores", " union all ".join(
    f"select '{how}' as rounding, " + ", ".join(f"{r6(_capture_sql(f, how))} as capture_top_{n}pct" for f, n in _FRACTIONS) +
    " from (select label, row_number() over (order by p_b desc, cell_id) as rn, count(*) over () as n from fx_scores)" for how in ("ceil", "floor"))))
def w3(fx):
    out = None
    for how in ("ceil", "floor"):
        one = rank.capture(fx.scores, "p_b", "label", "cell_id", rounding=how).withColumn("rounding", F.lit(how))
        out = one if out is None else out.unionByName(one)
    return rounded(out, *[c for c in out.columns if c.startswith("capture")])


@query("W4_precision_recall_at_k", sql("scores", f"""
select fold_id, {r6('sum(case when rn <= 50 then label else 0 end) / least(50, count(*))')} as precision_at_k,
 {r6('sum(case when rn <= 50 then label else 0 end) / greatest(sum(label), 1)')} as recall_at_k from (
 select fold_id, label, row_number() over (partition by fold_id order by p_a desc, cell_id) as rn from fs) group by 1""", FOLD_SCORES))
def w4(fx):
    return rounded(rank.precision_recall_at(fold_scores(fx), "p_a", "label", "cell_id", by=["fold_id"]), "precision_at_k", "recall_at_k")


@query("W5_auroc", sql("scores", f"select fold_id, {r6('auroc')} as auroc from {auc_sql('fs', 'p_a', 'fold_id')}", FOLD_SCORES))
def w5(fx):
    return rounded(rank.auroc(fold_scores(fx), "p_a", "label", ["fold_id"]).select("fold_id", "auroc"), "auroc")


CURVE_SQL = """cur as (select fold_id, p_a as score, sum(n) over w as called, sum(p) over w as tp, p, sum(p) over (partition by fold_id) as np from (
 select fold_id, p_a, count(*) as n, sum(label) as p from fs group by 1, 2) window w as (partition by fold_id order by p_a desc)),
pr as (select *, tp / called as prec, tp / np as rec from cur)"""


@query("W6_auprc", sql("scores", f"select fold_id, {r6('sum(p / np * prec)')} as auprc from pr group by 1", FOLD_SCORES, CURVE_SQL))
def w6(fx):
    return rounded(rank.auprc(fold_scores(fx), "p_a", "label", ["fold_id"]), "auprc")


_F1 = "round(2 * prec * rec / (prec + rec + 1e-12), 12)"


@query("W7_best_f1", sql("scores", f"""
select fold_id, {r6('f')} as f1, {r6('score')} as best_threshold from (select fold_id, score, {_F1} as f,
 row_number() over (partition by fold_id order by {_F1} desc, score) as rn from pr) where rn = 1""", FOLD_SCORES, CURVE_SQL))
def w7(fx):
    return rounded(rank.best_f1(fold_scores(fx), "p_a", "label", ["fold_id"]), "f1", "best_threshold")


@query("W7_best_f1_quantiles", sql("scores", f"""
select {r6('f')} as f1, {r6('case when f > 0 then t else 0.5 end')} as best_threshold from (
 select t, round(2 * tp / (k + np), 12) as f, row_number() over (order by round(2 * tp / (k + np), 12) desc, t) as rn from (
  select t, count(*) filter (p_a >= t) as k, sum(label) filter (p_a >= t) as tp, sum(label) as np from (
   select unnest(quantile_cont(p_a, [{', '.join(repr(0.01 + 0.98 * i / 199) for i in range(200))}])) as t from fx_scores) cross join fx_scores group by 1)) where rn = 1"""))
def w7q(fx):
    return rounded(rank.best_f1_at(fx.scores, "p_a", "label"), "f1", "best_threshold")


@query("T5_metric_bundle", sql("scores", f"""
select fold_id, n, np::bigint as n_pos, {r6('auroc')} as auroc, {r6('auprc')} as auprc, {r6('f1')} as f1, {r6('best_threshold')} as best_threshold,
 {r6('precision_at_k')} as precision_at_k, {r6('recall_at_k')} as recall_at_k, {', '.join(f'{r6(f"c{n}")} as capture_top_{n}pct' for _, n in _FRACTIONS)}
from (select fold_id, count(*) as n, sum(label) as np, sum(case when rn <= 50 then label else 0 end) / least(50, count(*)) as precision_at_k,
 sum(case when rn <= 50 then label else 0 end) / sum(label) as recall_at_k, {', '.join(f"{_capture_sql(f, 'ceil')} as c{n}" for f, n in _FRACTIONS)}
 from (select fold_id, label, row_number() over (partition by fold_id order by p_a desc, cell_id) as rn, count(*) over (partition by fold_id) as n from fs) group by 1)
join {auc_sql('fs', 'p_a', 'fold_id')} using (fold_id) join (select fold_id, sum(p / np * prec) as auprc from pr group by 1) using (fold_id)
join (select fold_id, f as f1, score as best_threshold from (select fold_id, score, {_F1} as f,
 row_number() over (partition by fold_id order by {_F1} desc, score) as rn from pr) where rn = 1) using (fold_id)""", FOLD_SCORES, CURVE_SQL))
def t5(fx):
    out = rank.metric_bundle(fold_scores(fx), "p_a", "label", "cell_id", by=["fold_id"])
    return rounded(out, *[c for c in out.columns if c not in ("fold_id", "n", "n_pos")])


_RESOURCE = "res as (select cell_id, p_a * 100 as p50, p_a * 60 as p10, p_a * 210 as p90, PROV as province from fx_scores)".replace("PROV", PROVINCE_SQL)


def resource_rows(fx):
    return fx.scores.select("cell_id", (F.col("p_a") * 100).alias("p50"), (F.col("p_a") * 60).alias("p10"),
                            (F.col("p_a") * 210).alias("p90"), geo.province(F.col("lat"), F.col("lon")).alias("province"))


@query("W8_cumulative_resource", sql("scores", f"""
select cell_id, rn, {r6('sum(p10) over w', 4)} as cum_p10, {r6('sum(p50) over w', 4)} as cum_p50, {r6('sum(p90) over w', 4)} as cum_p90
from (select *, row_number() over (order by p50 desc, cell_id) as rn from res) window w as (order by rn)""", _RESOURCE))
def w8(fx):
    out = rank.running(resource_rows(fx), "p50", "cell_id", ["p10", "p50", "p90"])
    return rounded(out.select("cell_id", "rn", "cum_p10", "cum_p50", "cum_p90"), "cum_p10", "cum_p50", "cum_p90", digits=4)


_PROVINCES = ["Cascades", "Basin_and_Range", "Snake_River_Plain", "Rocky_Mountain", "Other"]


@query("W9_cumulative_by_province", sql("scores", f"""
select rn as rank, g as province, {r6('sum(case when province = g then p50 else 0 end) over (partition by g order by rn)', 4)} as running
from (select *, row_number() over (order by p50 desc, cell_id) as rn from res) cross join (values {', '.join(f"('{p}')" for p in _PROVINCES)}) v(g)""", _RESOURCE))
def w9(fx):
    return rounded(rank.running_by(resource_rows(fx), "p50", "cell_id", "province", "p50", _PROVINCES), "running", digits=4)


@query("W10_first_match", """
select o_custkey as fault_id, o_orderkey as seq, o_orderstatus as status from (
 select *, row_number() over (partition by o_custkey order by o_orderkey) as rn from orders) where rn = 1""")
def w10(fx):
    rows = fx.table("orders").select(F.col("o_custkey").alias("fault_id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return rank.first_match(rows, "fault_id", "seq", ["status"])


def _folded(at: str, n: str) -> str:
    """Index of the pixel that a position mirrors to."""
    m = f"(abs({at}) % greatest(1, 2 * ({n} - 1)))"
    return f"(case when {m} >= {n} then 2 * ({n} - 1) - {m} else {m} end)"


_MIRROR = f"""dims as materialized (select max(prow) + 1 as nr, max(pcol) + 1 as nc from fx_pixels),
rr as materialized (select r0, {_folded('r0 + i', 'nr')} as pr from dims cross join (select distinct prow as r0 from fx_pixels) cross join range(-16, 16) i(i)),
cc as materialized (select c0, {_folded('c0 + j', 'nc')} as pc from dims cross join (select distinct pcol as c0 from fx_pixels) cross join range(-16, 16) j(j)),
win as (select r0, c0, p.value as v from fx_pixels p join rr on p.prow = pr join cc on p.pcol = pc join fx_pixels a on a.prow = r0 and a.pcol = c0)"""


def pixel_cells(fx):
    bounds = raster_bounds(fx)
    return fx.pixels.withColumnsRenamed({"prow": "row", "pcol": "col"}), bounds.ny, bounds.nx


def _nine(got):
    return got.withColumn("mean", F.round("mean", 9))


# Part numbers start at 1, so the corner pixel (0, 0) is missing and the last row holds one pixel only.
# Means of 1024 values of one decimal often lie half way between two numbers of six digits: nine digits first,
# so that the last bits of a sum don't decide.
_STATS = f"{r6('cast(round(cast(avg(v) as decimal(18, 9)), 6) as double)')} as mean, {r6('stddev_pop(v)', 5)} as std, {r6('min(v)')} as min, {r6('max(v)')} as max"


@query("W11_patch_window", sql("pixels", f"select r0 as \"row\", c0 as col, {_STATS} from win group by 1, 2", _MIRROR))
def w11(fx):
    """32 x 32 mirrored patches around every pixel."""
    cells, n_rows, n_cols = pixel_cells(fx)
    got = raster.patch_stats(cells, "value", n_rows, n_cols).select("row", "col", "mean", "std", "min", "max")
    return rounded(rounded(_nine(got), "mean", "min", "max"), "std", digits=5)


@query("R1_patch_stats", sql("pixels", f"""
select r0 as "row", c0 as col, {r6('quantile_cont(v, 0.5)')} as median, {r6('quantile_cont(v, 0.9)')} as p90, {r6('quantile_cont(v, 0.1)')} as p10, {_STATS}
from win group by 1, 2""", _MIRROR))
def r1(fx):
    """Median and deciles beside the frame statistics."""
    cells, n_rows, n_cols = pixel_cells(fx)
    got = raster.patch_stats(cells, "value", n_rows, n_cols).select("row", "col", "mean", "std", "min", "max")
    q = raster.patch_quantiles(cells, "value", n_rows, n_cols, 32, (0.5, 0.9, 0.1), ("median", "p90", "p10"))
    return rounded(rounded(_nine(got).join(q, ["row", "col"]), "mean", "min", "max", "median", "p90", "p10"), "std", digits=5)


@query("R2_patch_mean", sql("pixels", f"select r0 as \"row\", c0 as col, {r6('cast(round(cast(avg(v) as decimal(18, 9)), 6) as double)')} as mean from win group by 1, 2", _MIRROR))
def r2(fx):
    cells, n_rows, n_cols = pixel_cells(fx)
    return rounded(_nine(raster.patch_stats(cells, "value", n_rows, n_cols).select("row", "col", "mean")), "mean")


@query("R3_patch_centre", sql("pixels", f"select prow as \"row\", pcol as col, {r6('value')} as centre from fx_pixels"))
def r3(fx):
    cells, *_ = pixel_cells(fx)
    return rounded(raster.patch_centre(cells, "value"), "centre")


@query("R4_valid_fraction", sql("pixels", f"""
select r0 as "row", c0 as col, count(g) / count(*)::double > 0.5 as covered, {r6('case when count(g) / count(*)::double > 0.5 then cast(round(cast(avg(g) as decimal(18, 9)), 6) as double) end')} as mean
from (select *, case when v > 10 then v end as g from win) group by 1, 2""", _MIRROR))
def r4(fx):
    """Patches more than half valid when low pixels count as missing."""
    cells, n_rows, n_cols = pixel_cells(fx)
    holey = cells.withColumn("value", F.when(F.col("value") > 10, F.col("value")))
    return rounded(_nine(raster.valid_patch(holey, "value", n_rows, n_cols).select("row", "col", "covered", "mean")), "mean")


@query("W12_holm", sql("scores", f"""
select cell_id, {r6('least(1, max(p * (m - rn + 1)) over (order by rn))')} as p_holm from (
 select cell_id, p, row_number() over (order by p, cell_id) as rn, count(*) over () as m from (select cell_id, p_b * p_b * p_b / 1000 as p from fx_scores))"""))
def w12(fx):
    tests = fx.scores.select("cell_id", (F.col("p_b") * F.col("p_b") * F.col("p_b") / 1000).alias("p"))
    return rounded(rank.holm(tests, "p", "cell_id").select("cell_id", "p_holm"), "p_holm")


@query("L1_order_report", sql("scores", f"""
select province, mean, row_number() over (order by mean desc, province) as place from (select {PROVINCE_SQL} as province, {r6('avg(p_a)')} as mean from fx_scores group by 1)"""))
def l1(fx):
    """A report per province, best first; its place shows the order."""
    cells = fx.scores.withColumn("province", geo.province(F.col("lat"), F.col("lon")))
    report = rounded(stats.group_means(cells, "province", ["p_a"]).withColumnRenamed("p_a", "mean"), "mean")
    ordered = rank.cumulate(report, "mean", "province", desc=True)
    return ordered.select("province", "mean", F.col("rn").cast("bigint").alias("place")).orderBy("place")


@query("L2_top_n", sql("scores", f"select * from (select cell_id, {r6('p_a')} as p_a, cast(row_number() over (order by p_a desc, cell_id) as integer) as rank from fx_scores) where rank <= 10"))
def l2(fx):
    """The ten best cells, a report of fixed length."""
    return rounded(rank.top_n(fx.scores.select("cell_id", "p_a"), "p_a", "cell_id", 10), "p_a")


@query("L3_top_n_per_group", sql("scores", f"""
select fold_id, arg_max(m, auroc) as model, {r6('max(auroc)')} as auroc from (select 'a' as m, * from {auc_sql('fs', 'p_a', 'fold_id')}
 union all select 'b', * from {auc_sql('fs', 'p_b', 'fold_id')}) group by 1""", FOLD_SCORES))
def l3(fx):
    """The better model of every fold."""
    a, b = (rank.auroc(fold_scores(fx), f"p_{m}", "label", ["fold_id"]).withColumn("model", F.lit(m)) for m in ("a", "b"))
    out = a.unionByName(b).groupBy("fold_id").agg(F.max_by("model", "auroc").alias("model"), F.max("auroc").alias("auroc"))
    return rounded(out, "auroc")


@query("U1_union_sites", sql("sites cells", """
select 's' || site_id as name, round(lat, 3) + 0.0 as lat from fx_sites where lat between 31 and 49
union all select 'c' || cell_id, round(lat, 3) + 0.0 from fx_cells where bal > 0 and lat between 31 and 49"""))
def u1(fx):
    """Two site lists, one with missing places."""
    a = fx.sites.select(F.concat(F.lit("s"), "site_id").alias("name"), "lat", "lon")
    b = fx.cells.select(F.concat(F.lit("c"), "cell_id").alias("name"), F.when(F.col("bal") > 0, F.col("lat")).alias("lat"), "lon")
    return rounded(labels.union_sites([a, b]).select("name", "lat"), "lat", digits=3)


@query("U2_iou_top", sql("scores", f"""
select count(*) filter (a and b) as n_both, count(*) filter (a or b) as n_either, {r6('count(*) filter (a and b) / count(*) filter (a or b)')} as iou from (
 select row_number() over (order by p_a desc, cell_id) <= greatest(1, floor(round(0.05::double * count(*) over (), 9))) as a,
 row_number() over (order by p_b desc, cell_id) <= greatest(1, floor(round(0.05::double * count(*) over (), 9))) as b from fx_scores)"""))
def u2(fx):
    return rounded(rank.iou_top(fx.scores, "p_a", "p_b", "cell_id", 0.05), "iou")


@query("U3_set_minus", sql("scores", """
select cell_id from fx_scores where label = 1 or p_b > 0.5 except select cell_id from (
 select cell_id from fx_scores where label = 0 and p_b > 0.5 order by cell_id limit (select least(2000, count(*) // 10) from fx_scores where label = 1 or p_b > 0.5))"""))
def u3(fx):
    """Training cells without the validation cells: the first min(2000, n/10) negatives."""
    train = fx.scores.filter("label = 1 or p_b > 0.5").select("cell_id", "label")
    take = min(2000, train.count() // 10)
    val = train.filter("label = 0").orderBy("cell_id").limit(take).select("cell_id")
    return train.select("cell_id").join(val, "cell_id", "left_anti")


@query("U4_distinct_union", sql("scores", "select cell_id from fx_scores where label = 1 union select cell_id from fx_scores where p_b > 0.5"))
def u4(fx):
    return fx.scores.filter("label = 1").select("cell_id").union(fx.scores.filter("p_b > 0.5").select("cell_id")).distinct()
