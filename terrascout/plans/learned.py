"""Queries over fitted models (ML, T4, ST1)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from terrascout.functions.portable import permuted_sql, uniform, uniform_sql
from terrascout.operators import labels, models, rank
from terrascout.plans.fixtures import TABLES, query, r6, rounded, sql
from terrascout.session import scratch_path
from terrascout.streaming import jobs
from terrascout.session import cut

COLS = ["f_score", "f_other", "f_std", "f_lat", "f_lon"]


def learning_cells(fx):
    """Scored cells whose label follows two of the features with some noise."""
    noise = uniform(F.col("cell_id"), 7) * 0.3
    return fx.scores.select(
        "cell_id", F.col("p_a").alias("f_score"), F.col("p_b").alias("f_other"), F.col("p_std").alias("f_std"),
        F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"),
        (F.col("p_a") + 0.5 * F.col("p_b") + noise > 0.75).cast("int").alias("label"))


def _metrics(fx, fit):
    """Fit on the training rows of a stratified split, score all, report the test rows."""
    cells = labels.random_split(learning_cells(fx), id_col="cell_id", by=["label"])
    model = fit(cells.filter("split = 'train'"), COLS)
    scored = model.score(cells)
    return rank.metric_bundle(scored.filter("split = 'test'"), "score", "label", "cell_id")


@query("ML1_rule_score", sql("scores", f"select cell_id, {r6('p_a')} as score from fx_scores"))
def ml1(fx):
    return rounded(models.rule_score(fx.scores, "p_a").select("cell_id", "score"), "score")


@query("ML2_logreg")
def ml2(fx):
    return _metrics(fx, models.fit_logreg)


@query("ML3_forest")
def ml3(fx):
    return _metrics(fx, partial(models.fit_forest, trees=20, depth=8))


@query("ML4_boosted")
def ml4(fx):
    return _metrics(fx, partial(models.fit_boosted, trees=10, depth=4))


@query("ML5_flat_mlp")
def ml5(fx):
    return _metrics(fx, partial(models.fit_mlp, hidden=(16, 16, 8), iterations=40))


@query("ML6_ensemble_score")
def ml6(fx):
    """Mean and spread of five bootstrap members for every cell."""
    cells = learning_cells(fx)
    members = models.fit_ensemble(cells, COLS, members=5)
    return models.score_with_uncertainty(cells, members).select("cell_id", "p_mean", "p_std")


@query("ML7_score_all")
def ml7(fx):
    cells = learning_cells(fx)
    return models.fit_logreg(cells, COLS).score(cells).select("cell_id", "score")


_RIDGE = 1e-3
# Newton's method on the same 25 models: three coefficients each, the step by Cramer's rule.
_ML8_STEP = """select h, it + 1,
 b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
 b1 - (h00 * (g1 * h22 - g2 * h12) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
 b2 - (h00 * (h11 * g2 - h12 * g1) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det from (
 select *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) as det from (
 select h, any_value(it) as it, any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2,
  sum(w * (p - y)) as g0, sum(w * (p - y) * z1) + any_value(e1 * b1) as g1, sum(w * (p - y) * z2) + any_value(e2 * b2) as g2,
  sum(w * v) as h00, sum(w * v * z1) as h01, sum(w * v * z2) as h02, sum(w * v * z1 * z1) + any_value(e1) as h11,
  sum(w * v * z1 * z2) as h12, sum(w * v * z2 * z2) + any_value(e2) as h22 from (
  select s.*, r.y, r.z1, r.z2, m.e1, m.e2, case when y = 1 then 0.5 / m.n1 else 0.5 / m.n0 end as w,
   1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) as p, exp(-(b0 + b1 * z1 + b2 * z2)) / pow(1 + exp(-(b0 + b1 * z1 + b2 * z2)), 2) as v
  from newton s join md m on m.h = s.h join r on not (r.y = 1 and r.id = s.h) where s.it < 25) group by h))"""


@query("ML8_leave_one_site_out", sql("rings cells", f"""
select f.h as poly_id, {r6('1 / (1 + exp(-f.z))')} as held_out_score, {r6('100.0 * avg(case when f.b0 + f.b1 * r.z1 + f.b2 * r.z2 < f.z - 1e-9 then 1 else 0 end)')} as percentile_vs_neg
from (select n.h, b0, b1, b2, b0 + b1 * z1 + b2 * z2 as z from newton n join r on r.y = 1 and r.id = n.h where it = 25) f join r on r.y = 0
group by f.h, f.z""",
                                     """raw as (select poly_id as id, 1 as y, avg(lat) as a, avg(lon) as b from fx_rings group by 1
 union all select cell_id + 1000, 0, lat, lon from fx_cells)""",
                                     "st as (select avg(a) as ma, avg(b) as mb, stddev_pop(a) as sa, stddev_pop(b) as sb from raw)",
                                     "r as (select id, y, (a - ma) / sa as z1, (b - mb) / sb as z2 from raw, st)",
                                     f"""md as (select r.id as h, count(*) filter (o.y = 1) as n1, count(*) filter (o.y = 0) as n0,
 {_RIDGE}::double * var_samp(o.z1) as e1, {_RIDGE}::double * var_samp(o.z2) as e2 from r join r o on not (o.y = 1 and o.id = r.id) where r.y = 1 group by 1)""",
                                     f"newton(h, it, b0, b1, b2) as (select h, 0, 0.0::double, 0.0::double, 0.0::double from md union all {_ML8_STEP})"))
def ml8(fx):
    """Polygon centres as positives against all cells."""
    centres = fx.rings.groupBy("poly_id").agg(F.avg("lat").alias("f_lat"), F.avg("lon").alias("f_lon"))
    cells = fx.cells.select((F.col("cell_id") + 1000).alias("poly_id"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    found = models.leave_one_site_out(centres, cells, ["f_lat", "f_lon"], id_col="poly_id", reg=_RIDGE)
    return rounded(found.select("poly_id", "held_out_score", "percentile_vs_neg"), "held_out_score", "percentile_vs_neg")


@query("ML9_sweep")
def ml9(fx):
    """Negative ratios, and one feature group left out, one metrics row each."""
    cells = cut(labels.random_split(learning_cells(fx), id_col="cell_id", by=["label"]).withColumn("province", F.floor("f_lat").cast("string")))
    train, test = cells.filter("split = 'train'"), cells.filter("split = 'test'")
    n_pos = train.filter("label = 1").count()

    def run(df, ratio=None, cols=COLS):
        if ratio:
            negatives = labels.stratified_negatives(df.filter("label = 0"), n_pos, ratio)
            df = df.filter("label = 1").unionByName(negatives.select(*df.columns))
        model = models.fit_logreg(df, cols)
        return rank.metric_bundle(model.score(test), "score", "label", "cell_id")

    return models.sweep(train, {"ratio_1": {"ratio": 1}, "ratio_5": {"ratio": 5}, "no_place": {"cols": COLS[:3]}, "no_score": {"cols": COLS[1:]}}, run)


@query("T4_permutation_importance")
def t4(fx):
    cells = learning_cells(fx)
    model = models.fit_logreg(cells, COLS)
    groups = {"scores": ["f_score", "f_other"], "spread": ["f_std"], "place": ["f_lat", "f_lon"]}
    return models.permutation_importance(model, cells, groups, id_col="cell_id")


_T4_GROUPS = {"scores": ["f_score", "f_other"], "spread": ["f_std"], "place": ["f_lat", "f_lon"]}
_T4_RULE = models.LinearModel(["f_score", "f_other", "f_std"], [1.0, 0.5, 0.25])


def _t4_sql() -> str:
    """The published rule's AUROC with the same donors, walked to ranks below n."""
    runs = [(name, cols, r, 43 + g * 3 + r) for g, (name, cols) in enumerate(_T4_GROUPS.items()) for r in range(3)]
    u = uniform_sql("cell_id", 42)
    noise = f"{uniform_sql('cell_id', 7)} * 0.3"
    base = f"""lc as (select cell_id, p_a as f_score, p_b as f_other, p_std as f_std, lat as f_lat, lon as f_lon,
 case when p_a + 0.5 * p_b + {noise} > 0.75 then 1 else 0 end as label, row_number() over (order by {u}, cell_id) - 1 as rn from fx_scores)"""
    size = "sz as (select n, a, (n + a - 1) // a as b from (select count(*) as n, greatest(2, cast(floor(sqrt(count(*) - 1)) as bigint) + 1) as a from lc))"
    start = " union all ".join(f"select rn, {k} as seed, {permuted_sql('rn', 'a', 'b', k)} as m from lc, sz" for *_, k in runs)
    again = "case seed " + " ".join(f"when {k} then {permuted_sql('m', 'a', 'b', k)}" for *_, k in runs) + " end"
    walk = f"walk as ({start} union all select rn, seed, {again} from walk, sz where m >= n)"

    def run(name: str, cols: list, r: int, k: int) -> str:
        x = {c: f"d.{c}" if c in cols else f"o.{c}" for c in ("f_score", "f_other", "f_std")}
        return (f"select '{name}' as g, {r} as rep, o.label, 0.0 + 1.0 * coalesce({x['f_score']}, 0.0) + 0.5 * coalesce({x['f_other']}, 0.0) + 0.25 * coalesce({x['f_std']}, 0.0) as s "
                f"from lc o join walk w on w.rn = o.rn and w.seed = {k} and w.m < (select n from sz) join lc d on d.rn = w.m")

    every = "runs as (select '' as g, -1 as rep, label, 0.0 + 1.0 * f_score + 0.5 * f_other + 0.25 * f_std as s from lc union all " + \
        " union all ".join(run(*x) for x in runs) + ")"
    auc = """auc as (select g, rep, (sum(case when label = 1 then rk end) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) as auc from (
 select g, rep, label, rank() over (partition by g, rep order by s) + (count(*) over (partition by g, rep, s) - 1) / 2.0 as rk from runs) group by 1, 2)"""
    body = f"""select g as feature_group, {r6('avg(d)')} as drop_mean, {r6('stddev_pop(d)')} as drop_std, count(*) as repeats from (
 select g, (select auc from auc where rep = -1) - auc as d from auc where rep >= 0) group by 1"""
    return sql("scores", body, base, size, walk, every, auc)


@query("T4_permutation_published", _t4_sql())
def t4_published(fx):
    """The same over a published rule, which SQL can score as well."""
    found = models.permutation_importance(_T4_RULE, learning_cells(fx), _T4_GROUPS, id_col="cell_id")
    return rounded(found, "drop_mean", "drop_std")


@query("ST1_score_in_batches")
def st1(fx):
    """The event table scored as a stream by a model fitted on the table."""
    model = models.fit_logreg(learning_cells(fx), COLS)
    reader = fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.folder}/events*.parquet")
    rows = reader.selectExpr(*[f"{e} as {c}" for c, e in TABLES["scores"][1].items()]).select(
        "cell_id", F.col("p_a").alias("f_score"), F.col("p_b").alias("f_other"), F.col("p_std").alias("f_std"),
        F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    scored = jobs.score_stream(rows, model).select("cell_id", "score")
    out = scratch_path(fx.spark, "st1")
    jobs.run_to_table(scored, out, scratch_path(fx.spark, "st1-state"))
    return fx.spark.read.schema(scored.schema).parquet(out)
