import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrascout.functions.portable import low_halves, permuted, permuted_sql, uniform, uniforms
from terrascout.operators import labels, manifest, models, rank, stats
from terrascout.streaming import jobs


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["cell_id"], pdf["label"] = range(600), (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=600) * 0.5 > 0.8).astype(int)
    return spark.createDataFrame(pdf).cache()


COLS = ["a", "b", "c"]


def test_every_model_learns(cells):
    # A much narrower perceptron can stay in a poor optimum for some seeds.
    fits = [models.fit_logreg, lambda d, c: models.fit_forest(d, c, trees=10, depth=5),
            lambda d, c: models.fit_boosted(d, c, trees=5, depth=3), lambda d, c: models.fit_mlp(d, c, hidden=(16, 16, 8))]
    for fit in fits:
        scored = fit(cells, COLS).score(cells)
        assert rank.auroc(scored, "score", "label").first().auroc > 0.8
        low, high = scored.agg(F.min("score"), F.max("score")).first()
        assert 0 <= low <= high <= 1


def test_ensemble_repeats_with_its_seed(cells):
    def run(seed):
        members = models.fit_ensemble(cells, COLS, members=3, seed=seed)
        return models.score_with_uncertainty(cells, members).orderBy("cell_id").select("p_mean", "p_std").toPandas()

    a, b, c = run(1), run(1), run(2)
    assert np.allclose(a, b, atol=1e-9) and not np.allclose(a, c, atol=1e-9)
    assert (a.p_std >= 0).all() and a.p_std.max() > 0


def test_permutation_importance_finds_the_feature(cells):
    model = models.fit_logreg(cells, COLS)
    got = models.permutation_importance(model, cells, {"main": ["a"], "noise": ["c"]}, id_col="cell_id", repeats=2)
    drop = {r.feature_group: r.drop_mean for r in got.collect()}
    assert drop["main"] > 0.1 > abs(drop["noise"])


def test_bootstrap_interval_holds_the_estimate(cells):
    scored = cells.withColumn("s", F.col("a"))
    point = rank.auroc(scored, "s", "label").first().auroc
    row = stats.bootstrap_auroc(scored, "s", "label", "cell_id", rounds=60).first()
    assert row.ci_low < point < row.ci_high and abs(row["mean"] - point) < 0.02 and row.ci_high - row.ci_low < 0.15


def drawn(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16.0 ** 13


def test_bootstrap_equals_brute_force(spark):
    """Scores that lie in several ranges, one that a third of all rows share, NaN, and rows without a score."""
    rng, rounds = np.random.default_rng(6), 12
    rows = [(i, 0.5 if i % 3 == 0 else float("nan") if i % 29 == 0 else float(rng.integers(40)) / 40, int(rng.random() < 0.3)) for i in range(700)]
    df = spark.createDataFrame([*rows, (9000, None, 1)], "id long, s double, y int")
    got = stats.bootstrap_auroc(df, "s", "y", "id", rounds=rounds).first()
    steps, values = stats.poisson_steps(12), []
    s = np.array([2.0 if np.isnan(r[1]) else r[1] for r in rows])
    y = np.array([r[2] for r in rows])
    for r in range(1, rounds + 1):
        w = np.array([sum(drawn(f"{i}/{r}:42") >= x for x in steps) for i, _, _ in rows], float)
        pos, neg = w * y, w * (1 - y)
        won = sum(pos[k] * (neg[s < s[k]].sum() + neg[s == s[k]].sum() / 2) for k in range(len(rows)))
        values.append(won / (pos.sum() * neg.sum()))
    assert got.rounds == rounds and abs(got["mean"] - np.mean(values)) < 1e-9
    assert abs(got.ci_low - np.quantile(values, 0.025)) < 1e-9 and abs(got.ci_high - np.quantile(values, 0.975)) < 1e-9
    assert stats.bootstrap_auroc(df.limit(0), "s", "y", "id", rounds=3).first().rounds == 0
    assert stats.bootstrap_auroc(df.withColumn("y", F.lit(1)), "s", "y", "id", rounds=3).first().rounds == 0


def test_sign_flips_equal_brute_force(spark):
    rng, rounds = np.random.default_rng(7), 60
    rows = [(i, None if i % 4 == 0 else i % 3, float(rng.normal(0.2)), float(rng.normal())) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, 1, None, 1.0)], "id long, g int, a double, b double")

    def p(some):
        t = [abs(sum((a - b) * (1 if r and drawn(f"{i}:{r + 42}") < 0.5 else -1 if r else 1) for i, _, a, b in some)) for r in range(rounds + 1)]
        return (sum(x >= t[0] - 1e-12 for x in t[1:]) + 1) / (rounds + 1)

    got = {r.g: r.p_value for r in stats.sign_flip_p(df, "a", "b", "id", by=["g"], rounds=rounds).collect()}
    assert got == {g: p([r for r in rows if r[1] == g]) for g in (None, 0, 1, 2)}
    assert stats.sign_flip_p(df, "a", "b", "id", rounds=rounds).first().p_value == p(rows)
    assert stats.sign_flip_p(df.limit(0), "a", "b", "id", by=["g"], rounds=5).count() == 0


def test_low_halves_are_those_of_uniform(spark):
    ids = ["0", "17", "é5", "", "x" * 51, "y" * 52, "z" * 200, *map(str, range(95, 105))]
    seeds = [-3, 7, 99, 100, 1041]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    want = df.select("id", *[(uniform(F.col("id"), k) < 0.5).alias(f"s{k}") for k in seeds]).collect()
    assert low_halves([r.id for r in want], seeds).tolist() == [list(r[1:]) for r in want]
    assert not low_halves([None], seeds).any()


def test_uniforms_are_those_of_uniform(spark):
    ids = [0, 9, 10, 99, 100, 12345, 999_999, 1_000_000, 10 ** 12 + 7, 10 ** 17]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    for seed in (0, 4321):
        assert uniforms(np.array(ids), seed).tolist() == [r.u for r in df.select(uniform(F.col("id"), seed).alias("u")).collect()]
    got = spark.createDataFrame([(0,), (None,), (2,)], "i long").select(permuted(F.col("i"), 3, 5).alias("p")).collect()
    assert got[1].p is None and {got[0].p, got[2].p} < {0, 1, 2}


def test_mann_whitney_without_spread(spark):
    def p(rows):
        df = spark.createDataFrame(rows, "v double, g int")
        return stats.mann_whitney(df, "v", "g", 1).first()

    one_sided = p([(1.0, 1), (2.0, 1), (2.0, 1)])
    assert one_sided.p == 1 and (one_sided.n_first, one_sided.n_other, one_sided.u) == (3, 0, 0)
    assert one_sided.median_first == 2 and one_sided.median_other is None
    assert p([(1.0, 0), (1.0, 1), (1.0, 1)]).p == 1
    assert np.isnan(p([(1.0, 1)]).p)


def test_far_low_negatives_end_where_places_run_out(spark):
    box = dict(box=(0.0, 2.0, 0.0, 2.0), lat0=0.0, seed=3)
    stations = spark.createDataFrame([(0, 1.0, 1.0, 20.0)], "station_id long, lat double, lon double, hf double")
    sites = spark.createDataFrame([(0, 0.0, 0.0)], "site_id long, lat double, lon double")
    found = [r.point_id for r in labels.far_low_negatives(spark, sites, stations, 50, places=30, **box).collect()]
    assert 0 < len(found) <= 30 and max(found) < 30


def test_splits_are_whole_disjoint_and_seeded(cells):
    a = labels.random_split(cells.select("cell_id"), id_col="cell_id", seed=1)
    sizes = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"train": 420, "val": 90, "test": 90}
    again = labels.random_split(cells.select("cell_id").repartition(5), id_col="cell_id", seed=1)
    assert a.exceptAll(again).count() == 0
    other = labels.random_split(cells.select("cell_id"), id_col="cell_id", seed=2)
    assert a.exceptAll(other).count() > 100


def test_folds_hold_out_clusters(cells):
    rows = cells.select("cell_id", "label", F.when(F.col("label") == 1, F.col("cell_id") % 4).alias("cluster"))
    tests = labels.group_folds(rows, max_neg=20).cache()
    n_pos = rows.filter("label = 1").count()
    assert tests.filter("label = 1").count() == n_pos
    assert {r["count"] for r in tests.filter("label = 0").groupBy("fold_id").count().collect()} == {20}
    assert tests.count() == tests.distinct().count()
    roles = labels.fold_roles(tests, rows, 0).groupBy("role").count().collect()
    assert sum(r["count"] for r in roles) == 600


def test_stratified_negatives_fill_the_target(spark):
    pool = spark.createDataFrame([(i, "A" if i < 900 else "B" if i < 999 else "C") for i in range(1000)], "cell_id long, province string")
    got = labels.stratified_negatives(pool, 20, 5).groupBy("province").count().collect()
    assert {r.province: r["count"] for r in got} == {"A": 90, "B": 9, "C": 1}


def test_manifest_hash_notices_any_change(spark):
    df = spark.createDataFrame([(i, i * 0.25, "x") for i in range(100)], "id long, v double, t string")
    cols = ["id", "v", "t"]
    base = manifest.table_hash(df, cols, "id", 7).first()
    assert base == manifest.table_hash(df.repartition(5).orderBy(F.rand(1)), cols, "id", 7).first()
    changed = df.withColumn("v", F.when(F.col("id") == 50, 0.0).otherwise(F.col("v")))
    assert manifest.table_hash(changed, cols, "id", 7).first().sha256 != base.sha256
    assert manifest.verify(df, "no", cols, "id").first().matches is False


def test_stream_scores_like_the_table(spark, cells, tmp_path):
    model = models.fit_logreg(cells, COLS)
    source = str(tmp_path / "in")
    cells.write.parquet(source)
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.run_to_table(jobs.score_stream(stream, model).select("cell_id", "score"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("cell_id").toPandas()
    want = model.score(cells).orderBy("cell_id").select("cell_id", "score").toPandas()
    assert len(got) == 600 and np.allclose(got.score, want.score)


@pytest.mark.parametrize("turn", [1, -1])
def test_outcomes_stream_counts_late_and_repeated_results_once(spark, tmp_path, turn):
    sites = spark.createDataFrame([(1, 40.0, -117.0), (2, 45.0, -110.0)], "site_id long, lat double, lon double")
    rows = [(1, "2024-02-01 00:00:00", "success", 40.1, -117.0), (1, "2024-02-01 00:00:00", "success", 40.1, -117.0),
            (2, "2024-02-02 00:00:00", "dry", 45.1, -110.0), (3, "2024-02-02 00:00:00", "dry", 45.01, -110.0),
            (4, "2023-01-01 00:00:00", "success", 40.0, -117.0), (5, "2024-02-03 00:00:00", "other", 40.0, -117.0),
            # An earlier result comes long after a later one of the same id; it counts.
            (6, "2025-01-01 00:00:00", "success", 45.0, -110.0), (6, "2024-03-01 00:00:00", "dry", 40.0, -117.0),
            (7, "2024-03-01 00:00:00", "success", 0.0, 0.0), (7, "2024-04-01 00:00:00", "success", 40.0, -117.0)]
    df = spark.createDataFrame(rows, "outcome_id long, ts string, outcome string, lat double, lon double").withColumn("ts", F.to_timestamp("ts"))
    for n, row in enumerate(rows[::turn] + rows[:3]):  # repeats come in later batches as well
        part = df.filter((F.col("outcome_id") == row[0]) & (F.col("ts") == F.lit(row[1]).cast("timestamp")))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a second run finds nothing new
        jobs.monitor(stream, sites, "2024-01-01 00:00:00", out, str(tmp_path / "state"), lat0=40.0)
    got = sorted(tuple(r) for r in jobs.monitored(spark, out).collect())
    batch = sorted(tuple(r) for r in jobs.outcomes(df, sites, "2024-01-01 00:00:00", lat0=40.0).collect())
    assert got == batch
    assert [(r[0], r[1], r[3]) for r in got] == [(1, 1, "verified"), (3, 2, "falsified"), (6, 1, "falsified")]


def test_leave_one_out_equals_refitting(spark):
    rng = np.random.default_rng(12)
    pos = pd.DataFrame(rng.normal(1.0, 1.0, (9, 3)), columns=COLS).assign(site=[f"s{i % 8}" for i in range(9)])
    neg = pd.DataFrame(rng.normal(0.0, 2.0, (400, 3)), columns=COLS).assign(site=[f"s{i}" for i in range(400)])
    neg.loc[3, "a"] = None
    positives, negatives = spark.createDataFrame(pos), spark.createDataFrame(neg)
    got = {r.site: r for r in models.leave_one_site_out(positives, negatives, COLS, id_col="site").collect()}
    assert sorted(got) == sorted(set(pos.site))
    for held in ("s0", "s5"):  # s0 has two rows
        rest = positives.filter(F.col("site") != held).withColumn("label", F.lit(1)).unionByName(negatives.withColumn("label", F.lit(0)))
        model = models.fit_logreg(rest, COLS)
        top = model.score(positives.filter(F.col("site") == held)).agg(F.max("score")).first()[0]
        assert np.isclose(got[held].held_out_score, top, atol=1e-5)
        share = model.score(negatives).agg(F.avg((F.col("score") < top).cast("double"))).first()[0]
        assert np.isclose(got[held].percentile_vs_neg, 100 * share, atol=0.3)
        published = models.LinearModel(COLS, got[held].weights, got[held].intercept).score(negatives).agg(F.max("score")).first()[0]
        assert np.isclose(1 / (1 + np.exp(-published)), model.score(negatives).agg(F.max("score")).first()[0], atol=1e-5)


@pytest.mark.parametrize("n", [1, 2, 3, 11, 400])
def test_permuted_is_a_bijection_that_sql_repeats(spark, n):
    import duckdb

    got = {}
    for seed in (3, 4):
        got[seed] = {r.id: r.m for r in spark.range(n).select("id", permuted(F.col("id"), n, seed).alias("m")).collect()}
        assert sorted(got[seed].values()) == list(range(n))
        a = max(2, int((n - 1) ** 0.5) + 1)
        b = -(-n // a)
        first, again = permuted_sql("i", str(a), str(b), seed), permuted_sql("m", str(a), str(b), seed)
        rows = duckdb.sql(f"""with recursive w as (select i, {first} as m from range({n}) r(i)
            union all select i, {again} from w where m >= {n}) select i, m from w where m < {n}""").fetchall()
        assert dict(rows) == got[seed]
    assert n < 11 or got[3] != got[4]
