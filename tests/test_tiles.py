import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import cloud, distances, table
from terrascout.functions.portable import rounding
from terrascout.operators import tiles


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("k", [1, 4])
def test_knn_equals_brute_force(spark, hot, k):
    q, t = cloud(300, 1, hot), cloud(700, 2, hot)
    d = distances(q, t)
    got = (tiles.knn(table(spark, q, "qid"), table(spark, t, "tid"), k, q_id="qid", t_id="tid", cap=16)
           .toPandas().sort_values(["qid", "rank"]))
    want = np.lexsort((np.tile(np.arange(700), (300, 1)), d), axis=1)[:, :k]
    assert (got.tid.values.reshape(300, k) == want).all()
    assert np.allclose(got.dist_km.values.reshape(300, k), np.take_along_axis(d, want, 1))


def test_knn_excludes_self_and_respects_limit(spark):
    p = cloud(400, 3, True)
    d = distances(p, p)
    np.fill_diagonal(d, np.inf)
    df = table(spark, p, "a")
    got = tiles.knn(df, df.withColumnRenamed("a", "b"), 3, q_id="a", t_id="b", exclude_self=True, cap=16)
    got = got.toPandas().sort_values(["a", "rank"])
    want = np.lexsort((np.tile(np.arange(400), (400, 1)), d), axis=1)[:, :3]
    assert (got.b.values.reshape(400, 3) == want).all()
    near = tiles.knn(df, df.withColumnRenamed("a", "b"), 3, q_id="a", t_id="b", exclude_self=True, limit_km=9.0)
    assert near.count() == np.minimum((d <= 9.0).sum(1), 3).sum()


def test_knn_of_few_or_no_targets(spark):
    q, t = cloud(20, 4), cloud(2, 5)
    few = tiles.knn(table(spark, q, "qid"), table(spark, t, "tid"), 5, q_id="qid", t_id="tid")
    assert few.count() == 40
    none = tiles.knn(table(spark, q, "qid"), table(spark, t, "tid").limit(0), 5, q_id="qid", t_id="tid")
    assert none.count() == 0 and none.columns == ["qid", "tid", "dist_km", "rank"]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("radius", [7.0, 60.0])
def test_radius_aggregate_equals_brute_force(spark, hot, radius):
    q, t = cloud(300, 6, hot), cloud(700, 7, hot)
    inside = distances(q, t) <= radius
    v = np.arange(700) * 1.0
    got = tiles.radius_aggregate(
        table(spark, q, "qid"), table(spark, t, "tid", v=v), radius,
        {"n": ("count", None), "s": ("sum", "v"), "hi": ("max", "v"), "mean": ("avg", "v")}, q_id="qid", cap=16)
    got = got.toPandas().set_index("qid").sort_index()
    hit = np.flatnonzero(inside.any(1))
    assert (got.index.values == hit).all()
    assert (got.n.values == inside.sum(1)[hit]).all()
    assert np.allclose(got.s.values, (inside @ v)[hit])
    assert (got.hi.values == [v[inside[i]].max() for i in hit]).all()
    assert np.allclose(got["mean"].values, [v[inside[i]].mean() for i in hit])


def test_radius_aggregate_by_target_column(spark):
    q, t = cloud(60, 8, True), cloud(500, 9, True)
    g = np.arange(500) % 3
    got = tiles.radius_aggregate(table(spark, q, "qid"), table(spark, t, "tid", g=g), 40.0,
                                 {"n": ("count", None)}, q_id="qid", t_by=["g"], cap=8).toPandas()
    inside = distances(q, t) <= 40.0
    want = {(i, k): int(inside[i][g == k].sum()) for i in range(60) for k in range(3) if inside[i][g == k].any()}
    assert {(r.qid, r.g): r.n for r in got.itertuples()} == want


def test_within_splits_hot_tiles(spark):
    q, t = cloud(300, 10, True), cloud(700, 11, True)
    pairs = tiles.within(table(spark, q, "qid"), table(spark, t, "tid"), 7.0, q_id="qid", t_id="tid", hot_rows=50)
    d = distances(q, t)
    assert {(r.qid, r.tid) for r in pairs.collect()} == set(zip(*np.nonzero(d <= 7.0)))
    strict = tiles.within(table(spark, q, "qid"), table(spark, q, "tid"), 1e-9, q_id="qid", t_id="tid", strict=True)
    assert strict.filter("dist_km > 0").count() == 0


@pytest.mark.parametrize("radius", [7.0, 60.0])
def test_within_sends_a_query_to_the_tiles_that_its_circle_meets(spark, monkeypatch, radius):
    q, t = cloud(400, 14), cloud(300, 15)
    t[:20], q[:4] = [2 * radius, 4 * radius], [[2 * radius, 3 * radius], [2 * radius, 5 * radius], [radius, 4 * radius], [3 * radius, 4 * radius]]
    sent, salted = [], tiles.salted

    def seen(many, few, *rest):
        sent.append(few.count())
        return salted(many, few, *rest)

    monkeypatch.setattr(tiles, "salted", seen)
    pairs = tiles.within(table(spark, q, "qid"), table(spark, t, "tid"), radius, q_id="qid", t_id="tid")
    assert {(r.qid, r.tid) for r in pairs.collect()} == set(zip(*np.nonzero(distances(q, t) <= radius)))
    assert sent[0] < 4.5 * len(q)


def test_exclude_within_edges(spark):
    t = spark.createDataFrame([(0, 0.0, 0.0)], "tid long, x double, y double")
    q = spark.createDataFrame([(0, 25.0, 0.0), (1, 24.9, 0.0), (2, 25.1, 0.0)], "qid long, x double, y double")
    assert [r.qid for r in tiles.exclude_within(q, t, 25.0, q_id="qid").orderBy("qid").collect()] == [2]
    loose = tiles.exclude_within(q, t, 25.0, q_id="qid", strict=False)
    assert [r.qid for r in loose.orderBy("qid").collect()] == [0, 2]


def test_plans_are_equi_joins(spark):
    q, t = cloud(300, 12), cloud(700, 13)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (tiles.within(table(spark, q, "qid"), table(spark, t, "tid"), 7.0, q_id="qid", t_id="tid"),
                   tiles.knn(table(spark, q, "qid"), table(spark, t, "tid"), 2, q_id="qid", t_id="tid"),
                   tiles.radius_aggregate(table(spark, q, "qid"), table(spark, t, "tid"), 7.0,
                                          {"n": ("count", None)}, q_id="qid")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_are_dealt_by_pairs(spark, monkeypatch):
    q, t = (table(spark, cloud(n, n), k) for n, k in ((400, "qid"), (300, "tid")))
    whole = tiles.within(q, t, 40.0, q_id="qid", t_id="tid")
    counts = tiles.radius_aggregate(q, t, 40.0, {"n": ("count", None)}, q_id="qid")
    monkeypatch.setattr(tiles, "TASK_PAIRS", 500)
    dealt = tiles.within(q, t, 40.0, q_id="qid", t_id="tid")
    fine = tiles.radius_aggregate(q, t, 40.0, {"n": ("count", None)}, q_id="qid")
    for before, after in ((whole, dealt), (counts, fine)):
        plan = after._jdf.queryExecution().toString()
        assert "REPARTITION_BY_NUM" in plan
        assert sorted(before.collect()) == sorted(after.collect())


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    values = [*rng.uniform(-40, 40, 500), *np.round(rng.uniform(0, 40, 500), 3), *((rng.integers(0, 10 ** 6, 300) + 0.5) / 1e6),
              0.0, -0.0, -1e-12, 1e300, -1e300, float("nan"), float("inf"), 123456789012.345678, None]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    for digits in (3, 6, 9):
        wrong = df.filter(~rounding(F.col("v"), digits).eqNullSafe(F.round("v", digits)))
        assert wrong.count() == 0
