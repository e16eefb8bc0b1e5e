import os

import numpy as np
import pandas as pd
import pytest

from helpers import as_degrees, cloud, distances, table
from terrascout.operators import cluster, joins
from terrascout.session import cut, steps


def sequential_dbscan(xy, eps, least):
    near = distances(xy, xy) <= eps
    core = near.sum(1) >= least
    label = -np.ones(len(xy), int)
    current = 0
    for i in range(len(xy)):
        if core[i] and label[i] < 0:
            label[i], todo = current, [i]
            while todo:
                u = todo.pop()
                for v in np.flatnonzero(near[u] & core & (label < 0)):
                    label[v] = current
                    todo.append(v)
            current += 1
    for i in np.flatnonzero(~core):
        around = label[near[i] & core]
        if len(around):
            label[i] = around.min()
    return label


@pytest.mark.parametrize("hot,eps,least", [(False, 14.0, 3), (True, 15.0, 4)])
def test_dbscan_equals_sequential(spark, hot, eps, least):
    xy = cloud(700, 20, hot)
    got = cluster.dbscan(as_degrees(table(spark, xy, "pid"), "pid"), eps, least, id_col="pid", lat0=0.0, cap=8)
    assert (got.toPandas().sort_values("pid").cluster.values == sequential_dbscan(xy, eps, least)).all()


def test_dbscan_of_too_few_points_is_noise(spark):
    got = cluster.dbscan(as_degrees(table(spark, np.zeros((2, 2)), "pid"), "pid"), 15.0, 3, id_col="pid", lat0=0.0)
    assert [r.cluster for r in got.collect()] == [-1, -1]


def test_dedupe_equals_sequential(spark):
    xy = np.vstack([cloud(300, 21, True), np.column_stack([np.arange(12) * 4.0, np.full(12, 900.0)])])
    d = distances(xy, xy)
    keep = np.ones(len(xy), bool)
    for i in range(len(xy)):
        if keep[i]:
            close = np.flatnonzero(d[i] <= 5.0)
            keep[close[close > i]] = False
    got = cluster.dedupe_sites(as_degrees(table(spark, xy, "pid"), "pid"), 5.0, order_col="pid", lat0=0.0)
    assert sorted(r.pid for r in got.collect()) == np.flatnonzero(keep).tolist()


@pytest.mark.parametrize("tile_rows", [4, 20_000])
def test_dedupe_in_small_tiles_equals_sequential(spark, tile_rows):
    rng = np.random.default_rng(8)
    xy = np.vstack([cloud(250, 22, True), np.column_stack([-np.arange(40) * 4.0, np.full(40, 900.0)]), rng.uniform(0, 40, (60, 2))])
    xy = xy[rng.permutation(len(xy))]
    d = distances(xy, xy)
    keep = np.ones(len(xy), bool)
    for i in range(len(xy)):
        if keep[i]:
            close = np.flatnonzero(d[i] <= 5.0)
            keep[close[close > i]] = False
    got = cluster.dedupe_sites(as_degrees(table(spark, xy, "pid"), "pid"), 5.0, order_col="pid", lat0=0.0, tile_rows=tile_rows)
    assert sorted(r.pid for r in got.collect()) == np.flatnonzero(keep).tolist()


def test_dedupe_of_a_long_chain_takes_few_passes(spark, monkeypatch):
    passes = []
    one = cluster._tile_pass
    monkeypatch.setattr(cluster, "_tile_pass", lambda *a: passes.append(1) or one(*a))
    line = spark.range(20_000).selectExpr("id as pid", "0.0D as lat", "id * 4.0D / 111.32 as lon")
    got = cluster.dedupe_sites(line, 5.0, order_col="pid", lat0=0.0, tile_rows=8_000)
    assert got.filter("pid % 2 = 0").count() == got.count() == 10_000
    assert len(passes) <= 10
    assert cluster.dedupe_sites(line.limit(0), 5.0, order_col="pid", lat0=0.0).count() == 0


def test_components_of_a_chain_a_star_and_loners(spark):
    chain = [(i, i + 1) for i in range(40, 70)]
    star = [(99, j) for j in range(80, 99)]
    nodes = spark.createDataFrame([(i,) for i in list(range(40, 71)) + list(range(80, 100)) + [5, 6]], "id long")
    edges = spark.createDataFrame(chain + star, "src long, dst long")
    got = {r.id: r.component for r in cluster.connected_components(nodes, edges).collect()}
    assert {got[i] for i in range(40, 71)} == {40} and {got[i] for i in range(80, 100)} == {80}
    assert got[5] == 5 and got[6] == 6


def test_components_around_hubs(spark):
    """Stars whose hubs have far more than an even share of the edges, joined by a chain."""
    star = spark.range(1, 6000).selectExpr("id as src", "cast(0 as bigint) as dst").union(
        spark.range(7000, 12000).selectExpr("cast(20000 as bigint) as src", "id as dst"))
    edges = star.union(spark.createDataFrame([(5, 30000), (30000, 30001), (30001, 7005)], "src long, dst long"))
    nodes = spark.range(0, 6000).union(spark.range(7000, 12000)).union(spark.createDataFrame([(20000,), (30000,), (30001,), (40000,)], "id long"))
    got = {r.id: r.component for r in cluster.connected_components(nodes, edges).collect()}
    assert len(got) == 11004 and got.pop(40000) == 40000 and set(got.values()) == {0}


def test_look_up_deals_frequent_keys(spark):
    many = cut(spark.range(40_000).selectExpr("if(id % 3 = 0, 7, if(id % 101 = 0, null, id)) as k", "id as x"))
    few = spark.range(0, 40_000, 2).selectExpr("id as k", "id * 10 as y").union(spark.createDataFrame([(7, 70)], "k long, y long"))
    hot = joins.frequent_keys(many, "k")
    assert [r.k for r in hot.collect()] == [7]
    got = joins.look_up(many, "k", few, hot)
    want = many.join(few, "k", "left")
    assert got.count() == 40_000 and got.exceptAll(want.select(got.columns)).isEmpty()
    assert joins.frequent_keys(many.filter("k <> 7"), "k") is None
    assert joins.look_up(many, "k", few, hot, "inner").filter("k = 7").count() == 13_335


def test_steps_delete_what_they_wrote(spark):
    with steps(spark) as outer:
        with steps(spark) as inner:
            a = cut(spark.range(5))
            kept = inner.keep(a.selectExpr("id + 1 as id"))
        assert not any(os.path.exists(p) for p in inner.paths) and len(inner.paths) == 1
        assert kept.count() == 5 and len(outer.paths) == 1
    assert not os.path.exists(outer.paths[0])
    with pytest.raises(ZeroDivisionError), steps(spark) as owner:
        cut(spark.range(3))
        raise ZeroDivisionError
    assert not os.path.exists(owner.paths[0])


def test_morans_i(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=50)
    nb = np.array([[(i + 1) % 50, (i + 2) % 50] for i in range(50)])
    x = v - v.mean()
    raw = sum((x * x[nb[:, j]]).sum() for j in range(2)) / (x ** 2).sum()
    values = spark.createDataFrame(pd.DataFrame({"id": range(50), "v": v}))
    edges = spark.createDataFrame([(i, int(j)) for i in range(50) for j in nb[i]], "src long, dst long")
    row = cluster.morans_i(values, edges, id_col="id", value="v").first()
    assert np.isclose(row.raw, raw) and np.isclose(row.morans_i, raw / 2)
    flat = spark.createDataFrame([(i, 1.0) for i in range(50)], "id long, v double")
    assert cluster.morans_i(flat, edges, id_col="id", value="v").first().morans_i is None


def test_neighbour_mean(spark):
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [4.0, 4.0])], "id long, z array<double>")
    edges = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long")
    got = {r.id: r.z for r in cluster.neighbour_mean(vecs, edges, 0.5, id_col="id", vec="z").collect()}
    assert np.allclose(got[0], [1.5, 1.5]) and got[1] == [0.0, 2.0]
    same = cluster.neighbour_mean(vecs, edges, 0.0, id_col="id", vec="z")
    assert {r.id: r.z for r in same.collect()}[0] == [1.0, 0.0]
