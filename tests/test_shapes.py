import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrascout.operators import features, midpoints, tiles, vicinity
from terrascout.plans import catalog
from terrascout.session import shared_dir
from terrascout.sources import raster, shapes


def ring(poly, number, corners):
    return [(poly, number, i, x, y) for i, (x, y) in enumerate(corners)]


def test_point_in_polygon_with_hole_and_overlap(spark):
    rows = (ring(1, 0, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(1, 1, [(4, 4), (6, 4), (6, 6), (4, 6)])
            + ring(2, 0, [(5, 5), (20, 5), (20, 20)]) + ring(3, 0, [(30.0, 30.0), (30.001, 30.0), (30.001, 30.001)]))
    df = spark.createDataFrame([(p, r, i, float(x), float(y)) for p, r, i, x, y in rows],
                               "poly_id long, ring int, seq int, lon double, lat double")
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 5.0, 5.5), (2, 4.5, 5.5), (3, 8.0, 6.0), (4, 19.0, 10.0),
                                    (5, 30.0009, 30.0002), (6, 25.0, 25.0), (7, -1.0, 5.0)], "id long, lon double, lat double")
    got = shapes.point_in_polygon(points, shapes.polygons(df, ring="ring"), id_col="id", edges_per_band=1)
    assert {r.id: r.poly_id for r in got.collect()} == {0: 1, 3: 1, 4: 2, 5: 3}


def test_line_samples_and_ends(spark):
    df = spark.createDataFrame([(1, 0, 10, 0.0, 0.0), (1, 0, 20, 0.0, 0.1), (1, 0, 40, 0.2, 0.1), (2, 0, 1, 5.0, 5.0),
                                (3, 0, 1, 1.0, 1.0), (3, 0, 2, 1.0, 1.0)], "fault_id long, part int, seq long, lon double, lat double")
    line = shapes.lines(df)
    got = shapes.line_samples(line, 2.0).toPandas().sort_values(["fault_id", "sample"])
    first = got[got.fault_id == 1]
    n = max(2, int(0.3 / (2.0 / 111.32)))
    assert len(first) == n and list(first["sample"]) == list(range(n))
    at = np.linspace(0, 0.3, n)
    assert np.allclose(first.lat, np.minimum(at, 0.1)) and np.allclose(first.lon, np.maximum(at - 0.1, 0))
    assert len(got[got.fault_id == 3]) == 2 and 2 not in set(got.fault_id)
    ends = shapes.line_endpoints(line).filter("fault_id = 1").orderBy("tip").collect()
    assert [(r.lon, r.lat) for r in ends] == [(0.0, 0.0), (0.2, 0.1)]


def test_multi_part_line_is_sampled_as_one(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.0, 0.0), (1, 0, 1, 0.1, 0.0), (1, 1, 0, 1.0, 0.0), (1, 1, 1, 1.1, 0.0)],
                               "fault_id long, part int, seq long, lon double, lat double")
    got = shapes.line_samples(shapes.lines(df), 2.0).toPandas().sort_values("sample")
    n = max(2, int(0.2 / (2.0 / 111.32)))
    at = np.linspace(0, 0.2, n)
    assert np.allclose(got.lon, np.where(at <= 0.1 + 1e-12, at, at + 0.9))


def pixel_table(spark, img):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(img)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def test_patches_mirror_like_numpy(spark):
    img = np.random.default_rng(1).normal(size=(9, 11))
    padded = np.pad(img, 4, mode="reflect")
    got = raster.patch_stats(pixel_table(spark, img), "value", 9, 11, 8).toPandas().sort_values(["row", "col"])
    patches = np.array([padded[r:r + 8, c:c + 8] for r in range(9) for c in range(11)])
    assert np.allclose(got["mean"], patches.mean((1, 2))) and np.allclose(got["std"], patches.std((1, 2)))
    assert np.allclose(got["min"], patches.min((1, 2))) and np.allclose(got["max"], patches.max((1, 2)))
    wanted = spark.createDataFrame([(0, 0), (8, 10)], "row int, col int")
    q = raster.patch_quantiles(pixel_table(spark, img), "value", 9, 11, 8, (0.5, 0.9), ("median", "p90"), wanted)
    q = q.toPandas().sort_values("row")
    assert np.allclose(q["median"], [np.median(patches[0]), np.median(patches[-1])])
    assert np.allclose(q["p90"], [np.percentile(patches[0], 90), np.percentile(patches[-1], 90)])
    # A patch wider than the grid mirrors repeatedly.
    wide = np.pad(img, 16, mode="reflect")
    big = raster.patch_stats(pixel_table(spark, img), "value", 9, 11, 32).toPandas().sort_values(["row", "col"])
    assert np.allclose(big["mean"], [wide[r:r + 32, c:c + 32].mean() for r in range(9) for c in range(11)])


def test_raster_sample_and_focal_mean(spark):
    img = np.random.default_rng(2).normal(size=(20, 30))
    img[3, 4] = np.nan
    px = pixel_table(spark, img).withColumnsRenamed({"row": "prow", "col": "pcol"})
    b = raster.Bounds(-110.0, 30.0, -100.0, 40.0, 30, 20)
    rng = np.random.default_rng(3)
    pts = pd.DataFrame({"id": range(40), "lat": rng.uniform(29, 41, 40), "lon": rng.uniform(-111, -99, 40)})
    pts.loc[0, ["lat", "lon"]] = [40 - 3.5 * 0.5, -110 + 4.5 / 3]
    got = raster.sample(spark.createDataFrame(pts), px, b, default=-9.0).toPandas().sort_values("id")
    focal = raster.focal_mean(spark.createDataFrame(pts), px, b, 60.0, id_col="id").toPandas().sort_values("id")
    for p, g, f in zip(pts.itertuples(), got.value, focal.regional):
        c, r = int((p.lon + 110) / 10 * 30), int((40 - p.lat) / 10 * 20)
        inside = -110 <= p.lon <= -100 and 30 <= p.lat <= 40
        want = img[min(max(r, 0), 19), min(max(c, 0), 29)] if inside else -9.0
        assert np.isclose(g, -9.0 if np.isnan(want) else want)
        dx = int(60 * (1 / (111.32 * max(0.2, np.cos(np.radians(p.lat))))) / 10 * 30)
        dy = int(60 / 111.32 / 10 * 20)
        window = img[max(0, r - dy):min(20, r + dy + 1), max(0, c - dx):min(30, c + dx + 1)]
        assert (np.isnan(f) if window.size == 0 else np.isclose(f, np.nanmean(window)))


def test_clip_rebases(spark):
    px = pixel_table(spark, np.arange(200.0).reshape(10, 20)).withColumnsRenamed({"row": "prow", "col": "pcol"})
    cut, b = raster.clip(px, raster.Bounds(0.0, 0.0, 20.0, 10.0, 20, 10), 5.0, 2.0, 8.0, 6.0)
    assert (b.nx, b.ny, b.west, b.north) == (3, 4, 5.0, 6.0)
    assert cut.filter("prow = 0 and pcol = 0").first().value == 4 * 20 + 5
    assert cut.count() == 12


def test_focal_mean_keeps_digits_beside_a_large_offset(spark):
    """Sums over a raster far from zero, with a hole, an infinite pixel and NaN, against numpy on the window alone."""
    rng = np.random.default_rng(3)
    img = 1e9 + rng.random((60, 80))
    img[3, 4], img[30, 40] = 1e15, -1e15
    holes = img.copy()
    holes[10, 10], holes[11, 11], holes[50, 5] = np.nan, np.inf, np.nan
    b = raster.Bounds(-125.0, 31.0, -103.0, 49.0, 80, 60)
    px = pixel_table(spark, holes).withColumnsRenamed({"row": "prow", "col": "pcol"})
    pts = spark.range(200).selectExpr("id", "31.2D + 17.6D * (id * 37 % 200) / 200 as lat", "-124.9D + 21.7D * (id * 71 % 200) / 200 as lon")
    got = raster.focal_mean(pts, px, b, 120.0, id_col="id").toPandas().sort_values("id")
    for p in got.itertuples():
        r, c = int((49.0 - p.lat) / 18.0 * 60), int((p.lon + 125.0) / 22.0 * 80)
        dy = int(120 / 111.32 / 18.0 * 60)
        dx = int(120 * (1 / (111.32 * max(0.2, np.cos(np.radians(p.lat))))) / 22.0 * 80)
        window = holes[max(0, r - dy):r + dy + 1, max(0, c - dx):c + dx + 1]
        want = math.fsum(window[np.isfinite(window)]) / np.isfinite(window).sum()
        # Steps are 2^-52 of a range of 2e15: half a unit.
        assert abs(p.regional - want) <= (0.5 if np.abs(window[np.isfinite(window)]).max() > 1e14 else 0.5 + 1e-6)
    calm = pixel_table(spark, 1e9 + rng.random((60, 80))).withColumnsRenamed({"row": "prow", "col": "pcol"})
    table = calm.toPandas().pivot(index="prow", columns="pcol", values="value").to_numpy()
    got = raster.focal_mean(pts, calm, b, 120.0, id_col="id").toPandas()
    for p in got.itertuples():
        r, c = int((49.0 - p.lat) / 18.0 * 60), int((p.lon + 125.0) / 22.0 * 80)
        dy = int(120 / 111.32 / 18.0 * 60)
        dx = int(120 * (1 / (111.32 * max(0.2, np.cos(np.radians(p.lat))))) / 22.0 * 80)
        window = table[max(0, r - dy):r + dy + 1, max(0, c - dx):c + dx + 1]
        assert abs(p.regional - math.fsum(window.ravel()) / window.size) <= 2.4e-7  # two units in the last place


def test_scale_of_extreme_rasters(spark):
    """Constant, empty and widest rasters."""
    b = raster.Bounds(-125.0, 31.0, -103.0, 49.0, 4, 3)
    pts = spark.range(1).selectExpr("id", "40.0D as lat", "-114.1D as lon")
    for img, want in ((np.full((3, 4), 7.25), 7.25), (np.full((3, 4), np.nan), None), (np.where(np.eye(3, 4) > 0, 1.5e308, -1.5e308), -0.75e308)):
        px = pixel_table(spark, img).withColumnsRenamed({"row": "prow", "col": "pcol"})
        got = raster.focal_mean(pts, px, b, 5000.0, id_col="id").first().regional
        assert got == want if want is None else abs(got - want) <= 1e-9 * abs(want)


def test_patches_far_from_zero_and_with_holes(spark):
    rng = np.random.default_rng(8)
    img = 1e9 + rng.random((9, 11))
    img[2:4, 3:9] = np.nan
    cells = pixel_table(spark, img).withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    padded = np.pad(img, ((4, 3), (4, 3)), mode="reflect")
    patches = np.array([padded[r:r + 8, c:c + 8] for r in range(9) for c in range(11)])
    got = raster.patch_stats(cells, "value", 9, 11, 8).toPandas().sort_values(["row", "col"])
    assert np.allclose(got["std"], np.nanstd(patches - 1e9, axis=(1, 2)), rtol=1e-6)
    q = raster.patch_quantiles(cells, "value", 9, 11, 8, (0.1, 0.5), ("low", "mid")).toPandas().sort_values(["row", "col"])
    assert np.allclose(q[["low", "mid"]].to_numpy().T - 1e9, np.nanpercentile(patches, (10, 50), axis=(1, 2)) - 1e9, atol=1e-6)
    empty = raster.patch_quantiles(cells.withColumn("value", F.lit(None).cast("double")), "value", 9, 11, 8).toPandas()
    assert len(empty) == 99 and empty["median"].isna().all()


@pytest.mark.parametrize("spread,part", [(60.0, 16_384), (60.0, 37), (300.0, 2), (0.01, 50)])
def test_tip_pairs_are_counted_around_cells_without_a_list(spark, monkeypatch, spread, part):
    rng = np.random.default_rng(6)
    tips = [(int(i % 70), int(i // 70 % 2), int(i % 3), *rng.uniform(0, spread, 2)) for i in range(260)]
    tips += [(90, 0, 0, 5.0, 5.0), (91, 0, 0, 5.0, 5.0), (92, 0, 0, 5.0, 15.0), (None, 0, 0, 5.0, 6.0), (93, 0, 0, math.nan, 1.0)]
    cells = [(i, *rng.uniform(-5, spread + 5, 2)) for i in range(150)] + [(200, 5.0, 0.0), (200, 5.0, 5.0), (201, 5.0, None), (202, 5.0, 20.0)]

    def degrees(rows, schema):
        made = spark.createDataFrame([(*r[:-2], *(None if v is None else float(v) for v in r[-2:])) for r in rows], schema + ", x double, y double")
        return made.selectExpr("*", "x / 111.32 as lon", "y / 111.32 as lat").drop("x", "y")

    ends = degrees(tips, "fault_id long, part int, tip int")
    around = degrees(cells, "cell_id long")
    pairs = shapes.tip_pairs(ends, 10.0, 0.0).select("x", "y").collect()
    at = {}
    for c in tiles.planar(around, 0.0).filter("y is not null").collect():
        d = [round(math.sqrt((c.x - p.x) ** 2 + (c.y - p.y) ** 2), 9) <= 10 for p in pairs]
        at[c.cell_id] = at.get(c.cell_id, 0) + sum(d)
    # Pairs must not be listed.
    monkeypatch.setattr(tiles, "within", None)
    monkeypatch.setattr(midpoints.count_near, "__kwdefaults__", {"part": part})
    got = {r.cell_id: r.n_tips for r in shapes.tip_pairs(ends, 10.0, 0.0, around=around, near_km=10.0).collect()}
    assert got == {k: v for k, v in at.items() if v}


@pytest.mark.parametrize("spread,part,places", [(200.0, 262_144, 1_048_576), (30.0, 40, 1_048_576), (30.0, 40, 9), (1e-6, 30, 20)])
def test_line_features_without_tiles_around_cells(spark, monkeypatch, spread, part, places):
    rng = np.random.default_rng(9)
    xy = rng.uniform(0, spread, (600, 2))
    xy[:150] = [min(spread, 20.0), 0.0]
    xy[150:300] = xy[150:300].round()
    slip = [None if i % 7 == 0 else float(i * 13 % 11) for i in range(600)]
    slip[201], xy[599] = math.nan, [-300.0, 400.0]
    samples = spark.createDataFrame([(float(x) / 111.32, float(y) / 111.32, v) for (x, y), v in zip(xy, slip)]
                                    + [(math.nan, 1.0, 99.0), (None, 0.0, 99.0)], "lon double, lat double, slip double")
    at = [(i, *map(float, rng.uniform(-40, spread + 40, 2))) for i in range(80)]
    at += [(3, 1.0, 1.0), (90, 45.0, 0.0), (91, 700.0, 700.0), (None, 0.0, 0.0), (92, None, 0.0)]
    cells = spark.createDataFrame([(i, None if x is None else x / 111.32, y / 111.32) for i, x, y in at], "cell_id long, lon double, lat double")
    t = tiles.planar(samples, 0.0).filter("x = x and not isnan(x)").toPandas()
    q = tiles.planar(cells, 0.0).toPandas()
    d = np.round(np.sqrt((q.x.to_numpy()[:, None] - t.x.to_numpy()) ** 2 + (q.y.to_numpy()[:, None] - t.y.to_numpy()) ** 2), 9)
    with np.errstate(invalid="ignore"):
        inside = d <= 25.0
    values = [slip[i] for i in range(600)]
    want = {}
    for i, (key, _, _) in enumerate(at):
        near = [v for v, k in zip(values, inside[i]) if k and v is not None]
        n, top, least = want.get(key, (0, [], 1000.0))
        want[key] = (n + int(inside[i].sum()), top + near, min(least, d[i].min()) if d[i].min() == d[i].min() else least)
    want[None] = (0, [], 1000.0)

    def highest(top):
        return math.inf if any(math.isnan(v) for v in top) else max(top, default=0.0)

    monkeypatch.setattr(tiles, "radius_aggregate", None)  # it writes tiles of each cell's rim, ever more with denser samples
    monkeypatch.setattr(vicinity.survey, "__kwdefaults__", {"part": part, "places_part": places})
    got = features.line_features(cells, samples, lat0=0.0).collect()
    assert len(got) == len(at)
    for r in got:
        n, top, least = want[r.cell_id]
        assert (r.density_km, math.inf if math.isnan(r.max_slip) else r.max_slip) == (2.0 * n, highest(top))
        assert abs(r.nearest_km - least) <= 1e-9


def test_line_features_leave_one_table(spark, tmp_path):
    """Every step is deleted when the next has what it needs; only the result stays."""
    spark.range(40).selectExpr("id as c_custkey", "'X' as c_mktsegment", "1.0D as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(400).selectExpr("id as o_orderkey", "id * 7 % 45 as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    before = set(os.listdir(shared_dir(spark)))
    rows = catalog.QUERIES["A2_line_features"](spark, str(tmp_path)).collect()
    assert len(rows) == 40 and min(r.nearest_km for r in rows) >= 0
    assert len(set(os.listdir(shared_dir(spark))) - before) == 1


def test_samples_carry_the_largest_value_of_the_whole_line(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 1.0), (1, 0, 1, 0.1, 0.0, None), (1, 1, 0, 1.0, 0.0, None), (1, 1, 1, 1.1, 0.0, 5.0), (2, 0, 0, 0.0, 0.0, None), (2, 0, 1, 0.0, 0.1, None)]
    df = spark.createDataFrame(rows, "fault_id long, part int, seq long, lon double, lat double, slip double")
    got = shapes.line_samples(shapes.lines(df, extra=["slip"]), 2.0, keep="slip").select("fault_id", "slip").distinct().collect()
    assert {tuple(r) for r in got} == {(1, 5.0), (2, None)}
