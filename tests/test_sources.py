import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.operators import features, labels
from terrascout.sources import grid, points, tables


def test_a_stage_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(100).select("id", (F.col("id") % 7).alias("k"))

    path = str(tmp_path / "stage")
    first = tables.load_or_build(spark, path, build, sort_by=["k"])
    second = tables.load_or_build(spark, path, build)
    assert len(built) == 1 and first.count() == second.count() == 100


@pytest.mark.parametrize("hot", [False, True])
def test_a_box_is_read_from_few_files(spark, tmp_path, hot):
    """Bands and boxes of either column, with and without a third of the places in one spot."""
    rng = np.random.default_rng(4)
    lat, lon = rng.uniform(30, 50, 30_000), rng.uniform(-120, -80, 30_000)
    if hot:
        lat[:10_000], lon[:10_000] = rng.normal(47, 0.01, 10_000), rng.normal(-84, 0.01, 10_000)
    places = spark.createDataFrame(pd.DataFrame({"id": np.arange(30_000), "lat": lat, "lon": lon}))
    odd = spark.createDataFrame([(30_000, None, 1.0), (30_001, float("nan"), 2.0)], "id long, lat double, lon double")
    path = str(tmp_path / "places")
    got = tables.load_or_build(spark, path, lambda: places.unionByName(odd), near_by=["lat", "lon"], files=64)
    assert got.count() == 30_002 and got.select("id").distinct().count() == 30_002
    boxes = [r for r in got.withColumn("f", F.input_file_name()).filter("lat is not null and not isnan(lat)").groupBy("f")
             .agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).toPandas().itertuples(index=False)]

    def files(south, north, west, east):
        return sum(r[1] <= north and r[2] >= south and r[3] <= east and r[4] >= west for r in boxes)

    assert len(boxes) > 50
    assert files(40.0, 40.5, -100.0, -99.0) <= 6
    assert files(41.0, 41.2, -180, 180) <= 20 and files(0, 90, -101.0, -100.6) <= 20


def test_places_in_order_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "lat double, lon double")
    assert tables.load_or_build(spark, str(tmp_path / "none"), lambda: none, near_by=["lat", "lon"]).count() == 0
    one = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "lat double, lon double")
    assert tables.load_or_build(spark, str(tmp_path / "one"), lambda: one, near_by=["lat", "lon"]).count() == 2


def test_headers_drift(spark, tmp_path):
    path = str(tmp_path / "f.csv")
    with open(path, "w") as f:
        f.write("Site, LATITUDE_dd ,Long,Temp F\na,56-49.95 N,135-22.25 W,12\nb,,-118,3\nc,40.5,-118.25,x\n")
    df = points.read_points(spark, path, {"lat": ["lat"], "lon": ["lon"], "name": ["site"], "t": ["tem"], "none": ["zzz"]},
                            text=["name"], dms=True)
    got = {r.name: r for r in df.collect()}
    assert set(got) == {"a", "c"} and np.isclose(got["a"].lat, 56.8325) and np.isclose(got["a"].lon, -135.370833)
    assert got["c"].t is None and got["a"].none is None
    no_place = str(tmp_path / "g.csv")
    with open(no_place, "w") as f:
        f.write("a,b\n1,2\n")
    assert points.read_points(spark, no_place) is None
    with pytest.raises(ValueError):
        points.read_many(spark, [no_place], points.LATLON)


def test_comment_header(spark, tmp_path):
    path = str(tmp_path / "m.csv")
    with open(path, "w") as f:
        f.write("# frozen: 2024\n# sha256: x\nid,lat\n1,2.5\n")
    assert [tuple(r) for r in points.read_commented(spark, path).collect()] == [("1", "2.5")]


def test_inclusive_grid_matches_arange(spark):
    got = grid.grid(spark, 25.0, 49.0, -103.0, -67.0, 40.0, inclusive=True).toPandas()
    lats = np.arange(25.0, 49.0 + 1e-6, 40 / 111.32)
    lons = np.arange(-103.0, -67.0 + 1e-6, 40 / (111.32 * np.cos(np.radians(37.0))))
    assert len(got) == len(lats) * len(lons)
    assert np.allclose(got.sort_values("cell_id").lat.values.reshape(len(lats), -1)[:, 0], lats)


def test_folds_round_trip(spark, tmp_path):
    folds = spark.createDataFrame([(0, 1, "test"), (0, 2, "train"), (1, 2, "test")], "fold_id long, cell_id long, role string")
    tables.write_folds(folds, str(tmp_path / "folds"))
    back = tables.read_folds(spark, str(tmp_path / "folds"))
    assert back.exceptAll(folds).count() == 0 and back.count() == 3
    docs = {r.fold_id: r.json for r in tables.folds_as_json(back).collect()}
    assert docs[0] == '{"fold_id":0,"train_idx":[2],"test_idx":[1]}' and '"train_idx":[]' in docs[1]


def test_zscore_fill_and_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "a double, b double")
    stats = features.norm_stats(df, ["a", "b"])
    rows = features.zscore(df, stats, fill="mean").collect()
    assert [r.a for r in rows] == [-1.0, 1.0, 0.0] and [r.b for r in rows] == [0.0, 0.0, 0.0]
    assert features.zscore(df, stats).collect()[2].a is None


def test_missing_sources_give_defaults(spark):
    cells = spark.createDataFrame([(1, 40.0, -117.0)], "cell_id long, lat double, lon double")
    row = features.point_features(cells, None, None, None, lat0=40.0).first()
    assert row.covered is False and row.n_springs == 0 and row.mean_cl == 0
    line = features.line_features(cells, None, lat0=40.0).first()
    assert (line.density_km, line.nearest_km, line.max_slip, line.n_tips) == (0.0, 1000.0, 0.0, 0)
    assert features.volcano_features(cells, None, lat0=40.0).first().nearest_km == 1000.0


def test_all_null_values_count_but_give_zero(spark):
    cells = spark.createDataFrame([(1, 40.0, -117.0)], "cell_id long, lat double, lon double")
    springs = spark.createDataFrame([(40.0, -117.0, None), (40.1, -117.0, None)], "lat double, lon double, spring_t double")
    row = features.point_features(cells, springs, None, None, lat0=40.0).first()
    assert row.covered and row.n_springs == 2 and row.max_spring_t == 0


def test_box_edges_and_specific_province(spark):
    df = spark.createDataFrame([(31.0, -125.0), (49.0, -103.0)], "lat double, lon double")
    assert geo.bbox(df, 31, 49, -125, -103).count() == 2 and geo.bbox(df, 31, 49, -125, -103, inclusive=False).count() == 0
    row = spark.range(1).select(geo.province(F.lit(33.0), F.lit(-115.0)), geo.province(F.lit(33.0), F.lit(-115.0), True)).first()
    assert tuple(row) == ("Basin_and_Range", "Salton_Trough")


def test_dim_tables(spark):
    sizes = [tables.dim_table(spark, n).count() for n in ("eastern_springs", "known_eastern", "volcanoes")]
    assert sizes == [25, 8, 16]


def test_transfer_needs_enough_rows(spark):
    df = spark.createDataFrame([("A", 1), ("B", 0)], "province string, label int")
    with pytest.raises(ValueError):
        labels.transfer_split(df, ["A"], ["B"])
