"""Plans that must hold at scale."""

import os

from pyspark.sql import functions as F

from helpers import cloud, table
from terrascout.functions import geo
from terrascout.operators import labels, rank, tiles
from terrascout.sources import points


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_box_filter_reaches_the_files(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.range(100).select("id", (F.col("id") * 0.1).alias("lat"), (-F.col("id") * 0.1).alias("lon"), F.lit("x").alias("note")).write.parquet(path)
    plan = plan_of(geo.bbox(spark.read.parquet(path), 1, 2, -2, -1).select("id"))
    assert "LessThanOrEqual(lat,2.0)" in plan
    assert "note" not in plan.split("ReadSchema")[1]


def test_csv_columns_are_pruned(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.range(10).select("id", F.lit(1.5).alias("Lat"), F.lit(2.5).alias("Lon"), F.lit("x").alias("junk")).write.option("header", True).csv(path)
    plan = plan_of(points.read_select(spark, path, {"Lat": "lat", "Lon": "lon"}, ["lat", "lon"]))
    assert "junk" not in plan.split("ReadSchema")[1]


def test_small_samples_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select(F.col("id").alias("cell_id"), (F.col("id") % 3).alias("cohort"))
    assert "WindowGroupLimit" in plan_of(labels.cohort_sample(df, 5))


def test_rank_windows_are_partitioned(spark):
    df = spark.range(2000).select("id", (F.col("id") % 97 / 97).alias("s"))
    plan = plan_of(rank.cumulate(df, "s", "id", piece_rows=100))
    # The rows are windowed per piece; only the offsets meet in one window.
    assert "windowspecdefinition(_b" in plan
    assert rank.cumulate(df, "s", "id", piece_rows=100).count() == 2000


def test_hot_keys_become_grids(spark):
    many = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    few = spark.range(150).select(F.when(F.col("id") < 120, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    left, right = tiles.salted(many, few, ["k"], "a", "b", 100)
    assert left.groupBy("k", "_salt", "_salt2").count().agg(F.max("count")).first()[0] < 160
    got = left.join(right, ["k", "_salt", "_salt2"]).select("k", "a", "b")
    want = many.join(few, "k").select("k", "a", "b")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_hot_spot_does_not_emit_its_pairs(spark):
    """A dense spot is merged per tile: what reaches the rim is far below all pairs."""
    xy = cloud(1500, 30, True)
    t = table(spark, xy, "tid")
    seen = []
    original = tiles._raw2

    def counted():
        seen.append(1)
        return original()

    tiles._raw2 = counted
    try:
        got = tiles.radius_aggregate(t.withColumnRenamed("tid", "qid"), t, 50.0, {"n": ("count", None)}, q_id="qid", cap=8)
        assert got.agg(F.sum("n")).first()[0] > 200_000
    finally:
        tiles._raw2 = original
    assert len(seen) > 2  # several levels were used


def test_stages_are_written_to_the_shared_folder(spark):
    from terrascout.session import cut, shared_dir

    df = cut(spark.range(10))
    assert any(f.startswith(("file:" + shared_dir(spark), "file://" + shared_dir(spark), shared_dir(spark))) for f in df.inputFiles())
    assert os.path.isdir(shared_dir(spark))
    assert cut(spark.range(10).filter("id < 0")).count() == 0
