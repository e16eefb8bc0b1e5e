"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrascout.functions import geo
from terrascout.operators import discovery, tiles
from terrascout.plans.fixtures import DIST, LAT0, X_SQL, Y_SQL, query, r6, rounded, sql
from terrascout.session import scratch_path
from terrascout.sources import grid, points, raster, shapes, tables

BOX = (31.0, 49.0, -125.0, -103.0)
PROVINCE_SQL = """case when lat > 41 and lon > -124 and lon < -120 then 'Cascades'
 when lat < 42 and lon > -118 and lon < -113 then 'Basin_and_Range'
 when lat > 42 and lat < 46 and lon > -116 and lon < -110 then 'Snake_River_Plain'
 when lat > 31 and lat < 35 and lon > -116 and lon < -113 then 'Salton_Trough'
 when lon > -113 and lon < -103 then 'Rocky_Mountain' else 'Other' end"""


@query("S1_read_points", sql("springs", f"select {r6('lat')} as lat, {r6('lon')} as lon, {r6('spring_t')} as spring_t from fx_springs"))
def s1(fx):
    """A CSV with drifting headers and unreadable numbers."""
    path = scratch_path(fx.spark, "s1")
    text = fx.springs.select(
        F.col("spring_id").alias("ID"), F.col("lat").cast("string").alias(" Latitude_WGS84 "),
        F.col("lon").cast("string").alias("LONGITUDE"),
        F.coalesce(F.col("spring_t").cast("string"), F.lit("n/a")).alias("Temp_C"))
    text.write.option("header", True).csv(path)
    spec = {"lat": ["lat"], "lon": ["lon"], "spring_t": ["temp", "tem"]}
    return rounded(points.read_points(fx.spark, path, spec), "lat", "lon", "spring_t")


@query("S2_read_many_union", sql("stations chem", f"""
select {r6('lat')} as lat, {r6('lon')} as lon, {r6('hf')} as bht, {r6('hf / 10')} as gradient from fx_stations
union all select {r6('lat')}, {r6('lon')}, {r6('sio2')}, cast(null as double) from fx_chem"""))
def s2(fx):
    """Two header families mapped by themselves, one unreadable path skipped."""
    one, two = scratch_path(fx.spark, "s2a"), scratch_path(fx.spark, "s2b")
    (fx.stations.select(F.col("lat").alias("LatDegree"), F.col("lon").alias("LongDegree"),
                        F.col("hf").alias("BHT_C"), (F.col("hf") / 10).alias("Gradient"))
     .write.option("header", True).csv(one))
    (fx.chem.select(F.col("lon").alias("LON"), F.col("lat").alias("LAT"), F.col("sio2").alias("Bottom_T"))
     .write.option("header", True).csv(two))
    spec = {"lat": ["lat"], "lon": ["lon"], "bht": ["bht", "bottom"], "gradient": ["grad"]}
    spec["lon"] = ["lon"]
    return rounded(points.read_many(fx.spark, [one, two, two + "-missing"], spec), "lat", "lon", "bht", "gradient")


@query("S3_read_select", sql("stations", f"select {r6('lat')} as lat, {r6('lon')} as lon, {r6('hf')} as hf from fx_stations"))
def s3(fx):
    """Three of five CSV columns under new names."""
    path = scratch_path(fx.spark, "s3")
    (fx.stations.select("station_id", F.col("lat").alias("LatDegreeWGS84"), F.col("lon").alias("LongDegreeWGS84"),
                        F.col("hf").alias("SiteHeatFlow"), F.lit("x").alias("note"))
     .write.option("header", True).csv(path))
    rename = {"LatDegreeWGS84": "lat", "LongDegreeWGS84": "lon", "SiteHeatFlow": "hf"}
    return rounded(points.read_select(fx.spark, path, rename, ["lat", "lon", "hf"]), "lat", "lon", "hf")


@query("S4_read_commented", sql("cells", f"select cell_id, {r6('lat')} as lat, {r6('lon')} as lon from fx_cells"))
def s4(fx):
    """CSV rows between comment lines."""
    path = scratch_path(fx.spark, "s4")
    line = F.concat_ws(",", "cell_id", "lat", "lon")
    fx.cells.select(F.explode(F.array(F.concat(F.lit("# frozen row "), "cell_id"), line)).alias("value")).write.text(path)
    got = points.read_commented(fx.spark, path, "cell_id bigint, lat double, lon double", header=False)
    return rounded(got, "lat", "lon")


_ROWS, _COLS, _DLAT, _DLON = grid.grid_shape(*BOX, 40.0)


@query("S5_grid_source", sql("springs", f"""
select g.cell_id, cast(g.r as integer) as "row", cast(g.c as integer) as col, {r6(f'31.0 + r * {_DLAT!r}::double')} as lat,
 {r6(f'-125.0 + c * {_DLON!r}::double')} as lon, coalesce(n, 0) as n_springs
from (select r * {_COLS} + c as cell_id, r, c from range({_ROWS}) a(r) cross join range({_COLS}) b(c)) g
left join (select cast(floor((lat - 31.0) / {_DLAT!r}::double) * {_COLS} + floor((lon + 125.0) / {_DLON!r}::double) as bigint) as cell_id,
 count(*) as n from fx_springs group by 1) s using (cell_id)"""))
def s5(fx):
    """The 40 km mesh over the region with the springs of each cell."""
    cells = grid.grid(fx.spark, *BOX, 40.0)
    counts = grid.snap(fx.springs, *BOX, 40.0).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n_springs"))
    out = cells.join(counts, "cell_id", "left").withColumn("n_springs", F.coalesce("n_springs", F.lit(0)).cast("bigint"))
    return rounded(out, "lat", "lon")


@query("S6_checkpoint_table", sql("cells", f"select cell_id, {PROVINCE_SQL} as province from fx_cells"))
def s6(fx):
    """A stage built once, sorted by place, and read twice."""
    path = scratch_path(fx.spark, "s6")

    def build():
        return fx.cells.withColumn("province", geo.province(F.col("lat"), F.col("lon")))

    tables.load_or_build(fx.spark, path, build, near_by=["lat", "lon"])
    return tables.load_or_build(fx.spark, path, build).select("cell_id", "province")


@query("S7_pixels_source", sql("pixels", f"select prow, pcol, {r6('nullif(value, -11.0)')} as value from fx_pixels"))
def s7(fx):
    return rounded(raster.pixels(fx.pixels, nodata=-11.0), "value")


@query("S8_lines_source", sql("faults", f"""
select fault_id, part, rn - 1 as seq, n as n_vertices, {r6('lon')} as lon, {r6('lat')} as lat from (
 select *, row_number() over (partition by fault_id, part order by seq) as rn, count(*) over (partition by fault_id, part) as n
 from fx_faults) where n >= 2"""))
def s8(fx):
    return rounded(shapes.lines(fx.faults), "lon", "lat")


@query("S8_polygons_source", sql("rings", f"""
select poly_id, 0 as ring, seq, 8::bigint as n_vertices, {r6('lon')} as lon, {r6('lat')} as lat from fx_rings"""))
def s8p(fx):
    return rounded(shapes.polygons(fx.rings), "lon", "lat")


_FOLDS = """select cast(f as bigint) as fold_id, cell_id, case when cell_id % 10 = f then 'test' else 'train' end as role
from fx_scores cross join range(10) r(f) where label = 1"""


@query("S9_folds_io", sql("scores", _FOLDS))
def s9(fx):
    """Test and training rows of ten folds of the positives, written as a table partitioned by role and read back."""
    path = scratch_path(fx.spark, "s9")
    role = F.when(F.col("cell_id") % 10 == F.col("fold_id"), "test").otherwise("train").alias("role")
    folds = fx.scores.filter("label = 1").withColumn("fold_id", F.explode(F.expr("sequence(0L, 9L)"))) \
        .select("fold_id", "cell_id", role)
    tables.write_folds(folds, path)
    return tables.read_folds(fx.spark, path)


@query("S10_table_sink", sql("cells", f"""
select {PROVINCE_SQL} as province, count(*) as n, {r6('sum(bal)', 2)} as sum_bal from fx_cells group by 1"""))
def s10(fx):
    """A report written as CSV, JSON and Parquet; the JSON copy is returned."""
    report = discovery.by_province(fx.cells.withColumn("province", geo.province(F.col("lat"), F.col("lon"))), "bal")
    report = rounded(report, "sum_bal", digits=2)
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(fx.spark, f"s10-{fmt}")
        tables.save(report, path, fmt)
        if fmt == "json":
            out = fx.spark.read.schema(report.schema).json(path)
    return out


@query("S11_grid_to_image", sql("pixels", f"""
select cast((select max(prow) from fx_pixels) - prow as integer) as img_row, pcol as img_col, {r6('value')} as value from fx_pixels"""))
def s11(fx):
    n_rows = fx.pixels.agg(F.max("prow")).first()[0] + 1
    cells = fx.pixels.withColumnsRenamed({"prow": "row", "pcol": "col"})
    return rounded(grid.to_north_up(cells, "value", n_rows), "value")


@query("S11_image_rows", sql("pixels", f"""
select cast((select max(prow) from fx_pixels) - prow as integer) as img_row, count(value) as n, {r6('sum(value)', 3)} as total
from fx_pixels group by 1"""))
def s11b(fx):
    """Image rows as arrays, checked by their length and sum."""
    n_rows = fx.pixels.agg(F.max("prow")).first()[0] + 1
    cells = fx.pixels.withColumnsRenamed({"prow": "row", "pcol": "col"})
    rows = grid.image_rows(grid.to_north_up(cells, "value", n_rows))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return rounded(rows.select("img_row", F.size("values").cast("bigint").alias("n"), total.alias("total")), "total", digits=3)


def volcano_values() -> str:
    rows = ", ".join(f"({i}::bigint, '{n}', {la}::double, {lo}::double)" for i, (n, la, lo) in enumerate(tables.VOLCANOES))
    return f"volc as (select *, {X_SQL} as x, {Y_SQL} as y from (values {rows}) v(volcano_id, volcano, lat, lon))"


@query("S12_dim_tables", sql("cells", f"""
select cell_id, volcano, {r6('d')} as dist_km from (select cell_id, volcano, {DIST} as d,
 row_number() over (partition by cell_id order by {DIST}, volcano_id) as rn from fx_cells a cross join volc b) where rn = 1""",
                             volcano_values()))
def s12(fx):
    """The nearest listed volcano of every cell."""
    volcanoes = tables.dim_table(fx.spark, "volcanoes")
    near = tiles.nearest(fx.cells, volcanoes, q_id="cell_id", t_id="volcano_id", lat0=LAT0, t_cols=["volcano"])
    return rounded(near.select("cell_id", "volcano", "dist_km"), "dist_km")


def raster_bounds(fx) -> raster.Bounds:
    """50 columns over the region, as many rows as there are parts."""
    return raster.Bounds(-125.0, 31.0, -103.0, 49.0, 50, fx.pixels.agg(F.max("prow")).first()[0] + 1)


@query("S13_raster_clip", sql("pixels", f"""
select cast(prow - r0 as integer) as prow, cast(pcol - c0 as integer) as pcol, {r6('value')} as value
from fx_pixels cross join (select cast(greatest(0, floor((49.0 - 45.0) / (18.0::double / ny))) as integer) as r0,
 cast(least(ny, ceil((49.0 - 36.0) / (18.0::double / ny))) as integer) as r1,
 cast(floor(5.0::double / 0.44) as integer) as c0, cast(ceil(15.0::double / 0.44) as integer) as c1
 from (select max(prow) + 1 as ny from fx_pixels))
where prow >= r0 and prow < r1 and pcol >= c0 and pcol < c1"""))
def s13(fx):
    """Pixels of 36-45 N, 120-110 W with rebased indexes."""
    px, _ = raster.clip(fx.pixels, raster_bounds(fx), -120.0, 36.0, -110.0, 45.0)
    return rounded(px, "value")
