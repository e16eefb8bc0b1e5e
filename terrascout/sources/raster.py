"""Rasters as pixel tables ``prow, pcol, value``."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bounds:
    """West, south, east, north edges and the pixel counts; row 0 is the north."""

    west: float
    south: float
    east: float
    north: float
    nx: int
    ny: int

    def col_of(self, lon: Column) -> Column:
        at = (lon - self.west) / (self.east - self.west) * self.nx
        return self._whole(at)

    def row_of(self, lat: Column) -> Column:
        at = (self.north - lat) / (self.north - self.south) * self.ny
        return self._whole(at)

    @staticmethod
    def _whole(at: Column) -> Column:
        # Cut toward zero.
        return F.when(at >= 0, F.floor(at)).otherwise(F.ceil(at)).cast("int")


def pixels(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """Pixel table with nodata and NaN as NULL."""
    value = F.col("value").cast("double")
    bad = F.isnan(value)
    if nodata is not None:
        bad = bad | (value == F.lit(float(nodata)))
    return df.select(F.col("prow").cast("int").alias("prow"), F.col("pcol").cast("int").alias("pcol"),
                     F.when(~bad, value).alias("value"))


def clip(px: DataFrame, bounds: Bounds, west: float, south: float, east: float,
         north: float) -> tuple[DataFrame, Bounds]:
    """Pixels whose cell touches the box, indexes rebased to the cut."""
    dx = (bounds.east - bounds.west) / bounds.nx
    dy = (bounds.north - bounds.south) / bounds.ny
    c0 = max(0, math.floor((west - bounds.west) / dx))
    c1 = min(bounds.nx, math.ceil((east - bounds.west) / dx))
    r0 = max(0, math.floor((bounds.north - north) / dy))
    r1 = min(bounds.ny, math.ceil((bounds.north - south) / dy))
    cut = (px.filter(F.col("pcol").between(c0, c1 - 1) & F.col("prow").between(r0, r1 - 1))
           .select((F.col("prow") - r0).cast("int").alias("prow"),
                   (F.col("pcol") - c0).cast("int").alias("pcol"), "value"))
    return cut, Bounds(bounds.west + c0 * dx, bounds.north - r1 * dy, bounds.west + c1 * dx,
                       bounds.north - r0 * dy, c1 - c0, r1 - r0)


def sample(points: DataFrame, px: DataFrame, bounds: Bounds, out: str = "value",
           default: float | None = None, clamp: bool = False) -> DataFrame:
    """Pixel under each point (J8): ``default`` outside and where the pixel is missing.

    ``clamp`` takes the edge pixel for a point outside instead.
    """
    col, row = bounds.col_of(F.col("lon")), bounds.row_of(F.col("lat"))
    col = F.least(F.greatest(col, F.lit(0)), F.lit(bounds.nx - 1))
    row = F.least(F.greatest(row, F.lit(0)), F.lit(bounds.ny - 1))
    if not clamp:
        inside = (F.col("lon").between(bounds.west, bounds.east)
                  & F.col("lat").between(bounds.south, bounds.north))
        col, row = F.when(inside, col), F.when(inside, row)
    keyed = points.withColumns({"_pr": row, "_pc": col})
    values = px.select(F.col("prow").alias("_pr"), F.col("pcol").alias("_pc"), F.col("value").alias("_v"))
    joined = keyed.join(values, ["_pr", "_pc"], "left")
    value = F.col("_v") if default is None else F.coalesce("_v", F.lit(float(default)))
    return joined.withColumn(out, value).drop("_pr", "_pc", "_v")


_LOW_BITS = 26  # of 52: either half summed over 10^11 pixels fits in a long


@dataclass(frozen=True)
class Scale:
    """Values as whole steps of a power of two above the smallest one; a step is 2^-52 of their range or less."""

    low: float
    exponent: int

    @staticmethod
    def of(px: DataFrame) -> Scale:
        """From one aggregation; NaN and infinite pixels count as missing."""
        low, high = px.filter(_finite("value")).agg(F.min("value"), F.max("value")).first()
        if low is None or high == low:
            return Scale(low or 0.0, 0)
        # Half of each first: the range of doubles of both signs may be beyond all doubles.
        _, e = math.frexp(high / 2 - low / 2)
        return Scale(low, min(51 - e, 1000))

    def steps(self, value: Column) -> Column:
        # Two factors, as one power of two may be beyond all doubles; halves for the same reason as above.
        half, rest = self.exponent // 2, self.exponent - self.exponent // 2
        return F.floor((value / 2 - F.lit(self.low / 2)) * F.lit(2.0 ** half) * F.lit(2.0 ** rest) * 2).cast("bigint")

    def mean(self, high: Column, low: Column, count: Column) -> Column:
        """Mean of ``count`` values whose steps' high and low halves sum to these."""
        half, rest = self.exponent // 2, self.exponent - self.exponent // 2
        steps = (high.cast("double") * F.lit(float(1 << _LOW_BITS)) + low.cast("double")) / F.nullif(count, F.lit(0))
        return (F.lit(self.low / 2) + steps / 2 / F.lit(2.0 ** half) / F.lit(2.0 ** rest)) * 2


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(F.col(name)) < F.lit(float("inf")))


def summed_area(px: DataFrame, bounds: Bounds, scale: Scale) -> DataFrame:
    """Sums and counts of all pixels up to and including (prow, pcol).

    ``hi`` and ``lo`` add up the two halves of whole steps, so differences of sums over the
    whole raster keep every digit.  Window frames run along one raster line at a time.
    """
    mesh = px.sparkSession.range(bounds.nx * bounds.ny).select(
        F.floor(F.col("id") / F.lit(bounds.nx)).cast("int").alias("prow"),
        (F.col("id") % bounds.nx).cast("int").alias("pcol"))
    steps = px.select("prow", "pcol", F.when(_finite("value"), scale.steps(F.col("value"))).alias("_q"))
    full = mesh.join(steps, ["prow", "pcol"], "left")
    along = Window.partitionBy("prow").orderBy("pcol").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("pcol").orderBy("prow").rowsBetween(Window.unboundedPreceding, 0)
    high, low = F.shiftright("_q", _LOW_BITS), F.col("_q").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))
    halves = full.select("prow", "pcol", F.coalesce(high, F.lit(0)).cast("bigint").alias("_hi"),
                         F.coalesce(low, F.lit(0)).cast("bigint").alias("_lo"), F.col("_q").isNotNull().cast("bigint").alias("_n"))
    line = halves.select("prow", "pcol", *[F.sum(c).over(along).alias(c) for c in ("_hi", "_lo", "_n")])
    return line.select("prow", "pcol", *[F.sum(c).over(down).alias(c[1:]) for c in ("_hi", "_lo", "_n")])


def focal_mean(points: DataFrame, px: DataFrame, bounds: Bounds, half_km: float, *, id_col: str,
               out: str = "regional") -> DataFrame:
    """Mean of the pixels in a +-half_km index window, cut at the edges.

    Four look-ups in the summed-area table replace the window's pixels, so the
    cost does not depend on the window size.  Missing and non-finite pixels don't count.
    """
    scale = Scale.of(px)
    per_km = half_km / 111.32
    squeeze = F.greatest(F.lit(0.2), F.cos(F.radians(F.col("lat"))))
    dx = F.floor(F.lit(half_km) * (1 / (111.32 * squeeze)) / (bounds.east - bounds.west) * bounds.nx).cast("int")
    dy = math.floor(per_km / (bounds.north - bounds.south) * bounds.ny)
    c, r = bounds.col_of(F.col("lon")), bounds.row_of(F.col("lat"))
    box = points.select(
        id_col,
        F.greatest(F.lit(0), r - dy).alias("r0"), F.least(F.lit(bounds.ny), r + dy + 1).alias("r1"),
        F.greatest(F.lit(0), c - dx).alias("c0"), F.least(F.lit(bounds.nx), c + dx + 1).alias("c1"))
    box = box.filter((F.col("r1") > F.col("r0")) & (F.col("c1") > F.col("c0")))
    corner = F.array(*[F.struct(rr.alias("prow"), cc.alias("pcol"), F.lit(sign).alias("sign"))
                       for rr, cc, sign in (
                           (F.col("r1") - 1, F.col("c1") - 1, 1), (F.col("r0") - 1, F.col("c1") - 1, -1),
                           (F.col("r1") - 1, F.col("c0") - 1, -1), (F.col("r0") - 1, F.col("c0") - 1, 1))])
    lookups = box.select(id_col, F.explode(corner).alias("_k")).select(
        id_col, F.col("_k.prow").alias("prow"), F.col("_k.pcol").alias("pcol"), F.col("_k.sign").alias("sign"))
    sums = (lookups.join(summed_area(px, bounds, scale), ["prow", "pcol"])
            .groupBy(id_col).agg(*[F.sum(F.col("sign") * F.col(c)).alias(f"_{c}") for c in ("hi", "lo", "n")]))
    mean = sums.select(id_col, scale.mean(F.col("_hi"), F.col("_lo"), F.col("_n")).alias(out))
    return points.join(mean, id_col, "left")


# ------------------------------------------------------------------- patches

def mirrored(cells: DataFrame, n_rows: int, n_cols: int, before: int, after: int) -> DataFrame:
    """Cells plus their mirror images beyond the edge; the edge itself is not repeated.

    Positions repeat with period 2 (n - 1), so a border wider than the grid
    mirrors again and again.
    """
    def images(axis: str, n: int) -> Column:
        period = max(1, 2 * (n - 1))
        turns = (n + before + after) // period + 1
        shifts = F.expr(f"sequence({-turns * period}, {turns * period}, {period})")
        both = F.concat(F.transform(shifts, lambda k: k + F.col(axis)), F.transform(shifts, lambda k: k - F.col(axis)))
        return F.array_distinct(F.filter(both, lambda p: p.between(-before, n - 1 + after)))

    return (cells.withColumn("_r", F.explode(images("row", n_rows)))
            .withColumn("_c", F.explode(images("col", n_cols))))


def patch_stats(cells: DataFrame, value: str, n_rows: int, n_cols: int, size: int = 32) -> DataFrame:
    """mean, std (population), min, max and valid share of the size x size patch
    around every cell (W11, R1, R2, R4): rows r-size/2 .. r+size/2-1, mirrored.

    Two separable frames: along the row, then along the column.  Values count from the mean of
    all cells, so that a common offset takes no digits from the spread.
    """
    half = size // 2
    source = F.col(value).cast("double")
    centre = cells.agg(F.avg(F.when(~F.isnan(source) & (F.abs(source) < F.lit(float("inf"))), source))).first()[0] or 0.0
    wide = mirrored(cells.select("row", "col", (source - F.lit(centre)).alias("_v"), source.alias("_self")),
                    n_rows, n_cols, half, half - 1)
    across = Window.partitionBy("_r").orderBy("_c").rowsBetween(-half, half - 1)
    line = wide.select(
        "_r", "_c", "_self", F.sum("_v").over(across).alias("_s"),
        F.sum(F.col("_v") * F.col("_v")).over(across).alias("_q"),
        F.min("_self").over(across).alias("_lo"), F.max("_self").over(across).alias("_hi"),
        F.count("_v").over(across).alias("_n"), F.count(F.lit(1)).over(across).alias("_m"))
    line = line.filter(F.col("_c").between(0, n_cols - 1))
    down = Window.partitionBy("_c").orderBy("_r").rowsBetween(-half, half - 1)
    full = line.select(
        "_r", "_c", "_self", F.sum("_s").over(down).alias("_s"), F.sum("_q").over(down).alias("_q"),
        F.min("_lo").over(down).alias("_lo"), F.max("_hi").over(down).alias("_hi"),
        F.sum("_n").over(down).alias("_n"), F.sum("_m").over(down).alias("_m"))
    mean = F.col("_s") / F.nullif(F.col("_n"), F.lit(0))
    spread = F.greatest(F.lit(0.0), F.col("_q") / F.nullif(F.col("_n"), F.lit(0)) - mean * mean)
    return full.filter(F.col("_r").between(0, n_rows - 1)).select(
        F.col("_r").alias("row"), F.col("_c").alias("col"), F.col("_self").alias("centre"),
        (F.lit(centre) + mean).alias("mean"), F.sqrt(spread).alias("std"), F.col("_lo").alias("min"), F.col("_hi").alias("max"),
        (F.col("_n") / F.col("_m")).alias("valid"))


def patch_centre(cells: DataFrame, value: str) -> DataFrame:
    """The patch's own cell (R3): no window is needed."""
    return cells.select("row", "col", F.col(value).cast("double").alias("centre"))


def patch_quantiles(cells: DataFrame, value: str, n_rows: int, n_cols: int, size: int = 32,
                    probs: Sequence[float] = (0.5,), names: Sequence[str] = ("median",),
                    wanted: DataFrame | None = None) -> DataFrame:
    """Quantiles of the patch for the ``wanted`` cells (row, col), all by default.

    A frame along the row gathers ``size`` values as one array, a frame along the column
    ``size`` such arrays, which are sorted together: one row a cell is shuffled, not one a
    value.  Missing values don't count; without any the quantile is NULL.
    """
    half = size // 2
    base = cells.select("row", "col", F.col(value).cast("double").alias("_v"))
    if wanted is None:
        base = base.withColumn("_want", F.lit(True))
    else:
        asked = wanted.select("row", "col").distinct().withColumn("_want", F.lit(True))
        base = base.join(asked, ["row", "col"], "left")
    wide = mirrored(base, n_rows, n_cols, half, half - 1)
    across = Window.partitionBy("_r").orderBy("_c").rowsBetween(-half, half - 1)
    line = wide.select("_r", "_c", "_want", F.collect_list("_v").over(across).alias("_line")) \
        .filter(F.col("_c").between(0, n_cols - 1))
    down = Window.partitionBy("_c").orderBy("_r").rowsBetween(-half, half - 1)
    full = line.select("_r", "_c", "_want", F.collect_list("_line").over(down).alias("_lines")) \
        .filter(F.col("_r").between(0, n_rows - 1) & F.col("_want"))
    patch = full.select(F.col("_r").alias("row"), F.col("_c").alias("col"), F.sort_array(F.flatten("_lines")).alias("_p"))

    def quantile(p: float) -> Column:
        at = F.lit(float(p)) * (F.size("_p") - 1)
        low, high = F.get("_p", F.floor(at).cast("int")), F.get("_p", F.ceil(at).cast("int"))
        return F.when(F.size("_p") > 0, low + (high - low) * (at - F.floor(at)))

    return patch.select("row", "col", *[quantile(p).alias(n) for p, n in zip(probs, names)])


def valid_patch(cells: DataFrame, value: str, n_rows: int, n_cols: int, size: int = 32,
                share: float = 0.5) -> DataFrame:
    """Whether more than ``share`` of the patch is present, and its mean if so."""
    stats = patch_stats(cells, value, n_rows, n_cols, size)
    ok = F.col("valid") > share
    return stats.select("row", "col", ok.alias("covered"),
                        F.when(ok, F.coalesce("centre", "mean")).alias("filled"),
                        F.when(ok, F.col("mean")).alias("mean"))
