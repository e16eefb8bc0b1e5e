"""Regular cell grids and their image form."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def _steps(low: float, high: float, step: float, inclusive: bool) -> int:
    edge = high + 1e-6 if inclusive else high
    return max(0, math.ceil((edge - low) / step))


def grid_shape(lat_min: float, lat_max: float, lon_min: float, lon_max: float, res_km: float,
               inclusive: bool = False) -> tuple[int, int, float, float]:
    """(rows, cols, lat step, lon step) of the mesh."""
    mid = math.radians(0.5 * (lat_min + lat_max))
    squeeze = max(0.2, math.cos(mid)) if inclusive else math.cos(mid)
    dlat = res_km / KM_PER_DEGREE
    dlon = res_km / (KM_PER_DEGREE * squeeze)
    return (_steps(lat_min, lat_max, dlat, inclusive), _steps(lon_min, lon_max, dlon, inclusive),
            dlat, dlon)


def grid(spark: SparkSession, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
         res_km: float = 4.0, inclusive: bool = False) -> DataFrame:
    """Row-major mesh ``cell_id, row, col, lat, lon``.

    Half-open ranges; ``inclusive`` keeps an edge within 1e-6 degrees.
    """
    rows, cols, dlat, dlon = grid_shape(lat_min, lat_max, lon_min, lon_max, res_km, inclusive)
    row = F.floor(F.col("id") / F.lit(cols)).cast("int")
    return (spark.range(rows * cols)
            .withColumns({"row": row, "col": (F.col("id") % cols).cast("int")})
            .select(F.col("id").alias("cell_id"), "row", "col",
                    (F.lit(float(lat_min)) + F.col("row") * F.lit(dlat)).alias("lat"),
                    (F.lit(float(lon_min)) + F.col("col") * F.lit(dlon)).alias("lon")))


def snap(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float,
         res_km: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add the ``cell_id`` of the mesh cell that owns each point (nearest lower corner)."""
    rows, cols, dlat, dlon = grid_shape(lat_min, lat_max, lon_min, lon_max, res_km)
    r = F.floor((F.col(lat) - F.lit(float(lat_min))) / F.lit(dlat))
    c = F.floor((F.col(lon) - F.lit(float(lon_min))) / F.lit(dlon))
    ok = r.between(0, rows - 1) & c.between(0, cols - 1)
    return df.withColumn("cell_id", F.when(ok, r * cols + c).cast("bigint"))


def to_north_up(cells: DataFrame, value: str, n_rows: int) -> DataFrame:
    """Cells as an image with row 0 in the north; a missing value is NULL."""
    return cells.select((F.lit(n_rows - 1) - F.col("row")).cast("int").alias("img_row"),
                        F.col("col").cast("int").alias("img_col"), F.col(value).alias("value"))


def image_rows(image: DataFrame) -> DataFrame:
    """One array per image row, in column order; a row is one raster line long."""
    return (image.groupBy("img_row")
            .agg(F.array_sort(F.collect_list(F.struct("img_col", "value"))).alias("_p"))
            .select("img_row", F.col("_p.value").alias("values")))
