"""Point sources from CSV files with drifting headers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascout.functions.geo import parse_coord, to_number

# Output column -> substrings, the first header containing one of them is taken.
LATLON = {"lat": ["lat"], "lon": ["lon"]}


def _pick(columns: Sequence[str], needles: Sequence[str]) -> str | None:
    return next((c for c in columns if any(n in c for n in needles)), None)


def map_points(df: DataFrame, spec: dict[str, Sequence[str]], text: Sequence[str] = (),
               dms: bool = False) -> DataFrame | None:
    """Lower/trim headers, choose columns by substring, coerce, drop placeless rows.

    ``spec`` maps an output column to header substrings in order; ``lat`` and
    ``lon`` are required (``None`` is returned without them).  Columns listed in
    ``text`` stay strings, a missing optional column becomes NULL, and ``dms``
    also reads degree-minute coordinates.
    """
    df = df.toDF(*[c.lower().strip() for c in df.columns])
    picked = {out: _pick(df.columns, needles) for out, needles in spec.items()}
    if picked.get("lat") is None or picked.get("lon") is None:
        return None
    cols = []
    for out, name in picked.items():
        if name is None:
            col = F.lit(None).cast("string" if out in text else "double")
        elif out in text:
            col = F.col(f"`{name}`").cast("string")
        elif dms and out in ("lat", "lon"):
            col = parse_coord(F.col(f"`{name}`").cast("string"))
        else:
            col = to_number(F.col(f"`{name}`").cast("string"))
        cols.append(col.alias(out))
    return df.select(*cols).dropna(subset=["lat", "lon"])


def read_points(spark: SparkSession, path: str, spec: dict[str, Sequence[str]] | None = None,
                text: Sequence[str] = (), dms: bool = False) -> DataFrame | None:
    """One CSV file or folder."""
    return map_points(spark.read.option("header", True).csv(path), spec or LATLON, text, dms)


def read_many(spark: SparkSession, paths: Sequence[str], spec: dict[str, Sequence[str]],
              text: Sequence[str] = (), dms: bool = False, skipped: list[str] | None = None) -> DataFrame:
    """Several header families, each mapped by itself, concatenated.

    A family without coordinates is skipped, as is a path that is not there or no table;
    their paths are added to ``skipped``.  Any other error of the storage is raised.
    """
    frames = []
    for path in paths:
        try:
            frame = read_points(spark, path, spec, text, dms)
        except AnalysisException:
            frame = None
        if frame is not None:
            frames.append(frame)
        elif skipped is not None:
            skipped.append(path)
    if not frames:
        raise ValueError("no readable point file with coordinates")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_select(spark: SparkSession, path: str, rename: dict[str, str],
                numeric: Sequence[str] = ()) -> DataFrame:
    """Only the named columns, renamed; Spark prunes the rest of the CSV (S3)."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*[
        (to_number(F.col(f"`{old}`")) if new in numeric else F.col(f"`{old}`")).alias(new)
        for old, new in rename.items()])


def read_commented(spark: SparkSession, path: str, schema: str | None = None,
                   header: bool = True) -> DataFrame:
    """CSV with ``#`` comment lines."""
    reader = spark.read.option("header", header).option("comment", "#")
    return (reader.schema(schema) if schema else reader).csv(path)
