"""Domain tables derived from the driver's tables, for Spark and as SQL text.

Both engines evaluate the same expressions; coordinates come from integer
arithmetic on keys, inside 31-49 N, 125-103 W.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrascout.session import tune

LAT0 = 40.0
FROZEN = "2024-01-10 00:00:00"


def _place(key: str, a: int, b: int) -> dict[str, str]:
    return {"lat": f"31 + cast(({key} * {a}) % 18000 as double) / 1000",
            "lon": f"-125 + cast(({key} * {b}) % 22000 as double) / 1000"}


# name -> (driver table, {column: expression})
TABLES: dict[str, tuple[str, dict[str, str]]] = {
    "sites": ("supplier", {
        "site_id": "s_suppkey", "name": "s_name", **_place("s_suppkey", 7919, 104729), "bal": "s_acctbal"}),
    "cells": ("customer", {
        "cell_id": "c_custkey", **_place("c_custkey", 6007, 15485863), "segment": "c_mktsegment",
        "bal": "c_acctbal"}),
    "springs": ("orders", {
        "spring_id": "o_orderkey", **_place("o_orderkey", 7877, 130043),
        "spring_t": "case when o_orderpriority like '5%' then null else o_totalprice / 5000 end"}),
    "chem": ("events", {
        "sample_id": "event_id", **_place("event_id", 9973, 611953), "sio2": "value", "na": "value * 3",
        "k": "cast(1 + user_id % 40 as double)", "li": "value / 50", "cl": "value * 7"}),
    "stations": ("events", {
        "station_id": "event_id", **_place("event_id", 8191, 524287), "hf": "value"}),
    "scores": ("events", {
        "cell_id": "event_id", "p_a": "value / 491", "p_b": "cast((event_id * 7919) % 1000 as double) / 1000",
        "p_std": "cast((event_id * 31) % 100 as double) / 400",
        "label": "case when event_type = 'error' then 1 else 0 end", **_place("event_id", 9973, 611953)}),
    "permits": ("orders", {
        "permit_id": "o_orderkey", "filed": "cast(o_orderdate as date)", "status": "o_orderstatus",
        "priority": "o_orderpriority", **_place("o_orderkey", 3571, 179424673)}),
    "faults": ("orders", {
        "fault_id": "o_custkey", "part": "0", "seq": "o_orderkey",
        "lat": "31 + cast((o_custkey * 6007) % 18000 as double) / 1000 + cast((o_orderkey * 37) % 100 - 50 as double) / 500",
        "lon": "-125 + cast((o_custkey * 15485863) % 22000 as double) / 1000 + cast((o_orderkey * 53) % 100 - 50 as double) / 500",
        "slip_text": "case o_custkey % 5 when 0 then 'Less than 0.2 mm/yr' when 1 then 'Between 0.2 and 1.0 mm/yr' "
                     "when 2 then 'Between 1.0 and 5.0 mm/yr' when 3 then 'Unspecified' else '0.7 +/- 0.1 mm/yr' end"}),
    "pixels": ("part", {
        "prow": "cast(floor(p_partkey / 50) as int)", "pcol": "cast(p_partkey % 50 as int)",
        "value": "p_retailprice - 950 + p_size"}),
    "outcomes": ("events", {
        "outcome_id": "event_id", "ts": "ts",
        "outcome": "case when event_type = 'purchase' then 'success' when event_type = 'error' then 'dry' else 'other' end",
        **_place("event_id", 7919, 104729)}),
}

_RING_LAT = "33 + cast((n_nationkey * 5) % 15 as double) + (0.8 + 0.2 * (n_nationkey % 3)) * sin(seq * 0.7853981633974483)"
_RING_LON = "-122 + cast((n_nationkey * 11) % 17 as double) + (0.8 + 0.2 * (n_nationkey % 3)) * cos(seq * 0.7853981633974483)"
_RING_LITH = ("case n_nationkey % 4 when 0 then 'Igneous, volcanic' when 1 then 'Igneous, intrusive' "
              "when 2 then 'Sedimentary, clastic' else 'Unconsolidated, undifferentiated' end")

X_SQL = "lon * 111.32 * cos(radians(40.0))"
Y_SQL = "lat * 111.32"
DIST = "round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 9)"


def _table_sql(name: str) -> str:
    if name == "rings":
        inner = (f"select cast(n_nationkey as bigint) as poly_id, seq, {_RING_LAT} as lat, {_RING_LON} as lon, "
                 f"{_RING_LITH} as lith from nation cross join range(8) as v(seq)")
    else:
        table, cols = TABLES[name]
        inner = f"select {', '.join(f'{e} as {c}' for c, e in cols.items())} from {table}"
    if name == "pixels":
        return f"fx_pixels as ({inner})"
    return f"fx_{name} as (select *, {X_SQL} as x, {Y_SQL} as y from ({inner}))"


def sql(tables: str, body: str, *ctes: str) -> str:
    """A query over the named fixtures; ``ctes`` are further ``name as (...)`` parts."""
    parts = [_table_sql(t) for t in tables.split()] + list(ctes)
    head = "with recursive " + ",\n".join(parts) + "\n" if parts else ""
    return head + body


def r6(expr: str, digits: int = 6) -> str:
    """Rounded number in SQL; adding zero removes the sign of zero."""
    return f"(round({expr}, {digits}) + 0.0)"


class Fixtures:
    """Attribute access to the domain tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.folder, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        table, cols = TABLES[name]
        return self.table(table).selectExpr(*[f"{e} as {c}" for c, e in cols.items()])

    @cached_property
    def rings(self) -> DataFrame:
        corners = self.table("nation").selectExpr("*", "explode(sequence(0L, 7L)) as seq")
        return corners.selectExpr("cast(n_nationkey as bigint) as poly_id", "seq", f"{_RING_LAT} as lat",
                                  f"{_RING_LON} as lon", f"{_RING_LITH} as lith")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query over the fixtures and, if there is one, its SQL."""
    def register(fn: Callable[[Fixtures], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Fixtures(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """The Spark side of ``r6``."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in cols})
