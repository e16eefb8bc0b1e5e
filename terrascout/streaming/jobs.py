"""Structured Streaming jobs (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrascout.operators import tiles
from terrascout.operators.models import CellModel
from terrascout.session import cut, steps

VERIFY_KM = 25.0
FALSIFY_KM = 5.0


def score_stream(rows: DataFrame, model: CellModel, out: str = "score") -> DataFrame:
    """Feature rows scored as they arrive (ST1); the same code scores a table."""
    return model.score(rows, out)


_RESULT = ["ts", "outcome", "lat", "lon"]


def _results(rows: DataFrame, frozen: str) -> DataFrame:
    """Distinct successes and dry holes after the frozen time."""
    later = rows.filter((F.col("ts") > F.lit(frozen).cast("timestamp")) & F.col("outcome").isin("success", "dry"))
    return later.select("outcome_id", *_RESULT).distinct()


def _first(results: DataFrame) -> DataFrame:
    """One result for each outcome_id: the earliest, then the smallest in its other columns."""
    return results.groupBy("outcome_id").agg(F.min(F.struct(*_RESULT)).alias("_r")).select("outcome_id", "_r.*")


def _matched(results: DataFrame, manifest: DataFrame, site_id: str, lat0: float) -> DataFrame:
    """Results with the sites that they verify or falsify."""
    keyed = results.withColumn("_key", F.struct("outcome_id", *_RESULT))
    near = tiles.within(keyed, manifest, VERIFY_KM, q_id="_key", t_id=site_id, lat0=lat0)
    status = (F.when(F.col("_key.outcome") == "success", "verified")
              .when(F.col("dist_km") <= FALSIFY_KM, "falsified"))
    return near.withColumn("status", status).filter(F.col("status").isNotNull()).select("_key.*", site_id, "status", "dist_km")


def outcomes(rows: DataFrame, manifest: DataFrame, frozen: str, *, site_id: str = "site_id", lat0: float) -> DataFrame:
    """Drilling results after the frozen time matched with the manifest's sites (ST2).

    A success within 25 km verifies a site, a dry hole within 5 km falsifies it.  ``rows`` has
    ``outcome_id, ts, outcome, lat, lon``; an outcome_id counts once, with its earliest result.
    The join is an equi-join on tiles.
    """
    found = _matched(_first(_results(rows, frozen)), manifest, site_id, lat0)
    return found.select("outcome_id", site_id, "ts", "status", "dist_km")


def monitor(stream: DataFrame, manifest: DataFrame, frozen: str, path: str, checkpoint: str, *, site_id: str = "site_id",
            lat0: float) -> StreamingQuery:
    """Process what a stream of results holds and stop; ``monitored`` reads the outcome (ST2).

    Each micro-batch adds the results that are not stored yet, and their matches, to the
    tables below ``path``.  Nothing expires: a result counts once however late it comes and
    however often, and a batch that is run again replaces what it wrote.  As a micro-batch
    is a table, its join is dealt out like any other, be it a backlog of years.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = _results(batch, frozen)
        if number:
            stored = spark.read.parquet(f"{path}/results").filter(F.col("batch") < number)
            new = new.join(stored, ["outcome_id", *_RESULT], "left_anti")
        new = cut(new)
        _matched(new, manifest, site_id, lat0).write.mode("overwrite").parquet(f"{path}/matches/batch={number}")
        new.write.mode("overwrite").parquet(f"{path}/results/batch={number}")

    def run(batch: DataFrame, number: int) -> None:
        with steps(batch.sparkSession):
            merge(batch, number)

    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def monitored(spark: SparkSession, path: str, site_id: str = "site_id") -> DataFrame:
    """What ``monitor`` has found so far, equal to ``outcomes`` over all results together, in whatever order they came."""
    first = _first(spark.read.parquet(f"{path}/results").drop("batch"))
    matches = spark.read.parquet(f"{path}/matches").drop("batch")
    same = [first[c].eqNullSafe(matches[c]) for c in _RESULT]
    found = matches.join(first, [matches["outcome_id"] == first["outcome_id"], *same], "left_semi")
    return found.select("outcome_id", site_id, "ts", "status", "dist_km")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop, appending to a Parquet folder."""
    query = (stream.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", checkpoint).outputMode("append")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
