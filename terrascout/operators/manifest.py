"""Frozen manifests, quality rules and the summary card (M1-M5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrascout.functions.portable import fixed
from terrascout.operators.rank import cumulate
from terrascout.session import cut

CHUNK_ROWS = 10_000


def row_text(df: DataFrame, cols: Sequence[str], digits: int = 6) -> Column:
    """One CSV line per row with doubles in fixed notation."""
    parts = []
    for name in cols:
        kind = df.schema[name].dataType.typeName()
        col = fixed(name, digits) if kind in ("double", "float") else F.col(name).cast("string")
        parts.append(F.coalesce(F.when(F.col(name).isNotNull(), col), F.lit("")))
    return F.concat_ws(",", *parts)


def table_hash(df: DataFrame, cols: Sequence[str], id_col: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """SHA-256 over the rows in id order: (n_rows, sha256).

    Rows are hashed in chunks of ``chunk_rows`` consecutive rows; the result is
    the hash of the chunk hashes in order, in as many levels as it takes.
    """
    lines = cumulate(df.withColumn("_line", row_text(df, cols)), id_col, id_col)

    def joined(order: str, text: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(order, text)))
        return F.sha2(F.array_join(F.transform(pairs, lambda s: s[text]), "\n"), 256)

    level = cut(lines.groupBy(F.floor((F.col("rn") - 1) / F.lit(chunk_rows)).alias("_chunk"))
                .agg(joined("rn", "_line").alias("_h"), F.count(F.lit(1)).alias("_n")))
    # A tree: no row ever holds more than chunk_rows lines or hashes.
    while level.count() > chunk_rows:
        level = cut(level.groupBy(F.floor(F.col("_chunk") / F.lit(chunk_rows)).alias("_up"))
                    .agg(joined("_chunk", "_h").alias("_h"), F.sum("_n").alias("_n")).withColumnRenamed("_up", "_chunk"))
    return level.agg(F.sum("_n").alias("n_rows"), joined("_chunk", "_h").alias("sha256"))


MANIFEST_COLUMNS = ["discovery_id", "lat", "lon", "area_km2", "t_res_central", "mwe_p10", "mwe_p50", "mwe_p90",
                    "province", "plausibility"]


def manifest(df: DataFrame, cols: Sequence[str] = MANIFEST_COLUMNS, id_col: str = "discovery_id") -> DataFrame:
    """Hash, counts, sums and the sites per province as one row (M1)."""
    sums = df.agg(F.count(F.lit(1)).alias("n_sites"), *[F.sum(f"mwe_{q}").alias(f"mwe_{q}") for q in ("p10", "p50", "p90")],
                  F.count_if(F.col("plausibility") == "plausible").alias("plausible_count"))
    names = df.groupBy("province").agg(F.count(F.lit(1)).alias("n"))
    listed = names.agg(F.array_join(F.array_sort(F.collect_list(
        F.concat("province", F.lit(":"), F.col("n").cast("string")))), ",").alias("provinces"))
    one = F.lit(1).alias("_j")
    return (sums.select("*", one).join(listed.select("*", one), "_j")
            .join(table_hash(df, cols, id_col).select("sha256", one), "_j").drop("_j"))


def verify(df: DataFrame, sha256: str, cols: Sequence[str] = MANIFEST_COLUMNS, id_col: str = "discovery_id") -> DataFrame:
    """Recompute the hash and compare (M2): (sha256, matches)."""
    return table_hash(df, cols, id_col).select("sha256", (F.col("sha256") == F.lit(sha256)).alias("matches"))


def quality_checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) for predicates that should never hold, in one pass (M3)."""
    wide = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(f"r{i}") for i, bad in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("violations")) for i, n in enumerate(rules)])
    return wide.select(F.explode(pairs).alias("_e")).select("_e.rule", "_e.violations")


def dangling(df: DataFrame, key: str, parent: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """Rows whose key is missing in the parent table, as a quality rule (M3)."""
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    lost = df.filter(F.col(key).isNotNull()).join(known, key, "left_anti")
    return lost.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def summary_card(parts: Sequence[DataFrame]) -> DataFrame:
    """One-row tables side by side (M5)."""
    out = parts[0].withColumn("_j", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_j", F.lit(1)), "_j")
    return out.drop("_j")
