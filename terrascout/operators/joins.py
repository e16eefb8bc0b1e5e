"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrascout.session import cut

FEW = 256  # rows of a key that never matter


def share_of(rows: int, df: DataFrame) -> float:
    """Rows from which a key counts as frequent: a quarter of an even partition."""
    return max(float(FEW), rows / (4.0 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def frequent(counts: DataFrame, key: str, share: float) -> DataFrame | None:
    """(key, _parts): keys whose ``_n`` is above ``share``, with the parts to deal them over; None without any."""
    found = cut(counts.filter(F.col(key).isNotNull() & (F.col("_n") > share))
                .select(key, F.ceil(F.col("_n") / F.lit(share)).cast("int").alias("_parts")))
    return None if found.isEmpty() else found


def frequent_keys(many: DataFrame, key: str) -> DataFrame | None:
    """``frequent`` of a written table."""
    share = share_of(many.count(), many)
    return frequent(many.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, share)


def look_up(many: DataFrame, key: str, few: DataFrame, hot: DataFrame | None, how: str = "left") -> DataFrame:
    """``many`` with the columns of the row of ``few`` that has its ``key``; ``few`` has one row a key.

    ``hot`` are the frequent keys of ``many`` with their ``_parts`` (``frequent_keys``).  Their rows
    are dealt over the parts by a hash of the other columns, and the key's row of ``few`` is
    sent to each part.  Fewer than four times as many keys as shuffle partitions can be
    frequent, which bounds the broadcast.  A NULL key finds nothing.
    """
    if hot is None:
        return many.join(few, key, how)
    hot, number = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    others = [F.col(f"`{c}`") for c in many.columns if c != key]
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*others), number).cast("int")).drop("_parts")
    right = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), number - 1))).drop("_parts")
    return left.join(right, [key, "_salt"], how).drop("_salt")
