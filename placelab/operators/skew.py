"""Equi-joins that stay balanced when a single key holds a third of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 100_000


def hot_keys(sizes: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Keys with more than ``HOT_ROWS`` rows and the number of salts that brings them back under it.

    At most total/HOT_ROWS keys qualify, so this table is small enough to broadcast.
    """
    return sizes.filter(F.col(size) > HOT_ROWS).select(
        *keys, F.ceil(F.col(size) / HOT_ROWS).cast("int").alias("_salts")
    )


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join on ``keys``; rows of hot keys are spread over salts and the other side repeated per salt."""
    spread_by = [c for c in rows.columns if c not in keys][:4]
    salted = (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread_by), F.col("_salts")).cast("int"), F.lit(0)))
        .drop("_salts")
    )
    repeated = (
        other.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """Join ``rows`` with ``per_key``: one row per key, with the key's row count in ``size`` (dropped).

    ``per_key`` is asked at once whether any key is hot, and should be cheap to read.
    """
    hot, other = hot_keys(per_key, keys, size), per_key.drop(size)
    return rows.join(other, keys, how) if hot.isEmpty() else salted_join(rows, other, keys, hot, how)
