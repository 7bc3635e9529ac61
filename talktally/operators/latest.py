"""Keep one row per key, by an explicit total order."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.session import config_table, scratch_path


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in `order`.

    Catalyst turns `row_number() = 1` into a group limit before and after the
    shuffle, so a hot key sends at most one row per input partition.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest(df: DataFrame, keys: Sequence[str], *by: str) -> DataFrame:
    return one_per_key(df, keys, [F.col(c).desc() for c in by])


def positions(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Rows with their `position` in `order`, from 1 on.

    A window over all rows would put them into one task. The sorted rows are stored with their place in their part of the
    order instead, and what reaches the driver is the size of each part.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "sorted")
    df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_place", 33))
    sizes = sorted((r._part, r["count"]) for r in rows.groupBy("_part").count().collect())
    starts, before = {"_part": [], "_before": []}, 0
    for part, size in sizes:
        starts["_part"].append(part)
        starts["_before"].append(before)
        before += size
    known = config_table(spark, starts, pa.schema([("_part", pa.int64()), ("_before", pa.int64())]))
    place = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(known, "_part").withColumn("position", place).drop("_part", "_place", "_before")
