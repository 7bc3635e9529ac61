"""Small keyed tables where the newest row of a key stays, whichever run brings it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.operators.latest import latest
from talktally.session import cut_lineage, prepare
from talktally.sources import lake

SHARES = 8
PARTITIONS = ("tenant_id", "share")


def put(rows: DataFrame, path: str, keys: Sequence[str], *newest_by: str) -> None:
    """Merge rows into the table: per key the newest by `newest_by`, stored or given. Only shares with given keys are opened.

    Runs may come in any order, and a repeated one changes nothing.
    """
    spark = prepare(rows.sparkSession)
    share = F.pmod(F.xxhash64(*[k for k in keys if k != "tenant_id"]), F.lit(SHARES)).cast("string")
    columns = [c for c in rows.columns if c != "tenant_id"]
    new = latest(rows, keys, *newest_by).withColumn("share", share).select(*columns, *PARTITIONS)
    if lake.exists(spark, path):
        new = cut_lineage(new)
        places = new.select(*PARTITIONS).distinct()
        old = spark.read.schema(new.schema).parquet(path).where(lake.within(places.collect(), *PARTITIONS))
        new = cut_lineage(latest(old.join(places, list(PARTITIONS), "left_semi").unionByName(new), keys, *newest_by))
    lake.write_partitions(new, path, PARTITIONS, [k for k in keys if k != "tenant_id"])


def read(spark: SparkSession, path: str, tenant: str | None = None) -> DataFrame:
    rows = prepare(spark).read.parquet(path).drop("share")
    return rows if tenant is None else rows.where(F.col("tenant_id") == tenant)
