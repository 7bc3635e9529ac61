"""Daily counters: roll increments up, compare two versions, export key-value rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktally.functions.keys import aggregate_keys

GOLD_KEYS = ("tenant_id", "date", "metric_name")


def rollup(emitted: DataFrame) -> DataFrame:
    """Sum per tenant, day and metric; nine decimals, so summation order cannot show."""
    return emitted.groupBy(*GOLD_KEYS).agg(F.round(F.sum("inc"), 9).alias("value"))


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that would be added, removed or changed by replacing `old` with `new`."""
    both = old.select(*GOLD_KEYS, F.col("value").alias("old_value")).join(
        new.select(*GOLD_KEYS, F.col("value").alias("new_value")), list(GOLD_KEYS), "full_outer"
    )
    change = (
        F.when(F.col("old_value").isNull(), "added")
        .when(F.col("new_value").isNull(), "removed")
        .when(F.col("old_value") != F.col("new_value"), "changed")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull())


def key_value_rows(gold: DataFrame) -> DataFrame:
    """Gold rows in the exported spine-and-payload shape."""
    pk, sk = aggregate_keys(F.col("tenant_id"), F.col("date"), F.col("metric_name"))
    return gold.select(
        pk.alias("PK"),
        sk.alias("SK"),
        F.col("tenant_id").alias("tenantId"),
        "date",
        F.col("metric_name").alias("metricName"),
        F.lit("AGGREGATE").alias("entityType"),
        F.to_json(F.struct("value")).alias("payload"),
    )


def copy_counts(gold: DataFrame, tenants: list[str] | None = None) -> DataFrame:
    """Rows per tenant that a copy would move."""
    chosen = gold if tenants is None else gold.where(F.col("tenant_id").isin(tenants))
    return chosen.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("scanned"))


def tenants_in(gold: DataFrame) -> DataFrame:
    return gold.select("tenant_id").distinct()


def metric_names_in(gold: DataFrame) -> DataFrame:
    return gold.select("tenant_id", "metric_name").distinct()
