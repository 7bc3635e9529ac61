"""Rates and averages from counters, per day and per period."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talktally.config import Derived, MetricsConfig
from talktally.functions.values import ratio2
from talktally.session import config_table

PERIOD = "period"
ROLES = pa.list_(pa.struct([("derived_name", pa.string()), ("scale", pa.float64()), ("is_numerator", pa.bool_())]))


def _roles(df: DataFrame, defs: list[Derived]) -> DataFrame:
    """Metric name to the derived definitions it feeds, as numerator or denominator."""
    rows = [(d.numerator, d.name, d.scale, True) for d in defs]
    rows += [(d.denominator, d.name, d.scale, False) for d in defs]
    names, derived, scales, numerators = (list(c) for c in zip(*rows, strict=True))
    return config_table(
        df.sparkSession,
        {"metric_name": names, "derived_name": derived, "scale": scales, "is_numerator": numerators},
    )


def _parts(gold: DataFrame, defs: list[Derived]) -> DataFrame:
    used = gold.join(_roles(gold, defs), "metric_name")
    return used.select(
        "tenant_id",
        "date",
        "derived_name",
        "scale",
        F.when(F.col("is_numerator"), F.col("value")).alias("num"),
        F.when(~F.col("is_numerator"), F.col("value")).alias("den"),
    )


def _finish(sums: DataFrame) -> DataFrame:
    value = ratio2(F.col("num"), F.col("den"), F.col("scale"))
    return sums.select("tenant_id", "date", F.col("derived_name").alias("metric_name"), value.alias("value")).where(
        F.col("value").isNotNull()
    )


def derive(gold: DataFrame, defs: list[Derived]) -> DataFrame:
    """Derived rows per tenant and day. Both counters must exist; absent is not zero."""
    keys = ["tenant_id", "date", "derived_name", "scale"]
    return _finish(_parts(gold, defs).groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den")))


def with_derived(raw: DataFrame, defs: list[Derived]) -> DataFrame:
    """The raw rows and their daily derived rows, with the raw rows computed once.

    Every raw row goes on under its own name and once per definition it feeds;
    one aggregation then closes both kinds.
    """
    feeds: dict[str, list[dict]] = {}
    for d in defs:
        for name, is_numerator in ((d.numerator, True), (d.denominator, False)):
            feeds.setdefault(name, []).append({"derived_name": d.name, "scale": d.scale, "is_numerator": is_numerator})
    roles = config_table(
        raw.sparkSession, {"metric_name": list(feeds), "roles": list(feeds.values())}, pa.schema([("metric_name", pa.string()), ("roles", ROLES)])
    )
    role = "struct<derived_name:string,scale:double,is_numerator:boolean>"
    itself = F.array(F.lit(None).cast(role))
    each = F.explode_outer(F.concat(itself, F.coalesce("roles", F.array().cast(f"array<{role}>"))))
    rows = raw.join(roles, "metric_name", "left").select("tenant_id", "date", "metric_name", "value", each.alias("r"))
    name = F.coalesce("r.derived_name", "metric_name").alias("metric_name")
    sums = rows.groupBy("tenant_id", "date", name).agg(
        F.sum(F.when(F.col("r").isNull(), F.col("value"))).alias("raw_value"),
        F.sum(F.when(F.col("r.is_numerator"), F.col("value"))).alias("num"),
        F.sum(F.when(~F.col("r.is_numerator"), F.col("value"))).alias("den"),
        F.max("r.scale").alias("scale"),
    )
    value = F.coalesce("raw_value", ratio2(F.col("num"), F.col("den"), F.col("scale")))
    closed = sums.select("tenant_id", "date", "metric_name", value.alias("value"))
    return closed.where(F.col("value").isNotNull())


def derive_period(gold: DataFrame, defs: list[Derived]) -> DataFrame:
    """Derived rows of the whole range: sum first, then divide. `date` is 'period'."""
    keys = ["tenant_id", "derived_name", "scale"]
    sums = _parts(gold, defs).groupBy(*keys).agg(F.sum("num").alias("num"), F.sum("den").alias("den"))
    return _finish(sums.withColumn("date", F.lit(PERIOD)))


def derive_all(gold: DataFrame, defs: list[Derived]) -> DataFrame:
    """Per-day and period rows together, in one aggregation."""
    keys = ["tenant_id", "derived_name", "scale"]
    sums = _parts(gold, defs).groupingSets([[*keys, "date"], keys], *keys, "date").agg(
        F.sum("num").alias("num"), F.sum("den").alias("den"), F.grouping("date").alias("_all_days")
    )
    date = F.when(F.col("_all_days") == 1, PERIOD).otherwise(F.col("date"))
    return _finish(sums.withColumn("date", date))


def raw_only(gold: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """Drop stored derived rows, which are computed anew for every range."""
    names = config_table(gold.sparkSession, {"metric_name": [d.name for d in cfg.derived()]})
    return gold.join(names, "metric_name", "left_anti").select(*gold.columns)
