"""Which fires count: trigger allow-lists and one fire per conversation and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.config import MetricsConfig, Operator
from talktally.functions.values import day_stamp

# Total order of fires: arrival, then source document.
FIRE_ORDER = ("received_at", "source_uri")
SLOT = ("tenant_id", "date", "operator_name", "conversation_id")


def with_day(fires: DataFrame, time_col: str = "received_at") -> DataFrame:
    """Add `date`, the UTC arrival day unless another time column is asked for."""
    return fires.withColumn("date", day_stamp(F.col(time_col)))


def of_operator(op: Operator) -> Column:
    return F.col("operator_name").isin(op.names)


def trigger_passes(op: Operator) -> Column:
    """A missing trigger passes; a present one must be on the list."""
    if op.triggers is None:
        return F.lit(True)
    missing = F.col("trigger").isNull() | (F.col("trigger") == "")
    return missing | F.col("trigger").isin(list(op.triggers))


def counted(op: Operator) -> Column:
    return of_operator(op) & trigger_passes(op)


def gate(fires: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """Fires of configured operators that pass their trigger list.

    `once_per_conversation` is applied by `first_fire` after the payload has been
    reduced to what is counted, so whole payloads are not shuffled for it.
    """
    passes = F.lit(False)
    for op in cfg.operators:
        passes = passes | counted(op)
    return fires.where(passes)


def once_names(cfg: MetricsConfig) -> list[str]:
    return [name for op in cfg.operators if op.once_per_conversation for name in op.names]


def first_fire(df: DataFrame, value: str, keys: Sequence[str] = SLOT, order: Sequence[str] = FIRE_ORDER) -> DataFrame:
    """`value` of the first fire per slot; combined on the map side before the shuffle."""
    picked = F.min_by(F.struct(value), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("_first")).select(*keys, F.col(f"_first.{value}").alias(value))


def apply_once(df: DataFrame, cfg: MetricsConfig, value: str) -> DataFrame:
    """Keep every fire of ordinary operators and the first one of the others.

    The result has the slot columns and `value` only.
    """
    names = once_names(cfg)
    slim = [*SLOT, value]
    if not names:
        return df.select(*slim)
    once = F.col("operator_name").isin(names)
    return df.where(~once).select(*slim).unionByName(first_fire(df.where(once), value).select(*slim))
