"""Counters as increments that add up over batches, whatever order the fires arrive in.

Rows of a tenant and day are of these kinds:

* `sum`: an amount of a metric; amounts add up.
* `once`: a key that counts once, such as a conversation of the day; copies of it meet.
* `first`: what the first fire of a slot counts, with its position; of several, the earliest stays, so an
  earlier fire that arrives later takes the place of the one that counted. A slot whose first fire counts nothing
  has a row without a metric.
* `day`: the number of fires and their digest, which add up too.

`folded` makes fewer rows of the same meaning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktally.config import MetricsConfig
from talktally.operators.emit import expand, operator_count, timing_increments, with_increments
from talktally.operators.gates import FIRE_ORDER, gate, with_day
from talktally.operators.gold import rollup

POSITION = T.StructType([T.StructField("received_at", T.TimestampType()), T.StructField("source_uri", T.StringType())])
SCHEMA = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("position", POSITION),
        T.StructField("metric_name", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("digest", T.DecimalType(38, 0)),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("date", T.StringType()),
    ]
)
DAY = ["tenant_id", "date"]


def _rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """`df` in the shape of increments; a column neither given nor there is null."""
    given = {"kind": F.lit(kind), **{c: F.col(c) for c in df.columns}, **columns}
    return df.select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA))


def _first(rows: DataFrame) -> DataFrame:
    """`first` rows of fires with `key` and `increments`."""
    position = F.struct(*FIRE_ORDER)
    picked = rows.groupBy(*DAY, "key").agg(F.min_by(F.struct("increments"), position).alias("_first"), F.min(position).alias("position"))
    flat = picked.select(*DAY, "key", "position", F.inline_outer("_first.increments"))
    return _rows(flat.groupBy(*DAY, "key", "position", "metric_name").agg(F.sum("inc").alias("value")), "first")


def increments(fires: DataFrame, cfg: MetricsConfig, digests: DataFrame) -> DataFrame:
    """All rows of fires with prepared payloads; `digests` are their (tenant_id, date, fires, digest).

    The same counters as `emit_all`, but that a transcript's timing counts once on each day it has fires.
    """
    dated = with_day(fires)
    every_fire, first_only = cfg.split_once()
    sums = rollup(expand(with_increments(dated, every_fire, [operator_count()])))
    seen = dated.select(*DAY, F.col("conversation_id").alias("key")).distinct()
    parts = [
        _rows(sums, "sum", key=F.lit("")),
        _rows(seen, "once", metric_name=F.lit("conversation_count"), value=F.lit(1.0)),
        _rows(digests, "day", key=F.lit(""), value=F.col("fires")),
    ]
    if first_only.operators:
        slot = F.to_json(F.array("operator_name", "conversation_id"))
        parts.append(_first(with_increments(gate(dated, first_only), first_only).withColumn("key", slot)))
    if {"timing", "transcript_sid"} <= set(fires.columns):
        timed = dated.where(F.col("timing").isNotNull()).withColumn("increments", timing_increments())
        parts.append(_first(timed.withColumn("key", F.to_json(F.array(F.lit(None), "transcript_sid")))))
    return reduce(DataFrame.unionByName, parts)


def folded(rows: DataFrame) -> DataFrame:
    """Fewer rows with the same totals, which may be folded again with others."""
    keys = [*DAY, "kind", "key", "metric_name"]
    added = rows.where(F.col("kind").isin("sum", "day")).groupBy(*keys).agg(F.round(F.sum("value"), 9).alias("value"), F.sum("digest").alias("digest"))
    met = rows.where(F.col("kind") == "once").groupBy(*keys).agg(F.max("value").alias("value"))
    slot = Window.partitionBy(*DAY, "key")
    firsts = rows.where(F.col("kind") == "first").withColumn("_least", F.min("position").over(slot))
    firsts = firsts.where(F.col("position") == F.col("_least")).dropDuplicates([*DAY, "key", "metric_name"])
    shaped = [df.select(*(_or_null(df, f) for f in SCHEMA)) for df in (added, met, firsts)]
    return reduce(DataFrame.unionByName, shaped)


def _or_null(df: DataFrame, field: T.StructField) -> Column:
    column = F.col(field.name) if field.name in df.columns else F.lit(None)
    return column.cast(field.dataType).alias(field.name)


def totals(rows: DataFrame) -> DataFrame:
    """The counters of increments, in the shape of gold rows."""
    counted = folded(rows).where((F.col("kind") != "day") & F.col("metric_name").isNotNull())
    return rollup(counted.withColumnRenamed("value", "inc"))


def digests(rows: DataFrame) -> DataFrame:
    """(tenant_id, date, fires, digest) the increments stand for."""
    days = rows.where(F.col("kind") == "day").groupBy(*DAY)
    return days.agg(F.sum("value").cast("long").alias("fires"), F.sum("digest").alias("digest"))
