"""Streaming runs over the given events, read to their end."""

from __future__ import annotations

from checks import inputs as I
from checks.base import query
from checks.gold_queries import gold_sql
from talktally.operators.gates import with_day
from talktally.session import scratch_path
from talktally.streaming import live
from pyspark.sql import functions as F


def event_stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = I.table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return I.fires_of(rows)


def _totals(spark, increments, name):
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    counts = live.running_counts(increments)
    live.start_running_counts(counts, path, checkpoint).awaitTermination()
    return live.read_running_counts(spark, path).select("tenant_id", "date", "metric_name", "value")


def event_files(spark, sf_dir, parts=12):
    """The events as a stream of many files, one a micro-batch."""
    path = scratch_path(spark, "event-files")
    rows = I.table(spark, sf_dir, "events")
    rows.repartition(parts, "event_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return I.fires_of(stream)


@query(gold_sql("metric_name LIKE 'operator%'"))
def stream_many_batches(spark, sf_dir):
    """Running totals over more than ten micro-batches; the files are not in the order of time, so the state lives long."""
    rows = with_day(event_files(spark, sf_dir)).withWatermark("received_at", "4000 days")
    name = F.concat(F.lit("operator_"), "operator_name", F.lit("_count")).alias("metric_name")
    return _totals(spark, rows.select("tenant_id", "date", "received_at", name, F.lit(1.0).alias("inc")), "many")


@query(gold_sql("metric_name LIKE 'operator%'"))
def stream_daily_counts(spark, sf_dir):
    rows = with_day(event_stream(spark, sf_dir)).withWatermark("received_at", live.STATE_DELAY)
    name = F.concat(F.lit("operator_"), "operator_name", F.lit("_count")).alias("metric_name")
    return _totals(spark, rows.select("tenant_id", "date", "received_at", name, F.lit(1.0).alias("inc")), "daily")


@query(gold_sql("metric_name = 'conversation_count'"))
def stream_dedup_counts(spark, sf_dir):
    rows = with_day(event_stream(spark, sf_dir))
    seen = live.first_seen(rows, ("tenant_id", "date", "conversation_id"))
    counted = seen.select("tenant_id", "date", "received_at", F.lit("conversation_count").alias("metric_name"), F.lit(1.0).alias("inc"))
    return _totals(spark, counted, "dedup")


@query(gold_sql("metric_name NOT LIKE 'first%'"))
def stream_all_counts(spark, sf_dir):
    """Every counter that needs no order among the fires of a conversation."""
    cfg = I.only(operators=("click", "view", "purchase", "error"))
    return _totals(spark, live.streamed_increments(event_stream(spark, sf_dir), cfg), "all")


@query(gold_sql("metric_name NOT LIKE 'nothing'").replace("FROM g WHERE", "FROM (SELECT * FROM g UNION ALL SELECT * FROM daily) WHERE"))
def stream_silver_gold(spark, sf_dir):
    """Fires stored per micro-batch, touched days rebuilt: the exact batch result."""
    root = scratch_path(spark, "silver")
    cfg = I.config()

    def run(batch, batch_id):
        live.store_fires(batch, f"{root}/fires", batch_id)
        stored = live.read_fires(spark, f"{root}/fires")
        days = live.touched_days(stored)
        live.recompute(stored, days, cfg, f"{root}/metrics")

    live.start_silver(event_stream(spark, sf_dir), run, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/metrics").select("tenant_id", "date", "metric_name", "value")
