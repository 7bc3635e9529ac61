"""Structured Streaming: bronze to silver, running daily counters, recompute of touched days.

Two ways to the same numbers:

* `running_counts` keeps counters in state and can be read at once. Its
  deduplication forgets after the watermark, and rows later than that are not in it.
* `start_silver` stores every fire and brings conversations, results, index and counters up to date with those
  that are new. A redelivered batch or document changes nothing, and late rows count.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from talktally.config import MetricsConfig, TenantConfig
from talktally.functions import variants as V
from talktally.operators.emit import KEYS, with_increments
from talktally.operators.gates import SLOT, gate, with_day
from talktally.operators.headers import promoted, with_enrichment
from talktally.operators.latest import one_per_key
from talktally.plans import counters, silver
from talktally.plans.jobs import (
    Upstream,
    fires_from_documents,
    prepared,
    read_fires,
    recompute,
    store_fires,
    touched_days,
)
from talktally.session import prepare
from talktally.sources.archive import split_unreadable

__all__ = [
    "enriched_stream", "first_seen", "kafka_documents", "read_fires", "read_running_counts", "recompute", "reconcile", "running_counts", "silver_batch",
    "start_running_counts", "start_silver", "store_fires", "streamed_increments", "touched_days", "with_arrival_counts",
]

STATE_DELAY = "7 days"


def kafka_documents(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Documents from a topic, shaped like archived ones (needs the Kafka package on the cluster)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    rows = reader.options(**options).load()
    text = F.col("value").cast("string")
    return rows.select(
        V.parse(text).alias("body"),
        F.concat_ws("/", "topic", F.col("partition").cast("string"), F.col("offset").cast("string")).alias("source_uri"),
        F.lit(None).cast("string").alias("tenant_header"),
        F.col("timestamp").alias("received_at"),
    )


def first_seen(fires: DataFrame, keys: tuple[str, ...] = SLOT, delay: str = STATE_DELAY) -> DataFrame:
    """First fire per key within the state's lifetime, on a stream; expects `date`."""
    return fires.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(list(keys))


def streamed_increments(fires: DataFrame, cfg: MetricsConfig, delay: str = STATE_DELAY) -> DataFrame:
    """`(tenant_id, date, received_at, metric_name, inc)` of a stream of fires.

    The same emitters as in batch; only the gates that need memory use state. Custom metrics count every fire.
    """
    marked = with_day(fires).withWatermark("received_at", delay)
    every_fire, first_only = cfg.split_once()
    branches = [with_increments(marked, every_fire)]
    if first_only.operators:
        first = gate(marked, first_only).dropDuplicatesWithinWatermark(list(SLOT))
        branches.append(with_increments(first, first_only))
    columns = ["tenant_id", "date", "received_at"]
    parts = [
        b.select(*columns, F.inline_outer("increments")).where(F.col("metric_name").isNotNull()) for b in branches
    ]
    name = F.concat(F.lit("operator_"), "operator_name", F.lit("_count"))
    parts.append(marked.select(*columns, name.alias("metric_name"), F.lit(1.0).alias("inc")))
    seen = marked.dropDuplicatesWithinWatermark(["tenant_id", "date", "conversation_id"])
    parts.append(seen.select(*columns, F.lit("conversation_count").alias("metric_name"), F.lit(1.0).alias("inc")))
    return reduce(DataFrame.unionByName, parts)


def running_counts(increments: DataFrame, time_col: str = "received_at") -> DataFrame:
    """Daily tumbling sums, for update mode."""
    windowed = increments.groupBy(F.window(time_col, "1 day"), "tenant_id", "date", "metric_name")
    return windowed.agg(F.round(F.sum("inc"), 9).alias("value")).drop("window")


def start_running_counts(counts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the running totals under `path`, one folder per micro-batch.

    Each batch holds new totals, not additions, and a repeated batch replaces
    its own folder, so a restart cannot count twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_running_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest total of every counter; partition values are text, batches count as numbers."""
    rows = spark.read.parquet(path)
    return one_per_key(rows, KEYS, [F.col("batch_id").cast("long").desc()]).drop("batch_id")


def with_arrival_counts(stream: DataFrame, name: str = "arrivals") -> DataFrame:
    """Report rows and their arrival range per micro-batch to streaming listeners."""
    return stream.observe(
        name, F.count(F.lit(1)).alias("rows"), F.min("received_at").alias("earliest"), F.max("received_at").alias("latest")
    )


def enriched_stream(fires: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Stream–static left join with the latest enrichment known when the batch runs."""
    found = promoted(F.col("metadata"))
    keyed = fires.withColumns({"call_sid": found["call_sid"], "conversation_sid": found["conversation_sid"]})
    return with_enrichment(keyed, enrichment, hot_rows=None)


def silver_batch(
    cfg: MetricsConfig,
    tenants: TenantConfig,
    root: str,
    upstream: Upstream | None = None,
    hook=None,
    default_tenant: str = "default",
    name: str | None = None,
    close_after: timedelta | None = None,
    enrichment: DataFrame | None = None,
    enrichment_fields: tuple[str, ...] = (),
) -> Callable[[DataFrame, int], None]:
    """What one micro-batch of documents does: all stored tables follow it.

    Unreadable and unfitting documents go to quarantine and never stop the stream. Streams that write below one `root` need
    names of their own. With `close_after`, days that lie further behind the newest one are closed, and fires that come for them later are counted as late.
    """

    def run(docs: DataFrame, batch_id: int) -> None:
        batch = batch_name(batch_id, name)
        readable, bad = split_unreadable(docs)
        fires, rejected = fires_from_documents(readable, tenants, upstream, default_tenant)
        refused = rejected.select("source_uri", "received_at", F.col("rejected").alias("reason"))
        bad.unionByName(refused).write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch}")
        apply_fires(prepared(fires, hook), root, batch, cfg, close_after, enrichment, enrichment_fields)

    return run


def batch_name(batch_id: int, stream: str | None = None) -> str:
    return f"{stream}-{batch_id}" if stream else str(batch_id)


def apply_fires(
    fires: DataFrame,
    root: str,
    batch: str,
    cfg: MetricsConfig,
    close_after: timedelta | None = None,
    enrichment: DataFrame | None = None,
    enrichment_fields: tuple[str, ...] = (),
) -> None:
    """Store a micro-batch of prepared fires and bring conversations, results, index and counters up to date with it."""
    spark = prepare(fires.sparkSession)
    stored = silver.store_run(fires, root, batch)
    if stored.empty:
        return
    silver.at_once(
        spark,
        lambda: silver.update(spark, root, stored, cfg, enrichment, enrichment_fields),
        lambda: counters.add(spark, root, stored, batch, cfg, close_after),
    )


def start_silver(docs: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    return (
        docs.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def reconcile(
    spark: SparkSession, root: str, days: DataFrame, cfg: MetricsConfig, dry_run: bool = False, every: bool = False
) -> DataFrame | None:
    """Nightly check of days: those whose stored fires are not the ones their counters stand for are made anew.

    The comparison reads no payload, and of the other days nothing more is read. `every` makes all of them anew. With
    `dry_run` the difference is returned instead.
    """
    wanted = days.select("tenant_id", "date").distinct().collect()
    chosen = wanted if every else counters.differing_days(spark, root, wanted)
    frame = spark.createDataFrame([(d["tenant_id"], d["date"]) for d in chosen], "tenant_id string, date string")
    if dry_run:
        return recompute(read_fires(spark, f"{root}/fires", frame), frame, cfg, f"{root}/metrics", dry_run=True)
    if chosen:
        counters.close(spark, root, chosen, cfg, anew=True)
    return None
