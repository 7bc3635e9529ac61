"""Batch jobs: archive to silver, silver to gold, backfill and dry run."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talktally.config import MetricsConfig, TenantConfig
from talktally.functions.values import day_stamp
from talktally.operators.derived import with_derived
from talktally.operators.emit import emit_all
from talktally.operators.gold import GOLD_KEYS, diff, rollup
from talktally.operators.normalize import normalize_direct, normalize_v2, normalize_v3, split_shapes, union_fires
from talktally.operators.results import apply_hook, as_fires, unwrapped
from talktally.plans import counters, silver
from talktally.session import prepare
from talktally.sources import lake
from talktally.sources.fires import once_delivered, read_fires, store_fires, stored_rows

__all__ = [
    "Upstream", "backfill", "copy_metrics", "fires_from_documents", "gold_of", "new_run", "once_delivered", "prepared", "read_fires",
    "recompute", "store_fires", "stored_fires", "touched_days", "write_all", "write_silver",
]


@dataclass(frozen=True)
class Upstream:
    """Tables the transcript notifications refer to."""

    transcripts: DataFrame
    results: DataFrame
    timings: DataFrame | None = None


def fires_from_documents(
    docs: DataFrame,
    tenants: TenantConfig,
    upstream: Upstream | None = None,
    default_tenant: str = "default",
) -> tuple[DataFrame, DataFrame]:
    """(fires, rejected documents) of raw documents in any known shape."""
    shapes = split_shapes(docs, tenants, default_tenant)
    parts = [normalize_direct(shapes["direct"]), normalize_v3(shapes["v3"])]
    if upstream is not None:
        parts.append(normalize_v2(shapes["v2"], upstream.transcripts, upstream.results, upstream.timings))
    return union_fires(*parts), shapes["rejected"]


def prepared(fires: DataFrame, hook=None) -> DataFrame:
    """Fires with unwrapped and enriched payloads: what everything else is computed from."""
    return apply_hook(unwrapped(fires), hook)


def gold_of(fires: DataFrame, cfg: MetricsConfig, time_col: str = "received_at") -> DataFrame:
    """All raw daily counters and the daily derived rows."""
    return with_derived(rollup(emit_all(fires, cfg, time_col)), cfg.derived())


def write_silver(
    fires: DataFrame,
    root: str,
    cfg: MetricsConfig,
    enrichment: DataFrame | None = None,
    enrichment_fields: tuple[str, ...] = (),
    run: str | None = None,
) -> Observation:
    """Store the fires of a run and bring conversations, results and index up to date with them.

    Runs add up in any order, and fires that another run delivered already change nothing. Without a name every call is a run of its
    own; the same `run` again takes its former fires back and puts the given ones in their place. Returns the number of results
    derived, counted while writing.
    """
    spark = prepare(fires.sparkSession)
    return silver.update(spark, root, silver.store_run(fires, root, run or new_run()), cfg, enrichment, enrichment_fields)


def write_all(
    fires: DataFrame,
    root: str,
    cfg: MetricsConfig,
    enrichment: DataFrame | None = None,
    enrichment_fields: tuple[str, ...] = (),
    run: str | None = None,
    close_after: timedelta | None = None,
) -> Observation:
    """`write_silver`, and the daily counters of the stored fires.

    Nothing is written, and the observation stays open, if all the fires were delivered before.
    """
    spark, name = prepare(fires.sparkSession), run or new_run()
    stored, written = silver.store_run(fires, root, name), []
    if stored.empty:
        return Observation("results")
    silver.at_once(
        spark,
        lambda: written.append(silver.update(spark, root, stored, cfg, enrichment, enrichment_fields)),
        lambda: counters.add(spark, root, stored, name, cfg, close_after),
    )
    return written[0]


def new_run() -> str:
    """A name no other run has."""
    return f"run-{uuid.uuid4().hex}"


def touched_days(fires: DataFrame) -> DataFrame:
    return fires.select("tenant_id", day_stamp(F.col("received_at")).alias("date")).distinct()


def stored_fires(
    spark: SparkSession, path: str, tenant: str | None = None, start: date | None = None, end: date | None = None,
    operator: str | None = None,
) -> DataFrame:
    """Stored operator results of a range, in fire shape.

    The curated table keeps no trigger and a missing one passes every gate, so counters
    are rebuilt from the fires themselves; this is for looking into results.
    """
    rows = as_fires(lake.scan_results(spark, path, tenant, start, end))
    if operator is not None:
        rows = rows.where(F.col("operator_name") == operator)
    return rows if "trigger" in rows.columns else rows.withColumn("trigger", F.lit(None).cast("string"))


def recompute(fires: DataFrame, days: DataFrame, cfg: MetricsConfig, path: str, dry_run: bool = False) -> DataFrame | None:
    """Rebuild the counters of `days` from the fires and replace them.

    Nothing is added to a stored value, so running it again changes nothing.
    With `dry_run` the change is returned instead of made.
    """
    chosen = fires.withColumn("_day", day_stamp(F.col("received_at"))).join(
        days.select("tenant_id", F.col("date").alias("_day")).distinct(), ["tenant_id", "_day"], "left_semi"
    )
    gold = gold_of(chosen.drop("_day"), cfg)
    if not dry_run:
        lake.replace_days(gold, days, path)
        return None
    spark = fires.sparkSession
    if not lake.exists(spark, path):
        return diff(gold.limit(0), gold)
    months = days.select("tenant_id", F.substring("date", 1, 4).alias("year"), F.substring("date", 5, 2).alias("month")).distinct()
    old = lake.scan(spark, path, "metrics").where(lake.within(months.collect(), *lake.GOLD_PARTITIONS))
    old = old.join(days.select("tenant_id", "date").distinct(), ["tenant_id", "date"], "left_semi")
    return diff(old.select(*GOLD_KEYS, "value"), gold)


def backfill(
    spark: SparkSession,
    fires_path: str,
    gold_path: str,
    cfg: MetricsConfig,
    tenant: str,
    start: date,
    end: date,
    dry_run: bool = False,
) -> DataFrame | None:
    """The ordinary gold job over a tenant's day range of stored fires."""
    rows = stored_rows(spark, fires_path).where(F.col("tenant_id") == tenant)
    days = rows.where(F.col("date").between(f"{start:%Y%m%d}", f"{end:%Y%m%d}")).select("tenant_id", "date").distinct()
    return recompute(read_fires(spark, fires_path, days), days, cfg, gold_path, dry_run)


def copy_metrics(
    spark: SparkSession, source: str, target: str, tenants: list[str] | None = None, dry_run: bool = False
) -> DataFrame:
    """Put gold rows over those of the target, row by row; returns rows scanned and migrated per tenant."""
    rows = lake.scan(spark, source, "metrics")
    if tenants is not None:
        rows = rows.where(F.col("tenant_id").isin(tenants))
    if not dry_run:
        lake.merge_rows(rows, target, lake.GOLD_PARTITIONS, ("tenant_id", "date", "metric_name"), ("metric_name", "date"))
    counts = rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("scanned"))
    return counts.withColumn("migrated", F.col("scanned"))
