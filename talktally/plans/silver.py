"""Bring the stored tables up to date with the fires of a run or micro-batch.

What a run adds follows from its fresh fires, those no other run delivered, and from the stored rows of their
conversations: headers are merged as states, results by key, index entries by day. No payload stored before is read, but for operators that
count once per conversation and day: an earlier fire that arrives later takes the place of the one that counted, so their fires of
the run's own days are looked at again.

A run that was stored before is rebuilt instead of added: the conversations it had and has are derived anew from the stored fires
of their days. So a repeated micro-batch changes nothing, and a corrected run takes its former fires back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from talktally.config import MetricsConfig
from talktally.operators.gates import once_names, with_day
from talktally.operators.headers import header_state, merge_headers, with_enrichment
from talktally.operators.index import daily_index, header_entries, stored_index
from talktally.operators.results import operator_results
from talktally.session import cut_lineage
from talktally.sources import access, fires as F_, lake, locator

CONVERSATION = ["tenant_id", "conversation_id"]
HEADERS, RESULTS, INDEX, PLACES, FIRES = "conversations", "operator_results", "index", "conversation_days", "fires"
COUNTS = "run_counts"


@dataclass(frozen=True)
class Run:
    """What a stored run changes."""

    fresh: DataFrame
    days: list
    rebuilt: bool
    gone: DataFrame | None = None  # conversations the run had before it was stored again
    gone_days: tuple = ()
    name: str = ""
    keys: DataFrame | None = None  # keys and stored digests of the fresh fires

    @property
    def empty(self) -> bool:
        """Whether it changes nothing: all its fires were delivered before."""
        return not self.rebuilt and (not self.days or self.fresh.isEmpty())


def note_counts(spark: SparkSession, root: str, run: int | str, **rows: int) -> None:
    """Enter how many rows each output of a run had; the same run again replaces its counts."""
    table = spark.createDataFrame(list(rows.items()), "output string, rows long").coalesce(1)
    table.write.mode("overwrite").parquet(f"{root}/{COUNTS}/batch_id={run}")


def run_counts(spark: SparkSession, root: str) -> DataFrame:
    """(output, rows, batch_id) of every run that changed something."""
    return spark.read.schema("output string, rows long, batch_id string").parquet(f"{root}/{COUNTS}")


def store_run(fires: DataFrame, root: str, run: int | str) -> Run:
    """Store the fires of a run and tell what it changes."""
    spark, path = fires.sparkSession, f"{root}/{FIRES}"
    repeated = F_.run_is_stored(spark, path, run)
    gone, gone_days = None, []
    if repeated:
        before = F_.stored_rows(spark, path).where(F.col("batch_id") == str(run))
        gone, gone_days = cut_lineage(before.select(*CONVERSATION).distinct()), F_.days_of(before)
    F_.store_fires(fires, path, run)
    if not F_.run_is_stored(spark, path, run):
        none = with_day(fires).withColumn("digest", F_.content_digest()).limit(0)
        return Run(none.drop("date", "digest"), [], repeated, gone, tuple(gone_days), str(run), none.select(*F_.KEY))
    mine = F_.stored_rows(spark, path).where(F.col("batch_id") == str(run))
    fresh = F_.fresh_rows(spark, path, run)
    return Run(fresh.drop(*F_.STORED_ONLY), F_.days_of(mine), repeated, gone, tuple(gone_days), str(run), fresh.select(*F_.KEY))


def update(
    spark: SparkSession,
    root: str,
    run: Run,
    cfg: MetricsConfig,
    enrichment: DataFrame | None = None,
    enrichment_fields: Sequence[str] = (),
) -> Observation:
    """Conversations, results and index with what a stored run changes; returns the number of results written."""
    if run.rebuilt:
        known, heads, old = _rebuilt(spark, root, run)
        slots = known
    else:
        known = run.fresh
        heads, old = _merged(spark, root, known)
        slots = _same_slots(spark, root, run, known, cfg)
    if enrichment is not None:
        heads = _enriched(heads, enrichment)
    written = Observation("results")
    heads = cut_lineage(heads)
    results = cut_lineage(operator_results(known).observe(written, F.count(F.lit(1)).alias("rows")))
    entries = cut_lineage(_index_entries(slots, heads, cfg, enrichment_fields))

    def write_results() -> None:
        if run.rebuilt:
            _replace_results(spark, root, run, results, old)
        else:
            lake.write_results(results, f"{root}/{RESULTS}")

    at_once(
        spark,
        write_results,
        lambda: write_headers(spark, root, heads, old),
        lambda: _write_index(spark, root, run, known, entries, old, cfg),
    )
    # All three are stored by now, so counting them reads no fire again.
    note_counts(spark, root, run.name, conversations=heads.count(), results=results.count(), index=entries.count())
    return written


def at_once(spark: SparkSession, *writes: Callable[[], None]) -> None:
    """Run writes of different tables side by side: the jobs of a small batch are too short to fill a cluster one by one."""
    with ThreadPoolExecutor(len(writes)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]
    for one in started:
        one.result()


def _conversations(run: Run) -> DataFrame:
    named = run.fresh.select(*CONVERSATION)
    return (named if run.gone is None else named.union(run.gone)).distinct()


def _stored_heads(spark: SparkSession, root: str, named: DataFrame) -> DataFrame:
    """Stored headers of some conversations; only the days the locator names are opened."""
    places = locator.find(spark, f"{root}/{PLACES}", named)
    days = places.select(
        "tenant_id", F.substring("day", 1, 4).alias("year"), F.substring("day", 5, 2).alias("month"), F.substring("day", 7, 2).alias("day")
    )
    found = days.distinct().collect()  # partitions, not conversations
    path = f"{root}/{HEADERS}"
    if not found or not lake.exists(spark, path):
        return spark.createDataFrame([], lake.CONVERSATIONS)
    rows = lake.scan(spark, path, "conversations").where(lake.within(found, *lake.ROW_PARTITIONS))
    return rows.join(named, CONVERSATION, "left_semi")


def _without_days(rows: DataFrame) -> DataFrame:
    return rows.drop("year", "month", "day")


def _merged(spark: SparkSession, root: str, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(headers of the run's conversations with the stored state merged in, the stored rows)."""
    new = cut_lineage(lake.curated_conversations(header_state(fresh)))
    old = cut_lineage(_stored_heads(spark, root, new.select(*CONVERSATION)))
    merged = merge_headers(_without_days(old), _without_days(new))
    return lake.curated_conversations(merged), old


def _rebuilt(spark: SparkSession, root: str, run: Run) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all fires of the run's conversations, their headers anew, the stored rows).

    The fires lie between the first and last arrival their headers know, or on the run's own days.
    """
    named = cut_lineage(_conversations(run))
    old = cut_lineage(_stored_heads(spark, root, named))
    span = old.select(
        "tenant_id", F.explode(F.sequence(F.to_date("started_at"), F.to_date("updated_at"))).alias("day")
    ).select("tenant_id", F.date_format("day", "yyyyMMdd").alias("date"))
    days = [*span.distinct().collect(), *run.days, *run.gone_days]
    rows = F_.stored_rows(spark, f"{root}/{FIRES}").where(lake.within(days, *F_.DAY))
    known = F_.once_delivered(rows, named)
    heads = lake.curated_conversations(header_state(known))
    kept = old.select(*CONVERSATION, "enrichment").withColumnRenamed("enrichment", "_kept")
    heads = heads.join(kept, CONVERSATION, "left").withColumn("enrichment", F.coalesce("enrichment", "_kept")).drop("_kept")
    return known, heads, old


def _enriched(heads: DataFrame, enrichment: DataFrame) -> DataFrame:
    return lake.curated_conversations(with_enrichment(lake.stored_headers(heads), enrichment))


def write_headers(
    spark: SparkSession, root: str, heads: DataFrame, old: DataFrame | None = None,
    partitions: Sequence[str] = lake.ROW_PARTITIONS, grain: str = access.MONTH,
) -> None:
    """Put stored-shape headers in place of `old`, the stored rows of the same conversations; by day, and by access path.

    Coarser `partitions` (by month) and a coarser `grain` of the copies suit tenants with few conversations a day.
    """
    old = spark.createDataFrame([], lake.CONVERSATIONS) if old is None else old
    places = old.select(*partitions).distinct().collect()
    lake.merge_rows(
        heads, f"{root}/{HEADERS}", partitions, CONVERSATION, ("customer_key", "agent_id"), within=lake.within(places, *partitions), gone=old
    )
    day = F.concat("year", "month", "day").alias("day")
    moved = heads.select(*CONVERSATION, day).join(old.select(*CONVERSATION, day), [*CONVERSATION, "day"], "left_anti")
    locator.enter(moved, f"{root}/{PLACES}")
    access.update(spark, root, heads, old, grain)


def _replace_results(spark: SparkSession, root: str, run: Run, results: DataFrame, old: DataFrame) -> None:
    """Results of the rebuilt conversations, on the days they have or had fires."""
    parts = F.substring("date", 1, 4).alias("year"), F.substring("date", 5, 2).alias("month"), F.substring("date", 7, 2).alias("day")
    days = spark.createDataFrame([*run.days, *run.gone_days], "tenant_id string, date string").select("tenant_id", *parts)
    new = cut_lineage(lake.curated_results(results))
    named = cut_lineage(old.select(*CONVERSATION).union(new.select(*CONVERSATION)).distinct())
    places = days.union(new.select(*lake.ROW_PARTITIONS)).distinct().collect()
    lake.merge_rows(
        new, f"{root}/{RESULTS}", lake.ROW_PARTITIONS, CONVERSATION, ("operator_name",),
        within=lake.within(places, *lake.ROW_PARTITIONS), gone=named,
    )


def _same_slots(spark: SparkSession, root: str, run: Run, fresh: DataFrame, cfg: MetricsConfig) -> DataFrame:
    """The fresh fires, and all fires of the run's days in the slots of operators that count once."""
    names = once_names(cfg)
    if not names or not run.days:
        return fresh
    once = F.col("operator_name").isin(names)
    slots = with_day(fresh).where(once).select("tenant_id", "date", "operator_name", "conversation_id").distinct()
    rows = F_.stored_rows(spark, f"{root}/{FIRES}").where(lake.within(run.days, *F_.DAY) & once)
    every = F_.once_delivered(rows, slots)
    return fresh.where(~once).unionByName(every)


def _index_entries(slots: DataFrame, heads: DataFrame, cfg: MetricsConfig, enrichment_fields: Sequence[str]) -> DataFrame:
    entries = daily_index(slots, cfg).unionByName(header_entries(lake.stored_headers(heads), enrichment_fields))
    return stored_index(entries)


def _write_index(
    spark: SparkSession, root: str, run: Run, known: DataFrame, new: DataFrame, old: DataFrame, cfg: MetricsConfig
) -> None:
    """Entries of the run's days and conversations.

    Entries of ordinary operators are added, the later arrival staying; those of slots that count once, of headers and of rebuilt
    conversations replace the stored ones. Only months of the run's days and of the headers' former and new days are opened.
    """
    path = f"{root}/{INDEX}"
    if not lake.exists(spark, path):
        lake.write_partitions(new, path, lake.INDEX_PARTITIONS, ("field_value",))
        return
    month = F.substring("date", 1, 6).alias("month")
    run_months = spark.createDataFrame([*run.days, *run.gone_days], "tenant_id string, date string").select("tenant_id", month)
    of_heads = old.select("tenant_id", F.date_format("updated_at", "yyyyMM").alias("month"))
    months = run_months.union(of_heads).union(new.select("tenant_id", "month")).distinct().collect()
    stored = spark.read.schema(new.schema).parquet(path).where(lake.within(months, "tenant_id", "month"))
    named = known.select(*CONVERSATION).union(old.select(*CONVERSATION)).distinct()
    names = once_names(cfg)
    if run.rebuilt:
        stale = stored.join(named, CONVERSATION, "left_semi")
    else:
        of_slots = with_day(known.where(F.col("operator_name").isin(names))).select("tenant_id", "date", "operator_name", "conversation_id").distinct()
        stale = stored.where(F.col("operator_name") == "").join(named, CONVERSATION, "left_semi")
        stale = stale.unionByName(stored.join(of_slots, of_slots.columns, "left_semi"))
    keys = [c for c in new.columns if c not in ("received_at", "expires_at")]
    touched = stale.select(*lake.INDEX_PARTITIONS).union(new.select(*lake.INDEX_PARTITIONS)).distinct()
    around = stored.join(touched, list(lake.INDEX_PARTITIONS), "left_semi")
    kept = around.join(stale.select(*keys).distinct(), keys, "left_anti")
    merged = kept.unionByName(new).groupBy(*keys).agg(F.max("received_at").alias("received_at"), F.max("expires_at").alias("expires_at"))
    lake.replace_partitions(merged.select(*new.columns), around, path, lake.INDEX_PARTITIONS, ("field_value",))
