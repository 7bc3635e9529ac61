"""Stored fires: every delivery of every run, and each fire once.

A fire may be delivered by several runs. Each run keeps what it was given, so replacing a run never takes a fire from another one. A
copy agrees in conversation, operator, version, arrival and the stored digest of trigger, payload and metadata. A document that itself holds
the same result several times keeps them: its copies are numbered, and equal numbers meet.

Which deliveries are copies is found on narrow columns, and the addresses of the superfluous rows are written to the scratch folder. While
they are few, as a rule, they are broadcast and payloads stay where they are. Their size on disk says little, as addresses compress to
almost nothing, so they are counted: many meet the fires by a merge, whose result is kept, and if all rows are superfluous none is read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from talktally.operators.gates import with_day
from talktally.session import prepare, scratch_path
from talktally.sources import lake

PARTITIONS = ("tenant_id", "date", "batch_id")
DAY = ["tenant_id", "date"]
KEY = ["tenant_id", "conversation_id", "operator_name", "schema_version", "received_at", "digest"]
STORED_ONLY = ("digest", "batch_id", "date")
_ADDRESS = ["_file", "_row"]
FEW = 50_000  # addresses that are broadcast, of some 200 bytes each
_RUN_NAME = re.compile(r"[A-Za-z0-9_.-]+")


def content_digest() -> Column:
    return F.xxhash64(F.to_json("data"), F.to_json("metadata"), "trigger")


def store_fires(fires: DataFrame, path: str, batch_id: int | str) -> None:
    """Store the fires of a run or micro-batch; the same one again replaces all it stored before."""
    run = str(batch_id)
    if not _RUN_NAME.fullmatch(run):
        raise ValueError(f"a run's name has letters, digits, '_', '-' and '.' only: {run!r}")
    spark = fires.sparkSession
    rows = with_day(fires).withColumns({"batch_id": F.lit(run), "digest": content_digest()})
    earlier = lake.files_below(spark, f"{path}/tenant_id=*/date=*/batch_id={run}")
    lake.write_partitions(rows, path, PARTITIONS)
    # A written partition has new files only; where earlier ones are left, the run no longer has rows.
    left = lake.files_below(spark, f"{path}/tenant_id=*/date=*/batch_id={run}") if earlier else set()
    for folder in sorted({file.rsplit("/", 1)[0] for file in earlier & left}):
        lake.drop_folder(spark, folder)


def run_is_stored(spark: SparkSession, path: str, run: int | str) -> bool:
    return bool(lake.files_below(spark, f"{path}/tenant_id=*/date=*/batch_id={run}"))


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """All deliveries."""
    return prepare(spark).read.parquet(path)


def days_of(rows: DataFrame) -> list:
    """The (tenant_id, date) pairs of some fires: as many rows as the partitions they lie in."""
    return rows.select(*DAY).distinct().collect()


def _copies(rows: DataFrame, prefer: Column | None = None) -> DataFrame:
    """Addresses and keys of the rows with `_rank` among their copies, 1 for the one that stays."""
    narrow = rows.select(*KEY, "source_uri", "batch_id", *_ADDRESS).repartition(*KEY)
    inside = Window.partitionBy(*KEY, "source_uri", "batch_id").orderBy(*_ADDRESS)
    numbered = narrow.withColumn("_copy", F.row_number().over(inside))
    order = [F.col("source_uri").desc(), F.col("batch_id").desc(), *_ADDRESS]
    between = Window.partitionBy(*KEY, "_copy").orderBy(*([prefer.desc()] if prefer is not None else []), *order)
    return numbered.withColumn("_rank", F.row_number().over(between))


def _addressed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})


def _without(rows: DataFrame, copies: DataFrame, superfluous: Column) -> DataFrame:
    """`rows` but for those whose addresses are `superfluous` among `copies`, the addresses of all of them at least."""
    spark = rows.sparkSession
    path, met = scratch_path(spark, "copies"), Observation()
    copies.observe(met, F.count(F.lit(1)).alias("rows")).where(superfluous).select(*_ADDRESS).write.parquet(path)
    known = spark.read.schema("_file string, _row long").parquet(path)
    found = known.count()
    if not found:
        return rows.drop(*_ADDRESS)
    if found == met.get["rows"]:
        return rows.drop(*_ADDRESS).limit(0)
    if found <= FEW:
        return rows.join(F.broadcast(known), _ADDRESS, "left_anti").drop(*_ADDRESS)
    kept = rows.join(known.hint("merge"), _ADDRESS, "left_anti").drop(*_ADDRESS)
    path = scratch_path(spark, "once")
    kept.write.parquet(path)
    return spark.read.schema(kept.schema).parquet(path)


def once_delivered(stored: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Stored fires, each once; `stored` is a scan of the table with any filter, `of` the keys of those that are wanted."""
    rows = _addressed(stored)
    if of is not None:
        rows = rows.join(of, of.columns, "left_semi")
    return _without(rows, _copies(rows), F.col("_rank") > 1).drop(*STORED_ONLY)


def fresh_fires(spark: SparkSession, path: str, run: int | str) -> DataFrame:
    """The fires of a run that no other run delivered.

    A copy has the same arrival, so only the run's own days are searched for it.
    """
    return fresh_rows(spark, path, run).drop(*STORED_ONLY)


def fresh_rows(spark: SparkSession, path: str, run: int | str) -> DataFrame:
    """The same as they are stored, with day and digest."""
    mine = F.col("batch_id") == str(run)
    days = days_of(stored_rows(spark, path).where(mine))
    rows = _addressed(stored_rows(spark, path).where(lake.within(days, *DAY)))
    copies = _copies(rows, prefer=~mine).where(mine)
    return _without(rows.where(mine), copies, F.col("_rank") > 1)


def read_fires(spark: SparkSession, path: str, days: DataFrame | None = None) -> DataFrame:
    """Stored fires, each once; of the given `(tenant_id, date)` only, whose partitions alone are opened."""
    rows = stored_rows(spark, path)
    if days is not None:
        wanted = days.select(*DAY).distinct()
        return once_delivered(rows.where(lake.within(wanted.collect(), *DAY)), wanted)
    return once_delivered(rows)


def day_digests(spark: SparkSession, path: str, days: list) -> DataFrame:
    """(tenant_id, date, fires, digest) of the given days: what is stored, each fire once, in any order. Reads no payload."""
    rows = _addressed(stored_rows(spark, path).where(lake.within(days, *DAY)))
    kept = _copies(rows).where(F.col("_rank") == 1)
    return digest_of(with_day(kept))


def digest_of(rows: DataFrame) -> DataFrame:
    """The digests of days add up over disjoint sets of fires."""
    each = F.xxhash64(*KEY[1:]).cast("decimal(38,0)")
    return rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("fires"), F.sum(each).alias("digest"))
