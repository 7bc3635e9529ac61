"""Copies of the headers by agent, queue and customer, newest first.

A copy lies by access path, tenant, a hash share of the value and the month the conversation began (or the year, for tenants with few
conversations), sorted by value. A page of one value's newest conversations opens its share period by period from the newest on, twice
as many each time, until the page is full: what it reads follows the page, not the history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.session import prepare
from talktally.sources import lake

PATHS = {"agent_id": "agent", "queue_id": "queue", "customer_key": "customer"}
PARTITIONS = ("path", "tenant_id", "share", "period")
SHARES = 8
MONTH, YEAR = "yyyyMM", "yyyy"
KEYS = ("path", "tenant_id", "conversation_id")
FOLDER = "conversations_by"


def share_of(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(SHARES)).cast("string")


def copies(headers: DataFrame, grain: str = MONTH) -> DataFrame:
    """One row per stored header and access path it has a value for."""
    parts = []
    for column, path in PATHS.items():
        rows = headers.where(F.col(column).isNotNull())
        parts.append(rows.withColumns({"path": F.lit(path), "value": F.col(column)}))
    found = reduce(DataFrame.unionByName, parts)
    placed = found.withColumns({"share": share_of(F.col("value")), "period": F.date_format("started_at", grain)})
    placed = placed.drop("year", "month", "day")
    return placed.select(*[c for c in placed.columns if c not in PARTITIONS], *PARTITIONS)


def update(spark: SparkSession, root: str, headers: DataFrame, old: DataFrame, grain: str = MONTH) -> None:
    """Put the copies of `headers` in place of those of `old`, the stored rows of the same conversations."""
    gone = copies(old, grain)
    places = gone.select(*PARTITIONS).distinct().collect()
    lake.merge_rows(
        copies(headers, grain), f"{root}/{FOLDER}", PARTITIONS, KEYS, ("value", "started_at"), within=lake.within(places, *PARTITIONS), gone=gone
    )


def periods(spark: SparkSession, root: str, tenant: str, path: str, share: str) -> list[str]:
    """Periods of a share, newest first, from the folder names."""
    folder = lake.partition_path(spark, f"{root}/{FOLDER}", path=path, tenant_id=tenant, share=share)
    return sorted({f.split("/period=")[1].split("/")[0] for f in lake.files_below(spark, f"{folder}/period=*")}, reverse=True)


def _of_value(
    spark: SparkSession, root: str, tenant: str, column: str, value: str, also: Column | None = None,
    first: str | None = None, last: str | None = None,
) -> tuple[DataFrame | None, list[str]]:
    """(copies with `column` = `value` that satisfy `also`, the periods from `first` to `last` that may hold some, newest first)."""
    path = PATHS[column]
    share = prepare(spark).range(1).select(share_of(F.lit(value)).alias("s")).first().s
    known = periods(spark, root, tenant, path, share)
    found = [p for p in known if (first or "")[: len(p)] <= p <= (last or "999999")[: len(p)]]
    if not found:
        return None, []
    place = (F.col("path") == path) & (F.col("tenant_id") == tenant) & (F.col("share") == share)
    rows = spark.read.parquet(f"{root}/{FOLDER}")
    return rows.where(place & (F.col("value") == value) & (F.lit(True) if also is None else also)), found


def _headers(spark: SparkSession, rows: DataFrame | None) -> DataFrame:
    """Copies as headers; none without copies."""
    if rows is None:
        return lake.stored_headers(spark.createDataFrame([], lake.CONVERSATIONS)).drop("year", "month", "day")
    shaped = rows.withColumns({c: F.lit(None).cast("string") for c in ("year", "month", "day")})
    return lake.stored_headers(shaped.select(*lake.CONVERSATIONS.fieldNames())).drop("year", "month", "day")


def newest(
    spark: SparkSession, root: str, tenant: str, column: str, value: str, limit: int, also: Column | None = None,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """Headers with `column` = `value`: all of the periods opened, which hold at least the `limit` newest that also satisfy `also`.

    `first` and `last` (yyyyMM) leave out periods.
    """
    rows, found = _of_value(spark, root, tenant, column, value, also, first, last)
    taken = 1
    while taken < len(found) and rows.where(F.col("period").isin(found[:taken])).limit(limit).count() < limit:
        taken *= 2
    return _headers(spark, rows if rows is None else rows.where(F.col("period").isin(found[:taken])))


def every(
    spark: SparkSession, root: str, tenant: str, column: str, value: str, also: Column | None = None,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """All headers with `column` = `value` that satisfy `also`; `first` and `last` (yyyyMM) leave out periods."""
    rows, found = _of_value(spark, root, tenant, column, value, also, first, last)
    return _headers(spark, rows if rows is None else rows.where(F.col("period").isin(found)))
