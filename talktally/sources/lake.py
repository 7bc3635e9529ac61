"""Partitioned Parquet tables: scans with partition predicates, idempotent writes."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktally.functions.keys import day_of, metric_of, tenant_of
from talktally.operators.latest import latest
from talktally.session import cut_lineage, prepare

ROW_PARTITIONS = ("tenant_id", "year", "month", "day")
GOLD_PARTITIONS = ("tenant_id", "year", "month")


def _text(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _times(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.TimestampType()) for n in names]


CONVERSATIONS = T.StructType(
    [
        *_text("conversation_id", "customer_key", "channel", "agent_id", "team_id", "queue_id"),
        *_times("started_at", "created_at", "updated_at"),
        T.StructField("operator_count", T.IntegerType()),
        *_text("channel_type", "source_type", "source_sid", "call_sid", "conversation_sid", "reference_sids"),
        *_text("customer_phone", "customer_phone_last4", "last_uri", "enrichment"),
        *_text(*ROW_PARTITIONS),
    ]
)
OPERATOR_RESULTS = T.StructType(
    [
        *_text("conversation_id", "operator_name", "schema_version"),
        *_times("received_at"),
        *_text("s3_uri"),
        *_times("enriched_at"),
        *_text("enrichment_error", "enriched_payload", "display_fields"),
        *_text(*ROW_PARTITIONS),
    ]
)
METRICS = T.StructType(
    [*_text("date", "metric_name"), T.StructField("value", T.DoubleType()), *_text(*GOLD_PARTITIONS)]
)
INDEX = T.StructType(
    [
        *_text("field_value", "conversation_id", "operator_name", "date"),
        *_times("received_at", "expires_at"),
        *_text("tenant_id", "field_name", "month"),
    ]
)
TABLES = {"conversations": CONVERSATIONS, "operator_results": OPERATOR_RESULTS, "metrics": METRICS, "index": INDEX}


def with_date_parts(df: DataFrame, ts: Column, parts: Sequence[str] = ("year", "month", "day")) -> DataFrame:
    formats = {"year": "yyyy", "month": "MM", "day": "dd"}
    return df.withColumns({p: F.date_format(ts, formats[p]) for p in parts})


def curated_conversations(headers: DataFrame) -> DataFrame:
    """Headers in the stored shape with partition columns; objects as JSON text, attributes the headers lack as null."""
    kinds = dict(headers.dtypes)
    as_text = {}
    if kinds.get("channel") == "variant":
        plain = F.schema_of_variant("channel") == "STRING"
        as_text["channel"] = F.when(plain, F.try_variant_get("channel", "$", "string")).otherwise(F.to_json("channel"))
    if kinds.get("enrichment") == "variant":
        as_text["enrichment"] = F.to_json("enrichment")
    if kinds.get("reference_sids", "").startswith("map"):
        as_text["reference_sids"] = F.to_json("reference_sids")
    rows = with_date_parts(headers.withColumns(as_text) if as_text else headers, F.col("started_at"))
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in CONVERSATIONS if f.name not in rows.columns}
    rows = rows.withColumns(lacking) if lacking else rows
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in CONVERSATIONS])


def stored_headers(rows: DataFrame) -> DataFrame:
    """Stored conversations as headers: channel and enrichment as VARIANT, references as a map; partition columns stay."""
    channel = F.coalesce(F.when(F.col("channel").startswith("{"), F.try_parse_json("channel")), F.col("channel").cast("variant"))
    references = F.from_json("reference_sids", "map<string,string>")
    return rows.withColumns({"channel": channel, "enrichment": F.try_parse_json("enrichment"), "reference_sids": references})


def curated_results(results: DataFrame) -> DataFrame:
    rows = with_date_parts(results, F.col("received_at"))
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in OPERATOR_RESULTS])


def gold_table(gold: DataFrame) -> DataFrame:
    rows = gold.withColumns({"year": F.substring("date", 1, 4), "month": F.substring("date", 5, 2)})
    return rows.select(*[F.col(f.name).cast(f.dataType) for f in METRICS])


def scan(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """A stored table; with `table` the fixed schema is used and nothing is inferred.

    Partition columns are text (`04`, not 4) in both cases.
    """
    if table is not None:
        return spark.read.schema(TABLES[table]).parquet(path)
    return spark.read.parquet(path)


def months_between(start: date, end: date) -> list[tuple[str, str]]:
    found, year, month = [], start.year, start.month
    while (year, month) <= (end.year, end.month):
        found.append((f"{year:04d}", f"{month:02d}"))
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return found


def month_predicate(start: date, end: date) -> Column:
    """Partition predicate for a day range; a filter on a timestamp or day text alone prunes nothing."""
    by_year: dict[str, list[str]] = {}
    for year, month in months_between(start, end):
        by_year.setdefault(year, []).append(month)
    result = F.lit(False)
    for year, months in by_year.items():
        one = F.col("year") == year
        result = result | (one if len(months) == 12 else one & F.col("month").isin(months))
    return result


def day_predicate(start: date, end: date) -> Column:
    """The same down to days, for row-level tables: whole months, and the days of the first and last one."""
    result, whole = F.lit(False), []
    for year, month in months_between(start, end):
        first = date(int(year), int(month), 1)
        following = date(first.year + first.month // 12, first.month % 12 + 1, 1)
        if start <= first and following <= end + timedelta(days=1):
            whole.append(first)
            continue
        days = [f"{d:02d}" for d in range(max(start, first).day, min(end, following - timedelta(days=1)).day + 1)]
        result = result | ((F.col("year") == year) & (F.col("month") == month) & F.col("day").isin(days))
    return (result | month_predicate(whole[0], whole[-1])) if whole else result


def _folder(spark: SparkSession, path: str):
    """(file system, path) of an address."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def exists(spark: SparkSession, path: str) -> bool:
    system, folder = _folder(spark, path)
    return system.exists(folder)


def files_below(spark: SparkSession, pattern: str) -> set[str]:
    """Addresses of the files in the folders a pattern names."""
    system, folder = _folder(spark, f"{pattern}/*")
    return {str(f.getPath().toString()) for f in system.globStatus(folder) or ()}


def drop_folder(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def partition_path(spark: SparkSession, root: str, **values: str | None) -> str:
    """The folder of a partition; values are escaped as Spark escapes them."""
    escaped = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    return "/".join([root.rstrip("/"), *(escaped(name, value) for name, value in values.items())])


def within(rows: Sequence, *columns: str) -> Column:
    """A literal partition predicate that holds for all the given rows, and prunes: each column is among their values."""
    result = F.lit(True)
    for column in columns:
        values = sorted({r[column] for r in rows if r[column] is not None})
        inside = F.col(column).isin(values) if values else F.lit(False)
        result = result & ((inside | F.col(column).isNull()) if any(r[column] is None for r in rows) else inside)
    return result if rows else F.lit(False)


def scan_results(
    spark: SparkSession, path: str, tenant: str | None = None, start: date | None = None, end: date | None = None
) -> DataFrame:
    """Curated operator results of a tenant and day range, all partitions pruned."""
    rows = scan(spark, path, "operator_results")
    if tenant is not None:
        rows = rows.where(F.col("tenant_id") == tenant)
    if start is not None:
        rows = rows.where(day_predicate(start, end or start))
    return rows


def scan_metrics(spark: SparkSession, path: str, tenant: str, start: date, end: date) -> DataFrame:
    rows = scan(spark, path, "metrics").where((F.col("tenant_id") == tenant) & month_predicate(start, end))
    return rows.where(F.col("date").between(f"{start:%Y%m%d}", f"{end:%Y%m%d}"))


_among = within  # where a parameter has that name


def write_partitions(df: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Replace exactly the partitions present in `df`.

    A rebalance by the partition columns lets adaptive execution split big
    partitions and merge small ones, so files keep a fair size and a tenant
    with most of the data is written by many tasks.
    """
    prepare(df.sparkSession)
    rows = df.hint("rebalance", *[F.col(p) for p in partitions])
    if sort:
        rows = rows.sortWithinPartitions(*partitions, *sort)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


CONVERSATION_KEY = ("tenant_id", "conversation_id")
RESULT_KEY = (*CONVERSATION_KEY, "operator_name", "schema_version")
INDEX_PARTITIONS = ("tenant_id", "field_name", "month")


def write_conversations(headers: DataFrame, path: str) -> None:
    """Put headers over the stored ones of the same conversations, also where these began on another day.

    Sorted by customer inside files, so lookups by customer or agent skip row groups.
    """
    merge_rows(curated_conversations(headers), path, ROW_PARTITIONS, CONVERSATION_KEY, ("customer_key", "agent_id"))


def write_results(results: DataFrame, path: str) -> None:
    """Put results over the stored ones of the same key; the second of arrival is part of it.

    Within a second the later arrival stays, whichever was stored first; of equal ones, the larger address.
    """
    rows = curated_results(results).withColumn("stamp", F.date_trunc("second", "received_at"))
    spark = prepare(results.sparkSession)
    if not exists(spark, path):
        write_partitions(rows.drop("stamp"), path, ROW_PARTITIONS, ("operator_name",))
        return
    new = cut_lineage(rows)
    # A key's second is in its day's partition, so no other partition can hold it.
    places = new.select(*ROW_PARTITIONS).distinct()
    around = scan(spark, path, "operator_results").where(within(places.collect(), *ROW_PARTITIONS)).join(places, list(ROW_PARTITIONS), "left_semi")
    both = around.withColumn("stamp", F.date_trunc("second", "received_at")).select(*new.columns).unionByName(new)
    merged = latest(both, [*RESULT_KEY, "stamp"], "received_at", "s3_uri").drop("stamp")
    write_partitions(cut_lineage(merged), path, ROW_PARTITIONS, ("operator_name",))


def write_index(index: DataFrame, path: str) -> None:
    """Put index rows in place of the stored ones of the same conversations, by month of arrival."""
    rows = index.withColumn("month", F.date_format("received_at", "yyyyMM"))
    merge_rows(rows, path, INDEX_PARTITIONS, CONVERSATION_KEY, ("field_value",))


def write_metrics(gold: DataFrame, path: str) -> None:
    """Replace whole months."""
    write_partitions(gold_table(gold), path, GOLD_PARTITIONS, ("metric_name", "date"))


def replace_days(new: DataFrame, days: DataFrame, path: str) -> None:
    """Replace the given `(tenant_id, date)` pairs inside their month partitions.

    The other days of the touched months are read from the table itself, so the
    merged rows go to the shared checkpoint folder before the partitions are
    overwritten. A day in `days` without new rows ends up empty.
    """
    spark = new.sparkSession
    gold = gold_table(new)
    if not exists(spark, path):
        write_partitions(gold, path, GOLD_PARTITIONS, ("metric_name", "date"))
        return
    touched = days.select("tenant_id", "date").distinct()
    months = touched.select(
        "tenant_id", F.substring("date", 1, 4).alias("year"), F.substring("date", 5, 2).alias("month")
    ).distinct()
    old = scan(spark, path, "metrics").where(within(months.collect(), *GOLD_PARTITIONS))
    kept = old.join(months, list(GOLD_PARTITIONS), "left_semi").join(touched, ["tenant_id", "date"], "left_anti")
    merged = kept.select(*gold.columns).unionByName(gold)
    replace_partitions(merged, old.join(months, list(GOLD_PARTITIONS), "left_semi"), path, GOLD_PARTITIONS, ("metric_name", "date"))


def replace_partitions(rows: DataFrame, old: DataFrame, path: str, partitions: Sequence[str], sort: Sequence[str] = ()) -> None:
    """Put `rows` in place of `old`, the stored rows of whole partitions.

    Partitions left without rows are dropped after the others are written: as many folders as there are such partitions.
    """
    rows = cut_lineage(rows)
    spark = rows.sparkSession
    emptied = old.select(*partitions).distinct().join(rows.select(*partitions).distinct(), list(partitions), "left_anti").collect()
    write_partitions(rows, path, partitions, sort)
    for place in emptied:
        drop_folder(spark, partition_path(spark, path, **{p: place[p] for p in partitions}))


def merge_rows(
    new: DataFrame,
    path: str,
    partitions: Sequence[str],
    keys: Sequence[str],
    sort: Sequence[str] = (),
    within: Column | None = None,
    gone: DataFrame | None = None,
) -> None:
    """Replace the stored rows whose `keys` occur in `new`, or in `gone`, by the rows of `new`; all others stay.

    Only partitions that hold such rows, old or new, are read as a whole and written again. `within` is a
    partition predicate outside of which no such old row lies; no other partition is opened.
    """
    spark = prepare(new.sparkSession)
    if not exists(spark, path):
        write_partitions(new, path, partitions, sort)
        return
    new = cut_lineage(new)
    old = spark.read.schema(new.schema).parquet(path)
    new_places = new.select(*partitions).distinct()
    if within is not None:
        old = old.where(within | _among(new_places.collect(), *partitions))
    named = new.select(*keys) if gone is None else new.select(*keys).union(gone.select(*keys))
    named = named.distinct()
    touched = old.join(named, list(keys), "left_semi").select(*partitions).union(new_places).distinct()
    around = old.join(touched, list(partitions), "left_semi")
    kept = around.join(named, list(keys), "left_anti")
    replace_partitions(kept.select(*new.columns).unionByName(new), around, path, partitions, sort)


def drop_expired(spark: SparkSession, path: str, table: str, partitions: Sequence[str], as_of: Column | None = None) -> int:
    """Delete the rows of a stored table whose retention has passed, for a quiet hour; returns how many partitions it opened.

    Only partitions with such rows are written again, and those left empty go.
    """
    rows = scan(prepare(spark), path, table)
    now = F.current_timestamp() if as_of is None else as_of
    places = rows.where(F.col("expires_at") <= now).select(*partitions).distinct().collect()
    if not places:
        return 0
    stale = spark.createDataFrame(places)
    around = rows.where(within(places, *partitions)).join(stale, list(partitions), "left_semi")
    replace_partitions(around.where(F.col("expires_at") > now), around, path, partitions)
    return len(places)


def register_table(spark: SparkSession, name: str, table: str, path: str) -> None:
    """Catalog table over stored Parquet; partitions are discovered."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in TABLES[table])
    partitions = GOLD_PARTITIONS if table == "metrics" else ROW_PARTITIONS
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet "
        f"PARTITIONED BY ({', '.join(partitions)}) LOCATION '{path}'"
    )
    repair_table(spark, name)


def repair_table(spark: SparkSession, name: str) -> None:
    """Discover partitions written by another job."""
    spark.sql(f"MSCK REPAIR TABLE {name}")


def entities(dump: DataFrame, entity_type: str, tenant: str | None = None) -> DataFrame:
    """Rows of one entity type of the exported key-value table."""
    rows = dump.where(F.col("entityType") == entity_type)
    return rows if tenant is None else rows.where(tenant_of(F.col("PK")) == tenant)


def metrics_clean(dump: DataFrame) -> DataFrame:
    """Aggregates of the exported key-value table as plain columns."""
    rows = entities(dump, "AGGREGATE")
    return rows.select(
        tenant_of(F.col("PK")).alias("tenant_id"),
        F.to_date(day_of(F.col("SK")), "yyyyMMdd").alias("date"),
        metric_of(F.col("SK")).alias("metric_name"),
        F.get_json_object("payload", "$.value").try_cast("double").alias("metric_value"),
    )


def conversations_clean(dump: DataFrame) -> DataFrame:
    rows = entities(dump, "CONVERSATION")
    channel = F.get_json_object("payload", "$.channel")
    return rows.select(
        tenant_of(F.col("PK")).alias("tenant_id"),
        F.col("conversationId").alias("conversation_id"),
        F.get_json_object("payload", "$.customerKey").alias("customer_key"),
        F.get_json_object("payload", "$.agentId").alias("agent_id"),
        F.col("startedAt").alias("started_at"),
        F.coalesce(F.get_json_object("payload", "$.channel.type"), channel).alias("channel_type"),
        F.get_json_object("payload", "$.operatorCount").try_cast("int").alias("operator_count"),
    )


def operators_clean(dump: DataFrame) -> DataFrame:
    rows = entities(dump, "OPERATOR_RESULT")
    return rows.select(
        tenant_of(F.col("PK")).alias("tenant_id"),
        F.col("conversationId").alias("conversation_id"),
        F.col("operatorName").alias("operator_name"),
        F.col("schemaVersion").alias("schema_version"),
        F.col("receivedAt").alias("received_at"),
        F.get_json_object("payload", "$.enrichedPayload").alias("enriched_payload"),
        F.get_json_object("payload", "$.displayFields").alias("display_fields"),
    )
