"""The raw archive: one JSON document per file, read as VARIANT."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.functions import variants as V
from talktally.functions.values import blank_to_null, content_hash

# Layout: <root>/tenant/operator/version/yyyy-MM-dd/conversation-stamp.json
_LAYOUT = r"([^/]+)/([^/]+)/([^/]+)/(\d{4}-\d{2}-\d{2})/([^/]+)-(\d{14})\.json$"


def read_documents(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """One row per file below `path`: `body VARIANT, source_uri, tenant_header, received_at`.

    The scan itself yields VARIANT, so later predicates never parse the text again. `since` and
    `until` (days, inclusive) replay a range of the archive by the day in the file path.
    """
    return _documents(_json_reader(spark.read).json(path), since, until)


def stream_documents(
    spark: SparkSession, path: str, max_files: int = 10_000, since: str | None = None, until: str | None = None
) -> DataFrame:
    """The same as a stream over files as they arrive.

    With a range of days it replays that part of the archive: run it with a checkpoint of its own, to its end, beside the live
    stream and under another name. What the live stream stored already is recognised by its content.
    """
    return _documents(_json_reader(spark.readStream).option("maxFilesPerTrigger", max_files).json(path), since, until)


def _json_reader(reader):
    return (
        reader.option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("singleVariantColumn", "body")
    )


def _documents(files: DataFrame, since: str | None, until: str | None) -> DataFrame:
    uri = F.url_decode(F.col("_metadata.file_path"))
    if since is not None or until is not None:
        day = F.regexp_extract(uri, _LAYOUT, 4)
        files = files.where(day.between(since or "0000-00-00", until or "9999-99-99"))
    stamp = F.try_to_timestamp(F.regexp_extract(uri, _LAYOUT, 6), F.lit("yyyyMMddHHmmss"))
    own = F.try_to_timestamp(
        F.coalesce(V.text_at(F.col("body"), "_meta.receivedAt"), V.text_at(F.col("body"), "receivedAt"))
    )
    return files.select(
        "body",
        uri.alias("source_uri"),
        blank_to_null(F.regexp_extract(uri, _LAYOUT, 1)).alias("tenant_header"),
        F.coalesce(own, stamp, F.col("_metadata.file_modification_time")).alias("received_at"),
    )


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole file texts, for audits and for looking into quarantined documents."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return files.select(F.col("value").alias("body_text"), F.url_decode(F.col("_metadata.file_path")).alias("source_uri"))


def split_unreadable(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable objects, quarantine of addresses with a reason)."""
    readable = V.is_object(F.col("body"))
    reason = F.when(F.col("body").isNull(), "not JSON").otherwise("not a JSON object")
    bad = docs.where(~readable).select("source_uri", "received_at", reason.alias("reason"))
    return docs.where(readable), bad


def documents_at(docs: DataFrame, uris: DataFrame) -> DataFrame:
    """Documents whose address is listed in `uris(source_uri)`."""
    return docs.join(uris.select("source_uri").distinct(), "source_uri", "left_semi")


def archive_path(root: str, tenant: Column, operator: Column, version: Column, ts: Column, conversation: Column) -> Column:
    """Address of a document in the archive layout."""
    return F.concat_ws(
        "/",
        F.lit(root.rstrip("/")),
        tenant,
        operator,
        version,
        F.date_format(ts, "yyyy-MM-dd"),
        F.concat(conversation, F.lit("-"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit(".json")),
    )


def archive_documents(fires: DataFrame) -> DataFrame:
    """Fires in the archived document shape, as JSON text, with the partition columns."""
    meta = F.struct(
        F.col("tenant_id").alias("tenantId"),
        F.date_format("received_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("receivedAt"),
    )
    doc = F.struct(
        F.col("ci_version").alias("ciVersion"),
        F.col("conversation_id").alias("conversationId"),
        F.col("operator_name").alias("operatorName"),
        F.col("operator_type").alias("operatorType"),
        F.col("schema_version").alias("schemaVersion"),
        F.date_format("result_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "trigger",
        "data",
        "metadata",
        F.col("timing").alias("timingMetrics"),
        F.col("transcript_sid").alias("transcriptSid"),
        meta.alias("_meta"),
    )
    return fires.select(
        F.to_json(doc).alias("value"),
        "tenant_id",
        "operator_name",
        "schema_version",
        F.date_format("received_at", "yyyy-MM-dd").alias("date"),
    )


def append_archive(fires: DataFrame, path: str, run: str | None = None) -> None:
    """Append fires as JSON lines under tenant/operator/version/date partitions, and below them by run.

    The same named `run` again replaces its lines; without a name every call is a run of its own.
    """
    rows = archive_documents(fires).withColumn("run", F.lit(run or uuid.uuid4().hex))
    parts = ["tenant_id", "operator_name", "schema_version", "date", "run"]
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).text(path)


def read_lines(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Documents written by `append_archive`, one per line; of a range of days, whose partitions alone are opened."""
    return _lines(spark.read.text(path), since, until)


_LINES = "value string, tenant_id string, operator_name string, schema_version string, date string, run string"


def stream_lines(spark: SparkSession, path: str, max_files: int = 1000, since: str | None = None, until: str | None = None) -> DataFrame:
    """The same as a stream; with a range of days, a replay of it (see `stream_documents`)."""
    reader = spark.readStream.format("text").schema(_LINES).option("maxFilesPerTrigger", max_files)
    return _lines(reader.load(path), since, until)


def _lines(lines: DataFrame, since: str | None, until: str | None) -> DataFrame:
    if since is not None or until is not None:
        lines = lines.where(F.col("date").between(since or "0000-00-00", until or "9999-99-99"))
    return lines.select(
        F.col("value").alias("body_text"),
        V.parse(F.col("value")).alias("body"),
        F.concat_ws("#", F.col("_metadata.file_path"), F.sha2("value", 256)).alias("source_uri"),
        F.col("tenant_id").cast("string").alias("tenant_header"),
        F.try_to_timestamp(V.text_at(V.parse(F.col("value")), "_meta.receivedAt")).alias("received_at"),
    )


def integrity_audit(docs: DataFrame, body: str = "body_text", declared: str = "declared_hash") -> DataFrame:
    """Add `body_hash` and `intact`: the body's SHA-256 equals the declared one."""
    return docs.withColumn("body_hash", content_hash(F.col(body))).withColumn(
        "intact", F.coalesce(F.col("body_hash") == F.lower(declared), F.lit(False))
    )
