"""Schema and view registries with per-tenant overrides of defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.functions.values import blank_to_null
from talktally.operators.latest import latest, one_per_key
from talktally.sources import keyed

DEFAULT_TENANT = "default"
KEYS = ("operator_name", "schema_version")


def read_registry_tree(spark: SparkSession, path: str, kind: str = "schema", tenant: str = DEFAULT_TENANT) -> DataFrame:
    """Registry rows from files `<operator>/v<n>.<kind>.json`."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    layout = rf"([^/]+)/(v\d+)\.{kind}\.json$"
    uri = F.url_decode(F.col("_metadata.file_path"))
    rows = files.select(
        F.lit(tenant).alias("tenant_id"),
        F.regexp_extract(uri, layout, 1).alias("operator_name"),
        F.regexp_extract(uri, layout, 2).alias("schema_version"),
        F.col("value").alias("definition"),
        F.lit("active").alias("status"),
        F.col("_metadata.file_modification_time").alias("created_at"),
    )
    return rows.where(F.col("operator_name") != "")


def with_overrides(registry: DataFrame, tenant: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Default rows, replaced by the tenant's own rows of the same key."""
    own = registry.where(F.col("tenant_id") == tenant)
    if tenant == DEFAULT_TENANT:
        return own
    defaults = registry.where(F.col("tenant_id") == DEFAULT_TENANT)
    return defaults.join(own.select(*keys), list(keys), "left_anti").select(*registry.columns).unionByName(own)


def lookup(registry: DataFrame, tenant: str, operator: str, version: str) -> DataFrame:
    """The tenant's entry, else the default one, else no row."""
    hits = registry.where(
        (F.col("operator_name") == operator)
        & (F.col("schema_version") == version)
        & F.col("tenant_id").isin(tenant, DEFAULT_TENANT)
    )
    return one_per_key(hits, list(KEYS), [(F.col("tenant_id") == DEFAULT_TENANT).asc()])


def named(rows: DataFrame) -> DataFrame:
    """Rows with operator and version; others are refused."""
    return rows.where(blank_to_null(F.col("operator_name")).isNotNull() & blank_to_null(F.col("schema_version")).isNotNull())


def store(rows: DataFrame, path: str, keys: Sequence[str] = KEYS) -> None:
    """Put rows over the stored registry: per tenant and key the last created one stays."""
    keyed.put(named(rows), path, ["tenant_id", *keys], "created_at")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return keyed.read(spark, path)


def upsert(registry: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Registry with `rows` put over it; rows without operator or version are refused."""
    return latest(registry.unionByName(named(rows)), ["tenant_id", *keys], "created_at")
