"""Where conversations are stored: conversation → days of the partitions that hold, or have held, its header.

Headers are stored by the day a conversation began, so whoever brings one up to date has to know that day. The locator is narrow, dealt
by a hash of the conversation, and only grows by conversations that are new or whose beginning moved: a run opens the shares of its own conversations, and
then only the days named there. A day too many is harmless, so entries are appended and a repeated run may enter them again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talktally.session import cut_lineage, prepare
from talktally.sources import lake

SHARES = 16
PARTITIONS = ("tenant_id", "share")
KEYS = ["tenant_id", "conversation_id"]
SCHEMA = "conversation_id string, day string, tenant_id string, share string"


def share_of(conversation: Column) -> Column:
    return F.lpad(F.pmod(F.xxhash64(conversation), F.lit(SHARES)).cast("string"), 2, "0")


def find(spark: SparkSession, path: str, conversations: DataFrame) -> DataFrame:
    """(tenant_id, conversation_id, day) of the given conversations, as far as they are stored."""
    if not lake.exists(spark, path):
        return spark.createDataFrame([], "tenant_id string, conversation_id string, day string")
    named = conversations.select(*KEYS).distinct().withColumn("share", share_of(F.col("conversation_id")))
    shares = named.select(*PARTITIONS).distinct().collect()  # at most SHARES a tenant
    rows = prepare(spark).read.schema(SCHEMA).parquet(path).where(lake.within(shares, *PARTITIONS))
    return rows.join(named, [*KEYS, "share"], "left_semi").select(*KEYS, "day").distinct()


def enter(places: DataFrame, path: str) -> None:
    """Append (tenant_id, conversation_id, day) rows."""
    rows = places.select("conversation_id", "day", "tenant_id", share_of(F.col("conversation_id")).alias("share"))
    dealt = rows.hint("rebalance", *[F.col(p) for p in PARTITIONS])
    dealt.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


def fold(spark: SparkSession, path: str) -> None:
    """Write every share again as one set of rows; for a quiet hour."""
    rows = prepare(spark).read.schema(SCHEMA).parquet(path).distinct()
    lake.write_partitions(cut_lineage(rows), path, PARTITIONS, ("conversation_id",))
