"""Turn-taking times of transcripts.

The first speaker is the agent, the first other channel the customer; further
channels are neither. Only adjacent sentences make a gap, negative gaps are
dropped and zero is kept.

Ordinary transcripts go through one window over `(tenant, transcript)`, whose
partitioning the final aggregate reuses. With `hot_rows`, a transcript with that many
sentences is not put into one task: its time is cut into slices of equal length, gaps are
taken inside each slice, and each slice is stitched to the next one that has sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.functions.values import round2
from talktally.operators.skew import hot_keys

KEYS = ["tenant_id", "transcript_sid"]
ORDER = ["start_time", "sentence_index", "end_time", "media_channel"]
# Fixed value: longer transcripts carry corrupted times.
MAX_HANDLING_SEC = 7200


def typed_sentences(raw: DataFrame) -> DataFrame:
    """Times and confidence arrive as text; unreadable ones become null."""
    number = {c: F.col(c).cast("string").try_cast("double") for c in ("start_time", "end_time", "confidence")}
    return raw.withColumns({c: e for c, e in number.items() if c in raw.columns})


def timing(sentences: DataFrame, hot_rows: int | None = None, ranges: int | None = None) -> DataFrame:
    """One row per transcript; none for a transcript with an implausible duration."""
    slim = sentences.select(*KEYS, *ORDER)
    if hot_rows is None:
        return _finish(_sums_by_window(slim))
    hot = hot_keys(slim, KEYS, hot_rows)
    ordinary = _sums_by_window(slim.join(hot, KEYS, "left_anti"))
    split = _sums_by_range(slim.join(hot, KEYS, "left_semi"), ranges)
    return _finish(ordinary.unionByName(split))


def _gap(role_from: str, role_to: str) -> Column:
    gap = F.col("next_start") - F.col("end_time")
    turn = (F.col("media_channel") == F.col(role_from)) & (F.col("next_channel") == F.col(role_to))
    return F.when(turn & (gap >= 0), gap)


def _gap_sums(copies: Column | None = None) -> list[Column]:
    n = F.lit(1) if copies is None else copies
    return [
        F.sum(_gap("customer", "agent")).alias("response_sum"),
        F.count(_gap("customer", "agent")).alias("response_n"),
        F.sum(_gap("agent", "customer")).alias("wait_sum"),
        F.count(_gap("agent", "customer")).alias("wait_n"),
        F.sum(n).alias("sentences"),
        F.sum(F.when(F.col("media_channel") == F.col("agent"), n).otherwise(0)).alias("agent_sentences"),
        F.sum(F.when(F.col("media_channel") == F.col("customer"), n).otherwise(0)).alias("customer_sentences"),
    ]


def _sums_by_window(sentences: DataFrame) -> DataFrame:
    in_order = Window.partitionBy(*KEYS).orderBy(*ORDER)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sentences.select(
        "*",
        F.lead("start_time").over(in_order).alias("next_start"),
        F.lead("media_channel").over(in_order).alias("next_channel"),
        F.first("media_channel").over(in_order).alias("agent"),
        F.first("start_time").over(in_order).alias("first_start"),
        F.last("end_time").over(whole).alias("last_end"),
    )
    other = F.when(F.col("media_channel") != F.col("agent"), F.col("media_channel"))
    rows = rows.withColumn("customer", F.first(other, ignorenulls=True).over(whole))
    return rows.groupBy(*KEYS).agg(
        *_gap_sums(),
        F.first("first_start").alias("first_start"),
        F.first("last_end").alias("last_end"),
    )


def _sums_by_range(sentences: DataFrame, ranges: int | None) -> DataFrame:
    # Copies of a sentence are collapsed first: they share a channel, so no gap lies between them.
    runs = sentences.groupBy(*KEYS, *ORDER).agg(F.count(F.lit(1)).alias("copies"))
    position = F.struct(*ORDER)
    ends = runs.groupBy(*KEYS).agg(
        F.min_by("media_channel", position).alias("agent"),
        F.min_by("start_time", position).alias("first_start"),
        F.max_by("end_time", position).alias("last_end"),
    )
    # One row per hot transcript, so few of them.
    other = runs.join(ends.select(*KEYS, "agent"), KEYS).where(F.col("media_channel") != F.col("agent"))
    customer = other.groupBy(*KEYS).agg(F.min_by("media_channel", position).alias("customer"))
    roles = ends.join(customer, KEYS, "left")

    parts = ranges or int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A slice follows from the start time alone, so every reading of a row agrees on it.
    ranged = runs.withColumn("_range", F.floor(F.col("start_time") * (parts / MAX_HANDLING_SEC)))
    inside = Window.partitionBy(*KEYS, "_range").orderBy(*ORDER)
    steps = ranged.select(
        *KEYS,
        "_range",
        *ORDER,
        "copies",
        F.lead("start_time").over(inside).alias("next_start"),
        F.lead("media_channel").over(inside).alias("next_channel"),
    )
    edges = ranged.groupBy(*KEYS, "_range").agg(
        F.min_by("start_time", position).alias("head_start"),
        F.min_by("media_channel", position).alias("head_channel"),
        F.max_by("end_time", position).alias("end_time"),
        F.max_by("media_channel", position).alias("media_channel"),
    )
    across = Window.partitionBy(*KEYS).orderBy("_range")
    joints = edges.select(
        *KEYS,
        "end_time",
        "media_channel",
        F.lead("head_start").over(across).alias("next_start"),
        F.lead("head_channel").over(across).alias("next_channel"),
        F.lit(0).cast("bigint").alias("copies"),
    )
    moves = steps.select(*joints.columns).unionByName(joints).join(roles, KEYS)
    return moves.groupBy(*KEYS).agg(
        *_gap_sums(F.col("copies")),
        F.first("first_start").alias("first_start"),
        F.first("last_end").alias("last_end"),
    )


def _finish(sums: DataFrame) -> DataFrame:
    handling = F.col("last_end") - F.col("first_start")
    average = {
        name: F.when(F.col(f"{name}_n") > 0, round2(F.col(f"{name}_sum") / F.col(f"{name}_n"))).otherwise(F.lit(0.0))
        for name in ("response", "wait")
    }
    return sums.where((handling >= 0) & (handling <= MAX_HANDLING_SEC)).select(
        *KEYS,
        round2(handling).alias("handlingTimeSec"),
        average["response"].alias("avgResponseTimeSec"),
        average["wait"].alias("avgCustomerWaitTimeSec"),
        F.col("sentences").cast("bigint").alias("sentenceCount"),
        F.col("agent_sentences").cast("bigint").alias("agentSentenceCount"),
        F.col("customer_sentences").cast("bigint").alias("customerSentenceCount"),
    )


def as_struct(timings: DataFrame) -> DataFrame:
    """Key columns and one `timing` struct."""
    return timings.select(*KEYS, F.struct(*[c for c in timings.columns if c not in KEYS]).alias("timing"))
