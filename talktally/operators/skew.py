"""Equi-joins against a side with unique keys, safe when one key owns many rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 64


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with at least `hot_rows` rows: at most row count / hot_rows of them.

    Counted with partial aggregation over the key columns only.
    """
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows).drop("_n")


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys, the hot keys)."""
    hot = hot_keys(df, keys, hot_rows)
    return df.join(hot, list(keys), "left_anti"), df.join(hot, list(keys), "left_semi"), hot


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    hot_rows: int | None = None,
    salts: int = SALTS,
    spread: Sequence[str] = (),
) -> DataFrame:
    """Join `left` to `right`, which has unique keys, on `keys`.

    Adaptive execution splits skewed keys of `left`. With `hot_rows`, keys are counted first: rows whose
    key is null never enter the shuffle, and rows of a hot key are
    spread over `salts` tasks by the hash of the `spread` columns (all columns that
    can be hashed, unless given) and only the hot rows of `right` are copied once
    per salt.
    """
    keys = list(keys)
    if hot_rows is None:
        return left.join(right, keys, how)
    complete = F.lit(True)
    for key in keys:
        complete = complete & F.col(key).isNotNull()
    usable, keyless = left.where(complete), left.where(~complete)
    hot = hot_keys(usable, keys, hot_rows).withColumn("_hot", F.lit(True))
    spread_over = list(spread) or _hashable(left)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread_over), F.lit(salts))).otherwise(0)
    salted = usable.join(hot, keys, "left").withColumn("_salt", salt.cast("int")).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    replicated = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    joined = salted.join(replicated, [*keys, "_salt"], how).drop("_salt")
    if how == "left":
        missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema if f.name not in keys]
        joined = joined.unionByName(keyless.select("*", *missing))
    return joined


def _hashable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if "variant" not in f.dataType.simpleString() and "map<" not in f.dataType.simpleString()]
