"""Mixing sources to target weights with hash-threshold histograms (no Python, no sort of documents).

A document's place is the first 48 bits of the MD5 of its id and text. Per source, words are summed by the
leading bits of that place; the bucket in which the budget runs out is found from the running
sums and only its documents are summed again by the next bits. The budget thus becomes one
threshold per source, and a document is taken if its place lies below it. A smaller budget gives a
smaller threshold, so its documents are a subset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.llm.base import query, stored, table, word_count

BITS, LEVELS = 12, 4
PLACE_BITS = BITS * LEVELS


def place(doc_id: Column, text: Column) -> Column:
    """48 bits of the hash of id and text, so that documents without an id, or with one id, have places of their own."""
    digits = F.md5(F.concat_ws("#", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))
    return F.conv(F.substring(digits, 1, PLACE_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Per source its size and target.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes;
    none gets more than `most` times its size, and what is over goes to the others by weight. In the
    order of limit over weight the sources at their limit come first, so running sums give the
    common level of the others without a loop.
    """
    # One row per source: these windows over all sources are small.
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    per = per.withColumn("limit", (F.col("source_size") * most).cast("double"))
    per = per.withColumn("fill", F.col("limit") / F.col("weight"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns(
        {
            "before": F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every).cast("double"),
        }
    )
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(every)["level"]
    return per.withColumn("common", level).select(
        "source", "source_size", F.least(F.col("limit"), F.col("weight") * F.col("common")).alias("target")
    )


def thresholds(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Per source: source_size, target, whole (how often all is taken) and the threshold for once more."""
    plan = targets(sizes, weights, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", full).withColumn(
        "rest", F.when(F.col("whole") >= most, 0.0).otherwise(F.col("target") - F.col("whole") * F.col("source_size"))
    )
    cut = plan.select("source", "source_size", "target", "whole", "rest", F.lit(0).cast("long").alias("prefix"))
    for level in range(LEVELS):
        cut = stored(_refined(sizes, cut, level), "mix-cut")
    nearer = (F.col("rest") > 0) & (F.col("bucket_size") - F.col("rest") < F.col("rest"))
    last = F.when(F.col("source_size") == 0, 0).when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix"))
    return cut.select("source", "source_size", "target", "whole", last.alias("threshold"))


def sizes_of(docs: DataFrame) -> DataFrame:
    placed = place(F.col("doc_id"), F.col("text")).alias("place")
    return stored(docs.select("doc_id", "source", word_count("text").alias("size"), placed), "mix-sizes")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, copies, taken.

    `taken` is `copies` times the size. All documents are taken as often as the target holds the source
    whole; the rest of the target takes those below the threshold once more. The document at which
    the rest runs out is taken if that comes nearer. Null and empty texts have size 0; rows that agree in id and text
    are one document and taken together; a source without words takes nothing; an empty table gives no rows.
    """
    sizes = sizes_of(docs)
    cut = thresholds(sizes, weights, most).withColumnRenamed("source", "_source")
    joined = sizes.join(cut, F.col("source").eqNullSafe(F.col("_source")))
    copies = F.col("whole") + (F.col("place") < F.col("threshold")).cast("long")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of `docs` that the mix takes, each as often as it is taken."""
    cut = thresholds(sizes_of(docs), weights, most).withColumnRenamed("source", "_source")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    joined = rows.join(cut, F.col("row.source").eqNullSafe(F.col("_source")))
    below = place(F.col("row.doc_id"), F.col("row.text")) < F.col("threshold")
    copies = (F.col("whole") + below.cast("long")).cast("int")
    repeated = joined.select("row", F.explode(F.array_repeat(F.lit(1), copies)).alias("turn"))
    return repeated.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _refined(sizes: DataFrame, cut: DataFrame, level: int) -> DataFrame:
    """Extend each source's prefix by the bucket in which its rest runs out; the rest loses what lies before."""
    above, here = PLACE_BITS - BITS * level, PLACE_BITS - BITS * (level + 1)
    known = cut.select(F.col("source").alias("_source"), F.col("prefix").alias("_prefix"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.shiftright("place", above) == F.col("_prefix"))
    bucket = F.shiftright("place", here)
    inside = sizes if level == 0 else sizes.join(known, same, "left_semi")
    sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    running = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("upto", running).withColumnRenamed("source", "_source")
    joined = cut.select("source", "source_size", "target", "whole", "rest", "prefix").join(
        sums, F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    # The first bucket that passes the rest; where none does, the end of the last one.
    passed = F.when(F.col("upto") > F.col("rest"), F.struct("bucket", "bucket_size", "upto"))
    found = joined.groupBy("source", "source_size", "target", "whole", "rest", "prefix").agg(
        F.min(passed).alias("hit"), F.max(F.struct("bucket", "upto")).alias("end")
    )
    return found.select(
        "source",
        "source_size",
        "target",
        "whole",
        F.when(F.col("hit").isNull(), 0.0)
        .otherwise(F.col("rest") - (F.col("hit.upto") - F.col("hit.bucket_size")))
        .alias("rest"),
        F.coalesce(F.col("hit.bucket"), F.col("end.bucket") + 1, F.shiftleft("prefix", BITS)).alias("prefix"),
        F.coalesce(F.col("hit.bucket_size"), F.lit(0)).cast("long").alias("bucket_size"),
    )


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '#' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS place
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source
), f AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS fill FROM s
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(lim) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY fill, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM f
), t AS (
  SELECT source, source_size, least(lim, weight * (SELECT arg_min(lev, fill) FROM l WHERE lev <= fill)) AS target FROM l
), w AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, CASE WHEN whole >= 3 THEN 0.0::DOUBLE ELSE target - whole * source_size END AS rest FROM w
), p AS (
  SELECT d.*, r.source_size, r.target, r.whole, r.rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY d.source, place) AS here
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN upto <= rest THEN 1
                                 WHEN upto - here < rest AND upto - rest < rest - (upto - here) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p
"""


@query("op8_mixing", OP8_SQL)
def op8_mixing(spark, sf_dir):
    """Every document with the words the mix takes of it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
