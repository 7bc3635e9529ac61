"""Daily counters kept as increments of runs: what a run costs follows its own fires.

Every run stores the increments of its fresh fires per tenant and day, and gold days are made of the stored increments of the days
the run touched; no payload is read for it. After `FOLD_AT` micro-batches a day's older ones are folded into one, so files
and rows of a day stay few.

A closed day keeps a single row, the digest of its fires. A fire that comes for a closed day is late: it is counted as such, and its
day is made anew from the stored fires. The same goes for days of a run that is stored again.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktally.config import MetricsConfig
from talktally.operators.derived import with_derived
from talktally.operators.gates import with_day
from talktally.operators.increments import DAY, SCHEMA, digests, folded, increments, totals
from talktally.plans.silver import FIRES, Run
from talktally.session import cut_lineage, prepare
from talktally.sources import fires as F_, lake

FOLDER, LATE, GOLD = "increments", "late", "metrics"
PARTITIONS = ("tenant_id", "date", "batch_id")
FOLD_AT = 8
CLOSED = "closed"
# A stream's batches are numbered, behind its name if it has one; a fold is named by the last batch in it.
_NUMBERED = r"^((?:[A-Za-z0-9_.-]*-)?)(upto_)?(\d+)$"


def _path(root: str) -> str:
    return f"{root}/{FOLDER}"


def _scan(spark: SparkSession, root: str) -> DataFrame:
    schema = T.StructType([*SCHEMA.fields, T.StructField("batch_id", T.StringType())])
    return prepare(spark).read.schema(schema).parquet(_path(root))


def _batches(rows: DataFrame) -> DataFrame:
    """(tenant_id, date, batch_id) of the partitions that count, with stream, number and whether it is a fold.

    Batches a fold includes are left out, as is everything beside `closed`.
    """
    name = F.col("batch_id")
    parts = rows.select(*PARTITIONS).distinct().withColumns(
        {
            "stream": F.regexp_extract(name, _NUMBERED, 1),
            "fold": F.regexp_extract(name, _NUMBERED, 2) != "",
            "number": F.regexp_extract(name, _NUMBERED, 3).try_cast("long"),
        }
    )
    included = F.max(F.when(F.col("fold"), F.col("number"))).over(Window.partitionBy(*DAY, "stream"))
    closed = F.max((name == CLOSED).cast("int")).over(Window.partitionBy(*DAY)) == 1
    known = parts.withColumns({"_included": included, "_closed": closed})
    counts = F.coalesce(
        F.col("number").isNull() | F.col("_included").isNull() | F.when(F.col("fold"), F.col("number") == F.col("_included")).otherwise(F.col("number") > F.col("_included")),
        F.lit(True),
    )
    return known.where(counts).drop("_included")


def read(spark: SparkSession, root: str, days: list) -> DataFrame:
    """Increments that count, of the given (tenant_id, date) rows; of a closed day, its digests."""
    if not days or not lake.exists(spark, _path(root)):
        return spark.createDataFrame([], SCHEMA)
    rows = _scan(spark, root).where(lake.within(days, *DAY))
    valid = _batches(rows).join(_frame(spark, days), DAY, "left_semi").select(*PARTITIONS, F.col("_closed").alias("closed"))
    kept = rows.join(valid, list(PARTITIONS)).where(~F.col("closed") | (F.col("kind") == "day"))
    return kept.select(*SCHEMA.fieldNames())


def closed_days(spark: SparkSession, root: str, days: list) -> list:
    """Those of the given days that are closed."""
    if not days or not lake.exists(spark, _path(root)):
        return []
    rows = _scan(spark, root).where(lake.within(days, *DAY) & (F.col("batch_id") == CLOSED))
    found = {(r.tenant_id, r.date) for r in rows.select(*DAY).distinct().collect()}
    return [d for d in days if (d["tenant_id"], d["date"]) in found]


def _frame(spark: SparkSession, days: list) -> DataFrame:
    return spark.createDataFrame([(d["tenant_id"], d["date"]) for d in days], "tenant_id string, date string")


def add(spark: SparkSession, root: str, run: Run, name: int | str, cfg: MetricsConfig, close_after: timedelta | None = None) -> DataFrame:
    """Store the increments of a run and bring the gold days it touches up to date; returns the run's late rows per day.

    With `close_after`, days that lie further behind the newest one are closed afterwards.
    """
    name, days = str(name), _distinct([*run.days, *run.gone_days])
    late = days if run.rebuilt else closed_days(spark, root, days)
    late_days = {(d["tenant_id"], d["date"]) for d in late}
    open_days = [d for d in days if (d["tenant_id"], d["date"]) not in late_days]
    late_rows = _late(spark, run, late)
    if not run.rebuilt:
        _store(spark, root, run, name, cfg, late)
    if late:
        late_rows.write.mode("overwrite").parquet(f"{root}/{LATE}/batch_id={name}")
        close(spark, root, late, cfg, anew=True)
    if open_days:
        _fold(spark, root, open_days, name)
        gold = with_derived(totals(read(spark, root, open_days)), cfg.derived())
        lake.replace_days(gold, _frame(spark, open_days), f"{root}/{GOLD}")
    if close_after is not None:
        close_before(spark, root, cfg, close_after)
    return late_rows


def _distinct(days: list) -> list:
    return list({(d["tenant_id"], d["date"]): d for d in days}.values())


def _late(spark: SparkSession, run: Run, late: list) -> DataFrame:
    rows = with_day(run.fresh).join(_frame(spark, late), DAY, "left_semi")
    return rows.groupBy(*DAY).agg(F.count(F.lit(1)).alias("rows"))


def _store(spark: SparkSession, root: str, run: Run, name: str, cfg: MetricsConfig, late: list) -> None:
    def current(fires: DataFrame) -> DataFrame:
        return with_day(fires).join(_frame(spark, late), DAY, "left_anti").drop("date") if late else fires

    own = F_.digest_of(with_day(current(run.keys)))
    rows = increments(current(run.fresh), cfg, own).withColumn("batch_id", F.lit(name))
    lake.write_partitions(rows, _path(root), PARTITIONS, ("kind",))


def _fold(spark: SparkSession, root: str, days: list, name: str) -> None:
    """Fold the batches before `name` of its stream, on days with `FOLD_AT` of them; these are complete, or `name` would not run."""
    rows = _scan(spark, root).where(lake.within(days, *DAY))
    me = spark.range(1).select(F.regexp_extract(F.lit(name), _NUMBERED, 1).alias("s"), F.regexp_extract(F.lit(name), _NUMBERED, 3).alias("n")).first()
    if not me.n:
        return
    before = (F.col("stream") == me.s) & (F.col("number") < int(me.n)) & ~F.col("_closed")
    mine = cut_lineage(_batches(rows).where(before))
    full = mine.groupBy(*DAY).agg(F.count(F.lit(1)).alias("batches")).where(F.col("batches") >= FOLD_AT)
    places = mine.join(full, DAY, "left_semi").select(*PARTITIONS).collect()  # at most FOLD_AT a day
    if not places:
        return
    chosen = rows.where(lake.within(places, *PARTITIONS)).join(spark.createDataFrame(places), list(PARTITIONS), "left_semi")
    fold = folded(chosen.select(*SCHEMA.fieldNames())).withColumn("batch_id", F.lit(f"{me.s}upto_{int(me.n) - 1}"))
    lake.write_partitions(cut_lineage(fold), _path(root), PARTITIONS, ("kind",))
    # Readers leave these out already; until they are gone they only take room.
    for place in places:
        lake.drop_folder(spark, lake.partition_path(spark, _path(root), **{p: place[p] for p in PARTITIONS}))


def close(spark: SparkSession, root: str, days: list, cfg: MetricsConfig, anew: bool = False) -> None:
    """Leave one row, the digest, of each day; with `anew`, make its counters from the stored fires first."""
    if anew:
        fires = F_.read_fires(spark, f"{root}/{FIRES}", _frame(spark, days))
        known = F_.day_digests(spark, f"{root}/{FIRES}", days).join(_frame(spark, days), DAY, "left_semi")
        rows = cut_lineage(increments(fires, cfg, known))
        gold = with_derived(totals(rows), cfg.derived())
        lake.replace_days(gold, _frame(spark, days), f"{root}/{GOLD}")
    else:
        rows = read(spark, root, days)
    single = cut_lineage(folded(rows.where(F.col("kind") == "day")).withColumn("batch_id", F.lit(CLOSED)))
    lake.write_partitions(single, _path(root), PARTITIONS)
    others = _scan(spark, root).where(lake.within(days, *DAY) & (F.col("batch_id") != CLOSED))
    for place in others.join(_frame(spark, days), DAY, "left_semi").select(*PARTITIONS).distinct().collect():
        lake.drop_folder(spark, lake.partition_path(spark, _path(root), **{p: place[p] for p in PARTITIONS}))


def close_before(spark: SparkSession, root: str, cfg: MetricsConfig, behind: timedelta) -> list:
    """Close the days that lie further than `behind` the newest day with fires; returns them."""
    parts = _scan(spark, root).select(*PARTITIONS).distinct()
    newest = parts.agg(F.max("date").alias("date")).first().date
    if newest is None:
        return []
    horizon = f"{datetime.strptime(newest, '%Y%m%d') - behind:%Y%m%d}"
    state = parts.where(F.col("date") < horizon).groupBy(*DAY).agg(F.max((F.col("batch_id") == CLOSED).cast("int")).alias("closed"))
    days = state.where("closed = 0").select(*DAY).collect()
    if days:
        close(spark, root, days, cfg)
    return days


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """(tenant_id, date, rows, batch_id): how many fires came for days that were closed."""
    schema = "tenant_id string, date string, rows long, batch_id string"
    if not lake.exists(spark, f"{root}/{LATE}"):
        return spark.createDataFrame([], schema)
    return prepare(spark).read.schema(schema).parquet(f"{root}/{LATE}")


def differing_days(spark: SparkSession, root: str, days: list) -> list:
    """Those of the given days whose stored fires are not the ones their counters stand for. Reads no payload."""
    stored = F_.day_digests(spark, f"{root}/{FIRES}", days)
    counted = digests(read(spark, root, days)).withColumnsRenamed({"fires": "counted", "digest": "counted_digest"})
    both = stored.join(counted, DAY, "full_outer").join(_frame(spark, days), DAY, "left_semi")
    same = F.col("fires").eqNullSafe(F.col("counted")) & F.col("digest").eqNullSafe(F.col("counted_digest"))
    return both.where(~same).select(*DAY).collect()
