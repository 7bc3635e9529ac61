"""Line dedup by winnowing over line hashes (no Python).

Every line with words is hashed. From each of them a window runs on until it holds `least` words; the
smallest line hash in it is a fingerprint. A repeated stretch of `least` words or more contains such a
window, and its fingerprint depends on nothing outside, so both copies have it. Fingerprints met once are put aside;
around the others, equal windows extend a match forwards and backwards as long as they go on, and all but the
first copy of each is deleted.

Windows that run on from each line leave what follows the last of them in a repeated stretch. With `whole`, others run
back from each line, so every line of such a stretch lies in a window that ends or begins within it.

Fingerprints and windows are aggregated to their first place, so a passage in a million documents gives a
million rows, never pairs of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.llm.base import WORD, query, stored, table

LEAST = 50


def _window(lines: Column, least: int, seed: int = 0) -> Column:
    """The shortest run of `lines` from the first one with `least` words; each line has a word, so it has `least` lines at most."""
    empty = F.struct(
        F.lit(0).alias("words"),
        F.lit(seed).cast("long").alias("content"),
        F.lit(None).cast("long").alias("mark"),
        F.lit(-1).alias("mark_at"),
        F.lit(-1).alias("first"),
        F.lit(-1).alias("last"),
    )

    def grow(w: Column, line: Column) -> Column:
        smaller = F.coalesce(line["hash"] <= w["mark"], F.lit(True))
        return F.when(w["words"] >= least, w).otherwise(
            F.struct(
                (w["words"] + line["words"]).alias("words"),
                F.xxhash64(w["content"], line["hash"]).alias("content"),
                F.when(smaller, line["hash"]).otherwise(w["mark"]).alias("mark"),
                F.when(smaller, line["at"]).otherwise(w["mark_at"]).alias("mark_at"),
                F.when(w["first"] < 0, line["at"]).otherwise(w["first"]).alias("first"),
                line["at"].alias("last"),
            )
        )

    return F.aggregate(lines, empty, grow)


def windows(docs: DataFrame, least: int = LEAST, whole: bool = True) -> DataFrame:
    """doc_id, copy (hash of the text), content, mark, mark_at, first, last: the windows of every text.

    With `whole`, also those that run back. They hash their lines in that order from another seed, so they equal only
    each other; of one line, both would be the same.
    """
    lines = F.transform(
        F.split("text", "\n"),
        lambda line, at: F.struct(F.xxhash64(line).alias("hash"), F.regexp_count(line, F.lit(WORD)).alias("words"), at.alias("at")),
    )
    cut = docs.select("doc_id", F.xxhash64("text").alias("copy"), lines.alias("lines"))
    cut = cut.select("doc_id", "copy", F.filter("lines", lambda x: x["words"] > 0).alias("lines"))
    made = F.transform("lines", lambda _, at: _window(F.slice("lines", at + 1, least), least))
    if whole:
        before = lambda at: F.slice("lines", F.greatest(at - least + 2, F.lit(1)), F.least(at + 1, F.lit(least)))
        turned = F.transform("lines", lambda _, at: _window(F.reverse(before(at)), least, seed=1))
        turned = F.transform(turned, lambda w: w.withField("first", w["last"]).withField("last", w["first"]))
        made = F.concat(made, F.filter(turned, lambda w: w["first"] < w["last"]))
    out = cut.select("doc_id", "copy", F.inline_outer(made)).where(F.col("words") >= least)
    return out.select("doc_id", "copy", "content", "mark", "mark_at", "first", "last")


def repeated_runs(docs: DataFrame, least: int = LEAST, whole: bool = True) -> DataFrame:
    """doc_id, copy and the runs of lines to delete: an array of (first, last) in order, apart from each other."""
    every = stored(windows(docs, least, whole), "line-windows")
    place = F.struct("doc_id", "copy", "mark_at")
    marks = every.groupBy("mark").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high")
    near = every.join(marks.select("mark"), "mark", "left_semi").select("doc_id", "copy", "content", "first", "last")
    near = stored(near, "line-near")
    firsts = near.groupBy("content").agg(
        F.min(F.struct("doc_id", "copy", "first")).alias("low"), F.max(F.struct("doc_id", "copy", "first")).alias("high")
    )
    firsts = firsts.where("low <> high").select("content", "low")
    later = near.join(firsts, "content").where(F.struct("doc_id", "copy", "first") > F.col("low")).select("doc_id", "copy", "first", "last").distinct()
    # Windows that touch or overlap are one run.
    inside = Window.partitionBy("doc_id", "copy").orderBy("first")
    later = later.withColumn("upto", F.max("last").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    later = later.withColumn("run", F.sum(F.coalesce(F.col("first") > F.col("upto") + 1, F.lit(True)).cast("int")).over(inside))
    runs = later.groupBy("doc_id", "copy", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, least: int = LEAST, lines: str = "n_lines", deleted: str = "n_deleted", whole: bool = True) -> DataFrame:
    """The columns of `docs` with later repeated runs of lines deleted from `text`, and both counts of lines (long).

    Places are ordered by doc_id (null first), then text; the first copy of a run stays, others go, also within one
    text. Lines without words belong to no window; those inside a deleted run go with it. Repeated rows are
    one document and stay as they are; another document with their text loses it to them. A null text stays null
    with no lines. Columns of these names are replaced.

    A repeated run is any stretch of lines with `least` words that an earlier place has too, so with `whole` a text of that
    many words that is repeated as a whole loses all lines from its first to its last one with words. Without `whole`, only
    the shortest windows from each line are compared: up to `least` - 1 words at the end of a run stay.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), least, whole).select(F.col("doc_id").alias("_run_doc"), F.col("copy").alias("_run_copy"), F.col("runs").alias("_runs"))
    kept = [c for c in docs.columns if c not in (lines, deleted)]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("body"))
    joined = rows.withColumn("copy", F.xxhash64("body")).join(
        runs, F.col("id").eqNullSafe(F.col("_run_doc")) & (F.col("copy") == F.col("_run_copy")), "left"
    )
    joined = joined.withColumn("parts", F.split("body", "\n"))
    n = F.size("_runs")

    def between(k: Column) -> Column:
        """The lines before run k and behind the one before it; after the last run, the rest."""
        start = F.when(k == 0, 0).otherwise(F.get("_runs", k - 1)["last"] + 1)
        end = F.when(k == n, F.size("parts")).otherwise(F.get("_runs", k)["first"])
        return F.slice("parts", start + 1, end - start)

    rest = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), n), between)), "\n")
    gone = F.aggregate("_runs", F.lit(0), lambda sum_, r: sum_ + r["last"] - r["first"] + 1)
    shorter = F.when(F.col("_runs").isNull(), F.col("body")).otherwise(rest).alias("text")
    return joined.select(
        *(shorter if c == "text" else F.col("row").getField(c).alias(c) for c in kept),
        F.when(F.col("body").isNull(), 0).otherwise(F.size("parts")).cast("long").alias(lines),
        F.coalesce(gone, F.lit(0)).cast("long").alias(deleted),
    )


OP5_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM split)
), w AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS upto
  FROM l WHERE words > 0
), ends AS (
  SELECT a.doc_id, a.pos AS first, min(b.pos) AS last, min(b.k) AS last_k, min(a.k) AS first_k
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 AND b.upto - a.upto + a.words >= 50
  GROUP BY a.doc_id, a.pos
), begins AS (
  SELECT a.doc_id, max(b.pos) AS first, a.pos AS last, min(a.k) AS last_k, max(b.k) AS first_k
  FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 49 AND a.k AND a.upto - b.upto + b.words >= 50
  GROUP BY a.doc_id, a.pos
), whole AS (SELECT doc_id, list(line ORDER BY pos) AS lines FROM w GROUP BY doc_id),
win AS (
  SELECT e.doc_id, first, last, 'on' AS way, lines[first_k:last_k] AS content FROM ends e JOIN whole USING (doc_id)
  UNION ALL SELECT e.doc_id, first, last, 'back', lines[first_k:last_k] FROM begins e JOIN whole USING (doc_id) WHERE first < last
), later AS (
  SELECT doc_id, first, last, row_number() OVER (PARTITION BY way, content ORDER BY doc_id, first) AS turn FROM win
), gone AS (
  SELECT DISTINCT l.doc_id, l.pos FROM l JOIN later d ON l.doc_id = d.doc_id AND d.turn > 1 AND l.pos BETWEEN d.first AND d.last
), left_over AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS text,
         count(*) AS n_lines, count(g.pos) AS n_deleted
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted
FROM documents d LEFT JOIN left_over o ON d.doc_id = o.doc_id
"""


@query("op5_line_dedup", OP5_SQL)
def op5_line_dedup(spark, sf_dir):
    """Every document's text without later repeated runs of lines, to both ends."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
