"""Quality rules whose cutoffs come with a guarantee (no Python).

A rule rejects a document whose measure passes a cutoff. In each stratum (language) the cutoffs of all rules are
put in one fixed order, and after each of them the labelled good documents that the rules so far reject together are
counted. The hypothesis "these cutoffs reject more than `risk` of the good ones" is given up if so few rejections
would be that unlikely, by the exact binomial tail. Tests stop at the first hypothesis that stands, so their number costs
nothing: the first wrong one of the order must be given up for any mistake. The order is made without the labelled good
documents: first the cutoffs whose rejections are most often labelled as low quality, among all others of the stratum.

The level is divided by the number of strata that have enough labelled good documents to give up anything, which
depends on their numbers alone. So with probability 1 - level the rules of every stratum keep their promise together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.llm.base import query, stored, table, word_array

RISK, LEVEL = 0.01, 0.05
# Measures that reject when they are high, and the grid of cutoffs of each.
RULES = {
    "symbols": [0.002 * 1.25**k for k in range(32)],  # per character
    "dup_lines": [0.02 * 1.15**k for k in range(28)],  # per line
    "repeats": [0.01 * 1.15**k for k in range(33)],  # per word
    "long_words": [6.0 + 0.5 * k for k in range(40)],  # characters a word
    "short_words": [0.20 + 0.02 * k for k in range(20)],  # one over characters a word
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, copy, lang and per text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long).

    n_lines counts the lines with a word. n_repeat_words counts the words that lie in a three-word window
    found twice or more. Windows are compared by hash; equal ones are found by sorting a text's windows.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    cut = docs.select("doc_id", F.xxhash64("text").alias("copy"), "lang", text.alias("body"), word_array("text").alias("words"), lines.alias("lines"))
    cut = cut.withColumn("n", F.size("words"))
    windows = F.when(
        F.col("n") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.col("n") - 3),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    counted = cut.select(
        "doc_id",
        "copy",
        "lang",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
    )
    counted = counted.withColumn("twice", F.size("windows") > F.size(F.array_distinct("windows")))
    placed = F.when(F.col("twice"), F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    counted = counted.withColumn("placed", placed).drop("windows")
    again = F.filter(
        "placed",
        lambda x, k: (F.get("placed", k - 1)["w"] == x["w"]) | (F.get("placed", k + 1)["w"] == x["w"]),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    n_repeat = F.when(F.col("placed").isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    return counted.select(*(c for c in counted.columns if c not in ("twice", "placed")), n_repeat.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def _shares() -> dict[str, Column]:
    """The measures of the rules; null where a text has none."""
    return {
        "symbols": F.try_divide(F.col("n_symbols"), F.col("word_chars")),
        "dup_lines": F.try_divide(F.col("n_dup_lines"), F.col("n_lines")),
        "repeats": F.try_divide(F.col("n_repeat_words"), F.col("n_words")),
        "long_words": F.try_divide(F.col("word_chars"), F.col("n_words")),
        "short_words": F.try_divide(F.col("n_words"), F.col("word_chars")),
    }


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series at x + 8, stepped back."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    steps = F.lit(1.0)
    for k in range(8):
        steps = steps * (x + k)
    return series - F.log(steps)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial X for k below n * p, else 1: the largest term times a sum of falling ratios.

    So many terms are summed that what is left is below the precision of a double.
    """
    kd, nd = k.cast("double"), n.cast("double")
    largest = F.exp(
        log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(p)) + (nd - kd) * F.log(F.lit(1 - p))
    )
    terms = F.least(k, F.ceil(40 * F.sqrt(nd * p)) + 50).cast("int")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (kd - i + 1) / (nd - kd + i) * ((1 - p) / p)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.filter(F.sequence(F.lit(0), terms), lambda i: i > 0), start, step)["sum"]
    return F.when(kd < nd * p, F.least(largest * total, F.lit(1.0))).otherwise(1.0)


def _passed(measured: DataFrame) -> DataFrame:
    """doc_id, lang, copy and passed: per rule the number of grid values below the measure, whose cutoffs reject the document."""

    def below(share: Column, grid: list[float]) -> Column:
        return F.coalesce(F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: share > g)), F.lit(0))

    # Written first: Catalyst would push the filter and the comparisons into measures that are not stored, and work these out
    # anew for every window and every grid value.
    shares = (share.alias(rule) for rule, share in _shares().items())
    rows = stored(measured.select("doc_id", "lang", "copy", base_failed().alias("failed"), *shares), "quality-shares")
    passed = F.array(*(below(F.col(rule), grid) for rule, grid in RULES.items()))
    return rows.where(~F.col("failed")).select("doc_id", "lang", "copy", passed.alias("passed"))


def _order(passed: DataFrame, good: DataFrame, bad: DataFrame) -> DataFrame:
    """lang, path: the cutoffs as (place, rule, step) in the order in which they are tested.

    By the share of low-quality documents (`bad`) among the rejected ones that are not labelled good, drawn to the
    stratum's own share by one document; equal ones from the loosest cutoff on.
    """

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("lang", F.posexplode("passed").alias("rule", "n")).groupBy("lang", "rule", "n").agg(F.count("*").alias(name))

    counts = counted(passed, "every").unionByName(counted(good, "good"), True).unionByName(counted(bad, "bad"), True)
    counts = counts.groupBy("lang", "rule", "n").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("every", "good", "bad")))
    counts = counts.groupBy("lang", "rule").agg(
        F.sum(F.col("every") - F.col("good")).alias("others"),
        F.sum("bad").alias("bad"),
        F.collect_list(F.struct("n", (F.col("every") - F.col("good")).alias("others"), "bad")).alias("counts"),
    )
    lengths = F.array(*(F.lit(len(grid)) for grid in RULES.values()))
    counts = counts.withColumn("length", F.get(lengths, F.col("rule")))
    counts = counts.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("length") - 1)))

    def over(name: str) -> Column:
        return F.aggregate("counts", F.lit(0).cast("long"), lambda s, c: s + F.when(c["n"] > F.col("step"), c[name]).otherwise(0))

    score = (over("bad") + F.coalesce(F.try_divide(F.col("bad"), F.col("others")), F.lit(0.0))) / (over("others") + 1)
    scored = counts.select("lang", "rule", "step", score.alias("score"), (F.col("step") / F.col("length")).alias("strictness"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), (-F.col("strictness")).alias("loose"), "rule", "step")))
    path = scored.groupBy("lang").agg(ordered.alias("path"))
    return path.select("lang", F.transform("path", lambda x, i: F.struct(i.alias("place"), x["rule"].alias("rule"), x["step"].alias("step"))).alias("path"))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """(lang, rule, cutoff): the strictest cutoff of each rule in use, where there is one.

    `labels` holds doc_id and quality; the good (1) are the holdout. Each distinct text of a stratum is one trial, however many rows
    and documents have it, and is good if any label of theirs says so.
    """
    marked = labels.where("quality IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("is_good"))
    each = _passed(measured).join(marked, "doc_id", "left")
    # A text has one row of `passed`, so grouping by that too adds nothing but spares carrying it.
    passed = stored(each.groupBy("lang", "copy", "passed").agg(F.max("is_good").alias("is_good")), "quality-passed")
    labelled = stored(passed.where("is_good IS NOT NULL"), "quality-labelled")
    good = labelled.where("is_good = 1")
    # A few rows a stratum; written between the steps so that no expression is worked out more than once.
    path = stored(_order(passed, good, labelled.where("is_good = 0")), "quality-order")
    named = path.withColumnRenamed("lang", "_lang")
    hits = F.filter("path", lambda x: F.get("passed", x["rule"]) > x["step"])
    placed = good.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", F.get(hits, F.lit(0))["place"].alias("place"))
    placed = placed.groupBy("lang", "place").agg(F.count("*").alias("n"))
    strata = placed.groupBy("lang").agg(F.sum("n").alias("n"), F.filter(F.collect_list(F.struct("place", "n")), lambda x: x["place"].isNotNull()).alias("hits"))
    # One row per stratum: this window over all strata is small.
    strata = stored(strata.withColumn("turn", F.row_number().over(Window.orderBy(F.col("n").desc(), "lang"))), "quality-strata")
    enough = strata.where(F.pow(F.lit(1 - risk), F.col("n")) <= F.lit(level) / F.col("turn")).agg(F.max("turn").alias("tested"))
    tests = strata.withColumn("one", F.lit(1)).join(enough.withColumn("one", F.lit(1)), "one").where("turn <= tested")
    tests = tests.join(named, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "n", "hits", "tested", F.inline("path"))
    rejected = F.aggregate("hits", F.lit(0).cast("long"), lambda s, h: s + F.when(h["place"] <= F.col("place"), h["n"]).otherwise(0))
    tests = stored(tests.select("lang", "n", "tested", "place", "rule", "step", rejected.alias("rejected")), "quality-counts")
    tests = stored(tests.withColumn("tail", binomial_tail(F.col("rejected"), F.col("n"), risk)), "quality-tests")
    tests = tests.withColumn("stop", F.min(F.when(F.col("tail") > F.lit(level) / F.col("tested"), F.col("place"))).over(Window.partitionBy("lang")))
    used = tests.where(F.col("stop").isNull() | (F.col("place") < F.col("stop"))).groupBy("lang", "rule").agg(F.min("step").alias("step"))
    grids = F.array(*(F.array(*map(F.lit, grid)) for grid in RULES.values()))
    return used.select("lang", "rule", F.get(F.get(grids, F.col("rule")), F.col("step")).alias("cutoff"))


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """Per document its measures, base_failed and kept.

    Null and empty texts have no words, fail the base rule and are not kept. A stratum with too few labelled good
    documents (under 299 alone, 408 among three at the default risk and level) has no cutoff and rejects nothing beyond the base rule; documents without a language are a stratum of their
    own. Repeated rows are judged alike, and an empty table gives no rows.
    """
    measured = stored(measures(docs), "quality-measures")
    limits = cutoffs(measured, labels, risk, level).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))
    limits = limits.withColumnRenamed("lang", "_lang")
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    over = F.lit(False)
    for rule, share in enumerate(_shares().values()):
        over = over | F.coalesce(share > F.try_element_at("limits", F.lit(rule)), F.lit(False))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~over).drop("_lang", "limits")


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    """Every document's measures and verdict."""
    verdict = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdict.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
