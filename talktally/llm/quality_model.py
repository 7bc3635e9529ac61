"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of character 5-grams within words (a word is framed by spaces), trained on the texts whose label
says good. Distinct 5-grams with their counts are the only thing that leaves the tasks; counts, continuation
counts, discounts and the weights of shorter contexts are groupings and joins of these tables, spread over the
cluster by n-gram. A fifth of the trusted texts is not trained on, and sets the bounds. The probability of every 5-gram type of the whole corpus is joined together once, and a text's
perplexity is the sum over its words. Per language, a quantile of these texts' perplexities is the bound.

5-gram types follow the alphabet rather than the input, but nothing bounds them; so their probabilities are broadcast only
below `limit` bytes and beyond it are joined to each text's distinct 5-grams.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talktally.llm.base import chunks, map_arrow, query, stored, table
from talktally.llm.tokens import ODD, mixed

ORDER = 5
QUANTILE, SLACK, FOLDS = 0.999, 1.2, 5
LIMIT = 256 << 20
IDS = 1 << 20  # labelled ids that are broadcast; more of them are joined
PENDING = 500_000  # distinct 5-grams a task holds before it hands them on


def grams(word: str) -> list[str]:
    """The 5-grams of a framed word, one for each character and the closing space."""
    framed = " " * (ORDER - 1) + word + " "
    return [framed[i : i + ORDER] for i in range(len(framed) - ORDER + 1)]


def _framed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words in lower case with their frames, where each 5-gram starts, 5-grams per text)."""
    frame = " " * (ORDER - 1)
    words = [(t or "").lower().split() for t in texts]
    framed = [frame + (" " + frame).join(w) + " " if w else "" for w in words]
    points = np.frombuffer("".join(framed).encode("utf-32-le"), "uint32")
    letter = points != ord(" ")
    ends = np.flatnonzero(letter | np.concatenate(([False], letter[:-1]))) if len(points) else np.zeros(0, "int64")
    borders = np.cumsum(np.fromiter(map(len, framed), "int64", len(framed)))
    return points, ends - (ORDER - 1), np.diff(np.searchsorted(ends, borders), prepend=0)


def _keys(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of the five code points from each place."""
    wide = points.astype("uint64")
    a, b, c, d, e = (wide[i : len(wide) - ORDER + 1 + i] for i in range(ORDER))
    head = a << np.uint64(42) | b << np.uint64(21) | c
    return mixed(mixed(head[starts]) + (d << np.uint64(21) | e)[starts] * ODD) if len(starts) else np.zeros(0, "uint64")


def _strings(points: np.ndarray) -> list[str]:
    flat = points.tobytes().decode("utf-32-le")
    return [flat[i : i + ORDER] for i in range(0, len(flat), ORDER)]


def _united(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(keys, five code points each, counts, counts in taught texts), equal keys together."""
    keys, points, n, taught = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((keys[:1] == keys[:1], keys[1:] != keys[:-1])))
    if not len(first):
        return keys, points, n, taught
    return keys[first], points[order[first]], np.add.reduceat(n[order], first), np.add.reduceat(taught[order], first)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n, taught) over all texts, words in lower case: counts in all rows, and in those whose column taught is true."""

    def rows(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, points, n, taught = part
        return pa.RecordBatch.from_arrays([pa.array(_strings(points), pa.string()), pa.array(n), pa.array(taught)], names=["gram", "n", "taught"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = None
        for batch in chunks(batches, most=1 << 20):
            points, starts, each = _framed(batch.column("text").to_pylist())
            keys = _keys(points, starts)
            order = np.argsort(keys)
            first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[:1]]))
            if not len(first):
                continue
            taught = np.repeat(batch.column("taught").to_numpy(zero_copy_only=False).astype("int64"), each)
            five = points[starts[order[first]][:, None] + np.arange(ORDER)]
            part = keys[order[first]], five, np.diff(np.append(first, len(keys))), np.add.reduceat(taught[order], first)
            whole = part if whole is None else _united([whole, part])
            if len(whole[0]) > PENDING:
                yield rows(whole)
                whole = None
        if whole is not None:
            yield rows(whole)

    counted = map_arrow(docs.select("text", "taught"), run, "gram string, n bigint, taught bigint")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("taught").alias("taught"))


def _discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, for counts 1, 2 and from 3 on."""
    t = counts.agg(*(F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    if not t.n1 or not t.n2:
        return [0.5, 0.75, 0.9]
    y = t.n1 / (t.n1 + 2 * t.n2)
    after = [t.n1, t.n2, t.n3, t.n4]
    return [min(k, max(0.05, k - (k + 1) * y * after[k] / after[k - 1])) if after[k - 1] else 0.5 * k for k in (1, 2, 3)]


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def probabilities(trained: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp): natural log probability of the last character of every wanted 5-gram after the others.

    `trained` is (gram, n), `wanted` (gram). From single characters upwards, each order adds what its counts say
    and weighs the shorter one by the discounts taken from its context. Characters never met share one more outcome.
    """
    counts = {ORDER: trained}
    for order in range(ORDER - 1, 0, -1):
        # How many different characters stand before it: the count of a shorter one.
        counts[order] = stored(counts[order + 1].groupBy(F.substring("gram", 2, order).alias("gram")).agg(F.count("*").alias("n")), "kn-counts")
    single = counts[1].agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).first()
    total, kinds = (single.total or 0), single.kinds
    types = stored(wanted.select("gram").distinct(), "kn-types")

    def ends(order: int) -> DataFrame:
        return types.select(F.substring("gram", ORDER - order + 1, order).alias("gram")).distinct()

    lower = ends(1).join(counts[1], "gram", "left")
    lower = lower.select("gram", ((F.coalesce("n", F.lit(0)) + F.lit(1.0)) / (total + kinds + 1)).alias("p"))
    for order in range(2, ORDER + 1):
        d = _discounts(counts[order])
        head = F.substring("gram", 1, order - 1).alias("head")
        n = F.col("n")
        contexts = counts[order].groupBy(head).agg(F.sum("n").alias("all"), F.sum(_discount(n, d)).alias("taken"))
        met = ends(order).withColumn("head", F.substring("gram", 1, order - 1)).withColumn("tail", F.substring("gram", 2, order - 1))
        met = met.join(counts[order], "gram", "left").join(contexts, "head", "left").join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("shorter")), "tail")
        own = F.coalesce(F.greatest(n - _discount(n, d), F.lit(0.0)) / F.col("all"), F.lit(0.0))
        weight = F.coalesce(F.col("taken") / F.col("all"), F.lit(1.0))
        lower = stored(met.select("gram", (own + weight * F.col("shorter")).alias("p")), "kn-probabilities")
    return lower.select("gram", F.log("p").alias("logp"))


def _keyed(logp: DataFrame) -> DataFrame:
    """(key, logp) of (gram, logp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le"), "uint32")
            keys = _keys(points, np.arange(0, len(points), ORDER))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("int64")), batch.column("logp")], names=["key", "logp"])

    return stored(map_arrow(logp, run, "key bigint, logp float"), "kn-keyed")


def text_sums(docs: DataFrame, logp: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, copy, lang, n_grams and loss (minus the log probability) of every row."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "lang", "text")
    logp = logp.select("gram", F.col("logp").cast("float").alias("logp"))
    keyed = _keyed(logp)
    if keyed.count() * 12 > limit:
        return _sums_joined(rows, logp)
    found = keyed.toArrow()
    keys = found.column("key").to_numpy().view("uint64")
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order].tobytes(), found.column("logp").to_numpy()[order].tobytes()))
    del found, keys

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = (np.frombuffer(x, t) for x, t in zip(shared.value, ("uint64", "float32"), strict=True))
        for batch in chunks(batches, most=1 << 20):
            points, starts, each = _framed(batch.column("text").to_pylist())
            distinct, back = np.unique(_keys(points, starts), return_inverse=True)
            each_logp = values[np.searchsorted(known, distinct)].astype("float64")[back]
            loss = np.zeros(len(each))
            if len(each_logp):
                loss[each > 0] = -np.add.reduceat(each_logp, (np.cumsum(each) - each)[each > 0])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "copy", "lang")), pa.array(each, pa.int64()), pa.array(loss)],
                names=["doc_id", "copy", "lang", "n_grams", "loss"],
            )

    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, run, f"doc_id {doc_type}, copy bigint, lang string, n_grams bigint, loss double")


def _sums_joined(rows: DataFrame, logp: DataFrame) -> DataFrame:
    """The same by a join of each text's distinct 5-grams with their probabilities."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.groupBy("doc_id", "copy", "lang").agg(F.first("text").alias("text"), F.count("*").alias("rows"))
    texts = stored(texts, "kn-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            for row, text in enumerate(batch.column("text").to_pylist()):
                found: Counter = Counter()
                for word, times in Counter((text or "").lower().split()).items():
                    for gram in grams(word):
                        found[gram] += times
                fixed = [pa.array([batch.column(c)[row].as_py()] * len(found), batch.column(c).type) for c in ("doc_id", "copy", "lang")]
                yield pa.RecordBatch.from_arrays(
                    [*fixed, pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    names=["doc_id", "copy", "lang", "gram", "times"],
                )

    met = map_arrow(texts.drop("rows"), run, f"doc_id {doc_type}, copy bigint, lang string, gram string, times bigint").join(logp, "gram")
    sums = met.groupBy("doc_id", "copy", "lang").agg(F.sum("times").alias("n_grams"), F.sum(-F.col("times") * F.col("logp")).alias("loss"))
    same = F.lit(True)
    for c in ("doc_id", "copy", "lang"):
        same = same & F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = texts.alias("t").join(sums.alias("s"), same, "left")
    return joined.select("t.doc_id", "t.copy", "t.lang", F.coalesce("n_grams", F.lit(0)).alias("n_grams"), F.coalesce("loss", F.lit(0.0)).alias("loss"), F.explode(F.array_repeat(F.lit(1), F.col("rows").cast("int")))).drop("col")


def perplexities(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, limit: int = LIMIT) -> DataFrame:
    """Per row doc_id, lang, trusted, n_grams, perplexity, bound (its language's) and kept.

    Trusted are the texts that a label calls good. A text is kept if its perplexity is at most `slack` times the
    `quantile` of the trusted texts of its language that were not trained on. Null and empty texts have no perplexity and are kept, as are those of
    a language without such texts; null is a language of its own. Repeated rows are scored alike.
    """
    good = labels.where("quality = 1").select(F.col("doc_id").alias("_good")).distinct()
    same = F.col("doc_id") == F.col("_good")
    every = docs.select("doc_id", "text", "lang")
    aside = F.crc32(F.col("_good").cast("string")) % FOLDS == 0
    teaching = good.where(~aside)
    teaching = F.broadcast(teaching) if teaching.count() <= IDS else teaching
    taught = every.join(teaching, same, "left").select("text", F.col("_good").isNotNull().alias("taught"))
    counted = stored(gram_counts(taught), "kn-counted")
    logp = probabilities(counted.where("taught > 0").select("gram", F.col("taught").alias("n")), counted)
    sums = stored(text_sums(every, logp, limit), "kn-sums")
    sums = sums.withColumn("perplexity", F.when(F.col("n_grams") > 0, F.exp(F.col("loss") / F.col("n_grams"))))
    marked = stored(sums.join(good, same, "left").withColumn("trusted", F.col("_good").isNotNull()).withColumn("aside", aside).drop("_good"), "kn-scored")
    bounds = marked.where("aside AND perplexity IS NOT NULL").groupBy(F.col("lang").alias("_lang"))
    bounds = bounds.agg((F.percentile_approx("perplexity", quantile, 100_000) * slack).alias("bound"))
    joined = marked.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang", "copy", "loss", "aside")
    return joined.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("bound"), F.lit(True)))


@query("op7_quality_model")
def op7_quality_model(spark, sf_dir):
    """Every document's perplexity and whether its language's bound keeps it."""
    return perplexities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
