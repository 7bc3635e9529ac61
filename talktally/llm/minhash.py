"""Near-duplicate documents by circulant MinHash, with every link confirmed on the full sets.

Two permutations serve for all coordinates of a signature: the first spreads the shingles over the 64-bit
circle, the second ranks its places, shifted circularly by k for coordinate k. Coordinates are banded;
documents that share a band are candidates.

Exact copies of a set form one class, and only classes go on. The classes of a bucket form a family with its most central
one, the pivot, and each is compared with the pivot in full. What is left apart within a family is found by how its members
differ from the pivot: two members are linked if enough of their differences are the same. Sorted with the seldom ones
first, the differences of linked members meet in a short beginning of both lists, so only members that share such a difference
are compared, and no link within a family is lost. With 84 bands of 6 out of 128 coordinates a pair at exactly the threshold 0.75
meets in no band once in 50,000 times (simulated); one of similarity 0.2, as a shared passage gives, meets once in 200.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talktally.llm.base import chunks, map_arrow, query, stored, table, texts_of
from talktally.llm.tokens import ODD, hashed, low_words, mixed

WIDTH, PERCENT = 5, 75
COORDINATES, ROWS, DEALS = 128, 6, 4
# The coordinates are dealt into bands of six, four times over in another order.
BANDED = np.concatenate([np.random.default_rng(k).permutation(COORDINATES)[: COORDINATES // ROWS * ROWS].reshape(-1, ROWS) for k in range(DEALS)])


def shingles(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its `width`-word shingles; a shorter text is one shingle."""
    rolled = words.copy()
    for k in range(1, width):
        rolled[:-k] = rolled[:-k] * ODD + words[k:] if k == 1 else mixed(rolled[:-k]) * ODD + words[k:]
    rolled = mixed(rolled)
    out, start = [], 0
    for n in counts.tolist():
        if n >= width:
            out.append(np.unique(rolled[start : start + n - width + 1]))
        elif n:
            value = np.uint64(n)
            for w in words[start : start + n]:
                value = np.uint64((int(value) * int(ODD) + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(np.array([value], "uint64")))
        else:
            out.append(words[:0])
        start += n
    return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of `size` coordinates per (not empty) set."""
    places = np.concatenate(sets)
    starts = np.zeros(len(sets), "int64")
    np.cumsum([len(s) for s in sets[:-1]], out=starts[1:])
    out = np.full((len(sets), size), np.iinfo("uint64").max, "uint64")
    buffer = np.empty_like(places)
    for k in range(size):
        # Coordinate k ranks the places by the second permutation, turned by k.
        np.subtract(places, np.uint64(k + 1), out=buffer)
        out[:, k] = np.minimum.reduceat(mixed(buffer, out=buffer), starts)
    return out


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), n_shingles, set (16-byte digest of the shingle set) and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            sets = shingles(*hashed([low_words(t) for t in texts_of(batch)]))
            full = [i for i, s in enumerate(sets) if len(s)]
            ids, bands = [None] * len(sets), [None] * len(sets)
            if full:
                signed = signatures([sets[i] for i in full], COORDINATES)
                banded = signed[:, BANDED]
                keys = np.arange(1, len(BANDED) + 1, dtype="uint64")[None, :] * ODD
                for r in range(ROWS):
                    keys = mixed(keys ^ banded[:, :, r]) * ODD
                for row, i in enumerate(full):
                    ids[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                    bands[i] = keys[row].view("int64")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("copy"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "copy", "n_shingles", "set", "bands"],
            )

    fields = "doc_id bigint, copy bigint, n_shingles bigint, set binary, bands array<bigint>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), "text"), run, fields)


def _families(entries: DataFrame) -> DataFrame:
    """(a, b): the pivot of a bucket and each other class in it. The pivot is the one that meets most others, counted over all its buckets."""
    central = entries.groupBy("set").agg(F.sum("size").alias("meets"))
    pivots = entries.join(central, "set").groupBy("band").agg(F.max(F.struct("meets", "set")).alias("pivot")).select("band", F.col("pivot.set").alias("a"))
    return entries.join(pivots, "band").where("set <> a").select("a", F.col("set").alias("b")).distinct()


def _members(pairs: DataFrame, docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(set, members): the shingle hashes of every class in the pairs, from one of its documents."""
    ends = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b"))).distinct()
    # One document per set, found by its id; ids may repeat, so the set is checked again below.
    owners = sketch.join(ends, "set", "left_semi").groupBy("set").agg(F.min("doc_id").alias("doc_id"))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=1 << 20):
            sets = shingles(*hashed([low_words(t) for t in texts_of(batch)]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["set", "members"],
            )

    wanted = docs.select(F.col("doc_id").cast("long"), "text").join(
        owners.select("doc_id").distinct().withColumnRenamed("doc_id", "_owner"), F.col("doc_id").eqNullSafe(F.col("_owner")), "left_semi"
    )
    members = map_arrow(wanted, sets_of, "set binary, members binary").join(ends, "set", "left_semi")
    return members.groupBy("set").agg(F.first("members").alias("members"))


def _compared(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """a, b, whether they reach the threshold, the size of b's set, and the shingles that only one of the two has."""
    both = pairs.join(members.select(F.col("set").alias("a"), F.col("members").alias("set_a")), "a")
    both = both.join(members.select(F.col("set").alias("b"), F.col("members").alias("set_b")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                linked, sizes, away = [], [], []
                for x, y in zip(part.column("set_a"), part.column("set_b"), strict=True):
                    one, two = np.frombuffer(x.as_buffer(), "uint64"), np.frombuffer(y.as_buffer(), "uint64")
                    apart = np.setxor1d(one, two, assume_unique=True)
                    every = (len(one) + len(two) + len(apart)) // 2
                    linked.append(100 * (every - len(apart)) >= percent * every)
                    sizes.append(len(two))
                    away.append(apart.view("int64"))
                columns = [part.column("a"), part.column("b"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(away, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "linked", "size", "away"])

    return map_arrow(both.select("a", "b", "set_a", "set_b"), compare, "a binary, b binary, linked boolean, size bigint, away array<bigint>")


def _within_families(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of a family in different components, among them all that reach the threshold.

    With `away` the shingles in which members x and y differ from the pivot, x and y differ in |away x| + |away y| - 2 * same shingles. So
    they reach the threshold if and only if 2 * (100 + percent) * same >= over x + over y, with
    over = (100 + percent) * |away| - (100 - percent) * size. Where the right side is 0 or less, both are linked with the pivot; so
    members of different components have a difference in common. The first one in a fixed order has at least as many shared
    differences from it on, in either list, as the two have in common.
    """
    far, near = 100 + percent, 100 - percent
    parts = compared.join(labels.withColumnRenamed("set", "b"), "b", "left").withColumn("component", F.coalesce("component", "b"))
    apart = parts.groupBy("a").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    parts = parts.join(apart.select("a"), "a", "left_semi").withColumn("over", far * F.size("away") - near * F.col("size"))
    # The other one has at most 100 / percent as many shingles and cannot share more than all its differences.
    least = F.col("over") - F.ceil(F.lit(near * 100 / max(percent, 1)) * F.col("size"))
    held = parts.select("a", "b", "component", "over", least.alias("least"), F.explode("away").alias("shingle"))
    shared = held.groupBy("a", "shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    behind = Window.partitionBy("a", "b").orderBy(F.col("holders").desc(), "shingle")
    first = held.join(shared, ["a", "shingle"]).withColumn("left", F.row_number().over(behind)).where(far * F.col("left") >= F.col("least"))
    first = stored(first.select("a", "shingle", "b", "component", "over", "left"), "differences")
    other = first.select("a", "shingle", *(F.col(c).alias(f"{c}_2") for c in ("b", "component", "over", "left")))
    enough = 2 * far * F.least("left", "left_2") >= F.col("over") + F.col("over_2")
    met = first.join(other, ["a", "shingle"]).where((F.col("b") < F.col("b_2")) & (F.col("component") != F.col("component_2")) & enough)
    return met.select(F.col("b").alias("a"), F.col("b_2").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(set, component): the smallest set reachable, for every set that has a link.

    Each round takes the smallest label among the neighbours and then that label's own label, so a chain
    shrinks by half; rounds end when no label changes. Labels are kept in the shared folder between rounds.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("set")).agg(F.least(F.col("set"), F.min("b")).alias("component")), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("set", "b"), "b").groupBy(F.col("a").alias("set")).agg(F.min("component").alias("near"))
        lower = labels.join(around, "set").select("set", F.col("component").alias("was"), F.least("component", "near").alias("now"))
        further = labels.select(F.col("set").alias("now"), F.col("component").alias("then"))
        moved = stored(lower.join(further, "now", "left").select("set", "was", F.least("now", "then").alias("component")), "labels")
        labels = moved.select("set", "component")
        if moved.where("was <> component").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, copy (hash of its text), n_shingles, component_id and kept.

    Texts without words (null, empty, white space) have no shingles, are linked with nothing and are their
    own component. component_id is the smallest doc_id of the component, null only if none of its documents has an
    id; a document without id is kept only then. Repeated rows have equal results. An empty table gives no rows.
    """
    return _grouped(docs, percent).drop("component")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """near_duplicates with component: the smallest digest of the component's sets, null for texts without words."""
    sketch = stored(sketches(docs), "sketches")
    classes = stored(sketch.where("set IS NOT NULL").dropDuplicates(["set"]).select("set", "bands"), "classes")
    entries = classes.select("set", F.explode("bands").alias("band"))
    shared = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    families = stored(_families(stored(entries.join(shared, "band"), "entries")), "pairs")
    members = stored(_members(families, docs, sketch), "minhash-sets")
    compared = stored(_compared(families, members, percent), "compared")
    links = compared.where("linked").select("a", "b")
    labels = components(links)

    # What is left apart within a family may still be linked.
    rest = stored(_within_families(compared, labels, percent), "pairs")
    more = stored(_compared(rest, members, percent).where("linked").select("a", "b"), "confirmed")
    if not more.isEmpty():
        labels = components(links.union(more))

    grouped = sketch.select("doc_id", "copy", "n_shingles", "set").join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
    smallest = grouped.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    named = grouped.join(smallest, "component", "left")
    chosen = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
    return named.select("doc_id", "copy", "n_shingles", "component", chosen.alias("component_id"), F.col("doc_id").eqNullSafe(chosen).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` whose document stays, one row of each component; of repeated rows, one.

    A component whose documents have no id, or several texts under its smallest id, keeps the one with the most shingles.
    Texts without words are components of their own: one row of each doc_id and text.
    """
    wordless = F.col("component").isNull()
    same = Window.partitionBy("component", F.when(wordless, F.col("doc_id")), F.when(wordless, F.col("copy"))).orderBy(F.col("n_shingles").desc(), "copy")
    chosen = _grouped(docs, percent).where("kept").withColumn("turn", F.row_number().over(same)).where("turn = 1")
    chosen = chosen.select(F.col("doc_id").alias("_kept_doc"), F.col("copy").alias("_kept_copy"))
    # The row goes along in one column, so that its columns may have any name.
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_copy"))
    left = marked.join(chosen, F.col("_doc").cast("long").eqNullSafe(F.col("_kept_doc")) & (F.col("_copy") == F.col("_kept_copy")), "left_semi")
    once = Window.partitionBy("_doc", "_copy").orderBy(F.lit(0))
    return left.withColumn("_turn", F.row_number().over(once)).where("_turn = 1").select("_row.*")


@query("op3_minhash")
def op3_minhash(spark, sf_dir):
    """Every document with its component and whether it is the one that stays."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("copy")
