"""Approximate nearest neighbours with a hash-prefix forest.

Each tree has its own random hyperplanes; the signs of a vector against them are its hash string. A tree is
the order of these strings: vectors with a common prefix stand together, and how many they are is kept for
every prefix. A query descends in each tree as far as its string goes on in it, then ascends in all trees at once, one
bit at a time, until enough candidates (`share` of all, or `least` if that is more, each counted once a tree) share
its prefix. Candidates are compared on their original vectors.

Vectors that are equal form one class, which stands for the members that can be among the nearest: its 21 smallest
ids. So a vector repeated a million times is compared once. Prefixes with many classes are cut into blocks of bounded
size, each block met by the queries of its prefix; a query keeps its nearest per block, never pairs with all.

Tables that grow with the vectors or queries meet by merges. Sizes are unknown to the planner behind an explode, which makes 1,000
rows of a query here, and compressed files say little, so left to itself it would broadcast them from the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talktally.llm.base import map_arrow, query, stored, table

TREES, DEPTH = 40, 24
SHARE, LEAST = 0.9, 800
BLOCK, QUERIES = 4096, 2048
NEAREST = 20
FEW = 50_000  # prefixes in use that are broadcast
SEED = 11


def usable(vector: str) -> Column:
    """Not null, not empty or zero, every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def planes(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((TREES * DEPTH, size))


def _hashed(vectors: np.ndarray) -> np.ndarray:
    """The hash strings as numbers: one row a vector, one column a tree, the first bit on top."""
    signs = (vectors @ planes(vectors.shape[1]).T > 0).reshape(len(vectors), TREES, DEPTH)
    return signs @ (1 << np.arange(DEPTH - 1, -1, -1, dtype="int64"))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, size)


def strings(rows: DataFrame, key: str, size: int) -> DataFrame:
    """(key, strings): every row's hash strings, by tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                found = _hashed(_matrix(part.column("vector"), size))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(list(found), pa.list_(pa.int64()))], names=[key, "strings"])

    return map_arrow(rows.select(key, "vector"), run, f"{key} bigint, strings array<bigint>")


def prefix_counts(index: DataFrame) -> DataFrame:
    """(tree, level, prefix, n): the classes below every prefix, counted by tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _matrix(batch.column("strings"), TREES).astype("int64")
            for tree in range(TREES):
                for level in range(DEPTH + 1):
                    prefix, n = np.unique(found[:, tree] >> (DEPTH - level), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(prefix), v, "int32")) for v in (tree, level)] + [pa.array(prefix), pa.array(n)],
                        names=["tree", "level", "prefix", "n"],
                    )

    counted = map_arrow(index.select("strings"), run, "tree int, level int, prefix bigint, n bigint")
    return counted.groupBy("tree", "level", "prefix").agg(F.sum("n").alias("n"))


def levels(asked: DataFrame, counts: DataFrame, enough: int) -> DataFrame:
    """(query_id, strings, level): where the ascent of a query ends.

    The candidates of a level are the sum over the trees; a level no tree has counts nothing, which is the descent.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("level")
    at = asked.select("query_id", F.posexplode("strings").alias("tree", "string"))
    at = at.select("query_id", "tree", "string", steps).withColumn("prefix", F.expr(f"shiftright(string, {DEPTH} - level)"))
    met = at.join(counts.hint("merge"), ["tree", "level", "prefix"]).groupBy("query_id", "level").agg(F.sum("n").alias("n"))
    best = met.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("n") >= enough, F.col("level"))), F.lit(0)).alias("level"))
    return asked.join(best.hint("merge"), "query_id")


def search(rows: DataFrame, asked: Column, nearest: int = NEAREST, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """query_id, rank, vec_id, score of the nearest of each row that `asked` selects, itself left out.

    `rows` holds vec_id and embedding. Nearness is the inner product in double precision; ties go to the smaller
    vec_id. Vectors null, zero, or with null or infinite parts take no part, nor do rows without vec_id or those of another
    length than most. Rows that repeat a vec_id with the same vector are one. An empty table gives no rows.
    """
    clean = rows.where(usable("embedding") & F.col("vec_id").isNotNull())
    clean = clean.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector")).distinct()
    lengths = clean.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = lengths["size"] if lengths else 1
    clean = stored(clean.where(F.size("vector") == size), "ann-vectors")
    # Members beyond the smallest can't be among the nearest of any query.
    ranked = clean.groupBy("vector").agg(F.min("vec_id").alias("class"))
    classes = stored(ranked, "ann-classes")
    members = clean.join(classes.hint("merge"), "vector").select("class", "vec_id")
    within = Window.partitionBy("class").orderBy("vec_id")
    members = members.withColumn("turn", F.row_number().over(within)).where(F.col("turn") <= nearest + 1)
    members = stored(members.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "ann-members")

    index = stored(strings(classes, "class", size), "ann-index")
    total = index.count()
    enough = max(least, int(share * total))
    counts = stored(prefix_counts(index), "ann-prefixes")
    queries = stored(clean.where(asked).select(F.col("vec_id").alias("query_id"), "vector"), "ann-queries")
    placed = stored(levels(strings(queries, "query_id", size), counts, min(enough, TREES * total)), "ann-levels")

    # One row for each prefix in use; its classes and its queries are cut into blocks of bounded size.
    met = placed.select("query_id", "level", F.posexplode("strings").alias("tree", "string"))
    met = met.withColumn("prefix", F.expr(f"shiftright(string, {DEPTH} - level)")).drop("string")
    used = met.groupBy("tree", "level", "prefix").agg(F.count("*").alias("asking")).join(counts.hint("merge"), ["tree", "level", "prefix"])
    used = used.select("tree", "level", "prefix", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("asking") / QUERIES).alias("query_blocks"))
    used = stored(used, "ann-used")
    in_cells = F.broadcast(used) if used.count() <= FEW else used.hint("merge")
    in_use = [r.level for r in used.select("level").distinct().collect()] or [0]  # 25 levels at most
    keys = ["tree", "level", "prefix"]
    entries = index.select("class", F.posexplode("strings").alias("tree", "string"))
    entries = entries.select("class", "tree", "string", F.explode(F.array(*map(F.lit, in_use))).alias("level"))
    entries = entries.withColumn("prefix", F.expr(f"shiftright(string, {DEPTH} - level)")).drop("string")
    entries = entries.join(in_cells, keys).withColumn("block", F.pmod(F.xxhash64("class"), "blocks"))
    entries = entries.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)))
    asking = met.join(in_cells, keys).withColumn("query_block", F.pmod(F.xxhash64("query_id"), "query_blocks"))
    asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    cell = [*keys, "block", "query_block"]
    points = entries.join(classes.hint("merge"), "class").select(*cell, F.col("class").alias("id"), "vector")
    askers = asking.join(queries.hint("merge"), "query_id").select(*cell, F.col("query_id").alias("id"), "vector")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best classes of each query of a cell; one more than asked for, as a query may meet its own class."""
        left, right = left.combine_chunks(), right.combine_chunks()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            one = _matrix(left.column("vector").chunk(0), size)
            ids = left.column("id").to_numpy()
            n = min(nearest + 1, len(ids))
            for start in range(0, right.num_rows, 512):
                part = right.slice(start, 512).combine_chunks()
                scores = _matrix(part.column("vector").chunk(0), size) @ one.T
                # All that reach the n-th best score, so ties are not cut here.
                floor = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                row, col = np.nonzero(scores >= floor[:, None] - 1e-9)
                kept.append((part.column("id").to_numpy()[row], ids[col]))
        return pa.table(
            {
                "query_id": pa.array(np.concatenate([k[0] for k in kept]) if kept else [], pa.int64()),
                "class": pa.array(np.concatenate([k[1] for k in kept]) if kept else [], pa.int64()),
            }
        )

    found = points.groupBy(*cell).cogroup(askers.groupBy(*cell)).applyInArrow(compare, "query_id bigint, class bigint").distinct()
    pairs = found.join(classes.withColumnRenamed("vector", "other").hint("merge"), "class").join(queries.hint("merge"), "query_id")
    exact = F.aggregate(F.zip_with("vector", "other", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    pairs = pairs.select("query_id", "class", exact.alias("score"))
    by_class = Window.partitionBy("query_id").orderBy(F.desc("score"), "class")
    pairs = pairs.withColumn("turn", F.row_number().over(by_class)).where(F.col("turn") <= nearest + 1)
    answers = pairs.join(members.hint("merge"), "class").select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
    by_vector = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(by_vector)).where(F.col("rank") <= nearest)
    return answers.select("query_id", "rank", "vec_id", "score")


@query("op9_nearest")
def op9_nearest(spark, sf_dir):
    """The 20 nearest of every twentieth vector."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
