"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become integers first, so sums, means and distances from the mean are exact and the same in any order. The fit list
holds each distinct vector once. Its centred scatter is summed in tasks, one square matrix a task, and the
matrices are summed row by row. What reaches the driver is one matrix, whose size follows the dimension alone.

There the scatter is factored with pivoting, V = P L L' P', and the columns of L are rotated in pairs until they are
orthogonal: L W = U S. No product of L with itself is formed again. The squared norms of the rotated columns are the eigenvalues of V and
the normalised columns, in the rows' first order, its components.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talktally.llm.base import map_arrow, query, stored, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 46)  # of an entry: beyond it, 64 bits hold no whole number to compute with
BLOCK = 2048  # vectors worked on at once
SWEEPS = 60
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def integers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; null unless all of them are finite and below `LARGEST`."""
    entries = F.transform(vector, lambda c: c.cast("double"))
    good = (F.size(vector) > 0) & F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(vector.isNotNull() & good, F.transform(entries, lambda c: F.floor(c * SCALE) + SHIFT))


def matrix_of(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            yield part, matrix_of(part.column(column)).astype("int64")


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with v[order][:, order] = L L'; as many columns as the rank, numerically."""
    n = len(v)
    a, order = v.astype("float64").copy(), np.arange(n)
    factor = np.zeros((n, n))
    rest = a.diagonal().copy()
    least = n * np.finfo("float64").eps * max(rest.max(initial=0.0), 0.0)
    for k in range(n):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= least:
            return factor[:, :k], order
        for x in (order, rest):
            x[[k, p]] = x[[p, k]]
        a[[k, p]], factor[[k, p]] = a[[p, k]], factor[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        factor[k, k] = np.sqrt(rest[k])
        factor[k + 1 :, k] = (a[k + 1 :, k] - factor[k + 1 :, :k] @ factor[k, :k]) / factor[k, k]
        rest[k + 1 :] -= factor[k + 1 :, k] ** 2
    return factor, order


def rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, dealt into rounds of disjoint pairs."""
    size = n + n % 2
    circle = list(range(size))
    out = []
    for _ in range(size - 1):
        pairs = [(min(x, y), max(x, y)) for x, y in zip(circle[: size // 2], circle[: size // 2 - 1 : -1], strict=True) if max(x, y) < n]
        out.append((np.array([x for x, _ in pairs], int), np.array([y for _, y in pairs], int)))
        circle = [circle[0], circle[-1], *circle[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray) -> np.ndarray:
    """The columns of `factor`, rotated in pairs until any two of them are orthogonal to double precision."""
    g = factor.copy()
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in rounds(g.shape[1]):
            x, y = g[:, p], g[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(alpha * beta)
            open_pairs = np.abs(gamma) > 1e-15 * size
            worst = max(worst, float((np.abs(gamma) / np.where(size > 0, size, 1)).max(initial=0.0)))
            gamma = np.where(open_pairs, gamma, 1.0)
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            t = np.where(open_pairs, t, 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if worst <= 1e-14:
            break
    return g


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as rows) of a covariance, largest first; at most its rank of them."""
    factor, order = pivoted_cholesky(v)
    g = one_sided_jacobi(factor)
    values = (g * g).sum(0)
    chosen = np.argsort(-values, kind="stable")[:most]
    vectors = np.zeros((len(chosen), len(v)))
    vectors[:, order] = (g[:, chosen] / np.sqrt(values[chosen])).T if len(chosen) else vectors[:, order]
    return values[chosen], vectors


def summed_rows(partial: DataFrame, name: str) -> np.ndarray:
    """The matrix whose rows tasks have summed in part: one group a row, its parts in the order of their tasks."""

    def add(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")
        total = np.zeros(len(rows.column("part")[0]))
        for part in rows.column("part").to_pylist():
            total += part
        return pa.table({"i": rows.column("i")[:1], "total": pa.array([total], pa.list_(pa.float64()))})

    sums = partial.groupBy("i").applyInArrow(add, "i int, total array<double>").orderBy("i").collect()
    return np.array([r.total for r in sums]) if sums else np.zeros((0, 0))


def products(rows: DataFrame, project, width: int) -> np.ndarray:
    """Sum over the fit list of z z' with z = `project`(x-vectors), a vector of `width` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((width, width)), False
        for _, x in blocks(batches):
            z = project(x)
            total += z.T @ z
            any_rows = True
        if any_rows:
            task = np.full(width, TaskContext.get().partitionId())
            parts = pa.ListArray.from_arrays(pa.array(np.arange(width + 1) * width, pa.int32()), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(task), pa.array(np.arange(width, dtype="int32")), parts], ["task", "i", "part"])

    return summed_rows(map_arrow(rows, run, "task long, i int, part array<double>"), "part")


def fit_list(docs: DataFrame) -> DataFrame:
    """Each distinct x-vector of the rows with `x` once; copies meet in the tasks before the shuffle."""
    return docs.where("x IS NOT NULL").select("x").distinct()


class Whitening:
    """Mean, components and eigenvalues of a fit list with column `x`, all of one length."""

    def __init__(self, fit: DataFrame, most: int = COMPONENTS):
        sums = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
        found = sums.orderBy("i").collect()  # one row a dimension
        self.n = found[0].n if found else 0
        self.sums = np.array([r.s for r in found], "int64")
        self.values, self.vectors, self.trace, self.identity_error = np.zeros(0), np.zeros((0, len(found))), 0.0, 0.0
        if not self.n:
            return
        covariance = products(fit, self.centred, len(found)) / self.n
        self.trace = float(np.trace(covariance))
        self.values, self.vectors = components(covariance, most)
        if len(self.values):
            check = products(fit, self.whitened, len(self.values)) / self.n
            self.identity_error = float(np.abs(check - np.eye(len(check))).max())

    def exact(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly."""
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.exact(x) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 over the dimensions, exactly; null where it has no place in 64 bits."""
        far = self.exact(x)
        if len(far) and int(np.abs(far).max()) ** 2 * far.shape[1] >= 1 << 63:
            far = far.astype(object)
        return [s if s < 1 << 63 else None for s in (far * far).sum(1).tolist()]


def whiten(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row and component: the columns `keep` of `rows` (all by default; one named like a new one is replaced) with component
    (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error.

    Rows whose vector is null or empty, or holds null or non-finite entries (or ones beyond 2^46), are dropped, and so are those whose
    length is not the most frequent one (of equally frequent ones, the longest). Repeated vectors are fitted once and returned each.
    Components without variance cannot be scaled: there are at most as many as the rank, and none of fewer than two distinct
    vectors. An empty table gives no rows.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c not in RESULTS]
    staged = rows.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), integers(F.col(f"`{vector}`")).alias("x"))
    lengths = staged.where("x IS NOT NULL").groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows"))
    usual = lengths.orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    staged = staged.where(F.size("x") == (usual[0].d if usual else 0))
    found = Whitening(stored(fit_list(staged), "whitening"), most)
    explained = found.values / found.trace if found.trace else found.values
    k = len(found.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in blocks(batches):
            z, m = found.whitened(x), len(x)
            offsets = pa.array(np.arange(m + 1) * k, pa.int32())
            items = [pa.array(np.tile(np.arange(1, k + 1, dtype="int32"), m)), pa.array(z.ravel()), pa.array(np.tile(explained, m))]
            values = pa.StructArray.from_arrays(items, ["component", "whitened", "explained"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(found.deviation(x), pa.int64()), pa.ListArray.from_arrays(offsets, values)],
                ["row", "deviation", "values"],
            )

    listed = T.StructType.fromDDL("deviation long, values array<struct<component:int,whitened:double,explained:double>>")
    out = map_arrow(staged, run, T.StructType([staged.schema["row"], *listed.fields]))
    flat = out.select("row", "deviation", F.inline("values"))
    return flat.select(
        *(F.col("row").getField(c).alias(c) for c in keep),
        "component",
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(found.identity_error).alias("identity_error"),
    )


@query("op12_whitening")
def op12_whitening(spark, sf_dir):
    """Every embedding on the first 16 components of the distinct ones, at unit variance."""
    return whiten(table(spark, sf_dir, "embeddings"), keep=["vec_id"])
