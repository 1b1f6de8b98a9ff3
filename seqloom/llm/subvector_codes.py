"""Exact integer k-means over vectors held as codes into dictionaries of subvectors.

A vector's dimensions are cut into blocks of equal width. The distinct subvectors of each block form its dictionary, and
a vector becomes one code per block, without loss. In a round the exact squared distance of every distinct subvector to
every centroid's part is computed once; the distance of a vector is the sum of its codes' partial distances.

The block width is the widest power of two whose dictionaries are proven small: a block cannot have more distinct
subvectors than vectors, nor than the product of its dimensions' distinct values, which one map-side aggregate counts.
Below ``entries`` entries the dictionaries are collected once and sent to the tasks; the table of partial distances is
made once a round. If not even single dimensions are that poor in values, each batch of vectors gets dictionaries of
its own in its task, to the same result. The driver holds centroids (k x dimensions) and dictionaries of bounded size.

Components become floor(scale * x). Vectors with another number of components, with a null or non-finite one, or with
one of 2^19 or more in absolute size (whose squared distances no long can hold) are left out; null and empty arrays too.
Rows that repeat an id are vectors of their own. Start vectors go by the hash of their id, then by their components;
null ids come last. With fewer vectors than k there are as many centroids as vectors; an empty table gives no rows.
Sums of distances that no long can hold are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import stored

LARGEST = 1 << 27  # of an integer component: 64 squared differences stay below 2^62
ENTRIES = 1 << 16
FLUSH = 1 << 16
_CHUNK = 4096


def integers(vectors: DataFrame, key: str, values: str, dims: int, scale: int) -> DataFrame:
    """``_k`` and ``_v`` (array of long) of the vectors that are kept."""
    x = F.col(values).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & (F.abs(e) < LARGEST / scale))
    rows = vectors.select(F.col(key).alias("_k"), F.when(whole, x).alias("_x")).filter("_x IS NOT NULL")
    return rows.select("_k", F.transform("_x", lambda e: F.floor(e * scale)).alias("_v"))


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists are equally long."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(matrix: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1])
    return pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(matrix).ravel(), kind))


def _distinct(part: np.ndarray) -> np.ndarray:
    """The distinct rows in ascending order."""
    return np.unique(part, axis=0)


def distinct_parts(rows: DataFrame, width: int) -> DataFrame:
    """``block`` and ``part`` (array of long): the distinct subvectors of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            blocks = np.repeat(list(have), [len(p) for p in have.values()]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(blocks), _lists(np.concatenate(list(have.values())), pa.int64())], ["block", "part"])

        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(0))
            for k in range(v.shape[1] // width):
                part = v[:, k * width : (k + 1) * width]
                have[k] = _distinct(np.concatenate([have[k], part]) if k in have else part)
            if sum(map(len, have.values())) > FLUSH:
                yield out()
                have.clear()
        if have:
            yield out()

    return rows.select("_v").mapInArrow(run, "block int, part array<bigint>").distinct()


def block_width(rows: DataFrame, dims: int, entries: int) -> int:
    """The widest power of two that divides ``dims`` and has provably at most ``entries`` entries; 0 if none has."""
    total = rows.count()
    per = dict(distinct_parts(rows, 1).groupBy("block").count().collect())
    best, width = 0, 1
    while dims % width == 0 and per:
        bound = sum(
            min(total, reduce(lambda a, b: a * b, (per[d] for d in range(k, k + width)))) for k in range(0, dims, width)
        )
        if bound > entries:
            break
        best, width = width, 2 * width
    return best


def _codes(v: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    """Codes of the vectors in sorted dictionaries that hold all their subvectors."""
    out, at = [], 0
    for d in parts:
        part = v[:, at : at + d.shape[1]]
        at += d.shape[1]
        if d.shape[1] == 1:
            out.append(np.searchsorted(d[:, 0], part[:, 0]))
        else:
            view = lambda m: np.ascontiguousarray(m + LARGEST).astype(">u8").view(f"S{8 * d.shape[1]}").ravel()  # noqa: B023, E731
            out.append(np.searchsorted(view(d), view(part)))
    return np.stack(out, axis=1).astype(np.int32)


def partial_distances(parts: list[np.ndarray], centroids: np.ndarray) -> list[np.ndarray]:
    """For each block the squared distances of its entries to the centroids' parts."""
    out, at = [], 0
    for d in parts:
        c = centroids[:, at : at + d.shape[1]]
        at += d.shape[1]
        out.append(sum((d[:, i, None] - c[None, :, i]) ** 2 for i in range(d.shape[1])))
    return out


def nearest(codes: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; the smaller number of equally near ones."""
    total = np.zeros((len(codes), tables[0].shape[1]), np.int64)
    for b, table in enumerate(tables):
        total += table[codes[:, b]]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best]


class Clusters:
    """The vectors as codes, and what a round does with them."""

    def __init__(self, rows: DataFrame, dims: int, entries: int = ENTRIES):
        self.dims, self.kind = dims, rows.schema["_k"].dataType.simpleString()
        self.rows, width = rows, block_width(rows, dims, entries)
        self.parts: list[np.ndarray] | None = None
        if width:
            found: list[list] = [[] for _ in range(dims // width)]
            for block, part in distinct_parts(rows, width).collect():
                found[block].append(part)
            self.parts = parts = [_distinct(np.array(p, np.int64).reshape(-1, width)) for p in found]

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if b.num_rows:
                        yield pa.RecordBatch.from_arrays([b.column(0), _lists(_codes(_matrix(b.column(1)), parts), pa.int32())], ["_k", "_v"])

            self.rows = stored(rows.mapInArrow(run, f"_k {self.kind}, _v array<int>"))

    def _assigner(self, centroids: np.ndarray):
        """A function from the held form of vectors to (vectors, number, distance), block by block."""
        parts, dims = self.parts, self.dims
        shared = partial_distances(parts, centroids) if parts is not None else None

        def assign(held: np.ndarray):
            for at in range(0, len(held), _CHUNK):
                codes, own, tables = held[at : at + _CHUNK], parts, shared
                if own is None:
                    found = [np.unique(codes[:, d], return_inverse=True) for d in range(dims)]
                    own, codes = [f[0][:, None] for f in found], np.stack([f[1].ravel() for f in found], axis=1)
                    tables = partial_distances(own, centroids)
                best, far = nearest(codes, tables)
                yield lambda own=own, codes=codes: np.concatenate([p[codes[:, b]] for b, p in enumerate(own)], axis=1), best, far

        return assign

    def sums(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the components and number of the vectors nearest to each centroid."""
        assign, k, dims = self._assigner(centroids), len(centroids), self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dims + 1), np.int64)
            for b in batches:
                for vectors, best, _ in assign(_matrix(b.column(0))) if b.num_rows else ():
                    v = vectors()
                    order = np.argsort(best, kind="stable")
                    first = np.flatnonzero(np.diff(best[order], prepend=-1))
                    total[best[order][first], :dims] += np.add.reduceat(v[order], first, axis=0)
                    total[:, dims] += np.bincount(best, minlength=k)
            at = np.flatnonzero(total[:, dims])
            cell = (at[:, None] * (dims + 1) + np.arange(dims + 1)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total[at].ravel())], ["cell", "x"])

        out = np.zeros(k * (dims + 1), np.int64)
        for cell, x in self.rows.select("_v").mapInArrow(run, "cell long, x long").groupBy("cell").agg(F.sum("x")).collect():
            out[cell] = x
        out = out.reshape(k, dims + 1)
        return out[:, :dims], out[:, dims]

    def assigned(self, centroids: np.ndarray) -> DataFrame:
        """``_k``, ``cluster`` and ``distance`` of each vector."""
        assign = self._assigner(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = [(best, far) for _, best, far in assign(_matrix(b.column(1)))]
                    best, far = (np.concatenate(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(far)], ["_k", "cluster", "distance"])

        return self.rows.mapInArrow(run, f"_k {self.kind}, cluster int, distance long")


def start_vectors(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    mark = F.sha2(F.concat(F.lit(salt), F.col("_k").cast("string")).cast("binary"), 256)
    first = rows.select(mark.alias("_m"), "_v").orderBy(F.asc_nulls_last("_m"), "_v").limit(k).collect()
    return np.array([r["_v"] for r in first], np.int64)


def _total(x: Column) -> Column:
    return F.sum(x.cast("decimal(38,0)")).try_cast("long")


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    values: str = "embedding",
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    salt: str = "2:",
    entries: int = ENTRIES,
) -> DataFrame:
    """``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (array of long) per vector."""
    rows = integers(vectors, key, values, dims, scale)
    centroids = start_vectors(rows, k, salt)
    names = [F.col("_k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    if not len(centroids):
        empty = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid": "array<bigint>"}
        return rows.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()}).select(*names).limit(0)
    held = Clusters(rows, dims, entries)
    for _ in range(rounds):
        sums, n = held.sums(centroids)
        centroids = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], centroids)
    found = stored(held.assigned(centroids))
    spark = vectors.sparkSession
    last = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cluster int, centroid array<bigint>")
    # k rows at most, and one
    per = last.join(found.groupBy("cluster").agg(_total(F.col("distance")).alias("cluster_inertia")), "cluster")
    whole = found.agg(_total(F.col("distance")).alias("inertia")).first()["inertia"]
    return found.join(F.broadcast(per), "cluster").withColumn("inertia", F.lit(whole).cast("long")).select(*names)


def _sql(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The rounds one by one; a cell is one component of one vector."""
    steps = [
        f"""v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('{salt}' || vec_id)) - 1)::INT AS c, v FROM v
  ORDER BY sha256('{salt}' || vec_id) LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""d{r} AS (
  SELECT vec_id, v.v, c, list_sum(list_transform(list_zip(v.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM v, c{r}),
a{r} AS (SELECT vec_id, arg_min(c, (d, c)) AS c, min(d) AS d, any_value(v) AS v FROM d{r} GROUP BY 1)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (
  SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dims})) AS i FROM a{r}) GROUP BY 1, 2),
m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY 1),
c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""
    )


SQL = _sql()
