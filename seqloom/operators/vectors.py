"""Sums of whole vectors by key.

A column of K aggregates per vector entry costs generated code and an aggregation buffer that grow with K.  Here a
vector stays one value: tasks add up the vectors of a key as matrices, partial sums are exchanged by key and added up
again in key order.  No key is handled by itself in Python: keys are numbered in whole columns.  Whatever the number of
keys, a task holds ``HOLD`` numbers of partial sums and as many raw rows before the exchange, and ``FOLD`` numbers after
it; of a key that all rows share it gets one vector from each task, or a few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD = 250_000
HOLD = 1_000_000
#: Rows of an Arrow batch that leaves a task.
BATCH = 10_000


def lists(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of lists."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if len(m) else 0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(m, np.float64).ravel()))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _groups(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number per row, equal where all key columns are."""
    code, size = np.zeros(table.num_rows, np.int64), 1
    for c in keys:
        each = table.column(c).chunk(0).dictionary_encode("encode")
        if size * len(each.dictionary) >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        code = code * len(each.dictionary) + each.indices.to_numpy(zero_copy_only=False)
        size *= len(each.dictionary)
    return code


class _Fold:
    """Rows not added up yet and the sum so far of each key, as Arrow tables of ``keys`` and ``vec``."""

    def __init__(self, keys: list[str], vec: str):
        self.keys, self.vec = keys, vec
        self.parts: list[pa.Table] = []
        self.held, self.numbers, self.last = 0, 0, 0

    def add(self, batch: pa.RecordBatch) -> None:
        v = batch.column(self.vec).cast(pa.list_(pa.float64()))
        self.parts.append(pa.Table.from_arrays([*[batch.column(c) for c in self.keys], v], names=[*self.keys, self.vec]))
        self.held += len(v.flatten()) + batch.num_rows * len(self.keys)

    @property
    def full(self) -> bool:
        """Raw rows outweigh the sums they are added to, so that a number is moved a few times only."""
        return self.held > max(FOLD, self.numbers)

    def settle(self) -> pa.Table:
        """Add up; ``last`` is then the place of the key of the row that came last."""
        table = pa.concat_tables(self.parts).combine_chunks()
        code, v = _groups(table, self.keys), matrix(table.column(self.vec))
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.last = int(np.searchsorted(code[order][first], code[-1]))
        sums = v[order] if len(first) == len(code) else np.add.reduceat(v[order], first, axis=0)
        rows = table.select(self.keys).take(pa.array(order[first])).append_column(self.vec, lists(sums))
        self.parts, self.held, self.numbers = [rows], 0, sums.size
        return rows

    def keep(self, rows: pa.Table | None) -> None:
        self.parts = [] if rows is None else [rows]
        self.held = self.numbers = 0


def vector_sums(rows: DataFrame, keys: list[str], vec: str = "vec", summed: bool = False) -> DataFrame:
    """``keys`` and the sum of the vectors ``vec`` of each; all vectors are equally long and without nulls.

    ``summed`` says that a task has one row for a key at most already.
    """
    rows = rows.select(*keys, vec)
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keys) + f", `{vec}` array<double>"

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.combine_chunks().to_batches(max_chunksize=BATCH)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of a task; what grows beyond ``HOLD`` numbers is passed on and begun anew."""
        fold = _Fold(keys, vec)
        for b in batches:
            if b.num_rows:
                fold.add(b)
                if fold.full:
                    done = fold.settle()
                    if fold.numbers > HOLD:
                        fold.keep(None)
                        yield from out(done)
        if fold.parts:
            yield from out(fold.settle())

    def whole_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of rows sorted by key: all but the last key are done whenever rows are added up."""
        fold = _Fold(keys, vec)
        for b in batches:
            if b.num_rows:
                fold.add(b)
                if fold.full:
                    done = fold.settle()
                    at = fold.last
                    fold.keep(done.slice(at, 1))
                    yield from out(pa.concat_tables([done.slice(0, at), done.slice(at + 1)]))
        if fold.parts:
            yield from out(fold.settle())

    parts = rows if summed else rows.mapInArrow(partial_sums, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(whole_sums, schema)


def vector_total(rows: DataFrame, vec: str = "vec", summed: bool = False, groups: int = 64) -> np.ndarray | None:
    """The sum of all vectors; None of an empty table.

    One vector per task is exchanged (``summed``: a task has no more rows than one), first among ``groups`` tasks.
    """
    parts = rows.select(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("_g"), F.col(vec).alias("_v"))
    parts = vector_sums(parts, ["_g"], "_v", summed).select(F.lit(0).alias("_g"), "_v")
    found = vector_sums(parts, ["_g"], "_v").collect()
    return np.array(found[0]["_v"]) if found else None


def constants(values: np.ndarray) -> Column:
    """A vector of constants."""
    return F.array(*[F.lit(float(x)) for x in values])
