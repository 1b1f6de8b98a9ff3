"""Forward-backward over a table of sequences as Spark jobs.

Sequences are stored as segments of bounded length, so that no row grows with a user's history.
``run`` applies the numpy steps to all segments, in one of two ways that give equal results:

* all item probabilities fit on an executor: they are broadcast, one narrow pass over the segments
* they do not: segments are hashed into blocks of bounded size, every block is co-grouped with just
  the item rows it needs

A sequence of several segments first gets the state at each segment edge from a prefix scan over
K x K segment operators (`edges`), after which its segments are independent of each other.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import fetched, settle
from . import kernel
from .model import DENSE_LIMIT, VEC, Model
from .sessions import SEQ
from .vectors import vector_sums

# Positions of a segment.  Below it a sequence costs K x K numbers a position; the scan over segment edges, which costs
# K x K x K, is left to longer ones.  A segment's state vectors take SEGMENT x K numbers.
SEGMENT = 32_768
BLOCK_DOUBLES = 3_000_000
WORK_DOUBLES = 1_000_000
FAN = 128
# Clicks of a task: a task sends one row for each item it has seen, so many small tasks send more rows than few large ones.
TASK_CLICKS = 400_000
# Clicks of a task whose sums are one long vector over all items: each task sends a vector of that length.
SUM_CLICKS = 4_000_000
# Numbers of a row of such a vector.
SLAB = 512

KEY_SCHEMA = "user_id bigint, chunk int, seg int"
SCHEMAS = {
    "stats": f"restart int, kind string, ix int, vec {VEC}",
    "moments": f"restart int, kind string, ix int, vec {VEC}",
    "sums": f"restart int, ix int, vec {VEC}",
    "lik": f"restart int, {KEY_SCHEMA}, log_lik double, positions bigint",
    "posterior": f"restart int, {KEY_SCHEMA}, t bigint, item_ix int, log_c double, "
    f"filt {VEC}, pred {VEC}, smooth {VEC}",
    "last": f"restart int, {KEY_SCHEMA}, log_c double, filt {VEC}, next {VEC}",
    "transfer": f"restart int, {KEY_SCHEMA}, op {VEC}",
}


def block_of(blocks: int) -> Column:
    return F.pmod(F.xxhash64(*SEQ, "seg"), F.lit(blocks)).cast("int")


@dataclass
class Sequences:
    """Segments ``(user_id, chunk, seg, final, t, items, counts)`` and their overall sizes."""

    df: DataFrame
    sequences: int
    entries: int
    segments: int
    _needs: dict[int, DataFrame] = field(default_factory=dict)

    def needs(self, blocks: int) -> DataFrame:
        """Which items each block holds; stored once, as every EM round asks for it."""
        if blocks not in self._needs:
            pairs = self.df.select(block_of(blocks).alias("blk"), F.explode("items").alias("item_ix"))
            self._needs[blocks] = settle(pairs.distinct())
        return self._needs[blocks]

    @property
    def cut(self) -> bool:
        return self.segments > self.sequences

    @property
    def sum_tasks(self) -> int:
        """Tasks of a pass that sends one vector over all items from each: few, in whole rounds over the cores."""
        least = self.df.sparkSession.sparkContext.defaultParallelism
        return least * max(1, -(-self.entries // (least * SUM_CLICKS)))


def sequences(seq: DataFrame, segment: int = SEGMENT, keep: bool = True) -> Sequences:
    """Cut and pack ``(user_id, chunk, t, item_ix, n)`` into segments of ``segment`` positions."""
    size = F.floor(F.col("t") / segment).cast("int")
    spark = seq.sparkSession
    least = spark.sparkContext.defaultParallelism
    tasks = max(least, -(-seq.count() // TASK_CLICKS))
    # whole rounds of tasks: one task more than cores would double the time of each pass
    tasks = -(-tasks // least) * least
    df = (
        seq.withColumn("seg", size)
        # the number of tasks follows the work per position, not the bytes: keep it from shrinking
        .repartition(tasks, *SEQ, "seg")
        .groupBy(*SEQ, "seg")
        .agg(
            F.array_sort(F.collect_list(F.struct("t", "item_ix", F.col("n").cast("double").alias("n")))).alias("e")
        )
        .select(
            F.col("user_id").cast("bigint").alias("user_id"),
            F.col("chunk").cast("int").alias("chunk"),
            "seg",
            F.col("e.t").cast("array<bigint>").alias("t"),
            F.col("e.item_ix").cast("array<int>").alias("items"),
            F.col("e.n").alias("counts"),
        )
    )
    df = settle(df) if keep else df
    sizes = df.agg(
        F.sum(F.when(F.col("seg") == 0, 1).otherwise(0)),
        F.sum(F.size("items")),
        F.count("*"),
        F.max("seg"),
    ).first()
    n_seq, entries, n_seg, top = [x or 0 for x in sizes]
    if top:
        ends = df.groupBy(*SEQ).agg(F.max("seg").alias("_end"))
        df = df.join(ends, SEQ).withColumn("final", F.col("seg") == F.col("_end")).drop("_end")
    else:
        df = df.withColumn("final", F.lit(True))
    return Sequences(df, n_seq, entries, n_seg)


class _Piece:
    """Flat numpy view of some rows of a segment batch."""

    def __init__(self, batch: pa.RecordBatch):
        col = {n: batch.column(n) for n in batch.schema.names}
        self.col = col
        self.rows = batch.num_rows
        size = col["items"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.items = col["items"].flatten().to_numpy()
        self.counts = col["counts"].flatten().to_numpy()
        t = col["t"].flatten().to_numpy()
        begins = np.r_[0, np.cumsum(size)[:-1]]
        new = np.empty(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        new[begins] = True
        place = np.cumsum(new) - 1
        self.start = place[begins]
        self.length = np.diff(np.r_[self.start, place[-1] + 1])
        # entry -> position; None when every position has one click
        simple = bool(new.all()) and bool((self.counts == 1).all())
        self.first = None if simple else np.flatnonzero(new)
        self.place = place
        self.t = t[new]
        self.item = self.items[new]
        self.final = col["final"].to_numpy(zero_copy_only=False)

    def edge(self, name: str, restart: int, k: int, default: np.ndarray) -> np.ndarray:
        out = np.broadcast_to(default, (self.rows, k)).copy()
        if name in self.col:
            column = self.col[name]
            known = column.is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                rows = column.drop_null().flatten().to_numpy().reshape(int(known.sum()), -1)
                out[known] = rows[:, restart * k : (restart + 1) * k]
        return out

    def keys(self, times: np.ndarray | None = None, where=None) -> list:
        out = []
        for n in ("user_id", "chunk", "seg"):
            v = self.col[n].to_numpy(zero_copy_only=False)
            v = v if where is None else v[where]
            out.append(pa.array(v if times is None else np.repeat(v, times)))
        return out


def _pieces(batch: pa.RecordBatch, width: int):
    """Split a batch so that one piece times K stays within the working-set budget."""
    if batch.num_rows == 0:
        return
    size = np.cumsum(batch.column("items").value_lengths().to_numpy(zero_copy_only=False))
    limit = max(1, WORK_DOUBLES // width)
    cut = np.searchsorted(size, np.arange(limit, size[-1] + limit, limit), side="left") + 1
    lo = 0
    for hi in np.unique(np.minimum(cut, batch.num_rows)):
        if hi > lo:
            yield _Piece(batch.slice(lo, int(hi) - lo))
            lo = int(hi)


def _vectors(m: np.ndarray) -> pa.Array:
    m = np.ascontiguousarray(m, dtype=np.float64)
    offsets = np.arange(0, m.size + 1, m.shape[1], dtype=np.int32) if m.size else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(m.ravel()))


class _Totals:
    """Sums over a task: dense per-kind matrices, item sums keyed by the ids of the task."""

    def __init__(self, restarts: int, k: int, n_items: int):
        self.small = [{} for _ in range(restarts)]
        self.emis = np.zeros((restarts, n_items, k)) if n_items else None
        self.seen = np.zeros(n_items, bool)

    def add(self, restart: int, kind: str, rows: np.ndarray):
        have = self.small[restart].get(kind)
        self.small[restart][kind] = rows if have is None else have + rows

    def batch(self, ids: np.ndarray) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for r, kinds in enumerate(self.small):
            parts = [(kind, np.arange(len(m)), m) for kind, m in kinds.items()]
            if self.seen.any():
                at = np.flatnonzero(self.seen)
                parts.append(("emis", ids[at], self.emis[r, at]))
            for kind, ix, m in parts:
                cols[0].append(np.full(len(m), r, np.int32))
                cols[1] += [kind] * len(m)
                cols[2].append(ix.astype(np.int32))
                cols[3].append(m)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate(cols[0])),
                pa.array(cols[1], pa.string()),
                pa.array(np.concatenate(cols[2])),
                _vectors(np.concatenate(cols[3])),
            ],
            names=["restart", "kind", "ix", "vec"],
        )

    def slabs(self):
        """All sums of a restart end to end (pi, trans, lik, items), cut into rows of ``SLAB``; rows of zeros are left out."""
        for r, kinds in enumerate(self.small):
            head = np.concatenate([kinds["pi"].ravel(), kinds["trans"].ravel(), kinds["lik"][0, :1]])
            flat, n = self.emis[r].ravel(), len(head) + self.emis[r].size
            for lo in range(0, n, 2048 * SLAB):
                hi = min(n, lo + 2048 * SLAB)
                rows = np.zeros((-(-(hi - lo) // SLAB), SLAB))
                part = rows.ravel()
                at = max(0, len(head) - lo)
                part[:at] = head[lo : lo + at]
                part[at : hi - lo] = flat[lo + at - len(head) : hi - len(head)]
                keep = np.flatnonzero(rows.any(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keep), r, np.int32)), pa.array((lo // SLAB + keep).astype(np.int32)), _vectors(rows[keep])],
                    names=["restart", "ix", "vec"],
                )


def _apply(kind: str, batches, small, log_v: np.ndarray, ids: np.ndarray):
    """Run one kind of pass over batches of segments; ``log_v`` holds all restarts side by side."""
    k = len(small[0][0])
    totals = _Totals(len(small), k, len(ids) if kind in ("stats", "sums") else 0)
    names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    found = False
    for batch in batches:
        for piece in _pieces(batch, k):
            found = True
            for r, (pi, trans) in enumerate(small):
                log_f = kernel.emission(
                    log_v[:, r * k : (r + 1) * k], piece.items, piece.counts, piece.first
                )
                cols = _one(kind, piece, r, pi, trans, log_f, totals)
                if cols is not None:
                    tag = pa.array(np.full(len(cols[0]), r, np.int32))
                    yield pa.RecordBatch.from_arrays([tag, *cols], names=names)
    if found and kind in ("stats", "moments"):
        yield totals.batch(ids)
    if found and kind == "sums":
        yield from totals.slabs()


def _one(kind: str, piece: _Piece, r: int, pi, trans, log_f, totals: _Totals):
    k = len(pi)
    if kind == "transfer":
        op = kernel.transfer(log_f, piece.start, piece.length, trans)
        return [*piece.keys(), _vectors(op.reshape(len(op), k * k))]
    begin = piece.edge("begin", r, k, pi)
    way = kernel.walk(piece.start, piece.length)
    q, p, c, after = kernel.filtered(log_f[way.at], way, trans, begin)
    if kind == "lik":
        lik = np.add.reduceat(way.placed(c[None])[:, 0], piece.start)
        return [*piece.keys(), pa.array(lik), pa.array(piece.length.astype(np.int64))]
    if kind == "last":
        end = np.flatnonzero(piece.final)
        stop = np.empty(len(way.ends), np.int64)
        stop[way.order] = way.ends
        return [
            *piece.keys(where=end),
            pa.array(c[stop[end]]),
            _vectors(q[:, stop[end]].T),
            _vectors(after[end]),
        ]
    future = piece.edge("future", r, k, np.ones(k))
    g, ahead = kernel.smoothed(q, p, way, trans, after, future)
    if kind == "posterior":
        return [
            *piece.keys(times=piece.length),
            pa.array(piece.t),
            pa.array(piece.item.astype(np.int32)),
            pa.array(way.placed(c[None])[:, 0]),
            *(_vectors(way.placed(x)) for x in (q, p, g)),
        ]
    if kind == "moments":
        totals.add(r, "pop", g.sum(axis=1)[None])
        totals.add(r, "cov", g @ g.T)
        totals.add(r, "n", np.full((1, k), float(g.shape[1])))
        return None
    ahead[:, way.ends[piece.final[way.order]]] = 0.0
    first = piece.col["seg"].to_numpy(zero_copy_only=False) == 0
    lik = np.zeros((1, k))
    lik[0, 0] = c.sum()
    totals.add(r, "lik", lik)
    totals.add(r, "pi", g[:, : len(way.order)][:, first[way.order]].sum(axis=1)[None])
    totals.add(r, "trans", trans * (q @ ahead.T))
    if piece.first is None:
        ids, sums = kernel.sum_by_item(piece.items[way.at], g.T)
    else:
        ids, sums = kernel.sum_by_item(piece.items, way.placed(g)[piece.place] * piece.counts[:, None])
    totals.emis[r, ids] += sums
    totals.seen[ids] = True
    return None


def _map_dense(batches, kind, shared):
    small, log_v = shared.value
    yield from _apply(kind, batches, small, log_v, np.arange(len(log_v)))


def _map_sharded(left: pa.Table, right: pa.Table, kind, small) -> pa.Table:
    schema_names = [c.split()[0] for c in SCHEMAS[kind].split(", ")]
    right = right.sort_by("item_ix").combine_chunks()
    ids = right.column("item_ix").to_numpy()
    k = len(small[0][0]) * len(small)
    vec = right.column("vec").combine_chunks()
    with np.errstate(divide="ignore"):
        log_v = np.log(vec.flatten().to_numpy().reshape(len(ids), k))
    batches = []
    for b in left.combine_chunks().to_batches():
        local = np.searchsorted(ids, b.column("items").flatten().to_numpy()).astype(np.int32)
        lists = pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(b.column("items").value_lengths().to_numpy())].astype(np.int32)),
            pa.array(local),
        )
        at = b.schema.get_field_index("items")
        batches.append(b.set_column(at, "items", lists))
    out = list(_apply(kind, batches, small, log_v, ids))
    if kind == "posterior":
        at = schema_names.index("item_ix")
        out = [
            b.set_column(at, "item_ix", pa.array(ids[b.column(at).to_numpy()].astype(np.int32))) for b in out
        ]
    return pa.Table.from_batches(out)


def _side_by_side(models: list[Model]) -> DataFrame:
    """One item table whose vectors hold all restarts one after the other."""
    out = models[0].emis
    for m in models[1:]:
        other = m.emis.select("item_ix", F.col("vec").alias("_more"))
        out = out.join(other, "item_ix").select("item_ix", F.concat("vec", "_more").alias("vec"))
    return out


def run(seqs: Sequences, models: list[Model], kind: str, sharded: bool | None = None, held: list | None = None) -> DataFrame:
    """One pass of ``kind`` (see SCHEMAS) over all segments for all restarts.

    What is broadcast for it is added to ``held``, for callers that know when the pass is over.
    """
    small = [(m.pi, m.trans) for m in models]
    if sharded is None:
        sharded = not all(m.fits for m in models)
    # one pass reads the segments once for all restarts; its sums leave as they are, so that more of them fit
    limit = 4 * DENSE_LIMIT if kind == "sums" else DENSE_LIMIT
    if not sharded and len(models) > 1 and sum(m.n_items * m.states for m in models) > limit:
        half = len(models) // 2
        rest = run(seqs, models[half:], kind, False, held).withColumn("restart", F.col("restart") + half)
        return run(seqs, models[:half], kind, False, held).unionByName(rest)
    df = seqs.df
    if seqs.cut and kind != "transfer":
        df = df.join(edges(seqs, models, sharded), [*SEQ, "seg"], "left")
    if not sharded:
        with np.errstate(divide="ignore"):
            log_v = np.log(np.hstack([m.dense for m in models]))
        shared = df.sparkSession.sparkContext.broadcast((small, log_v))
        if held is not None:
            held.append(shared)
        if kind == "sums":
            df = df.coalesce(seqs.sum_tasks)
        return df.mapInArrow(partial(_map_dense, kind=kind, shared=shared), SCHEMAS[kind])
    blocks = max(1, -(-seqs.entries * len(models) * models[0].states // BLOCK_DOUBLES))
    df = df.withColumn("blk", block_of(blocks))
    rows = seqs.needs(blocks).join(_side_by_side(models), "item_ix").select(F.col("blk").alias("at"), "item_ix", "vec")
    work = partial(_map_sharded, kind=kind, small=small)

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left.drop(["blk"]), right)

    return df.groupBy("blk").cogroup(rows.groupBy("at")).applyInArrow(block, SCHEMAS[kind])


def edges(seqs: Sequences, models: list[Model], sharded: bool | None = None) -> DataFrame:
    """State before and likelihood after each segment of the sequences that have several.

    Prefix scan over the segment operators: products are combined FAN at a time until one is left
    per sequence, then the start and the future are handed back down level by level.  The units of
    at most FAN operators are hashed into groups of bounded size.
    """
    k, n = models[0].states, len(models)
    part = Sequences(
        seqs.df.where(~(F.col("final") & (F.col("seg") == 0))), seqs.sequences, seqs.entries, seqs.segments
    )
    ops = run(part, models, "transfer", sharded)
    ops = ops.select(*SEQ, "restart", F.col("seg").cast("bigint").alias("node"), "op")
    groups = max(1, seqs.segments * n * k * k // BLOCK_DOUBLES)
    parent_of = F.floor(F.col("node") / FAN).cast("bigint").alias("up")
    group_of = F.pmod(F.xxhash64(*SEQ, "restart", "up"), F.lit(groups)).cast("int").alias("grp")

    def grouped(df: DataFrame):
        return df.select("*", parent_of).select("*", group_of).groupBy("grp")

    def combine(table: pa.Table) -> pa.Table:
        return _combine(table, k)

    def hand_down(table: pa.Table) -> pa.Table:
        return _hand_down(table, k)

    levels = [settle(ops)]
    top = levels[0].agg(F.max("node")).first()[0] or 0
    while top > 0:
        levels.append(settle(grouped(levels[-1]).applyInArrow(combine, COMBINED)))
        top //= FAN
    starts = F.array(*[F.array(*[F.lit(float(x)) for x in m.pi]) for m in models])
    ones = F.array(*[F.lit(1.0)] * k)
    state = levels[-1].select(
        *SEQ, "restart", "node", F.element_at(starts, F.col("restart") + 1).alias("begin"), ones.alias("future")
    )
    for level in reversed(levels[:-1]):
        parent = state.withColumnRenamed("node", "up")
        child = level.select("*", parent_of).join(parent, [*SEQ, "restart", "up"])
        child = child.select("*", group_of).groupBy("grp")
        state = child.applyInArrow(hand_down, HANDED)

    def ordered(c):
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("restart", c))), lambda s: s[c]))

    out = state.groupBy(*SEQ, F.col("node").cast("int").alias("seg")).agg(
        ordered("begin").alias("begin"), ordered("future").alias("future")
    )
    return settle(out)


COMBINED = f"user_id bigint, chunk int, restart int, node bigint, op {VEC}"
HANDED = f"user_id bigint, chunk int, restart int, node bigint, begin {VEC}, future {VEC}"


def _units(table: pa.Table, k: int):
    """Rows of a group sorted by unit and node, with the operators and the bounds of the units."""
    keys = [*SEQ, "restart", "up"]
    table = table.sort_by([(c, "ascending") for c in [*keys, "node"]]).combine_chunks()
    cols = [table.column(c).to_numpy() for c in keys]
    new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, table.num_rows])
    ops = table.column("op").combine_chunks().flatten().to_numpy().reshape(-1, k, k)
    order, active = kernel.by_length(length)
    return table, ops, start, start[order], active


def _combine(table: pa.Table, k: int) -> pa.Table:
    table, ops, start, first, active = _units(table, k)
    out = ops[first]
    for t, m in enumerate(active[1:], 1):
        out[:m] = kernel.scaled(out[:m] @ ops[first[:m] + t])
    head = table.take(first)
    names = ["user_id", "chunk", "restart", "up"]
    return pa.Table.from_arrays(
        [*[head.column(c) for c in names], _vectors(out.reshape(len(out), k * k))],
        names=["user_id", "chunk", "restart", "node", "op"],
    )


def _hand_down(table: pa.Table, k: int) -> pa.Table:
    table, ops, start, first, active = _units(table, k)
    begin, future = np.empty((len(ops), k)), np.empty((len(ops), k))
    head = table.take(first)
    a = head.column("begin").combine_chunks().flatten().to_numpy().reshape(-1, k).copy()
    b = head.column("future").combine_chunks().flatten().to_numpy().reshape(-1, k).copy()
    for t, m in enumerate(active):
        at = first[:m] + t
        begin[at] = a[:m]
        a[:m] = (a[:m, None, :] @ ops[at])[:, 0]
        a[:m] = kernel.ratio(a[:m], np.broadcast_to(a[:m].sum(axis=1, keepdims=True), (m, k)))
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = first[:m] + t
        future[at] = b[:m]
        b[:m] = (ops[at] @ b[:m, :, None])[:, :, 0]
        b[:m] = kernel.ratio(b[:m], np.broadcast_to(b[:m].max(axis=1, keepdims=True), (m, k)))
    names = ["user_id", "chunk", "restart", "node"]
    return pa.Table.from_arrays(
        [*[table.column(c) for c in names], _vectors(begin), _vectors(future)],
        names=[*names, "begin", "future"],
    )


def statistics(seqs: Sequences, models: list[Model], kind: str = "stats", sharded=None) -> DataFrame:
    """Expected counts summed over all sequences: ``(restart, kind, ix, vec)``."""
    return vector_sums(run(seqs, models, kind, sharded), ["restart", "kind", "ix"], summed=True)


def dense_sums(seqs: Sequences, models: list[Model]) -> list[tuple[np.ndarray, np.ndarray, float, np.ndarray]]:
    """As ``statistics`` for models that fit, on the driver: (pi, trans, lik, items) of each restart."""
    held: list = []
    rows = fetched(vector_sums(run(seqs, models, "sums", False, held), ["restart", "ix"], summed=True))
    for b in held:
        b.destroy()
    restart, ix = rows.column("restart").to_numpy(), rows.column("ix").to_numpy()
    vec = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(-1, SLAB)
    out = []
    for r, m in enumerate(models):
        k, size = m.states, m.states * (1 + m.states) + 1
        flat = np.zeros((-(-(size + m.dense.size) // SLAB), SLAB))
        flat[ix[restart == r]] = vec[restart == r]
        flat = flat.ravel()
        sums = flat[size : size + m.dense.size].reshape(-1, k)
        out.append((flat[:k], flat[k : k + k * k].reshape(k, k), float(flat[size - 1]), sums))
    return out


def log_likelihood(seqs: Sequences, models: list[Model], sharded=None) -> DataFrame:
    """Log-likelihood per restart and sequence (forward pass only)."""
    rows = run(seqs, models, "lik", sharded)
    if not seqs.cut:
        return rows.drop("seg")
    return rows.groupBy("restart", *SEQ).agg(
        F.sum("log_lik").alias("log_lik"), F.sum("positions").alias("positions")
    )


def posterior(seqs: Sequences, model: Model, sharded=None) -> DataFrame:
    """Filtered, predicted and smoothed state per position."""
    return run(seqs, [model], "posterior", sharded).drop("restart", "seg")


def next_state(seqs: Sequences, model: Model, sharded=None) -> DataFrame:
    """State predicted for the position after each sequence, and the last log normaliser."""
    return run(seqs, [model], "last", sharded).drop("restart", "seg")
