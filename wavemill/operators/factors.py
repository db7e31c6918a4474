"""Non-negative factorisation of few long matrices: every column (block) stays a row, only W is sent.

Updates are those of ``learn.nmf_matrix``. A round reads the columns, renews each one's part of H with the W of all, and
sums per task and matrix what W's update needs (bins * rank + rank numbers a matrix and task). H is cut off
from its lineage each round by a checkpoint. No matrix is gathered in a task, and one that holds a third of all columns is spread
like the others. W of all matrices together has to be below MOST_NUMBERS, which is checked; many short matrices are
``learn.nmf``'s, one task each.

Columns whose values are null, or hold a null or a non-finite or negative value, and rows without a matrix or a place take no part. An
empty table gives no rows. Columns of a matrix need not be numbered without gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import matrix
from .warping import kept

MOST_NUMBERS = 1 << 23
# fixed values: the floor, the offset of the logarithm, the relative change that ends a fit
TINY, OFFSET, ENOUGH = 1e-30, 1e-24, 0.001


def drawn(places: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1] for each place and component, the same wherever a row lies."""
    z = places.astype(np.uint64)[:, None] * np.uint64(rank) + np.arange(rank, dtype=np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ z >> np.uint64(shift)) * np.uint64(factor)
    return ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(float) / (1 << 53) + 1.0 / (1 << 53)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[object, pa.RecordBatch]]:
    """The rows of each matrix in a batch."""
    keys = batch.column("signal_id").dictionary_encode()
    for n, key in enumerate(keys.dictionary.to_pylist()):
        yield key, batch.filter(pa.array(keys.indices.to_numpy() == n))


def nmf_columns(matrices: DataFrame, rank: int, max_iter: int = 300, sparsity: float = 0.0, seed: int = 1, start_w: Callable[[int], np.ndarray] | None = None, start_h: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[dict, DataFrame, dict]:
    """({signal_id: W (bins, rank)}, (signal_id, block_idx, h, est), {signal_id: cost}) of (signal_id, block_idx, mag).

    ``start_w(bins)`` and ``start_h(places)`` give the first W and rows of H; without them they are drawn. Matrices stop one by one.
    """
    good = F.col("mag").isNotNull() & ~F.exists("mag", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v == float("inf")))
    x = matrices.select("signal_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("mag").cast("array<double>").alias("mag")).where(good & F.col("signal_id").isNotNull() & F.col("block_idx").isNotNull())
    kind = dict(x.dtypes)["signal_id"]
    columns = f"signal_id {kind}, block_idx long, mag array<double>, old array<double>, h array<double>"
    some = x.groupBy("signal_id").agg(F.max(F.size("mag")).alias("bins")).limit(MOST_NUMBERS // max(rank, 1) + 1).collect()
    if sum(r["bins"] * rank for r in some) > MOST_NUMBERS:
        raise ValueError("too many matrices to send W of each; learn.nmf takes many short ones")
    rng = np.random.Generator(np.random.PCG64(seed))
    w = {r["signal_id"]: start_w(r["bins"]) if start_w else rng.random((r["bins"], rank)) for r in sorted(some, key=lambda r: r["signal_id"])}
    w = {k: v / np.abs(v).sum(axis=0) for k, v in w.items()}
    first_h = start_h or (lambda places: drawn(places, rank, seed))

    def mapped(df: DataFrame, ddl: str, fn: Callable) -> DataFrame:
        """fn(signal_id, rows) -> columns by name, for the rows of each matrix in a batch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for key, part in _groups(batch):
                    yield pa.RecordBatch.from_pydict(fn(key, part))

        return df.mapInArrow(run, ddl)

    def summed(df: DataFrame, size: Callable, fn: Callable, combine: str = "sum") -> dict:
        """{signal_id: vector}, one vector a matrix and task; fn(signal_id, rows) gives a batch's part."""
        add = np.add if combine == "sum" else np.maximum

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict = {}
            field = None
            for batch in batches:
                field = batch.schema.field("signal_id").type
                for key, part in _groups(batch):
                    total[key] = add(total.get(key, np.zeros(size(key))), fn(key, part))
            if total:
                yield pa.RecordBatch.from_pydict({"signal_id": pa.array(list(total), field), "v": pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))})

        sent = df.mapInArrow(run, f"signal_id {kind}, v array<double>").select("signal_id", F.posexplode("v").alias("i", "v"))
        out = {k: np.zeros(size(k)) for k in w}
        for r in sent.groupBy("signal_id", "i").agg(getattr(F, combine)("v").alias("v")).collect():
            out[r["signal_id"]][r["i"]] = r["v"]
        return out

    def rows(a: np.ndarray) -> pa.Array:
        return pa.array(list(a), pa.list_(pa.float64()))

    def begin(key, part):
        h = rows(first_h(part.column("block_idx").to_numpy()))
        return {**{c: part.column(c) for c in ("signal_id", "block_idx", "mag")}, "old": h, "h": h}

    state = mapped(x, columns, begin)
    cost, first, live = {}, {}, set(w)
    for it in range(max_iter):
        if not live:
            break

        def renew(key, part, w=dict(w), live=frozenset(live)):
            m, h = matrix(part.column("mag")), matrix(part.column("h"))
            new = h
            if key in live:
                new = h * ((m / (h @ w[key].T + TINY)) @ w[key]) / (w[key].sum(axis=0)[None, :] + sparsity + TINY)
                new = np.where(new < TINY, 0.0, new)
            return {**{c: part.column(c) for c in ("signal_id", "block_idx", "mag")}, "old": rows(h), "h": rows(new)}

        def parts(key, part, w=dict(w)):
            m, old, h = (matrix(part.column(c)) for c in ("mag", "old", "h"))
            return np.append(((m / (old @ w[key].T + TINY)).T @ h).ravel(), h.sum(axis=0))

        state = kept(mapped(state, columns, renew))
        sizes = {k: v.size + rank for k, v in w.items()}
        for key, v in summed(state, sizes.get, parts).items():
            if key in live:
                new = w[key] * v[:-rank].reshape(-1, rank) / (v[-rank:][None, :] + TINY)
                new /= np.maximum(np.abs(new).sum(axis=0), TINY)
                w[key] = np.where(new < TINY, 0.0, new)

        def height(key, part, w=dict(w)):
            return np.array([(matrix(part.column("h")) @ w[key].T + TINY).sum(axis=1).max()])

        top = summed(state, lambda k: 1, height, "max") if sparsity else {k: np.zeros(1) for k in w}

        def costs(key, part, w=dict(w), top=top):
            m = matrix(part.column("mag"))
            est = matrix(part.column("h")) @ w[key].T + TINY + sparsity * top[key][0]
            return np.array([(m * (np.log((m + OFFSET) / (est + OFFSET)) - 1) + est).sum()])

        for key, v in summed(state, lambda k: 1, costs).items():
            if key in live:
                if it and abs((v[0] - cost[key]) / (first[key] - v[0] + TINY)) < ENOUGH:
                    live.discard(key)
                first.setdefault(key, v[0])
                cost[key] = float(v[0])

    def estimate(key, part, w=dict(w)):
        return {"signal_id": part.column("signal_id"), "block_idx": part.column("block_idx"), "h": part.column("h"), "est": rows(matrix(part.column("h")) @ w[key].T)}

    return w, mapped(state, f"signal_id {kind}, block_idx long, h array<double>, est array<double>", estimate), cost
