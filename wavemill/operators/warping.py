"""Warping of long sequences: the table of costs in tiles, of which only the borders are kept.

Sequences lie in chunks of ``tile`` values, rows (pair_id, chunk_idx, x). The tiles of an anti-diagonal depend on the
bottom rows and right columns of the two before only, so each wave of tiles is one job, and a tile needs
tile ** 2 numbers in a task whatever the sequences' lengths. What is kept of all tiles grows with
rows * columns / tile. The path is found back from the end: each step computes one tile of each pair again, from its
borders, walks through it and goes on in the tile that the path comes from.

Costs, paths and ties are those of ``kernels.dtw``: the diagonal first, then along the row. Pairs of which one side
has no values have no rows. Chunks follow each other without gaps, and only the last may be shorter.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import lists, matrix

#: Costs that are made at once: many small tiles, or one large one.
AT_ONCE = 1 << 20


def costs(x: np.ndarray, y: np.ndarray, top, left, corner: float) -> np.ndarray:
    """Costs of a tile under |x_i - y_j|, with the row above it and the column before it."""
    edge = lambda v, n: np.full((1, n), np.inf) if v is None else np.asarray(v, dtype=float)[None, :]
    return costs_of(x[None, :], y[None, :], edge(top, len(y)), edge(left, len(x)), np.array([corner]))[0]


def costs_of(x: np.ndarray, y: np.ndarray, top: np.ndarray, left: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """``costs`` of many tiles of equal size, one a row; what is not there is infinite."""
    rows, cols = x.shape[1], y.shape[1]
    c = np.empty((rows + 1, cols + 1, len(x)))  # a diagonal's cells of all tiles follow each other
    c[0, 0], c[0, 1:], c[1:, 0] = corner, top.T, left.T
    x, y = np.ascontiguousarray(x.T), np.ascontiguousarray(y.T)
    for n in range(rows + cols - 1):
        i = np.arange(max(0, n - cols + 1), min(rows, n + 1))
        j = n - i
        c[i + 1, j + 1] = np.abs(x[i] - y[j]) + np.minimum(np.minimum(c[i, j], c[i + 1, j]), c[i, j + 1])
    return np.moveaxis(c, 2, 0)


def walk(c: np.ndarray, i: int, j: int) -> list[tuple[int, int]]:
    """Cells of the path back from (i, j), up to the first one outside of the tile (with -1 in a place)."""
    rows, cols, n = walks(c[None, :, :], np.array([i]), np.array([j]))
    return list(zip(rows[0, : n[0]].tolist(), cols[0, : n[0]].tolist(), strict=True))


def walks(c: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, lengths) of the paths back in many tiles of equal size, one a row, each up to its first cell outside."""
    i, j = i.copy(), j.copy()
    rows, cols = (np.full((len(c), c.shape[1] + c.shape[2]), -1, np.int64) for _ in range(2))
    n, live, k = np.zeros(len(c), np.int64), np.arange(len(c)), 0
    while len(live):
        rows[live, k], cols[live, k] = i[live], j[live]
        n[live] += 1
        k += 1
        live = live[(i[live] >= 0) & (j[live] >= 0)]
        a, b = i[live], j[live]
        diag, along, down = c[live, a, b], c[live, a + 1, b], c[live, a, b + 1]
        both = (diag <= along) & (diag <= down)
        i[live] -= both | ~(along <= down)
        j[live] -= both | (along <= down)
    return rows, cols, n


def kept(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a checkpoint in the shared folder that the session names; only a local master may do without."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="wavemill-"))
    return df.checkpoint()


def _tiles(a: DataFrame, b: DataFrame, borders: DataFrame | None, at: DataFrame) -> DataFrame:
    """``at`` (pair_id, ti, tj, ...) with the values x, y of its tiles and the borders top, left, corner."""
    out = at.join(a, ["pair_id", "ti"]).join(b, ["pair_id", "tj"])
    none = F.lit(None)
    if borders is None:
        return out.withColumns({"top": none.cast("array<double>"), "left": none.cast("array<double>"), "corner": none.cast("double")})
    shifted = lambda di, dj, *c: borders.select("pair_id", (F.col("ti") + di).alias("ti"), (F.col("tj") + dj).alias("tj"), *c)
    key = ["pair_id", "ti", "tj"]
    out = out.join(shifted(1, 0, F.col("bottom").alias("top")), key, "left").join(shifted(0, 1, F.col("right").alias("left")), key, "left")
    return out.join(shifted(1, 1, F.element_at("bottom", -1).alias("corner")), key, "left")


def _computed(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of ``batch`` whose tiles have equal sizes, some at a time, with their costs."""
    same: dict[tuple[int, int], list[int]] = {}
    for k, size in enumerate(zip(*(pc.list_value_length(batch.column(n)).to_pylist() for n in ("x", "y")), strict=True)):
        same.setdefault(size, []).append(k)

    def edge(column: pa.Array, n: int) -> np.ndarray:
        out, there = np.full((len(column), n), np.inf), column.is_valid().to_numpy(zero_copy_only=False)
        if there.any():
            out[there] = matrix(column.filter(pa.array(there)))
        return out

    for (rows, cols), places in same.items():
        most = max(1, AT_ONCE // ((rows + 1) * (cols + 1)))
        for at in range(0, len(places), most):
            part = batch.take(pa.array(places[at : at + most]))
            first = (part.column("ti").to_numpy() == 0) & (part.column("tj").to_numpy() == 0)
            corner, known = part.column("corner"), part.column("corner").is_valid().to_numpy(zero_copy_only=False)
            corner = np.where(known, corner.fill_null(0.0).to_numpy(), np.where(first, 0.0, np.inf))
            yield part, costs_of(matrix(part.column("x")), matrix(part.column("y")), edge(part.column("top"), cols), edge(part.column("left"), rows), corner)


def dtw_chunks(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((pair_id, cost), (pair_id, row, col)): the cheapest warping of each pair of sequences in chunks; a path's cells in the order of row + col."""
    total, parts = dtw_parts(a, b)
    return total, cells(parts)


def cells(parts: DataFrame) -> DataFrame:
    """The cells (row, col) of path parts (rows, cols), with all other columns."""
    rest = [c for c in parts.columns if c not in ("rows", "cols")]
    return parts.select(*rest, F.explode(F.arrays_zip("rows", "cols")).alias("p")).select(*rest, F.col("p.rows").alias("row"), F.col("p.cols").alias("col"))


def dtw_parts(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``dtw_chunks``, with the path as one row (pair_id, rows, cols) a tile."""
    kind = dict(a.dtypes)["pair_id"]
    side = lambda s, index, name: s.where(F.size("x") > 0).select("pair_id", F.col("chunk_idx").cast("long").alias(index), F.col("x").cast("array<double>").alias(name))
    a, b = side(a, "ti", "x"), side(b, "tj", "y")
    last = a.groupBy("pair_id").agg(F.max("ti").alias("li"), F.max(F.struct("ti", F.size("x").alias("n")))["n"].alias("ni"))
    last = last.join(b.groupBy("pair_id").agg(F.max("tj").alias("lj"), F.max(F.struct("tj", F.size("y").alias("n")))["n"].alias("nj")), "pair_id")
    last = kept(last)
    waves = last.agg(F.max(F.col("li") + F.col("lj"))).first()[0]
    size = max((s.agg(F.max(F.size(c))).first()[0] or 0) for s, c in ((a, "x"), (b, "y")))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in _computed(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("pair_id", "ti", "tj")), lists(c[:, -1, 1:]), lists(c[:, 1:, -1])], names=["pair_id", "ti", "tj", "bottom", "right"])

    done: list[DataFrame] = []
    for w in range(waves + 1 if waves is not None else 0):
        at = last.select("pair_id", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), w - F.col("lj")), F.least(F.lit(w).cast("long"), F.col("li")))).alias("ti")) if w else last.select("pair_id", F.lit(0).cast("long").alias("ti"))
        at = at.join(last.select("pair_id", "li", "lj"), "pair_id").where((F.lit(w) <= F.col("li") + F.col("lj"))).select("pair_id", "ti", (F.lit(w) - F.col("ti")).alias("tj"))
        near = reduce(DataFrame.unionByName, done[-2:]) if done else None
        done.append(kept(_tiles(a, b, near, at).mapInArrow(forward, f"pair_id {kind}, ti long, tj long, bottom array<double>, right array<double>")))
    if not done:
        none = a.sparkSession.createDataFrame([], f"pair_id {kind}, cost double, rows array<long>, cols array<long>")
        return none.select("pair_id", "cost"), none.select("pair_id", "rows", "cols")
    borders = reduce(DataFrame.unionByName, done)
    ends = borders.join(last, (borders.pair_id == last.pair_id) & (F.col("ti") == F.col("li")) & (F.col("tj") == F.col("lj")))
    total = ends.select(borders.pair_id, F.element_at("bottom", -1).alias("cost"))

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, c in _computed(batch):
                ti, tj, i, j = (part.column(n).to_numpy() for n in ("ti", "tj", "i", "j"))
                rows, cols, n = walks(c, i, j)
                here = np.arange(len(n))
                i, j = rows[here, n - 1], cols[here, n - 1]  # outside
                inside = np.arange(rows.shape[1])[None, :] < n[:, None] - 1
                ends = pa.array(np.concatenate([[0], np.cumsum(n - 1)]).astype(np.int32))
                paths = (pa.ListArray.from_arrays(ends, pa.array((at[:, None] * size + v)[inside])) for at, v in ((ti, rows), (tj, cols)))
                # only the last tile of a side may be short, so the tile before has ``size`` values
                ti, tj = ti - (i < 0), tj - (j < 0)
                on = (ti >= 0) & (tj >= 0)
                yield pa.RecordBatch.from_arrays([part.column("pair_id"), *map(pa.array, (np.where(on, ti, -1), np.where(on, tj, -1), np.where(i < 0, size - 1, i), np.where(j < 0, size - 1, j))), *paths], names=["pair_id", "ti", "tj", "i", "j", "rows", "cols"])

    at = last.select("pair_id", F.col("li").alias("ti"), F.col("lj").alias("tj"), (F.col("ni") - 1).cast("long").alias("i"), (F.col("nj") - 1).cast("long").alias("j"))
    pieces: list[DataFrame] = []
    while at.take(1):
        found = kept(_tiles(a, b, borders, at).mapInArrow(back, f"pair_id {kind}, ti long, tj long, i long, j long, rows array<long>, cols array<long>"))
        pieces.append(found.select("pair_id", "rows", "cols"))
        at = found.where("ti >= 0").select("pair_id", "ti", "tj", "i", "j")
    return total, reduce(DataFrame.unionByName, pieces)
