"""Large matrices as square tiles: products over a grid of cells, determinant, solution and inverse by pivoted elimination.

A ``Blocked`` is a table (bi, bj, t): tile (bi, bj) holds rows bi * tile to bi * tile + tile and the columns alike, row by row, as
the bytes of 64-bit numbers; tiles at the far edges are smaller. A tile without a row in the table is zero.

A product deals both sides to cells of CELL rows, columns and inner places, so a tile is sent once for each cell
that needs it, and no task holds more than three squares of CELL numbers. The products of cells that share rows
and columns are added within each task first, then tile by tile.

Elimination goes panel by panel (one tile's columns). Every task picks as many rows of the panel as it has columns by partial
pivoting, the picks play each other in a tree, and the driver gets the last FAN of them: a few squares of the tile's size. Rows
stay in their places; the driver keeps one number for each row, and the tiles right of the panel get the outer product by one
exchange. A round is two jobs and cut off by a checkpoint, so a matrix of n rows takes n / tile rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .warping import kept

#: Rows, columns and inner places of a cell of a product.
CELL = 2048
#: Picks of rows that one step of the tournament compares.
FAN = 8
#: Rows of a matrix that can be eliminated: the driver and each task hold one number for each.
MOST_ROWS = 1 << 22

_DDL = "bi int, bj int, t binary"


@dataclass(frozen=True)
class Blocked:
    df: DataFrame
    rows: int
    cols: int
    tile: int

    @property
    def shape(self) -> tuple[int, int]:
        """Tiles along both sides."""
        return -(-self.rows // self.tile), -(-self.cols // self.tile)


def _side(total: int, tile: int, b: int) -> int:
    return min(tile, total - b * tile)


def _array(data: bytes, cols: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, cols)


def _table(keys, tiles) -> pa.Table:
    bi, bj = zip(*keys, strict=True) if keys else ((), ())
    return pa.table([pa.array(bi, pa.int32()), pa.array(bj, pa.int32()), pa.array([np.ascontiguousarray(t, dtype=np.float64).tobytes() for t in tiles], pa.binary())], names=["bi", "bj", "t"])


def _checked(rows: int, cols: int, tile: int) -> None:
    if rows < 0 or cols < 0 or not 0 < tile <= CELL:
        raise ValueError(f"sides must not be negative and tiles have 1 to {CELL} rows")


def from_entries(m: DataFrame, rows: int, cols: int, tile: int = 512) -> Blocked:
    """Of (i, j, v): entries that occur more than once are added, those with a null count as 0. Places outside of the matrix are an error."""
    _checked(rows, cols, tile)

    def build(table: pa.Table) -> pa.Table:
        i, j, v = (table.column(c).to_numpy() for c in ("i", "j", "v"))
        bi, bj = int(i[0]) // tile, int(j[0]) // tile
        out = np.zeros((_side(rows, tile, bi), _side(cols, tile, bj)))
        np.add.at(out, (i - bi * tile, j - bj * tile), v)
        return _table([(bi, bj)], [out])

    inside = (F.col("i") >= 0) & (F.col("i") < rows) & (F.col("j") >= 0) & (F.col("j") < cols)
    source = m.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v")).dropna()
    source = source.withColumn("v", F.when(inside, F.col("v")).otherwise(F.raise_error(F.lit("a place lies outside of the matrix")).cast("double")))
    return Blocked(source.groupBy(F.expr(f"i div {tile}"), F.expr(f"j div {tile}")).applyInArrow(build, _DDL), rows, cols, tile)


def from_rows(df: DataFrame, rows: int, cols: int, tile: int = 512) -> Blocked:
    """Of (i, x ARRAY): each row is cut into the tiles' widths before the exchange. Rows that are null or too short are filled with 0; of equal i the sum counts."""
    _checked(rows, cols, tile)

    def build(table: pa.Table) -> pa.Table:
        i, bj = table.column("i").to_numpy(), table.column("bj")[0].as_py()
        bi = int(i[0]) // tile
        out = np.zeros((_side(rows, tile, bi), _side(cols, tile, bj)))
        for k, x in zip(i - bi * tile, table.column("x"), strict=True):
            v = x.values.fill_null(0.0).to_numpy(zero_copy_only=False)
            out[k, : len(v)] += v
        return _table([(bi, bj)], [out])

    width = -(-cols // tile)
    x = F.slice(F.col("x").cast("array<double>"), F.col("bj") * tile + 1, F.least(F.lit(tile), F.lit(cols) - F.col("bj") * tile))
    source = df.where("i is not null and x is not null").select(F.col("i").cast("long").alias("i"), "x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("bj"))
    fits = (F.col("i") >= 0) & (F.col("i") < rows) & (F.size("x") <= cols)
    source = source.select(F.when(fits, F.col("i")).otherwise(F.raise_error(F.lit("a row lies outside of the matrix")).cast("long")).alias("i"), "bj", x.alias("x"))
    return Blocked(source.groupBy(F.expr(f"i div {tile}"), "bj").applyInArrow(build, _DDL), rows, cols, tile)


def eye(spark: SparkSession, n: int, tile: int = 512) -> Blocked:
    _checked(n, n, tile)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("id").to_pylist():
                yield from _table([(b, b)], [np.eye(_side(n, tile, b))]).to_batches()

    return Blocked(spark.range(-(-n // tile)).mapInArrow(build, _DDL), n, n, tile)


def to_entries(m: Blocked) -> DataFrame:
    """(i, j, v) of the tiles that the table holds."""
    tile, cols = m.tile, m.cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                x = _array(t, _side(cols, tile, bj))
                i, j = np.indices(x.shape)
                yield pa.RecordBatch.from_arrays([pa.array(i.ravel() + bi * tile), pa.array(j.ravel() + bj * tile), pa.array(x.ravel())], names=["i", "j", "v"])

    return m.df.mapInArrow(run, "i long, j long, v double")


def transpose(m: Blocked) -> Blocked:
    tile, cols = m.tile, m.cols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                yield from _table([(bj, bi)], [_array(t, _side(cols, tile, bj)).T]).to_batches()

    return Blocked(m.df.mapInArrow(run, _DDL), m.cols, m.rows, tile)


# --- products --------------------------------------------------------------------------------------


def _added(parts: DataFrame, most: int) -> DataFrame:
    """The sum of the tiles of each place: within each task, at most ``most`` places at a time, then in order of the places."""

    def early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                x = np.frombuffer(t)
                held[bi, bj] = held[bi, bj] + x if (bi, bj) in held else x
                if len(held) > most:
                    yield from _table(list(held), held.values()).to_batches()
                    held = {}
        yield from _table(list(held), held.values()).to_batches()

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0)
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                if at == (bi, bj):
                    total = total + np.frombuffer(t)
                    continue
                if at is not None:
                    yield from _table([at], [total]).to_batches()
                at, total = (bi, bj), np.frombuffer(t)
        if at is not None:
            yield from _table([at], [total]).to_batches()

    return parts.mapInArrow(early, _DDL).repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(ordered, _DDL)


def matmul(a: Blocked, b: Blocked, cell: int = CELL) -> Blocked:
    if a.cols != b.rows or a.tile != b.tile:
        raise ValueError("the inner sides and the tiles must be equal")
    tile, inner, cols = a.tile, a.cols, b.cols
    side = max(1, cell // tile)
    across = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-n // side) - 1))))
    left = a.df.select(F.expr(f"bi div {side}").alias("gi"), across(b.shape[1]).alias("gj"), F.expr(f"bj div {side}").alias("gk"), "bi", "bj", "t")
    right = b.df.select(across(a.shape[0]).alias("gi"), F.expr(f"bj div {side}").alias("gj"), F.expr(f"bi div {side}").alias("gk"), "bi", "bj", "t")

    def product(table: pa.Table) -> pa.Table:
        rows: dict = {}
        lefts = []
        for part, bi, bj, t in zip(*(table.column(c).to_pylist() for c in ("part", "bi", "bj", "t")), strict=True):
            if part:
                rows.setdefault(bi, []).append((bj, _array(t, _side(cols, tile, bj))))
            else:
                lefts.append((bi, bj, _array(t, _side(inner, tile, bj))))
        out: dict = {}
        for i, k, u in lefts:
            for j, v in rows.get(k, []):
                out[i, j] = out[i, j] + u @ v if (i, j) in out else u @ v
        return _table(list(out), out.values())

    both = left.withColumn("part", F.lit(0)).unionByName(right.withColumn("part", F.lit(1)))
    parts = both.groupBy("gi", "gj", "gk").applyInArrow(product, _DDL)
    several = -(-a.shape[1] // side) > 1
    return Blocked(_added(parts, max(1, (cell // tile) ** 2)) if several else parts, a.rows, b.cols, tile)


# --- elimination -----------------------------------------------------------------------------------


def picked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, diagonal): the rows that partial pivoting takes for the columns of ``x``, in order, and their pivots."""
    x = x.copy()
    order = np.arange(len(x))
    count = min(x.shape)
    for c in range(count):
        p = c + int(np.argmax(np.abs(x[c:, c])))
        if p != c:
            x[[c, p]], order[[c, p]] = x[[p, c]], order[[p, c]]
        if x[c, c] != 0:
            x[c + 1 :, c] /= x[c, c]
            x[c + 1 :, c + 1 :] -= np.outer(x[c + 1 :, c], x[c, c + 1 :])
    return order[:count], np.diagonal(x)[:count]


def _winners(ids: list[np.ndarray], values: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of several picks one; the rows are compared in the order of their numbers, however they come."""
    i, v = np.concatenate(ids), np.concatenate(values).reshape(-1, width)
    order = np.argsort(i, kind="stable")
    i, v = i[order], v[order]
    take, _ = picked(v)
    return i[take], v[take]


def _tournament(panel: DataFrame, width: int, tile: int, tiles: int, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, their values) of up to ``width`` pivot rows among the free rows of a panel."""
    ddl = "ids binary, v binary"

    def result(ids, values) -> Iterator[pa.RecordBatch]:
        if ids is not None:
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())], names=["ids", "v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for bi, t in zip(batch.column("bi").to_pylist(), batch.column("t").to_pylist(), strict=True):
                x = _array(t, width)
                ids = np.arange(len(x)) + bi * tile
                ok = free[ids]
                if ok.any():
                    got = [(ids[ok], x[ok])] + ([best] if best else [])
                    best = _winners([g[0] for g in got], [g[1] for g in got], width)
        yield from result(*best) if best else ()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for ids, v in zip(batch.column("ids").to_pylist(), batch.column("v").to_pylist(), strict=True):
                one = (np.frombuffer(ids, dtype=np.int64), _array(v, width))
                best = _winners([best[0], one[0]], [best[1], one[1]], width) if best else one
        yield from result(*best) if best else ()

    picks = panel.mapInArrow(first, ddl)
    while tiles > FAN:
        tiles = -(-tiles // FAN)
        picks = picks.repartition(tiles).mapInArrow(again, ddl)
    got = picks.collect()
    if not got:
        return np.zeros(0, dtype=np.int64), np.zeros((0, width))
    return _winners([np.frombuffer(r["ids"], dtype=np.int64) for r in got], [_array(r["v"], width) for r in got], width)


def _filled(m: Blocked) -> DataFrame:
    """The table with every tile present."""
    rows, cols, tile = m.rows, m.cols, m.tile
    tall, wide = m.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                yield from _table([(bi, bj)], [np.zeros((_side(rows, tile, bi), _side(cols, tile, bj))) if t is None else _array(t, _side(cols, tile, bj))]).to_batches()

    grid = m.df.sparkSession.range(tall * wide).select(F.expr(f"cast(id div {wide} as int)").alias("bi"), F.expr(f"cast(id % {wide} as int)").alias("bj"))
    return grid.join(m.df, ["bi", "bj"], "left").mapInArrow(run, _DDL)


def _sign(order: np.ndarray) -> float:
    """1 for an even permutation, else -1."""
    seen, odd = np.zeros(len(order), dtype=bool), len(order)
    for k in range(len(order)):
        if not seen[k]:
            odd -= 1
            while not seen[k]:
                seen[k] = True
                k = order[k]
    return -1.0 if odd % 2 else 1.0


def _eliminate(a: Blocked, right: Blocked | None) -> tuple[np.ndarray, float, float, float, DataFrame | None]:
    """(row taken for each column, sign and logarithm of the determinant, smallest pivot, tiles of ``right`` with rows where they were).

    With a right side rows above are cleared too, so that it ends as the solution; without one only free rows are.
    """
    n, tile = a.rows, a.tile
    if n != a.cols:
        raise ValueError("the matrix must be square")
    if n > MOST_ROWS:
        raise ValueError(f"at most {MOST_ROWS} rows can be eliminated")
    tall, last = a.shape[0], a.shape[1]
    wide = last + (right.shape[1] if right else 0)
    breadth = lambda b: _side(n, tile, b) if b < last else _side(right.cols, tile, b - last)
    breadths = [breadth(b) for b in range(wide)]
    work = _filled(a)
    if right:
        work = work.unionAll(_filled(right).select("bi", (F.col("bj") + last).cast("int").alias("bj"), "t"))
    work = kept(work)
    free, taken, sign, log, least = np.ones(n, dtype=bool), [], 1.0, 0.0, np.inf
    for k in range(last):
        width = breadths[k]
        ids, pivots = _tournament(work.where(F.col("bj") == k), width, tile, tall, free)
        s, low = np.linalg.slogdet(pivots) if len(ids) == width else (0.0, -np.inf)
        if s == 0:
            return np.concatenate([*taken, ids]), 0.0, -np.inf, 0.0, None
        sign, log, least = sign * s, log + low, min(least, float(np.abs(picked(pivots)[1]).min()))
        taken.append(ids)
        free[ids] = False
        if k + 1 < wide:
            work = kept(_step(work, k, ids, pivots, free.copy(), right is not None, tile, tall, breadths))
    order = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
    return order, sign * _sign(order), log, least, work if right else None


def _step(work: DataFrame, k: int, ids: np.ndarray, pivots: np.ndarray, free: np.ndarray, everything: bool, tile: int, tall: int, breadths: list[int]) -> DataFrame:
    """One panel's round: the pivot rows are divided by the pivots, and their multiples taken from the other rows."""
    place = {int(r): p for p, r in enumerate(ids)}
    width, wide = len(ids), len(breadths)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                x = _array(t, breadths[bj])
                here = [r for r in range(len(x)) if r + bi * tile in place]
                if here:
                    at = np.array([place[r + bi * tile] for r in here], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([bj], pa.int32()), pa.array([at.tobytes()], pa.binary()), pa.array([x[here].tobytes()], pa.binary())], names=["bj", "at", "t"])

    def solved(table: pa.Table) -> pa.Table:
        bj = table.column("bj")[0].as_py()
        rows = np.zeros((width, breadths[bj]))
        for at, t in zip(table.column("at").to_pylist(), table.column("t").to_pylist(), strict=True):
            rows[np.frombuffer(at, dtype=np.int64)] = _array(t, breadths[bj])
        return pa.table([pa.array([bj], pa.int32()), pa.array([np.linalg.solve(pivots, rows).tobytes()], pa.binary())], names=["bj", "t"])

    def update(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        part = dict(zip(table.column("part").to_pylist(), table.column("t").to_pylist(), strict=True))
        x, u, factor = _array(part[0], breadths[bj]).copy(), _array(part[2], breadths[bj]), _array(part[1], width).copy()
        number = np.arange(len(x)) + bi * tile
        own = np.array([r in place for r in number.tolist()])
        factor[own if everything else ~free[number]] = 0.0
        x -= factor @ u
        if own.any():
            x[own] = u[[place[r] for r in number[own].tolist()]]
        return _table([(bi, bj)], [x])

    rest = work.where(F.col("bj") > k)
    upper = rest.mapInArrow(rows_of, "bj int, at binary, t binary").groupBy("bj").applyInArrow(solved, "bj int, t binary")
    factors = work.where(F.col("bj") == k).select("bi", F.explode(F.sequence(F.lit(k + 1), F.lit(wide - 1))).alias("bj"), F.lit(1).alias("part"), "t")
    upper = upper.select(F.explode(F.sequence(F.lit(0), F.lit(tall - 1))).alias("bi"), "bj", F.lit(2).alias("part"), "t")
    return rest.select("bi", "bj", F.lit(0).alias("part"), "t").unionAll(factors).unionAll(upper).groupBy("bi", "bj").applyInArrow(update, _DDL)


def determinant(a: Blocked) -> tuple[float, float]:
    """(sign, logarithm of the absolute value); (0, -inf) of a singular matrix, (1, 0) of one without rows."""
    _, sign, log, _, _ = _eliminate(a, None)
    return sign, log


def solve(a: Blocked, b: Blocked) -> Blocked:
    """X with a X = b. A matrix whose pivots vanish against its largest number is an error."""
    if a.rows != b.rows or a.tile != b.tile:
        raise ValueError("both sides need as many rows, and equal tiles")
    n, tile, cols, last = a.rows, a.tile, b.cols, a.shape[1]
    order, sign, _, least, work = _eliminate(a, b)
    most = _largest(a)
    if sign == 0 or least <= n * np.finfo(float).eps * most:
        raise ValueError("the matrix is singular")
    where = np.empty(n, dtype=np.int64)
    where[order] = np.arange(n)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bi, bj, t in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "t")), strict=True):
                x = _array(t, _side(cols, tile, bj - last))
                to = where[bi * tile : bi * tile + len(x)]
                for target in np.unique(to // tile).tolist():
                    rows = to // tile == target
                    yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), pa.array([bj - last], pa.int32()), pa.array([(to[rows] - target * tile).tobytes()], pa.binary()), pa.array([x[rows].tobytes()], pa.binary())], names=["bi", "bj", "at", "t"])

    def placed(table: pa.Table) -> pa.Table:
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        out = np.zeros((_side(n, tile, bi), _side(cols, tile, bj)))
        for at, t in zip(table.column("at").to_pylist(), table.column("t").to_pylist(), strict=True):
            out[np.frombuffer(at, dtype=np.int64)] = _array(t, out.shape[1])
        return _table([(bi, bj)], [out])

    return Blocked(work.mapInArrow(sent, "bi int, bj int, at binary, t binary").groupBy("bi", "bj").applyInArrow(placed, _DDL), n, cols, tile)


def inverse(a: Blocked) -> Blocked:
    return solve(a, eye(a.df.sparkSession, a.rows, a.tile))


def _largest(a: Blocked) -> float:
    """The largest absolute value, one number a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = 0.0
        for batch in batches:
            top = max([top, *(float(np.abs(np.frombuffer(t)).max(initial=0.0)) for t in batch.column("t").to_pylist())])
        yield pa.RecordBatch.from_arrays([pa.array([top])], names=["top"])

    return a.df.mapInArrow(run, "top double").agg(F.max("top")).first()[0] or 0.0
