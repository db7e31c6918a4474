"""Exact nearest neighbours by regions: what is provably too far is never compared.

Training rows belong to the nearest of some drawn pivots (regions) and, within a region, to one of a few rings
of equal counts by their distance to the pivot: the cells. A cell's count and smallest and largest distance
to its pivot are all that the driver holds (most_pivots * rings cells at most, whatever the rows). Cells meet queries
in blocks of up to BLOCK_ROWS training rows; a cell of more than CELL_ROWS rows is dealt over slices by the hash of the
id, so no task holds more than a block or a slice, and the queries of a block are dealt over groups of QUERY_ROWS, so a
block that a third of all queries need is many tasks.

1. Each query meets one slice of the nearest cell that has rows enough. The k-th distance there bounds its radius.
2. It meets all slices of the cells that no bound puts beyond that radius: the ring's distances to its pivot
   (triangle inequality) and the border between two pivots' regions. It is sent once to a block, with a bit for each of
   the block's cells, so it is sent as often as there are blocks at most, not cells. Only the k nearest within the
   radius leave a task.

Distances are those of ``learn.neighbours``, so results and ties are the same. Bounds have a slack of 1e-9 of the
distances that they come from, more than rounding. A query that finds fewer than k rows at first (few training
rows, or ids that repeat and are excluded) meets every cell. Rows without an id, or whose f is null or has a null or
non-finite component, take no part; of rows that share an id each counts. An empty side gives no rows. Where
distances hardly differ (many independent dimensions) nothing can be skipped: n rows are then sent some 2 n / BLOCK_ROWS
times each, and all pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import matrix
from .learn import Near, observations
from .warping import kept

#: Training rows of a slice and of a block, and queries that meet it in one group.
CELL_ROWS, BLOCK_ROWS, QUERY_ROWS = 16_384, 65_536, 65_536
#: Queries that are searched for together, and the share of a block's pairs from which all of its rows are.
MET_ROWS, DENSE = 4096, 0.5
#: Rows that a ring has at least, but where a region has fewer.
RING_ROWS = 64
SLACK = 1e-9
_MET = pa.schema([("block", pa.int32()), ("slice", pa.int32()), ("obs_id", pa.int64()), ("f", pa.list_(pa.float64())), ("tau", pa.float64()), ("need", pa.binary())])


def _usable(df: DataFrame) -> DataFrame:
    good = F.exists("f", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    return observations(df).where(F.col("obs_id").isNotNull() & ~good)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


@dataclass
class Cells:
    """Pivots (None: no training rows), ring borders, the cells' region, bounds and counts, and the first cell of each block and the end."""

    pivots: np.ndarray | None
    borders: np.ndarray
    region: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray
    slices: np.ndarray
    number: dict[tuple[int, int], int] = field(default_factory=dict)
    start: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))

    def pack(self, rows: int) -> None:
        """Cells that follow each other share blocks of up to so many rows; one of several slices is alone."""
        start, held = [0], 0
        for i, n in enumerate(self.n):
            if i and (held + n > rows or self.slices[i] > 1 or self.slices[i - 1] > 1):
                start.append(i)
                held = 0
            held += n
        self.start = np.array([*start, len(self.n)], dtype=np.int64)

    def block(self, cell: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, cell, side="right") - 1

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, ring, distance to its pivot) of each row."""
        d = distances(x, self.pivots)
        region = d.argmin(axis=1)
        own = d[np.arange(len(x)), region]
        return region, (own[:, None] > self.borders[region]).sum(axis=1), own

    def beyond(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(what each row is away from each cell at least, the slack of that)."""
        d = distances(x, self.pivots)
        to = d[:, self.region]
        low = np.maximum(np.maximum(to - self.hi, self.lo - to), (to - d.min(axis=1)[:, None]) / 2)
        return low, SLACK * (to + self.hi)

    def needed(self, x: np.ndarray, tau: np.ndarray) -> np.ndarray:
        """Whether a cell may hold rows within tau of a row: rows by cells."""
        low, slack = self.beyond(x)
        return ~(low > tau[:, None] + slack)


def stride(n: int, rings: int) -> int:
    """How many rings of a region of n rows are one, so that rings have RING_ROWS rows or are all one."""
    out = 1
    while out < rings and n * out < RING_ROWS * rings:
        out *= 2
    return out


def fit_cells(train: DataFrame, most_pivots: int = 256, rings: int = 16, seed: int = 1, cell_rows: int = CELL_ROWS) -> Cells:
    """Two passes: distances to the pivots for the borders of rings (sketches of quantiles), then the cells' bounds."""
    rows = _usable(train)
    count = rows.count()
    size = min(most_pivots, int(np.ceil(np.sqrt(count) / 2)))
    drawn = [r["f"] for r in rows.orderBy(F.xxhash64(F.lit(seed), "obs_id"), "obs_id").limit(size).collect()] if count else []
    if not drawn:
        return Cells(None, *(np.zeros(0) for _ in range(6)))
    pivots = np.unique(np.array(drawn, dtype=float), axis=0)
    cells = Cells(pivots, np.full((len(pivots), rings - 1), np.inf), *(np.zeros(0) for _ in range(5)))

    def placed(c: Cells) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    region, ring, d = c.place(matrix(batch.column("f").slice(at, 64)))
                    yield pa.RecordBatch.from_pydict({"region": pa.array(region, pa.int32()), "ring": pa.array(ring, pa.int32()), "d": d})

        return rows.select("f").mapInArrow(run, "region int, ring int, d double")

    cuts = [(i + 1) / rings for i in range(rings - 1)]
    if cuts:
        for r in placed(cells).groupBy("region").agg(F.percentile_approx("d", cuts, 1000).alias("b"), F.count(F.lit(1)).alias("n")).collect():
            some = r["b"][stride(r["n"], rings) - 1 :: stride(r["n"], rings)]
            cells.borders[r["region"], : len(some)] = some
    found = placed(cells).groupBy("region", "ring").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("region", "ring").collect()
    cells.region, cells.n = (np.array([r[c] for r in found], dtype=np.int64) for c in ("region", "n"))
    cells.lo, cells.hi = (np.array([r[c] for r in found], dtype=float) for c in ("lo", "hi"))
    cells.slices = -(-cells.n // cell_rows)
    cells.number = {(r["region"], r["ring"]): i for i, r in enumerate(found)}
    cells.pack(min(BLOCK_ROWS, -(-count // _wide(train))))
    return cells


def _wide(df: DataFrame) -> int:
    """Blocks, and groups of queries of each, that small tables are dealt to at least: together a few tasks a core."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return int(np.ceil(np.sqrt(min(parts, 4 * spark.sparkContext.defaultParallelism))))


def _bits(need: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(need, axis=1)]


def _dealt(train: DataFrame, asked: DataFrame, cells: Cells, wide: int = 1) -> DataFrame:
    """Slices of blocks with the queries (block, slice, obs_id, f, tau, need) that ask for them, sorted for ``_meetings``; a training row's tau is its cell's place in the block."""
    spark = train.sparkSession
    asked_of = {r["block"]: r["c"] for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row a block
    groups = []
    for b, c in sorted(asked_of.items()):
        slices = int(cells.slices[cells.start[b]])
        groups.append((b, slices, max(-(-c // (QUERY_ROWS * slices)), min(wide, -(-c // (MET_ROWS * slices))))))
    table = F.broadcast(spark.createDataFrame(groups, "block int, slices int, dealt int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                region, ring, _ = cells.place(matrix(part.column("f")))
                cell = np.array([cells.number[x] for x in zip(region.tolist(), ring.tolist(), strict=True)])
                block = cells.block(cell)
                place = (cell - cells.start[block]).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *(part.column(c) for c in ("obs_id", "label", "f")), pa.array(place)], names=["block", "obs_id", "label", "f", "tau"])

    own = _usable(train).mapInArrow(run, "block int, obs_id long, label int, f array<double>, tau double").join(table, "block")
    own = own.select("block", F.pmod(F.xxhash64("obs_id"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.col("dealt") - 1)).alias("j"), F.lit(0).alias("kind"), "obs_id", "label", "f", "tau", F.lit(None).cast("binary").alias("need"))
    some = asked.join(table, "block").select("block", "slice", F.pmod(F.xxhash64("obs_id", F.lit(7)), "dealt").cast("int").alias("j"), F.lit(1).alias("kind"), "obs_id", F.lit(0).alias("label"), "f", "tau", "need")
    return own.unionAll(some).repartition("block", "slice", "j").sortWithinPartitions("block", "slice", "j", "kind", "tau")


class Block(Near):
    """A block's (or a slice's) training rows in the order of their cells; cell has each row's place."""

    def __init__(self, t: np.ndarray, ti: np.ndarray, cell: np.ndarray):
        super().__init__(t, ti)
        self.cell, self.edge = cell, np.searchsorted(cell, np.arange(cell[-1] + 2))
        self.near: dict[int, Near] = {}

    def asked(self, part: pa.RecordBatch, k: int, exclude_self: bool, dense: float = DENSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``search`` in the cells that each query's bits name: cell by cell, or in all rows at once where most pairs are asked for."""
        q, qi, tau = matrix(part.column("f")), part.column("obs_id").to_numpy(), part.column("tau").to_numpy(zero_copy_only=False)
        tau = np.where(np.isnan(tau), np.inf, tau)
        bits = np.stack([np.frombuffer(x, np.uint8) for x in part.column("need").to_pylist()])
        need = np.unpackbits(bits, axis=1, count=len(self.edge) - 1).astype(bool)
        if (need @ np.diff(self.edge)).sum() > dense * len(q) * len(self.t):
            i, j, d = self.search(q, qi, k, exclude_self, tau)
            own = need[i, self.cell[j]]  # what a query has met before is not found again
            return i[own], j[own], d[own]
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for c in np.flatnonzero(need.any(axis=0)).tolist():
            rows, lo, hi = np.flatnonzero(need[:, c]), *self.edge[c : c + 2]
            if c not in self.near:
                self.near[c] = Near(self.t[lo:hi], self.ti[lo:hi])
            i, j, d = self.near[c].search(q[rows], qi[rows], k, exclude_self, tau[rows])
            found.append((rows[i], j + lo, d))
        i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((self.ti[j], d, i))
        i, j, d = i[order], j[order], d[order]
        some = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[some], j[some], d[some]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch, tuple]]:
    """((block, slice, j), queries, (training rows for searches, ids, labels)): some queries at a time with their slice, which is held once."""
    key, held, whole = None, [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in range(4)], axis=1)  # block, slice, j, kind
        edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(names)], strict=True):
            if hi == lo:
                continue
            if tuple(names[lo, :3]) != key:
                key, held, whole = tuple(names[lo, :3]), [], None
            part = batch.slice(lo, hi - lo)
            if not names[lo, 3]:
                place = part.column("tau").cast(pa.float64()).fill_null(0).to_numpy().astype(np.int64)
                held.append((matrix(part.column("f")), part.column("obs_id").to_numpy(), part.column("label").to_numpy(zero_copy_only=False), place))
                continue
            if whole is None and held:
                t, ti, tl, place = (np.concatenate(x) for x in zip(*held, strict=True))
                whole, held = (Block(t, ti, place), ti, tl), []
            for at in range(0, part.num_rows, MET_ROWS):
                yield key, part.slice(at, MET_ROWS), whole


class Regions:
    """An index of ``train`` (obs_id, label, f): see the module."""

    def __init__(self, train: DataFrame, most_pivots: int = 256, rings: int = 16, seed: int = 1, cell_rows: int = CELL_ROWS):
        self.train, self.cells = train, fit_cells(train, most_pivots, rings, seed, cell_rows)

    def _first(self, queries: DataFrame, k: int, exclude_self: bool) -> DataFrame:
        """(obs_id, f, cell, slice, tau, near): the k nearest of each query in one slice, and the radius from them."""
        cells = self.cells
        enough = np.flatnonzero(cells.n >= min(4 * (k + 1) * cells.slices.max(), cells.n.max()))

        def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    cell = enough[cells.beyond(matrix(part.column("f")))[0][:, enough].argmin(axis=1)]
                    block = cells.block(cell)
                    need = [_bits(np.arange(cells.start[b], cells.start[b + 1])[None] == c)[0] for b, c in zip(block, cell, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(cells.slices[cell], pa.int32()), part.column("obs_id"), part.column("f"), pa.array(need, pa.binary())], names=["block", "slices", "obs_id", "f", "need"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, part, whole in _meetings(batches):
                n = part.num_rows
                cell = [int(cells.start[key[0]] + np.unpackbits(np.frombuffer(x, np.uint8)).argmax()) for x in part.column("need").to_pylist()]
                near: list[list[dict]] = [[] for _ in range(n)]
                if whole is not None:
                    index, ti, tl = whole
                    for i, j, d in zip(*index.asked(part, k, exclude_self, 1.0), strict=True):
                        near[i].append({"train_id": int(ti[j]), "label": None if tl[j] != tl[j] else int(tl[j]), "d": float(d)})
                tau = [x[-1]["d"] if len(x) == k else np.inf for x in near]
                yield pa.RecordBatch.from_arrays([part.column("obs_id"), part.column("f"), pa.array(cell, pa.int32()), pa.array([key[1]] * n, pa.int32()), pa.array(tau, pa.float64()), pa.array(near, pa.list_(pa.struct([("train_id", pa.int64()), ("label", pa.int32()), ("d", pa.float64())])))], names=["obs_id", "f", "cell", "slice", "tau", "near"])

        asked = _usable(queries).mapInArrow(home, "block int, slices int, obs_id long, f array<double>, need binary")
        asked = asked.select("block", F.pmod(F.xxhash64("obs_id", F.lit(3)), "slices").cast("int").alias("slice"), "obs_id", "f", F.lit(None).cast("double").alias("tau"), "need")
        return kept(_dealt(self.train, asked, cells).mapInArrow(run, "obs_id long, f array<double>, cell int, slice int, tau double, near array<struct<train_id: long, label: int, d: double>>"))

    def _further(self, first: DataFrame) -> DataFrame:
        """(block, slice, obs_id, f, tau, need): every slice of a block with cells within the radius that a query has not met."""
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    x, tau = matrix(part.column("f")), part.column("tau").to_numpy()
                    cell, met = part.column("cell").to_numpy(), part.column("slice").to_numpy()
                    need = cells.needed(x, tau)
                    need[np.arange(len(x)), cell] &= cells.slices[cell] > 1
                    home = cells.block(cell)
                    out: list[tuple] = []
                    for b, (lo, hi) in enumerate(zip(cells.start[:-1], cells.start[1:], strict=True)):
                        i = np.flatnonzero(need[:, lo:hi].any(axis=1))
                        bits = _bits(need[i, lo:hi])
                        times = int(cells.slices[lo])
                        for s in range(times):
                            out += [(b, s, q, y) for q, y in zip(i.tolist(), bits, strict=True) if times == 1 or home[q] != b or met[q] != s]
                    for lo in range(0, len(out), 4096):
                        block, s, i, bits = zip(*out[lo : lo + 4096], strict=True)
                        i = np.array(i)
                        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(s, pa.int32()), part.column("obs_id").take(pa.array(i)), _lists(x[i]), pa.array(tau[i]), pa.array(bits, pa.binary())], schema=_MET)

        return first.select("obs_id", "f", "cell", "slice", "tau").mapInArrow(run, "block int, slice int, obs_id long, f array<double>, tau double, need binary")

    def neighbours(self, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
        """(obs_id, rank, train_id, label, d): as ``learn.neighbours``."""
        ddl = "obs_id long, train_id long, label int, d double"
        if self.cells.pivots is None:
            return queries.sparkSession.createDataFrame([], ddl).withColumn("rank", F.lit(0))
        first = self._first(queries, k, exclude_self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, part, whole in _meetings(batches):
                if whole is not None:
                    index, ti, tl = whole
                    qi = part.column("obs_id").to_numpy()
                    i, j, d = index.asked(part, k, exclude_self)
                    yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(ti[j]), pa.array(tl[j], pa.int32(), from_pandas=True), pa.array(d)], names=["obs_id", "train_id", "label", "d"])

        near = first.select("obs_id", F.explode("near").alias("x")).select("obs_id", "x.*").unionAll(_dealt(self.train, self._further(first), self.cells, _wide(queries)).mapInArrow(run, ddl))
        rank = F.row_number().over(Window.partitionBy("obs_id").orderBy("d", "train_id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= k)

    def compared(self, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
        """(obs_id, compared): how many training rows no bound excludes for each query; blocks that are searched as a whole compare up to 1 / DENSE of them."""
        cells = self.cells

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    need = cells.needed(matrix(part.column("f")), part.column("tau").to_numpy())
                    yield pa.RecordBatch.from_arrays([part.column("obs_id"), pa.array((need @ cells.n).astype(float))], names=["obs_id", "compared"])

        return self._first(queries, k, exclude_self).select("obs_id", "f", "tau").mapInArrow(run, "obs_id long, compared double")


def neighbours(train: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """``learn.neighbours`` by regions."""
    return Regions(train).neighbours(queries, k, exclude_self)
