"""Learning tools on observations (obs_id, label, f ARRAY<DOUBLE>): neighbours, clusters, mixtures, factorisation.

Distances between two tables are computed in the cells of a grid: a cell holds its training rows as a matrix,
its queries go by, and only the k nearest of each query leave a cell. Iterative fits keep
their parameters on the driver (their size depends on features and classes, not on rows) and read the
data once per iteration, summing per partition before anything is shuffled. Rows whose f is null or
holds a null take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.arrow import lists, matrix

TILE_ROWS = 2048
#: Training rows that a cell of the grid of tiles holds, about; queries that meet a tile at once; pairs whose differences are made at once.
HELD_ROWS, QUERY_ROWS, PAIRS = 65_536, 256, 65_536
#: Rows of a strip of one dimension.
STRIP_ROWS = 16_384
NO_CLASS = -1111111111
#: Stands for a null label in tasks.
NO_LABEL = np.iinfo(np.int32).min


def observations(df: DataFrame) -> DataFrame:
    out = df.select(F.col("obs_id").cast("long").alias("obs_id"), F.col("label").cast("int").alias("label") if "label" in df.columns else F.lit(0).alias("label"), F.col("f").cast("array<double>").alias("f"))
    return out.where(F.col("f").isNotNull() & ~F.exists("f", lambda v: v.isNull()))


def _dims(df: DataFrame) -> int:
    return df.where("f is not null").select(F.size("f")).first()[0]


# --- normalisation -------------------------------------------------------------------------------


def partial_sums(df: DataFrame, fn: Callable, size: int) -> np.ndarray:
    """Sums the vectors that fn(matrix of f, labels) gives for each batch; one vector per partition is sent on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += fn(matrix(batch.column("f")), batch.column("label").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"bucket": [0], "v": [total.tolist()]}, schema=pa.schema([("bucket", pa.int32()), ("v", pa.list_(pa.float64()))]))

    sent = observations(df).mapInArrow(run, "bucket int, v array<double>")
    summed = sent.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(size)
    for r in summed:
        out[r["i"]] = r["x"]
    return out


def normalisation(train: DataFrame, kind: str = "none") -> tuple[np.ndarray, np.ndarray]:
    """(subtract, scale) per dimension; a zero scale is left at 0 shift of scale 1."""
    if kind == "none":
        n = _dims(train)
        return np.zeros(n), np.ones(n)
    each = observations(train).select(F.posexplode("f").alias("d", "x")).groupBy("d")
    if kind == "zscore":
        rows = each.agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("b")).orderBy("d").collect()
        shift, scale = (np.array([r[c] for r in rows], dtype=float) for c in ("a", "b"))
    elif kind == "minmax":
        rows = each.agg(F.min("x").alias("a"), F.max("x").alias("b")).orderBy("d").collect()
        shift = np.array([r["a"] for r in rows], dtype=float)
        scale = np.array([r["b"] for r in rows], dtype=float) - shift
    else:
        raise ValueError("normalisation is none, zscore or minmax")
    return shift, np.where(scale > 0, scale, 1.0)


def normalised(df: DataFrame, shift: np.ndarray, scale: np.ndarray) -> DataFrame:
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return df.withColumn("f", F.zip_with(F.zip_with("f", lit(shift), lambda x, s: x - s), lit(scale), lambda x, s: x / s))


# --- nearest neighbours --------------------------------------------------------------------------


def cells_of(queries: DataFrame, train: DataFrame) -> DataFrame:
    """Every query with every training row, in cells of a square grid: rows (qi, ti, kind, obs_id, label, f), sorted for ``_met``.

    Queries are copied along a row of the grid and training rows along a column, so that a row is sent as often as the
    grid is wide: the root of the shuffle partitions, or more where a cell would hold more than HELD_ROWS training rows.
    """
    parts = max(1, int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    queries, train = (observations(df).where("obs_id is not null") for df in (queries, train))
    wide = max(int(np.ceil(np.sqrt(parts))), -(-train.count() // HELD_ROWS))
    copies = F.explode(F.sequence(F.lit(0), F.lit(wide - 1)))
    place = F.pmod(F.xxhash64("obs_id"), F.lit(wide)).cast("int")
    q = queries.select(place.alias("qi"), copies.alias("ti"), F.lit(1).alias("kind"), "obs_id", "label", "f")
    t = train.select(copies.alias("qi"), place.alias("ti"), F.lit(0).alias("kind"), "obs_id", "label", "f")
    return t.unionAll(q).repartition(wide * wide, "qi", "ti").sortWithinPartitions("qi", "ti", "kind")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """((f, ids, labels) of some queries, the same of all training rows of their cell, which are held once); null labels are NO_LABEL."""
    key, held, whole = None, [], None
    for batch in batches:
        names = np.stack([batch.column(c).to_numpy() for c in ("qi", "ti", "kind")], axis=1)
        edges = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(names)], strict=True):
            if hi == lo:
                continue
            if tuple(names[lo, :2]) != key:
                key, held, whole = tuple(names[lo, :2]), [], None
            part = batch.slice(lo, hi - lo)
            rows = matrix(part.column("f")), part.column("obs_id").to_numpy(), part.column("label").fill_null(NO_LABEL).to_numpy()
            if not names[lo, 2]:
                held.append(rows)
                continue
            if whole is None and held:
                whole, held = tuple(np.concatenate(x) for x in zip(*held, strict=True)), []
            if whole is not None:
                yield rows, whole


class Near:
    """Training rows t (ids ti) for exact searches of the k nearest.

    A product of matrices in single precision gives squared distances with a bound on their error. Only pairs that may be
    among the nearest by it get their distance by differences, so results and ties are those of comparing all pairs that way.
    """

    def __init__(self, t: np.ndarray, ti: np.ndarray):
        self.t, self.ti, self.centre = t, ti, np.zeros(t.shape[1])
        with np.errstate(all="ignore"):
            mean = t.mean(axis=0) if len(t) else self.centre
            self.centre = np.where(np.isfinite(mean), mean, 0.0)
            self.x, self.norm = self._single(t)
        self.fits = bool(np.isfinite(self.norm).all())

    def _single(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (x - self.centre).astype(np.float32)
        return x, np.einsum("ij,ij->i", x, x)

    def search(self, q: np.ndarray, qi: np.ndarray, k: int, exclude_self: bool, tau: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, training row, distance) of the k nearest within tau, by query, distance and id."""
        tau = np.full(len(q), np.inf) if tau is None else tau
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for at in range(0, len(q), QUERY_ROWS):
            some = slice(at, at + QUERY_ROWS)
            i, j, d = self._few(q[some], qi[some], k, exclude_self, tau[some])
            out.append((i + at, j, d))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _few(self, q, qi, k, exclude_self, tau):
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        with np.errstate(all="ignore"):
            x, norm = self._single(q)
        fits = self.fits and bool(np.isfinite(norm).all())
        dims = q.shape[1]
        for at in range(0, len(self.t), TILE_ROWS):
            end = min(at + TILE_ROWS, len(self.t))
            if fits:
                s = x @ self.x[at:end].T
                s *= -2
                s += self.norm[None, at:end]
                s += norm[:, None]
                # of the products, the sums, the differences from the centre and the plain distances' own rounding; and of underflow
                slack = 8 * (dims + 8) * np.finfo(np.float32).eps * (norm + self.norm[at:end].max()).astype(float) + dims * 1e-36
                with np.errstate(all="ignore"):
                    far = tau * tau
                if at == 0 and np.isinf(tau).any() and end - at > k + exclude_self:
                    # a row that is the query itself may be among these, so one more
                    most = k + int(exclude_self)
                    if not exclude_self or len(np.unique(self.ti[at:end])) == end - at:
                        far = np.minimum(far, np.partition(s, most - 1, axis=1)[:, most - 1] + slack)
                i, j = np.nonzero(s <= (far + slack)[:, None].astype(np.float64))
                own = qi[i] == self.ti[at + j] if exclude_self else np.zeros(len(i), bool)
                i, j = i[~own], j[~own]
                parts = [slice(lo, lo + PAIRS) for lo in range(0, len(i), PAIRS)]
                d = np.concatenate([np.zeros(0), *(np.sqrt(((q[i[p]] - self.t[at + j[p]]) ** 2).sum(axis=1)) for p in parts)])
            else:
                d = np.concatenate([np.sqrt(((q[lo : lo + 64, None, :] - self.t[None, at:end]) ** 2).sum(axis=2)) for lo in range(0, len(q), 64)])
                if exclude_self:
                    d[qi[:, None] == self.ti[None, at:end]] = np.inf
                i, j = np.nonzero(d <= tau[:, None])
                d = d[i, j]
            good = np.isfinite(d) & (d <= tau[i])
            i, j, d = (np.concatenate([b, n[good]]) for b, n in zip(best, (i, j + at, d), strict=True))
            order = np.lexsort((self.ti[j], d, i))
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            some = place < k
            best = i[some], j[some], d[some]
            # what comes later must not be farther than the k-th so far
            last = place == k - 1
            tau = tau.copy()
            tau[i[last]] = np.minimum(tau[i[last]], d[last])
        return best


def neighbours(train: DataFrame, queries: DataFrame, k: int = 3, exclude_self: bool = False) -> DataFrame:
    """(obs_id, rank, train_id, label, d): the k nearest training rows; equal distances in the order of train_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = of = None
        for (q, qi, _), whole in _met(batches):
            if of is not whole:
                of, index = whole, Near(*whole[:2])
            i, j, d = index.search(q, qi, k, exclude_self)
            label = whole[2][j]
            yield pa.RecordBatch.from_arrays([pa.array(qi[i]), pa.array(whole[1][j]), pa.array(label, pa.int32(), mask=label == NO_LABEL), pa.array(d)], names=["obs_id", "train_id", "label", "d"])

    near = cells_of(queries, train).mapInArrow(run, "obs_id long, train_id long, label int, d double")
    rank = F.row_number().over(Window.partitionBy("obs_id").orderBy("d", "train_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def vote(labels: list[int], distances: list[float]) -> int:
    """Majority of the nearest; ties by mean distance, then with one neighbour less, and so on."""
    slots: list[int] = list(dict.fromkeys(labels))
    score = [float(labels.count(s)) for s in slots]
    k = len(labels)
    while True:
        most = max(score)
        if score.count(most) == 1 or k == 0:
            return slots[score.index(most)]
        some = list(zip(labels[:k], distances[:k], strict=True))
        slots = list(dict.fromkeys(x for x, _ in some))
        mean = [sum(d for x, d in some if x == s) / sum(1 for x, _ in some if x == s) for s in slots]
        score = [1 - m / max(mean) if max(mean) > 0 else 1.0 for m in mean]
        k -= 1
        slots, score = slots[: max(k, 1)], score[: max(k, 1)]


def knn(train: DataFrame, queries: DataFrame, k: int = 3, normalise: str = "none", exclude_self: bool = False, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """(obs_id, predicted). ``search`` finds the neighbours: by default in tiles, or ``regions.neighbours``."""
    if normalise != "none":
        shift, scale = normalisation(train, normalise)
        train, queries = normalised(train, shift, scale), normalised(queries, shift, scale)
    near = (search or neighbours)(train, queries, k, exclude_self)
    lists = near.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "d"))).alias("n"))  # k rows each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [vote([x["label"] for x in n], [x["d"] for x in n]) for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("obs_id"), pa.array(out, pa.int32())], names=["obs_id", "predicted"])

    return lists.mapInArrow(run, "obs_id long, predicted int")


def leave_one_out(obs: DataFrame, k: int = 3, classify: Callable[[DataFrame, DataFrame], DataFrame] | None = None, folds: int | None = None) -> DataFrame:
    """(accuracy, n). k-NN leaves each row out within one join.

    Any other ``classify(train, query)`` is a fit of its own for each row left out, so one plan a row; with
    ``folds`` rows are left out in that many groups (by the hash of the id) instead, one plan a group.
    """
    if classify is None:
        found = knn(obs, obs, k, exclude_self=True)
    else:
        name = F.pmod(F.xxhash64("obs_id"), F.lit(folds)) if folds else F.col("obs_id")
        parts = [(r,) for r in range(folds)] if folds else obs.select("obs_id").toLocalIterator()
        found = None
        for r in parts:
            one = classify(obs.where(name != r[0]), obs.where(name == r[0]))
            found = one if found is None else found.unionAll(one)
    joined = obs.select(F.col("obs_id").cast("long").alias("obs_id"), "label").join(found, "obs_id", "left")
    return joined.agg(F.avg((F.coalesce("predicted", F.lit(NO_CLASS)) == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def forward_selection(obs: DataFrame, dims: int | None = None, most: int | None = None) -> list[tuple[int, float]]:
    """(feature, accuracy) in the order of selection by 1-NN leave-one-out, ``most`` of them at most; of equal accuracies the last feature wins.

    Each step scores all candidate features: a candidate adds one squared difference to the distances of those chosen so far.
    Rows lie in strips of a dimension that counts (the first one picked, else each candidate's own). A row looks for its
    nearest in its strip, then only in the strips that this distance still reaches (``_in_strips``).
    """
    dims = dims or _dims(obs)
    chosen: list[tuple[int, float]] = []
    obs = observations(obs).where("obs_id is not null")
    while len(chosen) < min(dims, most or dims):
        picked = [v for v, _ in chosen]
        rest = [v for v in range(dims) if v not in picked]
        found, held = _in_strips(obs, picked, rest)
        first = found.where(F.col("d") < float("inf")).groupBy("v", "obs_id").agg(F.min(F.struct("d", "train_id", "hit")).alias("x"))
        each = first.groupBy("v").agg(F.avg("x.hit").alias("accuracy")).collect()
        for df in held:
            df.unpersist()
        scores = {r["v"]: r["accuracy"] for r in each}
        best = max(rest, key=lambda v: (scores.get(v, 0.0), v))
        chosen.append((best, float(scores.get(best, 0.0))))
    return chosen


def _in_strips(obs: DataFrame, picked: list[int], rest: list[int]) -> tuple[DataFrame, list[DataFrame]]:
    """((v, obs_id, d, train_id, hit), what is to be unpersisted): for each row and candidate v rows that have its nearest among them.

    Borders of strips come from a few rows drawn by their ids and matter for the balance only. A strip of more than HELD_ROWS rows
    (equal values) is a square of cells, in which each of its rows meets all others. No strip's rows need a task of their own.
    """
    parts, n = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions")), obs.count()
    strips = max(1, min(parts, n // 256), -(-n // 4096)) if picked else max(1, -(-n // STRIP_ROWS))
    draw = F.pmod(F.xxhash64(F.lit(17), "obs_id"), F.lit(max(1, n // (20 * strips))))
    some = [r["f"] for r in obs.where(draw == 0).select("f").limit(100 * strips).collect()]
    some = np.array(some, dtype=float).reshape(len(some), -1)
    along = picked[:1] or rest  # a strip's dimension also names its rows' problem
    edges = {}
    for v in along:
        x = some[np.isfinite(some[:, v]), v] if len(some) else np.zeros(0)
        edges[v] = np.unique(np.quantile(x, np.arange(1, strips) / strips, method="higher")) if len(x) and strips > 1 else np.zeros(0)

    def whole_numbers(x: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.asarray(x, np.int64).ravel()))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = matrix(batch.column("f"))
            for v in along if len(f) else ():
                at = np.flatnonzero(np.isfinite(f[:, v]))  # others are near nothing
                ids, labels = (batch.column(c).take(pa.array(at)) for c in ("obs_id", "label"))
                s = np.searchsorted(edges[v], f[at, v], side="right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.int32()), pa.array(s), ids, labels, lists(f[at] if picked else f[at, v : v + 1])], names=["v", "s", "obs_id", "label", "f"])

    rows = obs.mapInArrow(deal, "v int, s int, obs_id long, label int, f array<double>").persist(StorageLevel.DISK_ONLY)
    big = {(r["v"], r["s"]): -(-r["count"] // HELD_ROWS) for r in rows.groupBy("v", "s").count().where(F.col("count") > HELD_ROWS).collect()}
    wide = F.lit(1)
    for (v, s), k in big.items():
        wide = F.when((F.col("v") == v) & (F.col("s") == s), k).otherwise(wide)
    columns = ["v", "s", "i", "j", "kind", "obs_id", "label", "f", "d"]

    def cells(queries: DataFrame) -> DataFrame:
        every, place = F.explode(F.sequence(F.lit(0), F.col("k") - 1)), F.pmod(F.xxhash64("obs_id"), F.col("k")).cast("int")
        q = queries.withColumn("k", wide.cast("int")).withColumns({"i": place, "j": every, "kind": F.lit(1)}).select(*columns)
        t = rows.withColumn("k", wide.cast("int")).withColumns({"i": every, "j": place, "kind": F.lit(0), "d": F.lit(None).cast("array<double>")}).select(*columns)
        return t.unionAll(q).repartition(parts, "v", "s", "i", "j").sortWithinPartitions("v", "s", "i", "j", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, train, whole = None, [], None
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("v", "s", "i", "j", "kind")], axis=1)
            cut = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(names)], strict=True):
                if hi == lo:
                    continue
                if tuple(names[lo, :4]) != cell:
                    cell, train, whole = tuple(names[lo, :4]), [], None
                part = batch.slice(lo, hi - lo)
                f, ids, label = matrix(part.column("f")), part.column("obs_id").to_numpy(), part.column("label").fill_null(NO_LABEL).to_numpy()
                if not names[lo, 4]:
                    train.append((f, ids, label))
                    continue
                if whole is None and train:
                    whole, train = tuple(np.concatenate(x) for x in zip(*train, strict=True)), []
                limit = None if part.column("d").null_count else matrix(part.column("d"))
                if whole is None:
                    if limit is not None:
                        continue  # nothing is in this strip
                    whole = f[:0], ids[:0], label[:0]
                t, ti, tl = whole
                d, j = nearest_of_each(f, ids, t, ti, picked, rest if picked else [0], limit=limit) if len(t) else (np.full((len(f), len(rest) if picked else 1), np.inf), None)
                hit, near = (np.zeros(d.shape), np.zeros(d.shape)) if j is None else (tl[j] == label[:, None], ti[j])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("v", "s", "obs_id", "label", "f")), lists(d), whole_numbers(near), whole_numbers(hit)], names=["v", "s", "obs_id", "label", "f", "d", "train_id", "hit"])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the other strips that may hold a nearer one, or one as near."""
        for batch in batches:
            d, f, s, name = matrix(batch.column("d")), matrix(batch.column("f")), batch.column("s").to_numpy(), batch.column("v").to_numpy()
            for v in np.unique(name).tolist():
                mine = np.flatnonzero(name == v)
                x, far, e = f[mine, v if picked else 0], d[mine].max(axis=1), edges[v]
                for k in range(len(e) + 1):
                    # rounding keeps the order of differences and squares, so what is beyond a border is not nearer than it
                    gap = np.where(s[mine] > k, x - e[min(k, len(e) - 1)], x - e[max(k, 1) - 1]) ** 2 if len(e) else np.full(len(x), np.inf)
                    at = mine[(s[mine] != k) & (gap <= far)]
                    if len(at):
                        part = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([part.column("v"), pa.array([k] * len(at), pa.int32()), *(part.column(c) for c in ("obs_id", "label", "f", "d"))], names=["v", "s", "obs_id", "label", "f", "d"])

    ddl = "v int, s int, obs_id long, label int, f array<double>, d array<double>, train_id array<long>, hit array<long>"
    near = cells(rows.withColumn("d", F.lit(None).cast("array<double>"))).mapInArrow(search, ddl).persist(StorageLevel.DISK_ONLY)
    more = cells(near.mapInArrow(reach, "v int, s int, obs_id long, label int, f array<double>, d array<double>")).mapInArrow(search, ddl)
    flat = near.unionAll(more).select("v", "obs_id", F.posexplode(F.arrays_zip("d", "train_id", "hit")).alias("c", "x"))
    named = F.element_at(F.array(*map(F.lit, rest)), F.col("c") + 1) if picked else F.col("v")
    return flat.select(named.alias("v"), "obs_id", "x.d", "x.train_id", "x.hit"), [rows, near]


def nearest_of_each(q: np.ndarray, qi: np.ndarray, t: np.ndarray, ti: np.ndarray, picked: list[int], rest: list[int], width: int = 256, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, training row) of the nearest row but itself, for each query (row) and candidate (column); inf without one.

    Training rows are sorted by a dimension that counts (the first one picked, else the candidate). A query meets a window of
    them around its own value, which grows until all outside are farther by that dimension alone than the nearest inside, or
    than ``limit`` (a squared distance for each query and candidate, beyond which nothing is asked for).
    """
    best, at = np.full((len(q), len(rest)), np.inf), np.zeros((len(q), len(rest)), np.int64)
    column = {v: n for n, v in enumerate(rest)}

    def by(v: int, some: list[int]) -> None:
        order = np.lexsort((ti, t[:, v]))
        s, ids = t[order], ti[order]
        along = s[:, v]
        asked = np.argsort(q[:, v], kind="stable")
        for lo in range(0, len(asked), 64):
            mine, size = asked[lo : lo + 64], width if picked else 8
            todo = {c: np.arange(len(mine)) for c in range(len(some))}  # the queries of each candidate that go on
            x, own = q[mine], qi[mine]
            if limit is not None:
                outside = (x[:, v] - np.clip(x[:, v], along[0], along[-1])) ** 2
                todo = {c: near for c in todo if len(near := np.flatnonzero(limit[mine, column[some[c]]] >= outside))}
            while todo:
                live = np.unique(np.concatenate(list(todo.values())))
                a, b = (int(np.searchsorted(along, x[k, v])) for k in (live[0], live[-1]))
                first, last = max(0, a - size), min(len(s), b + size)
                w = slice(first, last)
                rank = np.argsort(ids[w], kind="stable")  # of equal distances the smallest id
                t_w, id_w = s[w][rank], ids[w][rank]
                base = np.zeros((len(mine), last - first))
                for u in picked:  # one difference at a time: windows need no third axis
                    base[live] += (x[live, None, u] - t_w[None, :, u]) ** 2
                base[live] = np.where((own[live, None] == id_w[None, :]) | np.isnan(base[live]), np.inf, base[live])
                # squares of the differences of what is outside are not smaller than these
                gap = np.minimum((x[:, v] - along[first - 1]) ** 2 if first else np.inf, (x[:, v] - along[last]) ** 2 if last < len(s) else np.inf) + np.zeros(len(mine))
                still = {}
                for c, rows in todo.items():
                    d = base[rows] + (x[rows, None, some[c]] - t_w[None, :, some[c]]) ** 2
                    d[np.isnan(d)] = np.inf
                    k = d.argmin(axis=1)
                    least = d[np.arange(len(rows)), k]
                    done = (least < gap[rows]) | ((first == 0) & (last == len(s)))
                    if limit is not None:
                        done |= limit[mine[rows], column[some[c]]] < gap[rows]
                    best[mine[rows[done]], column[some[c]]] = least[done]
                    at[mine[rows[done]], column[some[c]]] = order[first + rank[k[done]]]
                    if not done.all():
                        still[c] = rows[~done]
                todo, size = still, size * 4

    if picked:
        by(picked[0], rest)
    else:
        for v in rest:
            by(v, [v])
    return best, at


# --- k-means -------------------------------------------------------------------------------------


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)


def seeds(obs: DataFrame, k: int, seed: int = 1) -> np.ndarray:
    """k observations drawn at random, as starts for a fit: those with the smallest keyed hashes of their ids."""
    rows = observations(obs).orderBy(F.xxhash64(F.lit(seed), "obs_id"), "obs_id").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} starts need at least {k} observations")
    return np.array([r["f"] for r in rows], dtype=float)


def kmeans(obs: DataFrame, centres: np.ndarray | int, max_iter: int = 300, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((obs_id, cluster), centres) by Lloyd's rounds from the given centres (or that many drawn ones), until no centre moves.

    A cluster that becomes empty restarts at the row that is farthest from its centre so far (a random
    row in the literature; this choice is repeatable).
    """
    centres = seeds(obs, centres, seed) if isinstance(centres, int) else np.array(centres, dtype=float)
    k, dims = centres.shape

    def sums(x, labels, c):
        home = _nearest(x, c)
        out = np.zeros((k, dims + 1))
        np.add.at(out, home, np.c_[x, np.ones(len(x))])
        return out.ravel()

    for _ in range(max_iter):
        got = partial_sums(obs, lambda x, y, c=centres: sums(x, y, c), k * (dims + 1)).reshape(k, dims + 1)
        now = np.where(got[:, -1:] > 0, got[:, :-1] / np.maximum(got[:, -1:], 1), centres)
        for j in np.flatnonzero(got[:, -1] == 0):
            far = F.aggregate(F.zip_with("f", F.array(*[F.lit(float(v)) for v in centres[j]]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
            now[j] = observations(obs).orderBy(F.desc(far), "obs_id").select("f").first()[0]
        if np.abs(now - centres).sum() <= 0:
            break
        centres = now
    return assign(obs, centres), centres


def assign(obs: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = _nearest(matrix(batch.column("f")), centres) if batch.num_rows else np.empty(0, int)
            yield pa.RecordBatch.from_arrays([batch.column("obs_id"), pa.array(home, pa.int32())], names=["obs_id", "cluster"])

    return observations(obs).mapInArrow(run, "obs_id long, cluster int")


# --- Gaussian mixtures ---------------------------------------------------------------------------


class Mixture:
    """prior (k), mu (k, d), sigma (k, d, d). Densities are computed as logarithms from Cholesky factors, in any number of dimensions."""

    def __init__(self, prior, mu, sigma):
        self.prior, self.mu, self.sigma = (np.array(v, dtype=float) for v in (prior, mu, sigma))
        self.factors = [self._factor(s) for s in self.sigma]

    @staticmethod
    def _factor(sigma: np.ndarray) -> np.ndarray | None:
        """The lower factor; None if a pivot is lost in rounding against the mean variance."""
        try:
            low = np.linalg.cholesky(sigma)
        except np.linalg.LinAlgError:
            return None
        return low if (np.diag(low) ** 2).min() > 1e-13 * np.trace(sigma) / len(sigma) else None

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """Logarithm of prior * density of each component; degenerate components and those without prior have -inf."""
        out = np.full((len(x), len(self.prior)), -np.inf)
        for k, low in enumerate(self.factors):
            if low is not None and self.prior[k] > 0:
                z = np.linalg.solve(low, (x - self.mu[k]).T)
                out[:, k] = np.log(self.prior[k]) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.log_densities(x), axis=1)

    def density(self, x: np.ndarray) -> np.ndarray:
        return np.exp(self.log_density(x))

    def shares(self, x: np.ndarray) -> np.ndarray:
        """How much of each row belongs to each component; nothing where all are degenerate."""
        d = self.log_densities(x)
        top = d.max(axis=1, keepdims=True)
        p = np.exp(d - np.where(np.isfinite(top), top, 0.0))
        s = p.sum(axis=1, keepdims=True)
        return p / np.where(s > 0, s, 1.0)


def _weighted_moments(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """For each column of p its sum, the weighted sum of the rows and of their products."""
    return np.concatenate([np.concatenate([[w.sum()], w @ x, ((w[:, None] * x).T @ x).ravel()]) for w in p.T])


def gmm_by_label(obs: DataFrame, starts: dict[int, np.ndarray], max_iter: int = 300, tolerance: float = 1e-20, ridge: float = 0.0) -> dict[int, Mixture]:
    """EM with full covariances for every label at once: one pass over the rows a round, until no label's means move.

    ``starts`` has the first means of each label; priors are equal and covariances those of the label's rows. ``ridge``
    is added to all variances; without it a component of fewer rows than dimensions is degenerate. What comes to the driver are sums
    of labels * components * dimensions ** 2 numbers.
    """
    labels = sorted(starts)
    place = {y: i for i, y in enumerate(labels)}
    means = [np.array(starts[y], dtype=float) for y in labels]
    dims = means[0].shape[1]
    size = 1 + dims + dims * dims
    least = np.iinfo(np.int32).min
    known = np.array(labels)

    def by_label(x, y, share) -> np.ndarray:
        """Sums for all labels, one after the other; share(label's place, rows) gives a column for each component."""
        out = []
        y = np.where(np.isnan(y.astype(float)), least, y) if y.dtype == float else y
        for i, label in enumerate(known):
            rows = x[y == label]
            out.append(_weighted_moments(rows, share(i, rows)))
        return np.concatenate(out)

    def split(sums: np.ndarray, counts: list[int], centre: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        parts, at = [], 0
        for k in counts:
            block = sums[at : at + k * size].reshape(k, size)
            at += k * size
            w = np.where(block[:, 0] < 1e-30, 1.0, block[:, 0])
            shift = block[:, 1 : 1 + dims] / w[:, None]
            sigma = block[:, 1 + dims :].reshape(k, dims, dims) / w[:, None, None] - shift[:, :, None] * shift[:, None, :]
            parts.append((block[:, 0], shift + centre, sigma))
        return parts

    total = partial_sums(obs, lambda x, y: np.append(x.sum(axis=0), len(x)), dims + 1)
    centre = total[:-1] / max(total[-1], 1)  # sums around the mean lose fewer digits
    ones = split(partial_sums(obs, lambda x, y: by_label(x - centre, y, lambda i, rows: np.ones((len(rows), 1))), len(labels) * size), [1] * len(labels), centre)
    extra = ridge * np.eye(dims)
    rows = [float(n[0]) for n, _, _ in ones]
    now = [Mixture(np.full(len(m), 1 / len(m)), m, np.repeat((sigma * n / max(n - 1, 1) + extra)[None], len(m), axis=0)) for m, n, (_, _, (sigma,)) in zip(means, rows, ones, strict=True)]
    open_ = set(range(len(labels)))
    counts = [len(m) for m in means]
    for _ in range(max_iter):
        if not open_:
            break
        share = lambda i, x, models=list(now), todo=frozenset(open_): models[i].shares(x + centre) if i in todo else np.zeros((len(x), counts[i]))
        found = split(partial_sums(obs, lambda x, y, share=share: by_label(x - centre, y, share), sum(counts) * size), counts, centre)
        for i in sorted(open_):
            weight, mu, sigma = found[i]
            new = Mixture(weight / max(rows[i], 1), mu, sigma + extra)
            if np.abs(new.mu - now[i].mu).sum() / counts[i] <= tolerance:
                open_.discard(i)
            now[i] = new
    return {y: now[place[y]] for y in labels}


def gmm(obs: DataFrame, means: np.ndarray | int, max_iter: int = 300, tolerance: float = 1e-20, seed: int = 1, ridge: float = 0.0) -> Mixture:
    """EM with full covariances from the given means (or that many drawn observations), the global covariance and equal priors; labels are not read."""
    means = seeds(obs, means, seed) if isinstance(means, int) else np.array(means, dtype=float)
    return gmm_by_label(obs.withColumn("label", F.lit(0)), {0: means}, max_iter, tolerance, ridge)[0]


def score_mixtures(obs: DataFrame, mixtures: dict[int, Mixture]) -> DataFrame:
    """(obs_id, predicted, density, log_density): the label of the mixture with the largest density, the first of equal ones."""
    labels, models = list(mixtures), list(mixtures.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = np.stack([m.log_density(matrix(batch.column("f"))) for m in models], axis=1) if batch.num_rows else np.zeros((0, len(models)))
            best = d.argmax(axis=1)
            top = d[np.arange(len(d)), best]
            yield pa.RecordBatch.from_arrays([batch.column("obs_id"), pa.array(np.array(labels)[best], pa.int32()), pa.array(np.exp(top)), pa.array(top)], names=["obs_id", "predicted", "density", "log_density"])

    return observations(obs).mapInArrow(run, "obs_id long, predicted int, density double, log_density double")


def gmm_classifier(train: DataFrame, components: int = 3, max_iter: int = 300, ridge: float = 0.0) -> dict[int, Mixture]:
    """One mixture per label, in the order of the labels, all fitted in the same passes; each starts at the rows with the smallest hashed ids."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("obs_id"), "obs_id"))
    starts: dict[int, list] = {}
    known = observations(train).where("label is not null")
    for r in known.withColumn("rank", rank).where(F.col("rank") <= components).orderBy("label", "rank").collect():
        starts.setdefault(r["label"], []).append(r["f"])
    return gmm_by_label(known, {y: np.array(m) for y, m in starts.items()}, max_iter, ridge=ridge) if starts else {}


# --- covariance and principal components ----------------------------------------------------------


def moments(obs: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, sample covariance) in two passes."""
    dims = _dims(obs)
    s = partial_sums(obs, lambda x, y: np.append(x.sum(axis=0), len(x)), dims + 1)
    n, mean = int(s[-1]), s[:-1] / s[-1]
    c = partial_sums(obs, lambda x, y: ((x - mean).T @ (x - mean)).ravel(), dims * dims).reshape(dims, dims)
    return n, mean, c / max(n - 1, 1)


def covariance(obs: DataFrame) -> DataFrame:
    """(i, j, cov): sample covariance of all pairs of dimensions."""
    _, _, cov = moments(obs)
    rows = [(i, j, float(v)) for i, r in enumerate(cov) for j, v in enumerate(r)]
    return obs.sparkSession.createDataFrame(rows, "i int, j int, cov double")


#: Triangular factors that one task makes into one.
FACTORS = 16


def triangle(obs: DataFrame, centre: np.ndarray | None = None) -> np.ndarray:
    """R of the QR factorisation of all rows (less ``centre``), by a tree: each partition folds its rows into a triangle, then tasks fold triangles, down to FACTORS of them."""
    dims = _dims(obs)

    def fold(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            r = np.linalg.qr(np.concatenate([r, rows(batch)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.ravel().tolist()]})

    first = lambda batches: fold(batches, lambda b: matrix(b.column("f")) - (0 if centre is None else centre) if b.num_rows else np.zeros((0, dims)))
    again = lambda batches: fold(batches, lambda b: np.concatenate([np.array(v, dtype=float).reshape(-1, dims) for v in b.column("r").to_pylist()] or [np.zeros((0, dims))]))
    found = observations(obs).mapInArrow(first, "r array<double>")
    parts = int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = -(-parts // FACTORS)
        found = found.repartition(max(parts, FACTORS)).mapInArrow(again, "r array<double>")
        if parts <= FACTORS:
            break
    stacked = [np.array(x["r"], dtype=float).reshape(-1, dims) for x in found.collect()]  # at most FACTORS triangles
    return np.linalg.qr(np.concatenate([np.zeros((0, dims)), *stacked]), mode="r")


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column's largest entry is made positive, so that results are repeatable."""
    return vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _projected(obs: DataFrame, vectors: np.ndarray, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = matrix(batch.column("f")) @ vectors if batch.num_rows else np.zeros((0, vectors.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column("obs_id"), pa.array(list(out), pa.list_(pa.float64()))], names=["obs_id", name])

    return observations(obs).mapInArrow(run, f"obs_id long, {name} array<double>")


def pca(obs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((obs_id, components), eigenvalues descending, vectors): projections of the data as they are, not centred.

    The eigenvalues of the covariance are squared singular values of the centred rows, so that small ones keep their digits.
    """
    dims = _dims(obs)
    s = partial_sums(obs, lambda x, y: np.append(x.sum(axis=0), len(x)), dims + 1)
    r = triangle(obs, s[:-1] / max(s[-1], 1))
    _, w, vt = np.linalg.svd(np.concatenate([r, np.zeros((max(0, dims - len(r)), dims))]))
    vectors = _signed(vt.T)
    return _projected(obs, vectors, "components"), w**2 / max(s[-1] - 1, 1), vectors


def svd(obs: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((obs_id, u), W descending, V) of a table with at least as many rows as dimensions: the left vectors stay rows.

    Only a triangle of dimensions ** 2 numbers comes to the driver. The u of a singular value that is 0 against the largest are 0.
    """
    r = triangle(obs)
    if r.shape[0] < r.shape[1]:
        raise ValueError("the matrix needs at least as many rows as columns")
    _, w, vt = np.linalg.svd(r)
    v = _signed(vt.T)
    kept = w > w[0] * len(w) * np.finfo(float).eps
    return _projected(obs, np.where(kept, v / np.where(kept, w, 1.0), 0.0), "u"), w, v


# --- non-negative matrix factorisation -------------------------------------------------------------


def nmf_matrix(x: np.ndarray, w: np.ndarray, h: np.ndarray, max_iter: int = 300, sparsity: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(W, H, estimate, cost): multiplicative KL updates of x (bins, observations); columns of W sum to one."""
    # fixed values: the floor, the offset of the logarithm, the relative change that ends the fit
    tiny, offset, enough = 1e-30, 1e-24, 0.001
    w, h = w / np.abs(w).sum(axis=0), h.copy()
    first = last = 0.0
    for it in range(max_iter):
        ratio = x / (w @ h + tiny)
        h *= (w.T @ ratio) / (w.sum(axis=0)[:, None] + sparsity + tiny)
        h[h < tiny] = 0
        w = w * (ratio @ h.T) / (h.sum(axis=1)[None, :] + tiny)
        w /= np.maximum(np.abs(w).sum(axis=0), tiny)
        w[w < tiny] = 0
        clean = w @ h + tiny
        est = clean + sparsity * np.abs(clean).sum(axis=0).max()
        cost = float((x * (np.log((x + offset) / (est + offset)) - 1) + est).sum())
        if it == 0:
            first = cost
        elif abs((cost - last) / (first - cost + tiny)) < enough:
            break
        last = cost
    return w, h, w @ h, cost


def nmf(matrices: DataFrame, rank: int, max_iter: int = 300, sparsity: float = 0.0, seed: int = 1, start: Callable[[int, int], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """(signal_id, part, i, v): W (one row per component), H and estimate rows of each signal's matrix of blocks.

    ``matrices`` has (signal_id, block_idx, mag). One matrix is factorised in one task. ``start(bins, blocks)``
    gives the first W and H; without it they are drawn.
    """
    kind = dict(matrices.dtypes)["signal_id"]

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("block_idx")
        x = np.array(table.column("mag").to_pylist(), dtype=float).T
        rng = np.random.Generator(np.random.PCG64(seed))
        first = start(*x.shape) if start else (rng.random((x.shape[0], rank)), rng.random((rank, x.shape[1])))
        w, h, est, _ = nmf_matrix(x, *first, max_iter, sparsity)
        rows = [("W", i, c) for i, c in enumerate(w.T)] + [("H", i, c) for i, c in enumerate(h)] + [("X", i, c) for i, c in enumerate(est.T)]
        key = table.column("signal_id")[0].as_py()
        return pa.table({"signal_id": pa.array([key] * len(rows), table.schema.field("signal_id").type), "part": [p for p, _, _ in rows], "i": pa.array([i for _, i, _ in rows], pa.int64()), "v": pa.array([c for _, _, c in rows], pa.list_(pa.float64()))})

    return matrices.select("signal_id", "block_idx", "mag").groupBy("signal_id").applyInArrow(fit, f"signal_id {kind}, part string, i long, v array<double>")


# --- alignment -----------------------------------------------------------------------------------


def dtw(pairs: DataFrame, a: str, b: str, keep: list[str]) -> DataFrame:
    """``cost`` and ``path`` (array of (row, col)) of the cheapest warping of two value arrays under |a_i - b_j|."""
    types = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cost, path = [], []
            for x, y in zip(batch.column(a), batch.column(b), strict=True):
                p, c = K.dtw(np.abs(np.array(x.as_py(), dtype=float)[:, None] - np.array(y.as_py(), dtype=float)[None, :]))
                cost.append(c)
                path.append([{"row": int(i), "col": int(j)} for i, j in p])
            kind = pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(cost, pa.float64()), pa.array(path, kind)], names=[*keep, "cost", "path"])

    ddl = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["cost double", "path array<struct<row: int, col: int>>"])
    return pairs.select(*dict.fromkeys([*keep, a, b])).mapInArrow(run, ddl)
