"""Recurrences over long signals in chunks: one pass for what each chunk does to a state, a scan, one pass for the samples.

Signals are rows (signal_id, sample_rate, chunk_idx, samples). A linear filter turns its memory s into s R^n + load
over a chunk of n samples, where R is the filter's own step and the load what the chunk gives from rest. These maps compose, so
the memory before every chunk follows from a prefix scan over the chunks' lengths and loads: in groups of GROUP
chunks, then over the groups, as many levels as the longest signal needs. Then every chunk is filtered in a task
of its own. Zero phase is the same scan over the signal with its reflected ends, then over the result from its
end. Decoding works alike, with max-plus matrices instead of filters (``viterbi_chunks``).

Chunks of a signal follow each other without gaps; their lengths may differ. Chunks that are null are left out.
A null sample makes what comes after it NaN. A signal without samples has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.arrow import lists, matrix

#: Chunks that are scanned in one step.
GROUP = 512
#: Samples that are filtered at once.
AT_ONCE = 1 << 21


class Filter:
    """A rational filter: ``run(rows, states)`` gives (rows, states)."""

    def __init__(self, b, a) -> None:
        self.b, self.a = tuple(map(float, b)), tuple(map(float, a))
        self.order = max(len(b), len(a)) - 1

    def run(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return K.iir(self.b, self.a, x, s, with_state=True)

    def settled(self) -> np.ndarray:
        return K.steady_state(self.b, self.a)


class Gammatone:
    """Four second-order sections, one after the other."""

    order = 8

    def __init__(self, centre: float, rate: float) -> None:
        self.centre, self.rate = centre, rate

    def run(self, x: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out, after = K.gammatone(x, self.centre, self.rate, [s[:, 2 * k : 2 * k + 2] for k in range(4)], with_state=True)
        return out, np.concatenate(after, axis=1)


def step(system) -> np.ndarray:
    """R: a memory s becomes s R by one sample of silence."""
    return system.run(np.zeros((system.order, 1)), np.eye(system.order))[1]


Bank = Callable[[float], list]


def _numbers(column, i: int) -> np.ndarray:
    return np.asarray(column[i].values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)


def _alike(batch: pa.RecordBatch, backwards: bool) -> Iterator[tuple[np.ndarray, np.ndarray, float | None]]:
    """(places in the batch, samples as rows, rate) of chunks of equal length and rate, so that a filter runs over many of them at once."""
    samples, rates = batch.column("samples"), batch.column("sample_rate").to_pylist()
    same: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(pc.list_value_length(samples).to_pylist(), rates, strict=True)):
        same.setdefault(key, []).append(i)
    for (n, rate), places in same.items():
        most = max(1, AT_ONCE // max(1, n))
        for at in range(0, len(places), most):
            some = np.array(places[at : at + most])
            yield some, matrix(samples.take(pa.array(some)))[:, :: -1 if backwards else 1], rate


def _loads(chunks: DataFrame, bank: Bank, backwards: bool) -> DataFrame:
    """(signal_id, band, at, sample_rate, n, x0, load): what each chunk leaves in a memory that was empty; ``at`` orders the chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("chunk_idx").to_numpy() * (-1 if backwards else 1)
            for some, x, rate in _alike(batch, backwards):
                key, fs = (batch.column(c).take(pa.array(some)) for c in ("signal_id", "sample_rate"))
                for band, f in enumerate(bank(rate)):
                    load = f.run(x, np.zeros((len(x), f.order)))[1]
                    yield pa.RecordBatch.from_arrays([key, pa.array([band] * len(x), pa.int32()), pa.array(at[some], pa.int64()), fs, pa.array([x.shape[1]] * len(x), pa.int64()), pa.array(x[:, 0].copy()), lists(load)], names=["signal_id", "band", "at", "sample_rate", "n", "x0", "load"])

    kind = dict(chunks.dtypes)["signal_id"]
    return chunks.mapInArrow(run, f"signal_id {kind}, band int, at long, sample_rate double, n long, x0 double, load array<double>")


def _walked(table: pa.Table, bank: Bank, total: bool, first: Callable | None) -> pa.Table:
    """Over the sorted rows of one signal's group: the memory before each row, or (``total``) the map of all of them."""
    table = table.sort_by("at")
    n, rate, band = table.column("n").to_pylist(), table.column("sample_rate")[0].as_py(), table.column("band")[0].as_py()
    system = bank(rate)[band]
    loads = np.array(table.column("load").to_pylist(), dtype=float).reshape(len(n), system.order)
    powers: dict[int, np.ndarray] = {}
    r = step(system)
    given = table.column("start")[0].as_py() if "start" in table.column_names else None
    s = np.zeros(system.order) if total else np.array(given, dtype=float) if given is not None else first(system, table.column("x0")[0].as_py()) if first else np.zeros(system.order)
    before = []
    for k, load in zip(n, loads, strict=True):
        before.append(s.tolist())
        if k not in powers:
            powers[k] = np.linalg.matrix_power(r, k)
        s = s @ powers[k] + load
    if not total:
        return pa.table([table.column("signal_id"), table.column("band"), table.column("at"), pa.array(before, pa.list_(pa.float64()))], names=["signal_id", "band", "at", "start"])
    one = table.slice(0, 1)
    return pa.table([one.column("signal_id"), one.column("band"), one.column("g"), one.column("sample_rate"), pa.array([sum(n)]), one.column("x0"), pa.array([s.tolist()], pa.list_(pa.float64()))], names=["signal_id", "band", "at", "sample_rate", "n", "x0", "load"])


def _starts(loads: DataFrame, bank: Bank, first: Callable | None, low: int, high: int, group: int) -> DataFrame:
    """(signal_id, band, at, start): the memory before each chunk."""
    kind = dict(loads.dtypes)["signal_id"]
    ddl = f"signal_id {kind}, band int, at long, start array<double>"
    if high - low < group:
        return loads.groupBy("signal_id", "band").applyInArrow(lambda t: _walked(t, bank, False, first), ddl)
    grouped = loads.withColumn("g", F.floor((F.col("at") - low) / group).cast("long"))
    totals = grouped.groupBy("signal_id", "band", "g").applyInArrow(lambda t: _walked(t, bank, True, None), f"signal_id {kind}, band int, at long, sample_rate double, n long, x0 double, load array<double>")
    above = _starts(totals, bank, first, 0, (high - low) // group, group).withColumnRenamed("at", "g")
    return grouped.join(above, ["signal_id", "band", "g"]).groupBy("signal_id", "band", "g").applyInArrow(lambda t: _walked(t, bank, False, None), ddl)


def _scan(chunks: DataFrame, bank: Bank, first: Callable | None = None, backwards: bool = False, group: int = GROUP) -> DataFrame:
    """(signal_id, sample_rate, chunk_idx, band, samples): each chunk through each filter of bank(rate), with the memory that the chunks before it leave."""
    edge = chunks.agg(F.min("chunk_idx"), F.max("chunk_idx")).first()
    low, high = (edge[0] or 0, edge[1] or 0)
    low, high = (-high, -low) if backwards else (low, high)
    starts = _starts(_loads(chunks, bank, backwards), bank, first, low, high, group)
    memory = starts.groupBy("signal_id", "at").agg(F.map_from_entries(F.collect_list(F.struct("band", "start"))).alias("memory"))
    memory = memory.select("signal_id", (-F.col("at") if backwards else F.col("at")).alias("chunk_idx"), "memory")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x, rate in _alike(batch, backwards):
                held = [dict(v) for v in batch.column("memory").take(pa.array(some)).to_pylist()]
                keys = [batch.column(c).take(pa.array(some)) for c in ("signal_id", "sample_rate", "chunk_idx")]
                for band, f in enumerate(bank(rate)):
                    out = f.run(x, np.array([m[band] for m in held], dtype=float).reshape(len(x), f.order))[0][:, :: -1 if backwards else 1]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([band] * len(x), pa.int32()), lists(out)], names=["signal_id", "sample_rate", "chunk_idx", "band", "samples"])

    kind = dict(chunks.dtypes)["signal_id"]
    return chunks.join(memory, ["signal_id", "chunk_idx"]).select("signal_id", "sample_rate", "chunk_idx", "samples", "memory").mapInArrow(run, f"signal_id {kind}, sample_rate double, chunk_idx long, band int, samples array<double>")


def _clean(chunks: DataFrame) -> DataFrame:
    out = chunks.select("signal_id", F.col("sample_rate").cast("double").alias("sample_rate"), F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("samples").cast("array<double>").alias("samples"))
    return out.where(F.size("samples") > 0)


def filter_chunks(chunks: DataFrame, coefficients, zero_phase: bool = False, order: int | None = None, group: int = GROUP) -> DataFrame:
    """Signals in chunks through (b, a), or through coefficients(sample rate), which need their common ``order`` for zero phase."""
    of = coefficients if callable(coefficients) else lambda rate: coefficients
    bank = lambda rate: [Filter(*of(rate))]
    chunks = _clean(chunks)
    if not zero_phase:
        return _scan(chunks, bank, group=group).drop("band")
    if order is None:
        order = max(map(len, coefficients)) - 1
    pad = 3 * order  # both ends are reflected
    edge = _edges(chunks, pad + 1)
    mirrored = lambda c: F.transform(F.slice(c, 2, pad), lambda v: 2 * F.get(c, F.lit(0)) - v)
    front = edge.select("signal_id", "sample_rate", (F.col("low") - 1).alias("chunk_idx"), F.reverse(mirrored("head")).alias("samples"), "length")
    back = edge.withColumn("tail", F.reverse("tail")).select("signal_id", "sample_rate", (F.col("high") + 1).alias("chunk_idx"), mirrored("tail").alias("samples"), "length")
    short = F.raise_error(F.lit(f"zero-phase filtering needs more than {pad} samples")).cast("array<double>")
    ends = front.unionByName(back).withColumn("samples", F.when(F.col("length") <= pad, short).otherwise(F.col("samples")))
    whole = chunks.unionByName(ends.select(*chunks.columns)).where(F.size("samples") > 0)
    settle = lambda f, x0: f.settled() * x0 if f.order else np.zeros(0)
    forth = _scan(whole, bank, settle, group=group).drop("band")
    limits = edge.select("signal_id", "low", "high")
    forth = forth.join(limits, "signal_id").where("chunk_idx >= low").drop("low", "high")
    return _scan(forth, bank, settle, backwards=True, group=group).drop("band").join(limits, "signal_id").where("chunk_idx <= high").drop("low", "high")


def _edges(chunks: DataFrame, size: int) -> DataFrame:
    """(signal_id, sample_rate, low, high, length, head, tail): the first and last ``size`` samples of each signal, from as many chunks as hold them."""
    counts = chunks.groupBy("signal_id").agg(F.min("chunk_idx").alias("low"), F.max("chunk_idx").alias("high"), F.sum(F.size("samples")).alias("length"), F.max("sample_rate").alias("sample_rate"))
    # each chunk has a sample, so ``size`` chunks from an end are enough
    near = chunks.drop("sample_rate").join(counts, "signal_id").where(f"chunk_idx < low + {size} or chunk_idx > high - {size}")
    pieces = lambda c, at: F.flatten(F.transform(F.array_sort(F.collect_list(F.when(at, F.struct("chunk_idx", c)))), lambda s: s[c]))
    cut = near.withColumn("first", F.slice("samples", 1, size)).withColumn("last", F.slice("samples", F.greatest(F.size("samples") - size + 1, F.lit(1)), size))
    found = cut.groupBy("signal_id", "sample_rate", "low", "high", "length").agg(pieces("first", F.col("chunk_idx") < F.col("low") + size).alias("head"), pieces("last", F.col("chunk_idx") > F.col("high") - size).alias("tail"))
    return found.withColumn("head", F.slice("head", 1, size)).withColumn("tail", F.slice("tail", F.greatest(F.size("tail") - size + 1, F.lit(1)), size))


def single_pole_chunks(chunks: DataFrame, tau: float, group: int = GROUP) -> DataFrame:
    return filter_chunks(chunks, lambda rate: ((1 - (alpha := K.single_pole_alpha(tau, rate)),), (1.0, -alpha)), group=group)


def gammatone_chunks(chunks: DataFrame, bands: int = 20, start: float = 100.0, group: int = GROUP) -> DataFrame:
    """(signal_id, sample_rate, chunk_idx, band, samples): every chunk meets all bands in one task."""
    bank = lambda rate: [Gammatone(float(c), rate) for c in K.gammatone_centres(bands, start, rate)]
    return _scan(_clean(chunks), bank, group=group)


def rechunk(pieces: DataFrame, chunk: int) -> DataFrame:
    """Chunks of ``chunk`` samples from rows (signal_id, sample_rate, at, samples) that start at sample ``at``."""
    return bordered(pieces, chunk, 0, 0).drop("at")


def bordered(pieces: DataFrame, chunk: int, before: int, after: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(signal_id, sample_rate, *keep, chunk_idx, at, samples): ``rechunk`` with the samples ``before`` and ``after`` each chunk, as far as there
    are any. A chunk behind the last one also has a row if samples are before it; ``keep`` names columns with one value a signal.
    """
    low = F.greatest(F.floor((F.col("at") - after) / chunk), F.lit(0)).cast("long")
    last = F.expr(f"(at + size(samples) - 1 + {before}) div {chunk}")
    to = pieces.where(F.size("samples") > 0).withColumn("chunk_idx", F.explode(F.sequence(low, last)))
    begin = F.greatest(F.col("chunk_idx") * chunk - before - F.col("at"), F.lit(0)).cast("int")
    end = F.least((F.col("chunk_idx") + 1) * chunk + after - F.col("at"), F.size("samples").cast("long")).cast("int")
    cut = to.select("signal_id", "sample_rate", *keep, "chunk_idx", (F.col("at") + begin).alias("at"), F.slice("samples", begin + 1, end - begin).alias("part"))
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"]))
    return cut.groupBy("signal_id", "sample_rate", *keep, "chunk_idx").agg(F.min("at").alias("at"), joined.alias("samples"))


def placed_chunks(chunks: DataFrame) -> DataFrame:
    """(signal_id, sample_rate, at, samples, length, sound): the place of each chunk's first sample, its signal's length, and whether all of that are numbers.

    Only one row a chunk, without samples, is ordered within a signal.
    """
    number = lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf")))
    sizes = chunks.select("signal_id", "chunk_idx", F.size("samples").cast("long").alias("n"), F.forall("samples", lambda v: F.coalesce(number(v), F.lit(False))).alias("sound"))
    w = Window.partitionBy("signal_id")
    before = F.coalesce(F.sum("n").over(w.orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = sizes.select("signal_id", "chunk_idx", before.alias("at"), F.sum("n").over(w).alias("length"), F.min("sound").over(w).alias("sound"))
    return chunks.join(places, ["signal_id", "chunk_idx"]).select("signal_id", "sample_rate", "at", "samples", "length", "sound")


def resample_pieces(chunks: DataFrame, rate: float, chunk: int) -> DataFrame:
    """(signal_id, sample_rate, at, samples, length): resampled signals in pieces from sample ``at`` on, and their length.

    A filter's memory is lost to rounding after some samples (``kernels.reach``): chunks with that much of their neighbours are
    filtered alone, in one pass. Filters that remember more than a chunk go through the scans of ``resample_chunks``.
    """
    chunks, kind = _clean(chunks), dict(chunks.dtypes)["signal_id"]
    around = max([K.resample_reach(r[0], rate) for r in chunks.select("sample_rate").distinct().collect()], default=0)  # rates are few
    if around > chunk:
        return placed_chunks(resample_chunks(chunks, rate, chunk)).drop("sound")
    parts = bordered(placed_chunks(chunks), chunk, around, around, ("length", "sound")).where(f"chunk_idx <= (length - 1) div {chunk}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["sample_rate", "length", "sound", "chunk_idx", "at"]).to_pylist()
            for i, r in enumerate(rows):
                fs, begin, n = r["sample_rate"], r["chunk_idx"] * chunk, K.resample_length(r["length"], r["sample_rate"], rate)
                last = begin + chunk >= r["length"]
                k = np.arange(max(0, int(begin * rate / fs) - 2), n if last else min(n, int((begin + chunk) * rate / fs) + 2))
                place = np.floor(k * fs / rate)
                k = k[(place >= begin) & (last | (place < begin + chunk))]
                if not len(k):
                    continue
                x = _numbers(batch.column("samples"), i) if r["sound"] or fs == rate else np.full(len(batch.column("samples")[i]), np.nan)
                y = K.resample_part(x, r["at"], r["length"], int(k[0]), int(k[-1]) + 1, fs, rate)
                yield pa.RecordBatch.from_arrays([batch.column("signal_id").slice(i, 1), pa.array([float(rate)]), pa.array([int(k[0])], pa.int64()), lists(y[None, :]), pa.array([n], pa.int64())], names=["signal_id", "sample_rate", "at", "samples", "length"])

    return parts.mapInArrow(run, f"signal_id {kind}, sample_rate double, at long, samples array<double>, length long")


def _resampled(chunks: DataFrame, rate: float, chunk: int) -> DataFrame:
    """Linear interpolation of signals in chunks of ``chunk`` samples at the other rate's places; ``sample_rate`` stays what it was."""
    size = chunks.groupBy("signal_id").agg(F.sum(F.size("samples")).alias("length"), F.max("chunk_idx").alias("high"))
    ahead = chunks.select("signal_id", (F.col("chunk_idx") - 1).alias("chunk_idx"), F.get("samples", F.lit(0)).alias("next"))
    met = chunks.join(ahead, ["signal_id", "chunk_idx"], "left").join(size, "signal_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(["sample_rate", "chunk_idx", "next", "length", "high"]).to_pylist()
            at, out = [], []
            for i, r in enumerate(rows):
                x, fs = _numbers(batch.column("samples"), i), r["sample_rate"]
                first, n = r["chunk_idx"] * chunk, K.resample_length(r["length"], fs, rate)
                end = n if r["chunk_idx"] == r["high"] else min(n, int((first + chunk) * rate / fs) + 2)
                k = np.arange(max(0, int(first * rate / fs) - 2), end)
                place = np.floor(k * fs / rate)
                k = k[(place >= first) & ((place < first + chunk) | (r["chunk_idx"] == r["high"]))]
                at.append(int(k[0]) if len(k) else 0)
                out.append(K.interpolate(np.append(x, r["next"] if r["next"] is not None else 0.0), k * fs / rate - first))
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("sample_rate"), pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "sample_rate", "at", "samples"])

    kind = dict(chunks.dtypes)["signal_id"]
    return rechunk(met.select("signal_id", "sample_rate", "chunk_idx", "samples", "next", "length", "high").mapInArrow(run, f"signal_id {kind}, sample_rate double, at long, samples array<double>"), chunk)


def resample_chunks(chunks: DataFrame, rate: float, chunk: int, group: int = GROUP) -> DataFrame:
    """Signals in chunks of ``chunk`` samples at another rate, in chunks of the same length; filtered at the higher rate with zero phase."""
    chunks = _clean(chunks)
    low_pass = lambda fs: K.butterworth(4, 0.9 * min(fs, rate) / max(fs, rate))
    same, down, up = (chunks.where(c) for c in (F.col("sample_rate") == rate, F.col("sample_rate") > rate, F.col("sample_rate") < rate))
    down = _resampled(filter_chunks(down, low_pass, True, 4, group), rate, chunk)
    up = filter_chunks(_resampled(up, rate, chunk), low_pass, True, 4, group)
    return same.unionByName(down).unionByName(up.select(*down.columns)).withColumn("sample_rate", F.lit(float(rate)))


# --- decoding -------------------------------------------------------------------------------------

#: Logarithms become whole multiples of 2 ** -BITS, so that sums do not depend on where chunks begin and equal paths stay equal.
BITS = 40


def fixed(p) -> np.ndarray:
    return np.rint(np.log(np.asarray(p, dtype=float) + 1e-30) * 2.0**BITS).astype(np.int64)


def _through(e: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The max-plus matrix of a chunk: the best way from each state before it to each state at its end."""
    t = move + e[0][None, :]
    for row in e[1:]:
        t = (t[:, :, None] + move[None, :, :]).max(axis=1) + row[None, :]
    return t


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _forward(v: np.ndarray | None, e: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values at a chunk's end, and for each of its observations and states the best state before (-1 at a signal's start)."""
    back = np.full(e.shape, -1, np.int32)
    for i, row in enumerate(e):
        if v is None:
            v = start + row
            continue
        q = v[:, None] + move
        back[i] = q.argmax(axis=0)
        v = q.max(axis=0) + row
    return v, back


def viterbi_chunks(chunks: DataFrame, start, move, group: int = GROUP) -> DataFrame:
    """(signal_id, block_idx, state, probability) of rows (signal_id, chunk_idx, first, emissions ARRAY<ARRAY>), as ``music.viterbi``.

    ``first`` is the number of a chunk's first observation. Each chunk's max-plus matrix is made by a task; a scan over the
    chunks gives the values before each of them. Then each chunk says which state before it belongs to each of its
    last states; a scan of these maps from the end fixes the states at the borders, and the paths are filled in
    chunk by chunk.
    """
    start, move = fixed(start), fixed(move)
    states, kind = len(start), dict(chunks.dtypes)["signal_id"]
    rows = chunks.select("signal_id", F.col("chunk_idx").cast("long").alias("at"), F.col("first").cast("long").alias("first"), "emissions").where(F.size("emissions") > 0)
    edge = rows.agg(F.min("at"), F.max("at")).first()
    low, high = edge[0] or 0, edge[1] or 0
    pack = lambda m: np.ascontiguousarray(m, np.int64).tobytes()
    square = lambda b: np.frombuffer(b, np.int64).reshape(states, states)

    def each(fn, names: list[str], types: list):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    one = batch.slice(i, 1)
                    row = one.select([c for c in one.schema.names if c not in ("signal_id", "emissions")]).to_pylist()[0]
                    values = one.column("emissions")[0].values
                    e = fixed(values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), states))
                    got = fn(row, e)
                    m = len(got[0])
                    yield pa.RecordBatch.from_arrays([one.column("signal_id").take(pa.array([0] * m)), *(pa.array(g, t) for g, t in zip(got, types, strict=True))], names=["signal_id", *names])

        return run

    maps = rows.mapInArrow(each(lambda r, e: ([r["at"]], [pack(_through(e, move))], [pack(_forward(None, e, start, move)[0])]), ["at", "map", "alone"], [pa.int64(), pa.binary(), pa.binary()]), f"signal_id {kind}, at long, map binary, alone binary")

    def walk(table: pa.Table, total: bool) -> pa.Table:
        table = table.sort_by("at")
        ats, ms, alone = (table.column(c).to_pylist() for c in ("at", "map", "alone"))
        if total:  # the first chunk of a signal has no states before it; ``alone`` has its values then
            t, v = square(ms[0]), np.frombuffer(alone[0], np.int64)
            for m in ms[1:]:
                t, v = _times(t, square(m)), (v[:, None] + square(m)).max(axis=0)
                t, v = t - t.max(), v - v.max()
            one = table.slice(0, 1)
            return pa.table([one.column("signal_id"), one.column("g"), pa.array([pack(t)]), pa.array([pack(v)])], names=["signal_id", "at", "map", "alone"])
        given = table.column("start")[0].as_py() if "start" in table.column_names else None
        v, out = None if given is None else np.frombuffer(given, np.int64), []
        for m, a in zip(ms, alone, strict=True):
            out.append(None if v is None else pack(v))
            v = np.frombuffer(a, np.int64) if v is None else (v[:, None] + square(m)).max(axis=0)
            v = v - v.max()  # only differences matter, so nothing overflows
        return pa.table([table.column("signal_id"), pa.array(ats, pa.int64()), pa.array(out, pa.binary())], names=["signal_id", "at", "start"])

    def starts(found: DataFrame, low: int, high: int) -> DataFrame:
        if high - low < group:
            return found.groupBy("signal_id").applyInArrow(lambda t: walk(t, False), f"signal_id {kind}, at long, start binary")
        grouped = found.withColumn("g", F.floor((F.col("at") - low) / group).cast("long"))
        totals = grouped.groupBy("signal_id", "g").applyInArrow(lambda t: walk(t, True), f"signal_id {kind}, at long, map binary, alone binary")
        above = starts(totals, 0, (high - low) // group).withColumnRenamed("at", "g")
        return grouped.join(above, ["signal_id", "g"]).groupBy("signal_id", "g").applyInArrow(lambda t: walk(t, False), f"signal_id {kind}, at long, start binary")

    before = lambda r: None if r["start"] is None else np.frombuffer(r["start"], np.int64)

    def border(r, e):
        v, back = _forward(before(r), e, start, move)
        at = np.arange(states)
        for b in back[::-1]:
            at = np.where(b[at] >= 0, b[at], at) if b[0] >= 0 else at
        gain = int(v.max()) - (0 if r["start"] is None else 0)
        return [r["at"]], [at.astype(np.int32).tobytes()], [int(v.argmax())], [float(gain) / 2.0**BITS]

    valued = rows.join(starts(maps, low, high), ["signal_id", "at"])
    backs = valued.select("signal_id", "at", "first", "emissions", "start").mapInArrow(each(border, ["at", "back", "best", "gain"], [pa.int64(), pa.binary(), pa.int32(), pa.float64()]), f"signal_id {kind}, at long, back binary, best int, gain double")

    def trace(table: pa.Table, total: bool) -> pa.Table:
        """From the last chunk of a group: each chunk's last state; or the group's map and its last chunk's best state."""
        table = table.sort_by([("at", "descending")])
        maps_ = [np.frombuffer(b, np.int32) for b in table.column("back").to_pylist()]
        best, gains = table.column("best").to_pylist(), table.column("gain").to_pylist()
        if total:
            at = np.arange(states)
            for m in maps_:
                at = m[at]
            one = table.slice(0, 1)
            return pa.table([one.column("signal_id"), one.column("g"), pa.array([at.astype(np.int32).tobytes()]), pa.array([best[0]], pa.int32()), pa.array([sum(gains)])], names=["signal_id", "at", "back", "best", "gain"])
        given = table.column("last")[0].as_py() if "last" in table.column_names else None
        state, out = best[0] if given is None else given, []
        for m in maps_:
            out.append(int(state))
            state = m[state]
        whole = table.column("whole")[0].as_py() if "whole" in table.column_names else sum(gains)
        return pa.table([table.column("signal_id"), table.column("at"), pa.array(out, pa.int32()), pa.array([whole] * len(out), pa.float64())], names=["signal_id", "at", "last", "whole"])

    ends_ddl = f"signal_id {kind}, at long, last int, whole double"

    def ends(found: DataFrame, low: int, high: int) -> DataFrame:
        if high - low < group:
            return found.groupBy("signal_id").applyInArrow(lambda t: trace(t, False), ends_ddl)
        grouped = found.withColumn("g", F.floor((F.col("at") - low) / group).cast("long"))
        totals = grouped.groupBy("signal_id", "g").applyInArrow(lambda t: trace(t, True), f"signal_id {kind}, at long, back binary, best int, gain double")
        above = ends(totals, 0, (high - low) // group).withColumnRenamed("at", "g")
        return grouped.join(above, ["signal_id", "g"]).groupBy("signal_id", "g").applyInArrow(lambda t: trace(t, False), ends_ddl)

    def fill(r, e):
        _, back = _forward(before(r), e, start, move)
        path = [r["last"]]
        for b in back[:0:-1]:
            path.append(int(b[path[-1]]))
        m = len(e)
        return [r["first"] + k for k in range(m)], path[::-1], [r["whole"]] * m

    solved = valued.join(ends(backs, low, high), ["signal_id", "at"]).select("signal_id", "at", "first", "emissions", "start", "last", "whole")
    return solved.mapInArrow(each(fill, ["block_idx", "state", "probability"], [pa.int64(), pa.int32(), pa.float64()]), f"signal_id {kind}, block_idx long, state int, probability double")
