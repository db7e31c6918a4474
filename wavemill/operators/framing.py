"""Framing and pre-processing of signals.

A signal is a row (signal_id, sample_rate, samples); a sample table has rows (signal_id, i, x). Blocks
are rows (signal_id, sample_rate, block_idx, t_s, x [, xp]): block n holds x[nH : nH + B], padded with
zeros; there are floor(len / H) + 1 of them; t_s is the block's centre. ``xp`` is the block before
(zeros for the first), cut from the same samples, so that operators that compare neighbours need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.exprs import bind


def _check(block: int, hop: int) -> None:
    if not 0 < hop <= block:
        raise ValueError("0 < hop <= block is required")


def time_stamp(block_idx, block: int, hop: int, rate) -> Column:
    return (F.lit(block / 2) + F.col(block_idx) * hop) / F.col(rate)


def _cut(samples, first, count, block: int, hop: int, lead: int, previous: bool) -> Column:
    """Array of struct(x [, xp]): ``count`` blocks of a padded array whose first block starts at ``lead``; ``first`` is its number."""
    x = lambda k: F.slice(samples, k * hop + (lead + 1), block).alias("x")
    if not previous:
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(x(k)))
    zeros = F.array_repeat(F.lit(0.0), block)
    xp = lambda k: F.when((k + first) > 0, F.slice(samples, F.greatest(k * hop + (lead - hop + 1), F.lit(1)), block)).otherwise(zeros).alias("xp")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(x(k), xp(k)))


def blocks(signals: DataFrame, block: int = 2048, hop: int = 1024, previous: bool = False) -> DataFrame:
    """Blocks of whole signals. The samples are padded once and sliced, so exploding does not copy the signal per block."""
    _check(block, hop)
    count = F.floor(F.size("samples") / hop).cast("int") + 1
    padded = F.concat("samples", F.array_repeat(F.lit(0.0), block))
    cut = bind(padded, lambda p: _cut(p, F.lit(0), count, block, hop, 0, previous))
    out = signals.where(F.col("samples").isNotNull()).select("signal_id", "sample_rate", F.posexplode(cut).alias("block_idx", "b"))
    return _blocks_of(out.withColumn("block_idx", F.col("block_idx").cast("long")), block, hop, previous)


def _blocks_of(cut: DataFrame, block: int, hop: int, previous: bool) -> DataFrame:
    xp = [F.col("b.xp").alias("xp")] if previous else []
    return cut.select("signal_id", "sample_rate", "block_idx", F.col("b.x").alias("x"), time_stamp("block_idx", block, hop, "sample_rate").alias("t_s"), *xp)


def with_previous(blocks: DataFrame, column: str = "x", name: str = "xp") -> DataFrame:
    """Adds the block before to blocks that come without it; ``previous=True`` when cutting is cheaper."""
    w = Window.partitionBy("signal_id").orderBy("block_idx")
    return blocks.withColumn(name, F.coalesce(F.lag(column).over(w), F.transform(F.col(column), lambda v: F.lit(0.0))))


def placed(values, length) -> Column:
    """Array of ``length`` numbers with each x of the sorted array of struct(p, x) in its place p; zeros elsewhere, the first of equal places counts."""
    once = F.filter(values, lambda s, j: (j == 0) | (s["p"] != F.get(values, j - 1)["p"]))
    gap = lambda v, s, j: s["p"] - F.when(j > 0, F.get(v, j - 1)["p"]).otherwise(F.lit(-1)) - 1
    x = lambda s: F.coalesce(s["x"], F.lit(0.0))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n.cast("int"))
    sparse = bind(once, lambda v: F.flatten(F.transform(v, lambda s, j: F.concat(zeros(gap(v, s, j)), F.array(x(s))))))
    first, last = F.get(values, F.lit(0))["p"], F.get(values, F.size(values) - 1)["p"]
    # without a gap or a repeated place the values follow each other
    dense = F.size(values) == last - first + 1
    plain = F.concat(zeros(first), F.transform(values, x))
    strict = F.transform(values, lambda s, j: s["p"] == first + j)
    filled = F.when(dense & F.forall(strict, lambda ok: ok), plain).otherwise(sparse)
    return bind(filled, lambda f: F.concat(f, zeros(length - F.size(f))))


def blocks_from_samples(samples: DataFrame, block: int, hop: int, rate: float = 1.0, previous: bool = False, chunk_hops: int = 0) -> DataFrame:
    """Blocks of a sample table (signal_id, i, x); missing samples are 0, of samples with equal i the smallest counts.

    Samples are exchanged in chunks of many blocks: each goes to its chunk, and those near an edge also to
    the neighbour that needs them. No signal is gathered as a whole.
    """
    _check(block, hop)
    per = chunk_hops or max(1, -(-16 * block // hop))  # blocks of a chunk
    chunk, lead = per * hop, hop if previous else 0
    length = lead + chunk + block - hop
    counts = samples.groupBy("signal_id").agg((F.max("i") + 1).alias("n"))
    every = counts.select("signal_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {hop} div {per}"))).alias("chunk_idx"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("i") - (chunk + block - hop) + 1) / chunk))
    dealt = samples.where("i >= 0").select("signal_id", "i", "x", F.explode(F.sequence(first, F.expr(f"(i + {lead}) div {chunk}"))).alias("chunk_idx"))
    filled = dealt.groupBy("signal_id", "chunk_idx").agg(F.array_sort(F.collect_list(F.struct((F.col("i") - F.col("chunk_idx") * chunk + lead).alias("p"), "x"))).alias("v"))
    joined = every.join(filled, ["signal_id", "chunk_idx"], "left").withColumn("v", F.coalesce("v", F.array().cast("array<struct<p:bigint,x:double>>")))
    count = F.least(F.lit(per), F.expr(f"n div {hop}") + 1 - F.col("chunk_idx") * per).cast("int")
    cut = bind(placed(F.col("v"), F.lit(length)), lambda a: _cut(a, F.col("chunk_idx") * per, count, block, hop, lead, previous))
    out = joined.select("signal_id", F.lit(float(rate)).alias("sample_rate"), "chunk_idx", F.posexplode(cut).alias("k", "b"))
    return _blocks_of(out.withColumn("block_idx", F.col("chunk_idx") * per + F.col("k")), block, hop, previous)


def blocks_from_chunks(chunks: DataFrame, block: int, hop: int, chunk: int, previous: bool = False) -> DataFrame:
    """Blocks of long signals that are stored as rows (signal_id, sample_rate, chunk_idx, samples) of ``chunk`` samples.

    Each chunk borrows the beginnings of the next ones, and for ``xp`` the end of the one before, by
    equi-joins on (signal_id, chunk_idx), so a single long signal is spread over many tasks. ``chunk`` must
    be a multiple of the hop.
    """
    _check(block, hop)
    if chunk % hop:
        raise ValueError("the chunk length must be a multiple of the hop")
    per = chunk // hop
    keys = ["signal_id", "chunk_idx"]
    none = F.array().cast("array<double>")
    out = chunks.select("signal_id", "sample_rate", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.col("samples").cast("array<double>").alias("samples"))
    last = chunks.groupBy("signal_id").agg(F.max("chunk_idx").alias("last"))
    joined, padded = out, F.col("samples")
    for k in range(1, -(-(block - hop) // chunk) + 1):
        ahead = out.select("signal_id", (F.col("chunk_idx") - k).alias("chunk_idx"), F.slice("samples", 1, block - hop).alias(f"s{k}"))
        joined = joined.join(ahead, keys, "left")
        padded = F.concat(padded, F.coalesce(F.col(f"s{k}"), none))
    if previous:
        joined = joined.join(out.select("signal_id", (F.col("chunk_idx") + 1).alias("chunk_idx"), F.slice("samples", chunk - hop + 1, hop).alias("s0")), keys, "left")
        padded = F.concat(F.coalesce(F.col("s0"), F.array_repeat(F.lit(0.0), hop)), padded)
    joined = joined.join(last, "signal_id")
    # the last chunk also gives the block after its end
    count = F.when(F.col("chunk_idx") == F.col("last"), F.floor(F.size("samples") / hop) + 1).otherwise(F.lit(per)).cast("int")
    cut = bind(F.concat(padded, F.array_repeat(F.lit(0.0), block)), lambda p: _cut(p, F.col("chunk_idx") * per, count, block, hop, hop if previous else 0, previous))
    out = joined.select("signal_id", "sample_rate", "chunk_idx", F.posexplode(cut).alias("k", "b"))
    return _blocks_of(out.withColumn("block_idx", F.col("chunk_idx") * per + F.col("k")), block, hop, previous)


def downmix(channels: DataFrame) -> DataFrame:
    """(signal_id, i, x) as the mean over the channels of (signal_id, channel, i, x)."""
    return channels.groupBy("signal_id", "i").agg(F.avg("x").alias("x"))


def downmix_arrays(column: str = "channels") -> Column:
    """Mean over an array of channel arrays."""
    n = F.size(column)
    first = F.transform(F.get(F.col(column), F.lit(0)), lambda v: F.lit(0.0))
    return F.transform(F.aggregate(column, first, lambda s, c: F.zip_with(s, c, lambda a, b: a + b)), lambda v: v / n)


def normalise_samples(samples: DataFrame) -> DataFrame:
    """Each signal of a sample table scaled to a maximum of one; silence stays. One aggregate and a join on the signal."""
    peak = samples.groupBy("signal_id").agg(F.max(F.abs("x")).alias("peak"))
    return samples.join(peak, "signal_id").withColumn("x", F.col("x") / F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)).drop("peak")


def normalise(signals: DataFrame) -> DataFrame:
    """Whole signals scaled to a maximum of one, without a shuffle."""
    peak = F.array_max(F.transform("samples", F.abs))
    return signals.withColumn("samples", bind(peak, lambda p: F.transform("samples", lambda v: v / F.when(p > 0, p).otherwise(1.0))))


def _per_signal(signals: DataFrame, fn, rate=None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fs = batch.column("sample_rate").to_pylist()
            out = [fn(np.asarray(s.as_py(), dtype=float), f) for s, f in zip(batch.column("samples"), fs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), pa.array([rate or f for f in fs], pa.float64()), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "sample_rate", "samples"])

    source = signals.select("signal_id", "sample_rate", "samples").where(F.col("samples").isNotNull())
    return source.mapInArrow(run, f"signal_id {dict(source.dtypes)['signal_id']}, sample_rate double, samples array<double>")


def resample(signals: DataFrame, rate: float) -> DataFrame:
    return _per_signal(signals, lambda s, fs: s if fs == rate else K.resample(s, fs, rate), rate)


def filter_signals(signals: DataFrame, b, a, zero_phase: bool = False) -> DataFrame:
    f = K.filtfilt if zero_phase else K.iir
    return _per_signal(signals, lambda s, fs: f(b, a, s[None, :])[0])


def single_pole(signals: DataFrame, tau: float) -> DataFrame:
    return _per_signal(signals, lambda s, fs: K.single_pole(s[None, :], K.single_pole_alpha(tau, fs))[0])


def interpolate(samples: DataFrame, at: DataFrame) -> DataFrame:
    """Linear interpolation of sample tables at (signal_id, k, pos): two equi-joins on the neighbours of pos.

    Values outside fade to zero within one sample.
    """
    p = at.withColumn("lo", F.floor("pos").cast("long")).withColumn("frac", F.col("pos") - F.floor("pos"))
    left = samples.select("signal_id", F.col("i").alias("lo"), F.col("x").alias("a"))
    right = samples.select("signal_id", (F.col("i") - 1).alias("lo"), F.col("x").alias("b"))
    value = (1 - F.col("frac")) * F.coalesce("a", F.lit(0.0)) + F.col("frac") * F.coalesce("b", F.lit(0.0))
    return p.join(left, ["signal_id", "lo"], "left").join(right, ["signal_id", "lo"], "left").select("signal_id", "k", value.alias("y"))


def delay(samples: DataFrame, by: float) -> DataFrame:
    """(signal_id, i, y): a ring buffer read ``by`` samples back, linear between neighbours, zeros before the start."""
    at = samples.select("signal_id", F.col("i").alias("k"), (F.col("i") - F.lit(float(by))).alias("pos"))
    return interpolate(samples, at).withColumnRenamed("k", "i")


def normalise_chunks(chunks: DataFrame) -> DataFrame:
    """Signals in chunks scaled to a maximum of one each: one aggregate and a join on the signal."""
    peak = chunks.groupBy("signal_id").agg(F.max(F.array_max(F.transform("samples", F.abs))).alias("peak"))
    scale = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    return chunks.join(peak, "signal_id").withColumn("samples", F.transform("samples", lambda v: v / scale)).drop("peak")


def gammatone_bands(signals: DataFrame, bands: int = 20, start: float = 100.0, normalised: bool = True) -> DataFrame:
    """(signal_id, sample_rate, band, centre_hz, samples): every band of every signal is a row, filtered in its own task slot."""
    source = normalise(signals) if normalised else signals
    spread = source.select("signal_id", "sample_rate", "samples", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centre, out = [], []
            for s, fs, band in zip(batch.column("samples"), batch.column("sample_rate").to_pylist(), batch.column("band").to_pylist(), strict=True):
                centre.append(float(K.gammatone_centres(bands, start, fs)[band]))
                out.append(K.gammatone(np.asarray(s.as_py(), dtype=float)[None, :], centre[-1], fs)[0])
            yield pa.RecordBatch.from_arrays([batch.column("signal_id"), batch.column("sample_rate"), batch.column("band"), pa.array(centre), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "sample_rate", "band", "centre_hz", "samples"])

    return spread.mapInArrow(run, f"signal_id {dict(source.dtypes)['signal_id']}, sample_rate double, band int, centre_hz double, samples array<double>")


# --- moving averages over a sequence column -------------------------------------------------------


#: Up to this size averages are plain sliding sums.
SHORT = 32


def _short_zero_phase(df: DataFrame, value: str, size: int, out: str, key: str, order: str) -> DataFrame:
    """Sliding sums of v and of place * v, the places counted within four sizes, from one of two starts so that no frame wraps around."""
    w = Window.partitionBy(key).orderBy(order)
    placed = df.withColumn("_n", (F.row_number().over(w) - 1) % (4 * size))
    near = F.col("_n").between(size, 3 * size - 1)
    n, v, back, ahead = float(size), F.col(value), w.rowsBetween(-(size - 1), 0), w.rowsBetween(1, size - 1)
    terms = []
    for c in (F.col("_n"), (F.col("_n") + 2 * size) % (4 * size)):
        left = (n - c) * F.sum(v).over(back) + F.sum(c * v).over(back)
        right = (n + c) * _zero(F.sum(v).over(ahead)) - _zero(F.sum(c * v).over(ahead))
        terms.append((left + right) / (n * n))
    summed = placed.withColumns({"_one": terms[0], "_two": terms[1]})
    return summed.withColumn(out, F.when(near, F.col("_one")).otherwise(F.col("_two"))).select(*df.columns, *([out] if out not in df.columns else []))


def _run_sums(df: DataFrame, value: str, size: int, key: str, order: str, weighted: bool) -> DataFrame:
    """Rows with their place ``_r`` in groups ``_b`` of ``size`` rows, sums from the group's start to the row (_p) and from
    the row to its end (_s), and the same of value * place (_pw, _sw). Constant work a row, and no sum is longer than a group.
    """
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
    out = out.withColumn("_r", F.col("_n") % size).withColumn("_b", F.expr(f"_n div {size}"))
    group = Window.partitionBy(key, "_b")
    upto = group.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    terms = {"": F.col(value)} | ({"w": F.col(value) * F.col("_r")} if weighted else {})
    for name, term in terms.items():
        out = out.withColumn(f"_p{name}", F.sum(term).over(upto)).withColumn(f"_s{name}", F.sum(term).over(group) - F.col(f"_p{name}") + term)
    return out


def _zero(c) -> Column:
    return F.coalesce(c, F.lit(0.0))


def moving_average(df: DataFrame, value: str, size: int, out: str, key: str = "signal_id", order: str = "block_idx") -> DataFrame:
    """Mean of the last ``size`` values, with zeros before the start."""
    if size <= SHORT:
        return df.withColumn(out, F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1), 0)) / size)
    w = Window.partitionBy(key).orderBy("_n")
    before = F.when(F.col("_r") < size - 1, _zero(F.lag("_s", size - 1).over(w))).otherwise(0.0)
    return _run_sums(df, value, size, key, order, False).withColumn(out, (F.col("_p") + before) / size).select(*df.columns, *([out] if out not in df.columns else []))


def moving_average_zero_phase(df: DataFrame, value: str, size: int, out: str, key: str = "signal_id", order: str = "block_idx") -> DataFrame:
    """Forwards and backwards: a triangular kernel with zeros outside.

    The weights are linear in the place within a group of ``size`` rows, so the sums of v and of place * v
    in this group and its neighbours are enough.
    """
    if size == 1:
        return df.withColumn(out, F.col(value) / F.lit(1.0))
    if size <= SHORT:
        return _short_zero_phase(df, value, size, out, key, order)
    n, r, v = float(size), F.col("_r"), F.col(value)
    w = Window.partitionBy(key).orderBy("_n")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.last(F.struct("_b", "_p", "_pw")).over(whole)
    # the group before from the place after this row's; the group after up to the place before, or its end
    behind = F.when(r < size - 1, _zero(F.lag("_sw", size - 1).over(w)) - r * _zero(F.lag("_s", size - 1).over(w))).otherwise(0.0)
    near = F.col("_last")["_b"] == F.col("_b") + 1
    ahead_p = F.coalesce(F.lead("_p", size - 1).over(w), F.when(near, F.col("_last")["_p"]), F.lit(0.0))
    ahead_w = F.coalesce(F.lead("_pw", size - 1).over(w), F.when(near, F.col("_last")["_pw"]), F.lit(0.0))
    ahead = F.when(r > 0, r * ahead_p - ahead_w).otherwise(0.0)
    left = (n - r) * F.col("_p") + F.col("_pw") + behind
    right = (n + r) * (F.col("_s") - v) - (F.col("_sw") - r * v) + ahead
    sums = _run_sums(df, value, size, key, order, True).withColumn("_last", last)
    return sums.withColumn(out, (left + right) / (n * n)).select(*df.columns, *([out] if out not in df.columns else []))
