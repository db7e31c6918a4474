"""Novelty curves and beat histograms in segments, so that one signal's curve is spread over many tasks.

Rows (signal_id, block_idx, value) go to segments of ``block_idx``, those near an edge also to the neighbours whose smoothing
reaches them: a row travels twice at most, as a segment is at least four times as long as its borders. What needs the
whole curve (its largest value, its mean) is one aggregate of a row for each segment, and goes back to the segments by
a join that is dealt by runs of segments, so that a signal with a third of all rows is no hot key.

The sample rate is a column: signals of different rates are one plan. A null or missing value counts as 0 in sums, rows
without a signal, a place (0 or more) or a rate above 0 have no result, and of rows with an equal place each has the
same result, from the sum of their values. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .. import kernels as K

#: Places of a segment, at least.
SEGMENT = 4096
#: Segments of a signal that meet its aggregates in one key.
RUN = 256
# fixed values: seconds of the two smoothings, the share of the mean in the threshold
SMOOTH, ADAPT, LEVEL = 0.07, 0.14, 0.4


def _length(tau: float, rate: Column) -> Column:
    """``kernels.moving_average_length`` of a column."""
    return F.when(tau <= 1.5 / rate, F.lit(1)).otherwise(F.ceil(tau * rate)).cast("long")


def dealt(rows: DataFrame, size: Column, before: Column, after: Column) -> DataFrame:
    """``rows`` with their segment ``seg`` of ``size`` places, once for each whose borders hold them; ``size`` must be the same for all rows of a signal."""
    first = F.greatest(F.lit(0).cast("long"), F.floor((F.col("block_idx") - after) / size))
    last = F.floor((F.col("block_idx") + before) / size)
    return rows.withColumns({"size": size, "seg": F.explode(F.sequence(first, last))})


def _triangle(x: np.ndarray, size: int) -> np.ndarray:
    """A moving average of ``size`` there and back, zeros outside; the ends lose size - 1 values each."""
    one = np.full(size, 1.0 / size)
    return np.convolve(x, np.convolve(one, one), "valid")


def _segment(table: pa.Table, border: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, values from ``border`` before it to ``border`` after the end, which places are there, places of the own rows)."""
    size, seg = table.column("size")[0].as_py(), table.column("seg")[0].as_py()
    at = table.column("block_idx").to_numpy() - (seg * size - border)
    ok = (at >= 0) & (at < size + 2 * border)
    x, there = np.zeros(size + 2 * border), np.zeros(size + 2 * border, dtype=bool)
    np.add.at(x, at[ok], table.column("value").fill_null(0.0).to_numpy()[ok])
    there[at[ok]] = True
    own = np.sort(at[(at >= border) & (at < size + border)])
    return seg * size, x, there, own


def onsets(values: DataFrame, rate: str, hop: float = 1.0) -> DataFrame:
    """(signal_id, rate, block_idx, value, novelty, excess, onset) of (signal_id, rate, block_idx, value).

    ``hop`` samples make a step of the curve. ``novelty``: scaled by the largest value, smoothed over 0.07 s there and back, rectified. ``excess``: above
    its own smoothing over 0.14 s and 0.4 of its mean (the first block left out). ``onset``: a strict maximum of the excess.
    """
    kind = dict(values.dtypes)["signal_id"]
    steps = F.col("rate") / hop
    source = values.select("signal_id", F.col(rate).cast("double").alias("rate"), F.col("block_idx").cast("long").alias("block_idx"), F.col("value").cast("double").alias("value"))
    source = source.where("signal_id is not null and block_idx >= 0 and rate > 0")
    border = _length(SMOOTH, steps) + _length(ADAPT, steps)  # (n - 1) + (m - 1), and one neighbour each way
    size = F.greatest(F.lit(SEGMENT).cast("long"), 4 * border)
    parts = "signal_id {}, rate double, seg long, places array<bigint>, value array<double>, novelty array<double>, gap array<double>, top double, total double, n long".format(kind)

    def smoothed(table: pa.Table) -> pa.Table:
        fs = table.column("rate")[0].as_py() / hop
        n, m = K.moving_average_length(SMOOTH, fs), K.moving_average_length(ADAPT, fs)
        border = n + m
        first, x, there, own = _segment(table, border)
        if not len(own):
            return pa.Table.from_pylist([], schema)
        # places outside of the signal have no novelty, though the smoothing reaches beyond its ends
        end = int(np.flatnonzero(there)[-1]) + 1
        nov = np.maximum(_triangle(x, n), 0.0)  # of the places n - 1 on
        place = np.arange(n - 1, n - 1 + len(nov))
        nov[(place >= end) | (place + first - border < 0)] = 0.0
        gap = nov[m - 1 : len(nov) - (m - 1)] - _triangle(nov, m)  # of the places border - 2 on
        nov = nov[m - 1 : len(nov) - (m - 1)]
        low = border - 2
        inside = lambda at: (at < end) & (at + first - border >= 0)
        beside = np.stack([own - 1, own, own + 1])
        three = np.where(inside(beside), gap[beside - low], np.nan)
        where = own - border + first
        mine, distinct = x[own], np.unique(own)
        counted = nov[distinct - low][distinct - border + first > 0]
        return pa.Table.from_pylist([{"signal_id": table.column("signal_id")[0].as_py(), "rate": table.column("rate")[0].as_py(), "seg": table.column("seg")[0].as_py(), "places": where.tolist(), "value": mine.tolist(), "novelty": nov[own - low].tolist(), "gap": three.T.ravel().tolist(), "top": float(np.abs(mine).max()), "total": float(counted.sum()), "n": len(counted)}], schema)

    schema = to_arrow_schema(values.sparkSession.createDataFrame([], parts).schema)
    cut = dealt(source, size, border, border).groupBy("signal_id", "rate", "seg").applyInArrow(smoothed, parts)
    ends = cut.groupBy("signal_id", "rate").agg(F.max("top").alias("peak"), F.try_divide(F.sum("total"), F.sum("n")).alias("mean"), F.max("seg").alias("last"))
    ends = ends.select("signal_id", "rate", "peak", "mean", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {RUN}"))).alias("run"))
    joined = cut.withColumn("run", F.expr(f"seg div {RUN}")).join(ends, ["signal_id", "rate", "run"])
    scale = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    rows = joined.select("signal_id", "rate", scale.alias("scale"), (LEVEL * F.coalesce(F.col("mean") / scale, F.lit(0.0))).alias("level"), F.posexplode("places").alias("k", "block_idx"), "value", "novelty", "gap")
    excess = lambda side: F.get("gap", F.col("k") * 3 + side) / F.col("scale") - F.col("level")
    at = lambda side: F.when(~F.isnan(excess(side)), F.greatest(excess(side), F.lit(0.0)))
    out = rows.select("signal_id", F.col("rate").alias(rate), "block_idx", F.get("value", F.col("k")).alias("value"), (F.get("novelty", F.col("k")) / F.col("scale")).alias("novelty"), at(1).alias("excess"), at(0).alias("_b"), at(2).alias("_a"))
    onset = (F.col("excess") > F.col("_b")) & (F.col("excess") > F.col("_a")) & (F.col("excess") > 0)
    return out.withColumn("onset", F.coalesce(onset, F.lit(False))).drop("_b", "_a")


def beat_histogram(curve: DataFrame, rate: str, method: str = "fft", size: int = 65536, hop: float = 1.0) -> DataFrame:
    """(signal_id, bin, bpm, value) of (signal_id, rate, block_idx, value): blocks of ``size`` values a quarter apart, summed, 30 to 200 BPM, scaled to one.

    A segment has 16 blocks or SEGMENT values; each gives one vector, and these are added bin by bin.
    """
    if method not in ("fft", "acf"):
        raise ValueError("the method is fft or acf")
    quarter = max(1, size // 4)
    blocks = max(16, -(-SEGMENT // quarter))
    length = blocks * quarter
    kind = dict(curve.dtypes)["signal_id"]
    source = curve.select("signal_id", F.col(rate).cast("double").alias("rate"), F.col("block_idx").cast("long").alias("block_idx"), F.col("value").cast("double").alias("value"))
    source = source.where("signal_id is not null and block_idx >= 0 and rate > 0")

    def summed(table: pa.Table) -> pa.Table:
        fs, seg = table.column("rate")[0].as_py() / hop, table.column("seg")[0].as_py()
        x = np.zeros(length + size)
        at = table.column("block_idx").to_numpy() - seg * length
        np.add.at(x, at, table.column("value").fill_null(0.0).to_numpy())
        total = 0.0
        for b in range(blocks):
            part = x[b * quarter : b * quarter + size][None, :]
            if part.any():
                total = total + (K.magnitude(part, "hann", 2)[0][:size] if method == "fft" else K.acf(part)[0][::-1])
        lo, hi = K.beat_range(method, size, fs)
        out = total[max(lo, 0) : hi + 1] if np.ndim(total) else np.zeros(size)[max(lo, 0) : hi + 1]
        bpm = K.beat_axis(method, size, fs)[max(0, -lo) :][: len(out)]  # bins below the first one are skipped
        count = len(out)
        one = lambda name: table.column(name).combine_chunks().take(pa.array([0] * count, pa.int32()))
        return pa.table([one("signal_id"), pa.array(np.arange(count), pa.int64()), pa.array(bpm, pa.float64()), pa.array(out, pa.float64())], names=["signal_id", "bin", "bpm", "value"])

    parts = dealt(source, F.lit(length).cast("long"), F.lit(0), F.lit(size - quarter)).groupBy("signal_id", "rate", "seg").applyInArrow(summed, f"signal_id {kind}, bin long, bpm double, value double")
    total = parts.groupBy("signal_id", "bin", "bpm").agg(F.sum("value").alias("value"))
    most = F.max(F.abs("value")).over(Window.partitionBy("signal_id"))  # one row for each bin of a signal
    return total.withColumn("value", F.col("value") / F.when(most > 0, most).otherwise(1.0))
