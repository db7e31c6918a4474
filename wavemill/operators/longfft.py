"""Transforms and correlations of signals that are longer than a task: columns, twiddles, exchange, rows.

A signal of n = p * q values is a matrix of p rows and q columns. A task transforms some of its columns, turns them by the
twiddles, and sends each task of the second step its part of the rows; rows transformed give the bins. Tasks hold about
TASK values, or one column or row of the square root of n if that is more. Two exchanges move every value once each.

Signals and spectra are pieces (signal_id, at, re, im): values that follow each other from place ``at``. Places without a piece are
zero, so are null values, of pieces that overlap the sum counts, and rows without a signal or a place take no part. A place beyond n is an error. An empty
table gives no rows. Forward transforms are divided by n, as those of blocks are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a task in each of the two steps.
TASK = 1 << 20


def pieces_of_chunks(chunks: DataFrame, chunk: int) -> DataFrame:
    """Of (signal_id, chunk_idx, samples) with ``chunk`` samples in each but the last."""
    x = F.col("samples").cast("array<double>")
    return chunks.select("signal_id", (F.col("chunk_idx").cast("long") * chunk).alias("at"), x.alias("re"), F.transform(x, lambda v: F.lit(0.0)).alias("im"))


def length(pieces: DataFrame, least: int = 4) -> int:
    """The power of two that holds every signal of the table."""
    end = pieces.agg(F.max(F.col("at") + F.size("re"))).first()[0] or 0
    return 1 << max(2, (max(end, least) - 1).bit_length())


def _values(table, i: int) -> np.ndarray:
    part = lambda c: table.column(c)[i].values.fill_null(0.0).to_numpy(zero_copy_only=False)
    return part("re") + 1j * part("im")


def transform(pieces: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """The pieces of the spectrum of each signal (of the signal of each spectrum, if ``inverse``); n is a power of two from 4 on."""
    if n < 4 or n & (n - 1):
        raise ValueError("the length must be a power of two from 4 on")
    p = 1 << (n.bit_length() // 2)
    q = n // p
    wide, tall = max(1, min(q, TASK // p)), max(1, min(p, TASK // q))
    sign = 1 if inverse else -1
    source = pieces.select("signal_id", F.col("at").cast("long").alias("at"), F.col("re").cast("array<double>").alias("re"), F.col("im").cast("array<double>").alias("im")).where("signal_id is not null and at is not null and re is not null and im is not null")
    kind = dict(source.dtypes)["signal_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each piece at the borders of the column groups."""
        for batch in batches:
            for i, at in enumerate(batch.column("at").to_pylist()):
                v = _values(batch, i)
                if at < 0 or at + len(v) > n:
                    raise ValueError("a value lies outside of the signal")
                edges = [at, *range((at // wide + 1) * wide, at + len(v), wide), at + len(v)] if len(v) else []
                spans = list(zip(edges[:-1], edges[1:], strict=True))
                if spans:
                    yield pa.RecordBatch.from_arrays([batch.column("signal_id").take(pa.array([i] * len(spans))), pa.array([a % q // wide for a, _ in spans], pa.int32()), pa.array([a for a, _ in spans], pa.int64()), pa.array([v[a - at : b - at].tobytes() for a, b in spans], pa.binary())], names=["signal_id", "g", "at", "v"])

    def repeated(table: pa.Table, count: int):
        return table.column("signal_id").combine_chunks().take(pa.array([0] * count, pa.int32()))

    def columns(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        x = np.zeros((p, wide), dtype=complex)
        for at, v in zip(table.column("at").to_pylist(), table.column("v").to_pylist(), strict=True):
            part = np.frombuffer(v, dtype=complex)
            b = at % q - g * wide
            x[at // q, b : b + len(part)] += part
        y = np.fft.fft(x, axis=0) if not inverse else np.fft.ifft(x, axis=0) * p
        # whole numbers below n keep the angles exact
        turns = np.outer(np.arange(p, dtype=np.int64), np.arange(g * wide, g * wide + wide, dtype=np.int64)) % n
        y *= np.exp(sign * 2j * np.pi * turns / n)
        count = p // tall
        return pa.table([repeated(table, count), pa.array(range(count), pa.int32()), pa.array([g] * count, pa.int32()), pa.array([np.ascontiguousarray(y[r * tall : r * tall + tall]).tobytes() for r in range(count)], pa.binary())], names=["signal_id", "r", "g", "v"])

    def rows(table: pa.Table) -> pa.Table:
        r = table.column("r")[0].as_py()
        x = np.zeros((tall, q), dtype=complex)
        for g, v in zip(table.column("g").to_pylist(), table.column("v").to_pylist(), strict=True):
            x[:, g * wide : g * wide + wide] = np.frombuffer(v, dtype=complex).reshape(tall, wide)
        y = (np.fft.ifft(x, axis=1) * q if inverse else np.fft.fft(x, axis=1) / n).T
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(q + 1, dtype=np.int32) * tall), pa.array(np.ascontiguousarray(v).ravel()))
        return pa.table([repeated(table, q), pa.array(np.arange(q, dtype=np.int64) * p + r * tall), lists(y.real), lists(y.imag)], names=["signal_id", "at", "re", "im"])

    parts = source.mapInArrow(cut, f"signal_id {kind}, g int, at long, v binary").groupBy("signal_id", "g").applyInArrow(columns, f"signal_id {kind}, r int, g int, v binary")
    return parts.groupBy("signal_id", "r").applyInArrow(rows, f"signal_id {kind}, at long, re array<double>, im array<double>")


def values(pieces: DataFrame) -> DataFrame:
    """(signal_id, k, re, im), a row for each value."""
    one = pieces.select("signal_id", "at", F.posexplode(F.arrays_zip("re", "im")).alias("j", "z"))
    return one.select("signal_id", (F.col("at") + F.col("j")).alias("k"), "z.re", "z.im")


def correlate(a: DataFrame, b: DataFrame, n: int | None = None) -> DataFrame:
    """Pieces of r[lag] = sum of a[i + lag] * b[i] of the signals that both sides hold; negative lags stand at n + lag.

    ``n`` must reach over both lengths together; without it the tables are asked. Values are real parts and imaginary remainders.
    """
    n = n or length(a, 2 * max(length(a), length(b)))
    x, y = transform(a, n), transform(b, n).select("signal_id", "at", F.col("re").alias("u"), F.col("im").alias("v"))
    mix = lambda s, t, f: F.zip_with(s, t, f)
    both = x.join(y, ["signal_id", "at"])
    real = mix(mix("re", "u", lambda s, t: s * t), mix("im", "v", lambda s, t: s * t), lambda s, t: (s + t) * float(n))
    imag = mix(mix("im", "u", lambda s, t: s * t), mix("re", "v", lambda s, t: s * t), lambda s, t: (s - t) * float(n))
    return transform(both.select("signal_id", "at", real.alias("re"), imag.alias("im")), n, inverse=True)
