"""Operators with memory as Structured Streaming: samples (signal_id, i, x) in, results out.

Samples may arrive in any order; each key buffers those that are ahead of the next index and works
on gapless runs only, so a replayed micro-batch gives the same results. Of samples with equal i the first
counts. The state of a key is the next index, what waits, the length if it is known, and the operator's
memory as one array of numbers.

Lost samples. When more than ``patience`` samples wait behind a missing one, it is taken as 0 (and is too
late if it still comes). This depends on the data alone, so results can be replayed, and it bounds the
state: by ``patience``, the block length and the filter order. With ``timeout`` (milliseconds) a key
that gets nothing for so long also stops waiting.

End of a signal. A row with a null x says that the signal ends before i. When all samples before are
there (or given up), operators that still owe results for a complete signal (blocks: floor(len / H) + 1 of
them, the last ones padded with zeros) give them; later rows of the signal are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import kernels as K

STATE = "next bigint, wait_i array<bigint>, wait_x array<double>, memory array<double>, total bigint"
#: Samples that wait for a missing one.
PATIENCE = 1 << 16
#: Samples, or zeros in the place of lost ones, that a step works on at a time.
FILL = 1 << 16

#: step(memory, samples, index of the first sample) -> (memory, rows of the output without the key)
Step = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, list[tuple]]]
#: finish(memory, length of the signal) -> rows of the output without the key
Finish = Callable[[np.ndarray, int], list[tuple]]


def run(samples: DataFrame, step: Step, columns: str, finish: Finish | None = None, patience: int = PATIENCE, timeout: int | None = None) -> DataFrame:
    """Applies a step to the gapless runs of each signal. ``columns``: DDL of what the step gives."""
    kind = dict(samples.dtypes)["signal_id"]
    names = ["signal_id", *(c.strip().split(" ")[0] for c in columns.split(","))]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, wi, wx, memory, total = state.get if state.exists else (0, [], [], [], -1)
        memory = np.array(memory, dtype=float)
        frame = lambda rows: pd.DataFrame([(key[0], *r) for r in rows], columns=names)
        i, x = np.array(wi, dtype=np.int64), np.array(wx, dtype=float)
        if state.hasTimedOut:
            give_up = 0
        else:
            give_up, closed = patience, total >= 0
            more = [(i, x)]  # two numbers a sample are all that is held of a micro-batch
            for got in batches:
                gi, gx = got["i"].to_numpy(np.int64), got["x"].to_numpy(float)
                ends = got["x"].isna().to_numpy()
                if ends.any() and not closed:
                    total = max(total, int(gi[ends].max()))
                more.append((gi[~ends], gx[~ends]))
            i, x = (np.concatenate(v) for v in zip(*more, strict=True))
            del more
            if (i[1:] <= i[:-1]).any():
                i, first = np.unique(i, return_index=True)
                x = x[first]
        inside = (i >= at) & ((total < 0) | (i < total))
        i, x = i[inside], x[inside]
        while True:
            n = int(np.argmax(np.append(i != at + np.arange(len(i)), True)))
            for lo in range(0, n, FILL):  # results leave in slices
                memory, rows = step(memory, x[lo : min(lo + FILL, n)], at + lo)
                if rows:
                    yield frame(rows)
            at, i, x = at + n, i[n:], x[n:]
            stop = int(i[0]) if len(i) else total
            if at >= stop or len(i) <= give_up and not (state.hasTimedOut and stop > at):
                break
            while at < stop:
                zeros = np.zeros(min(FILL, stop - at))
                memory, rows = step(memory, zeros, at)
                if rows:
                    yield frame(rows)
                at += len(zeros)
        if 0 <= total <= at < 1 << 62:
            if finish is not None and (len(memory) or not total):
                rows = finish(memory, total)
                if rows:
                    yield frame(rows)
            memory = np.empty(0)
            i, x, at = i[:0], x[:0], 1 << 62  # closed
        state.update((at, i.tolist(), x.tolist(), memory.tolist(), total))
        if timeout is not None and at < 1 << 62:
            state.setTimeoutDuration(timeout)

    wait = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    return samples.groupBy("signal_id").applyInPandasWithState(update, f"signal_id {kind}, {columns}", STATE, "append", wait)


# --- steps ----------------------------------------------------------------------------------------


def block_step(block: int, hop: int, fn: Callable[[np.ndarray, np.ndarray, int], tuple] | None = None) -> Step:
    """Complete blocks; with ``fn(block, block before, number)`` its results instead of the samples.

    The memory is the block before followed by the samples that the next blocks still need.
    """

    def step(memory, x, at):
        before, held = (memory[:block], memory[block:]) if len(memory) else (np.zeros(block), np.zeros(0))
        held = np.concatenate([held, x])
        start = at + len(x) - len(held)
        rows = []
        while len(held) >= block:
            b, n = held[:block], start // hop
            rows.append((n, *fn(b, before, n)) if fn else (n, b.tolist()))
            before, held, start = b, held[hop:], start + hop
        return np.concatenate([before, held]), rows

    return step


def block_finish(block: int, hop: int, fn: Callable[[np.ndarray, np.ndarray, int], tuple] | None = None) -> Finish:
    """The blocks that are left at the end of a signal, padded with zeros."""

    def finish(memory, total):
        before, held = (memory[:block], memory[block:]) if len(memory) else (np.zeros(block), np.zeros(0))
        rows = []
        for n in range((total - len(held)) // hop, total // hop + 1):
            b = np.pad(held[:block], (0, max(0, block - len(held))))
            rows.append((n, *fn(b, before, n)) if fn else (n, b.tolist()))
            before, held = b, held[hop:]
        return rows

    return finish


def _blockwise(samples: DataFrame, block: int, hop: int, columns: str, fn=None, **policy) -> DataFrame:
    return run(samples, block_step(block, hop, fn), columns, block_finish(block, hop, fn), **policy)


def blocks(samples: DataFrame, block: int, hop: int, **policy) -> DataFrame:
    return _blockwise(samples, block, hop, "block_idx bigint, x array<double>", **policy)


def _pair(fn):
    return lambda b, before, n: (float(fn(K.magnitude(b[None, :]), K.magnitude(before[None, :]))[0]),)


def flux(samples: DataFrame, block: int, hop: int, **policy) -> DataFrame:
    return _blockwise(samples, block, hop, "block_idx bigint, value double", _pair(K.spectral_flux), **policy)


def novelty(samples: DataFrame, block: int, hop: int, kind: str = "Flux", **policy) -> DataFrame:
    from ..operators.music import NOVELTY

    fn = lambda m, p: NOVELTY[kind](2 * m, 2 * p)
    return _blockwise(samples, block, hop, "block_idx bigint, value double", _pair(fn), **policy)


def instantaneous_frequency(samples: DataFrame, block: int, hop: int, rate: float, **policy) -> DataFrame:
    def fn(b, before, n):
        return (K.instantaneous_frequency(K.spectrum(b[None, :]), K.spectrum(before[None, :]), hop, rate)[0].tolist(),)

    return _blockwise(samples, block, hop, "block_idx bigint, inst_hz array<double>", fn, **policy)


def fingerprints(samples: DataFrame, block: int, hop: int, rate: float, **policy) -> DataFrame:
    def fn(b, before, n):
        now, last = (K.fingerprint_differences(K.magnitude(v[None, :]), rate) for v in (b, before))
        return (int(K.fingerprint_words(now, last)[0]),)

    return _blockwise(samples, block, hop, "block_idx bigint, word bigint", fn, **policy)


def iir(samples: DataFrame, b, a, **policy) -> DataFrame:
    order = max(len(a), len(b)) - 1

    def step(memory, x, at):
        y, s = K.iir(b, a, x[None, :], memory[None, :] if len(memory) else np.zeros((1, order)), with_state=True)
        return s[0], [(at + k, float(v)) for k, v in enumerate(y[0])]

    return run(samples, step, "i bigint, y double", **policy)


def single_pole(samples: DataFrame, tau: float, rate: float, **policy) -> DataFrame:
    alpha = K.single_pole_alpha(tau, rate)
    return iir(samples, (1 - alpha,), (1.0, -alpha), **policy)


def moving_average(samples: DataFrame, size: int, **policy) -> DataFrame:
    def step(memory, x, at):
        held = np.concatenate([memory if len(memory) else np.zeros(size - 1), x])
        y = np.convolve(held, np.ones(size), "valid") / size
        return held[len(held) - (size - 1) :], [(at + k, float(v)) for k, v in enumerate(y)]

    return run(samples, step, "i bigint, y double", **policy)


def peak_meter(samples: DataFrame, rate: float, **policy) -> DataFrame:
    def step(memory, x, at):
        y, s = K.peak_meter(x, rate, float(memory[0]) if len(memory) else 0.0)
        return np.array([s]), [(at + k, float(v)) for k, v in enumerate(y)]

    return run(samples, step, "i bigint, y double", **policy)


def rms_meter(samples: DataFrame, rate: float, tau: float = 0.3, **policy) -> DataFrame:
    """Root of the single-pole mean of squares, sample by sample."""
    alpha = K.single_pole_alpha(tau, rate)

    def step(memory, x, at):
        y, s = K.iir((1 - alpha,), (1.0, -alpha), (x * x)[None, :], memory[None, :] if len(memory) else np.zeros((1, 1)), with_state=True)
        return s[0], [(at + k, float(v)) for k, v in enumerate(np.sqrt(np.maximum(y[0], 0)))]

    return run(samples, step, "i bigint, y double", **policy)


def delay(samples: DataFrame, by: float, **policy) -> DataFrame:
    """A ring buffer as a delay line: the value ``by`` samples ago, linear between neighbours, zeros before the start."""
    whole = int(np.floor(by))
    frac, size = by - whole, whole + 1

    def step(memory, x, at):
        held = np.concatenate([memory if len(memory) else np.zeros(size), x])
        near, far = held[size - whole : size - whole + len(x)], held[: len(x)]
        return held[len(held) - size :], [(at + k, float(v)) for k, v in enumerate((1 - frac) * near + frac * far)]

    return run(samples, step, "i bigint, y double", **policy)


def gammatone(samples: DataFrame, centre: float, rate: float, **policy) -> DataFrame:
    """One band; the same, sample by sample, as filtering the whole signal."""

    def step(memory, x, at):
        states = None if not len(memory) else [m[None, :] for m in memory.reshape(4, 2)]
        y, s = K.gammatone(x[None, :], centre, rate, states, with_state=True)
        return np.concatenate([v[0] for v in s]), [(at + k, float(v)) for k, v in enumerate(y[0])]

    return run(samples, step, "i bigint, y double", **policy)


# --- event time ------------------------------------------------------------------------------------


def windowed_levels(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", key: str = "user_id", value: str = "value") -> DataFrame:
    """Mean, RMS and count per key and event-time window, with a watermark for late rows."""
    from pyspark.sql import functions as F

    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.avg(value).alias("mean"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "rms", "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    from pyspark.sql import functions as F

    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
