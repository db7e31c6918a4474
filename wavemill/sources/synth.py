"""Test signals as DataFrames (i, x), made from spark.range."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _samples(spark: SparkSession, n: int, x) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), x.cast("double").alias("x"))


def sine(spark: SparkSession, freq: float, rate: float, n: int, amplitude: float = 1.0, phase: float = 0.0) -> DataFrame:
    return _samples(spark, n, F.lit(amplitude) * F.sin(F.lit(2 * math.pi * freq / rate) * F.col("id") + phase))


def square(spark: SparkSession, freq: float, rate: float, n: int, amplitude: float = 1.0) -> DataFrame:
    """High for the first half of each period, by whole samples of the period."""
    period = int(rate / freq + 0.5)
    return _samples(spark, n, F.when(F.col("id") % period < period // 2, amplitude).otherwise(-amplitude))


def saw(spark: SparkSession, freq: float, rate: float, n: int, amplitude: float = 1.0) -> DataFrame:
    """Rises from 0 by 2 * amplitude per period and wraps at the amplitude."""
    step = 2 * amplitude * freq / rate
    return _samples(spark, n, F.pmod(F.col("id") * step + amplitude, F.lit(2 * amplitude)) - amplitude)


def dc(spark: SparkSession, n: int, amplitude: float = 1.0) -> DataFrame:
    return _samples(spark, n, F.lit(amplitude))


def noise(spark: SparkSession, n: int, amplitude: float = 1.0, only_positive: bool = True, seed: int = 1) -> DataFrame:
    u = F.rand(seed)
    return _samples(spark, n, amplitude * (u if only_positive else 2 * u - 1))


def as_signal(samples: DataFrame, signal_id: str, rate: float) -> DataFrame:
    """One row (signal_id, sample_rate, samples) of a short sample table."""
    return samples.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select(F.lit(signal_id).alias("signal_id"), F.lit(float(rate)).alias("sample_rate"), F.transform("s", lambda p: p["x"]).alias("samples"))
