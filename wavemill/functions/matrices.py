"""Matrices in coordinate form: rows (i, j, v). Everything is joins and aggregates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_arrays


def eye(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def constant(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    return spark.range(rows * cols).select(F.expr(f"id div {cols}").alias("i"), (F.col("id") % cols).alias("j"), F.lit(float(value)).alias("v"))


def random(spark: SparkSession, rows: int, cols: int, seed: int = 1) -> DataFrame:
    return constant(spark, rows, cols).withColumn("v", F.rand(seed))


def row(m: DataFrame, i: int) -> DataFrame:
    return m.where(F.col("i") == i)


def column(m: DataFrame, j: int) -> DataFrame:
    return m.where(F.col("j") == j)


def diagonal(m: DataFrame) -> DataFrame:
    return m.where("i = j")


def set_row(m: DataFrame, i: int, values: DataFrame) -> DataFrame:
    """``values``: (j, v)."""
    return m.where(F.col("i") != i).unionByName(values.select(F.lit(i).cast("long").alias("i"), "j", "v"))


def set_column(m: DataFrame, j: int, values: DataFrame) -> DataFrame:
    """``values``: (i, v)."""
    return m.where(F.col("j") != j).unionByName(values.select("i", F.lit(j).cast("long").alias("j"), "v"))


def zero_below(m: DataFrame, threshold: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("v") < threshold, F.lit(0.0)).otherwise(F.col("v")))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def swap_rows(m: DataFrame, a: int, b: int) -> DataFrame:
    return m.withColumn("i", F.when(F.col("i") == a, b).when(F.col("i") == b, a).otherwise(F.col("i")).cast("long"))


def rearrange_rows(m: DataFrame, order: DataFrame) -> DataFrame:
    """``order``: (i, source): row i of the result is row ``source``."""
    return order.select(F.col("i").alias("to"), F.col("source").alias("i")).join(m, "i").select(F.col("to").alias("i"), "j", "v")


def _both(a: DataFrame, b: DataFrame, fn) -> DataFrame:
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).select("i", "j", fn(F.col("v"), F.col("w")).alias("v"))


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, lambda v, w: v + w)


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, lambda v, w: v - w)


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    return _both(a, b, lambda v, w: v * w)


def divide(a: DataFrame, b: DataFrame, offset: float = 1e-30) -> DataFrame:
    return _both(a, b, lambda v, w: F.try_divide(v, w + offset))


def add_constant(m: DataFrame, c: float) -> DataFrame:
    return m.withColumn("v", F.col("v") + c)


def scale(m: DataFrame, c: float) -> DataFrame:
    return m.withColumn("v", F.col("v") * c)


def scale_column(m: DataFrame, j: int, c: float) -> DataFrame:
    return m.withColumn("v", F.when(F.col("j") == j, F.col("v") * c).otherwise(F.col("v")))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    right = b.select(F.col("i").alias("k"), F.col("j").alias("c"), F.col("v").alias("w"))
    joined = a.select("i", F.col("j").alias("k"), "v").join(right, "k")
    return joined.groupBy("i", "c").agg(F.sum(F.col("v") * F.col("w")).alias("v")).select("i", F.col("c").alias("j"), "v")


def mat_vec(a: DataFrame, x: DataFrame) -> DataFrame:
    """``x``: (j, x); gives (i, v)."""
    return a.join(x, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def vec_mat(x: DataFrame, a: DataFrame) -> DataFrame:
    """``x``: (i, x); gives (j, v)."""
    return a.join(x, "i").groupBy("j").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def outer(x: DataFrame, y: DataFrame) -> DataFrame:
    """(i, x) and (j, y): all products; by nature as many rows as their numbers multiplied."""
    return x.crossJoin(y).select("i", "j", (F.col("x") * F.col("y")).alias("v"))


def normalise_columns(m: DataFrame) -> DataFrame:
    """Columns divided by their L1 norms; zero columns stay."""
    s = F.sum(F.abs("v")).over(Window.partitionBy("j"))
    return m.withColumn("v", F.col("v") / F.when(s > 0, s).otherwise(1.0))


def total(m: DataFrame) -> DataFrame:
    return m.agg(F.sum("v").alias("total"))


def maximum(m: DataFrame) -> DataFrame:
    return m.agg(F.max("v").alias("max"))


def column_sum(m: DataFrame, j: int, absolute: bool = False) -> DataFrame:
    return column(m, j).agg(F.sum(F.abs("v") if absolute else F.col("v")).alias("total"))


def norm1(m: DataFrame) -> DataFrame:
    """The largest L1 norm of a column."""
    return m.groupBy("j").agg(F.sum(F.abs("v")).alias("n")).agg(F.max("n").alias("norm"))


def kl_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    v, w = F.col("v"), F.col("w")
    return a.join(b.select("i", "j", F.col("v").alias("w")), ["i", "j"]).agg(F.sum(v * (F.log((v + 1e-24) / (w + 1e-24)) - 1) + w).alias("kl"))


def determinants(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """``det`` and ``inv`` (row-major; null if singular) of small square matrices in row-major arrays."""

    def fn(v, fs):
        n = round(v[column].shape[1] ** 0.5)
        if n * n != v[column].shape[1]:
            raise ValueError("the matrices must be square")
        m = v[column].reshape(-1, n, n)
        det = np.linalg.det(m)
        det = np.where(np.abs(det) < 1e-30, 0.0, det)
        return {"det": det, "inv": [np.linalg.inv(x).ravel() if d else None for x, d in zip(m, det, strict=True)]}

    def run(v, fs):
        got = fn(v, fs)
        got["inv"] = [x if x is not None else np.empty(0) for x in got["inv"]]
        return got

    out = map_arrays(df.withColumn("_one", F.lit(1.0)), [column], {"det": "double", "inv": "array<double>"}, run, keep, rate="_one")
    return out.withColumn("inv", F.when(F.size("inv") > 0, F.col("inv")))
