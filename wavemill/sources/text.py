"""Text sinks in the layouts of the command-line tools: matrices, time series and single columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def matrix_lines(df: DataFrame, value: str, key: str = "signal_id", order: str = "block_idx") -> DataFrame:
    """(signal_id, row, value): one tab-separated line per dimension, one column per block."""
    cells = df.select(key, order, F.posexplode(value).alias("row", "v"))
    lines = cells.groupBy(key, "row").agg(F.array_sort(F.collect_list(F.struct(order, "v"))).alias("c"))
    return lines.select(key, "row", F.concat_ws("\t", F.transform("c", lambda p: p["v"].cast("string"))).alias("value"))


def _write(lines: DataFrame, order: list[str], path: str, together: bool) -> None:
    lines = lines.repartition("signal_id").sortWithinPartitions("signal_id", *order)
    if not together:
        lines.select("signal_id", "value").write.partitionBy("signal_id").mode("overwrite").text(path)
        return
    name = F.coalesce(F.col("signal_id").cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))  # as in a folder's name
    name = F.when(name.rlike("[\t\r\n]"), F.raise_error(F.lit("the name of a signal has a tab or a line's end")).cast("string")).otherwise(name)
    lines.select(F.concat(name, F.lit("\t"), F.coalesce("value", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_matrix(df: DataFrame, value: str, path: str, together: bool = False) -> None:
    """One folder per signal; the lines of a signal are in order within its one file. See ``read_together`` for ``together``."""
    _write(matrix_lines(df, value), ["row"], path, together)


def write_series(df: DataFrame, value: str, path: str, time: str = "t_s", together: bool = False) -> None:
    """``time <tab> value`` per block."""
    _write(df.select("signal_id", time, F.concat_ws("\t", F.col(time).cast("string"), F.col(value).cast("string")).alias("value")), [time], path, together)


def hex_word(word: str = "word") -> Column:
    return F.lower(F.hex(word))


def write_column(df: DataFrame, value: Column, path: str, order: str = "block_idx", together: bool = False) -> None:
    _write(df.select("signal_id", order, value.cast("string").alias("value")), [order], path, together)


def read_together(spark: SparkSession, path: str) -> DataFrame:
    """(signal_id, value) of what was written with ``together``.

    That is for many signals: one folder each would be as many files, which the driver renames and lists one by one.
    Instead each task writes one file of whole signals, and the signal's name and a tab lead every line.
    """
    name = F.substring_index("value", "\t", 1)
    return spark.read.text(path).select(F.when(name != "__HIVE_DEFAULT_PARTITION__", name).alias("signal_id"), F.expr("substring(value, instr(value, '\t') + 1)").alias("value"))
