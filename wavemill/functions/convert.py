"""Pitch and frequency scales, as Column functions and as Spark SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Each scale: SQL of f (Hz) and of its inverse in v. Fixed formulas of the published scales.
MEL = {
    "fant": ("1000D * log2(1D + f / 1000D)", "1000D * (power(2D, v / 1000D) - 1D)"),
    "shaughnessy": ("2595D * log10(1D + f / 700D)", "700D * (power(10D, v / 2595D) - 1D)"),
    "umesh": ("f / (0.00024D * f + 0.741D)", "v * 0.741D / (1D - v * 0.00024D)"),
}
BARK = {
    "schroeder": ("7D * asinh(f / 650D)", "650D * sinh(v / 7D)"),
    "terhardt": ("13.3D * atan(0.75D * f / 1000D)", "1000D / 0.75D * tan(v / 13.3D)"),
    "zwicker": ("13D * atan(0.76D * f / 1000D) + 3.5D * atan(f / 7500D)", "-1D"),
    "traunmuller": ("26.81D / (1D + 1960D / f) - 0.53D", "1960D / (26.81D / (v + 0.53D) - 1D)"),
}


def _scale(table: dict, kind: str, which: int, name: str, c: str) -> Column:
    """c: a column name or SQL text."""
    if kind not in table:
        raise ValueError(f"unknown scale {kind!r}; known are {', '.join(table)}")
    return F.expr(re.sub(rf"\b{name}\b", f"({c})", table[kind][which]))


def hz_to_mel(c: str, kind: str = "fant") -> Column:
    return _scale(MEL, kind, 0, "f", c)


def mel_to_hz(c: str, kind: str = "fant") -> Column:
    return _scale(MEL, kind, 1, "v", c)


def hz_to_bark(c: str, kind: str = "schroeder") -> Column:
    return _scale(BARK, kind, 0, "f", c)


def bark_to_hz(c: str, kind: str = "schroeder") -> Column:
    """The Zwicker scale has no closed inverse: -1."""
    return _scale(BARK, kind, 1, "v", c)


def hz_to_midi(c, a4: float = 440.0) -> Column:
    return F.lit(69.0) + 12 * F.log2(_col(c) / a4)


def midi_to_hz(c, a4: float = 440.0) -> Column:
    return F.lit(a4) * F.pow(F.lit(2.0), (_col(c) - 69) / 12)


def hz_to_bin(c, fft_length: int, fs: float) -> Column:
    return _col(c) * fft_length / fs


def bin_to_hz(c, fft_length: int, fs: float) -> Column:
    return _col(c) * fs / fft_length


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: SQL functions: name -> (parameters, result type, body). Spark inlines them into the plan.
SQL_FUNCTIONS = {
    **{f"hz_to_mel_{k}": ("f DOUBLE", "DOUBLE", v[0]) for k, v in MEL.items()},
    **{f"mel_to_hz_{k}": ("v DOUBLE", "DOUBLE", v[1]) for k, v in MEL.items()},
    **{f"hz_to_bark_{k}": ("f DOUBLE", "DOUBLE", v[0]) for k, v in BARK.items()},
    **{f"bark_to_hz_{k}": ("v DOUBLE", "DOUBLE", v[1]) for k, v in BARK.items()},
    "hz_to_midi": ("f DOUBLE", "DOUBLE", "69D + 12D * log2(f / 440D)"),
    "midi_to_hz": ("v DOUBLE", "DOUBLE", "440D * power(2D, (v - 69D) / 12D)"),
    "hz_to_bin": ("f DOUBLE, fft_length INT, fs DOUBLE", "DOUBLE", "f * fft_length / fs"),
    "bin_to_hz": ("k DOUBLE, fft_length INT, fs DOUBLE", "DOUBLE", "k * fs / fft_length"),
    "round_half_away": ("v DOUBLE", "BIGINT", "cast(round(v) AS BIGINT)"),
    "is_pow2": ("n BIGINT", "BOOLEAN", "(n & (n - 1)) = 0"),
    "next_pow2": ("n BIGINT", "BIGINT", "CASE WHEN n <= 0 THEN 0 ELSE cast(power(2D, ceil(log2(n))) AS BIGINT) END"),
    "array_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "array_total": ("a ARRAY<DOUBLE>", "DOUBLE", "aggregate(a, 0D, (s, x) -> s + x)"),
    "array_euclidean": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))"),
    "array_manhattan": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> abs(x - y)), 0D, (s, x) -> s + x)"),
    "word_distance": ("a BIGINT, b BIGINT", "INT", "bit_count(a ^ b)"),
    "signal_blocks": ("x ARRAY<DOUBLE>, b INT, h INT", "ARRAY<ARRAY<DOUBLE>>", "transform(sequence(0, cast(size(x) div h as int)), n -> slice(concat(x, array_repeat(0D, b)), n * h + 1, b))"),
}


@F.udtf(returnType="block_idx bigint, x array<double>")
class SignalBlockRows:
    """Table function: the blocks of a sample array as rows; ``LATERAL signal_block_rows(samples, block, hop)``."""

    def eval(self, samples, block: int, hop: int):
        if not 0 < hop <= block:
            raise ValueError("0 < hop <= block is required")
        if samples is not None:
            for n in range(len(samples) // hop + 1):
                part = [float(v or 0) for v in samples[n * hop : n * hop + block]]
                yield n, part + [0.0] * (block - len(part))


def register(spark: SparkSession) -> list[str]:
    """Makes the functions and the table function ``signal_block_rows`` known to Spark SQL in this session; returns the names of the functions."""
    spark.udtf.register("signal_block_rows", SignalBlockRows)
    for name, (params, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body}")
    return list(SQL_FUNCTIONS)
