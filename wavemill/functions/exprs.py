"""Column expressions on arrays, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def bind(value: Column, fn) -> Column:
    """fn(value) with value computed once, also where fn uses it within a lambda (a plain reference would be inlined there)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def total(a) -> Column:
    """Sum of the elements."""
    return F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: x * y))


def places(a) -> Column:
    """0 .. size - 1 as an array; empty for an empty array."""
    n = F.size(col(a))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


# --- element-wise -----------------------------------------------------------------------------


def add(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def add_scaled(a, b, w: float) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + F.lit(w) * y)


def add_constant(a, c) -> Column:
    return F.transform(col(a), lambda x: x + c)


def subtract(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def subtract_scaled(a, b, w: float) -> Column:
    return add_scaled(a, b, -w)


def multiply(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x * y)


def scale(a, c) -> Column:
    return F.transform(col(a), lambda x: x * c)


def divide(a, b) -> Column:
    """Element-wise; null where the divisor is 0."""
    return F.zip_with(col(a), col(b), F.try_divide)


def zero_below(a, threshold: float) -> Column:
    return F.transform(col(a), lambda x: F.when(x < threshold, F.lit(0.0)).otherwise(x))


def flip(a) -> Column:
    return F.reverse(col(a))


def moved(a, to: int, at: int, n: int) -> Column:
    """The array with n elements from place ``at`` copied over those from place ``to``."""
    return F.concat(F.slice(col(a), 1, to), F.slice(col(a), at + 1, n), F.slice(col(a), to + n + 1, F.greatest(F.size(col(a)) - to - n, F.lit(0))))


def filled(value: float, n: int) -> Column:
    return F.array_repeat(F.lit(float(value)), n)


# --- reductions --------------------------------------------------------------------------------


def mean(a) -> Column:
    return F.try_divide(total(a), F.size(col(a)))


def mean_square(a) -> Column:
    return F.try_divide(dot(a, a), F.size(col(a)))


def rms(a) -> Column:
    return F.sqrt(mean_square(a))


def variance(a) -> Column:
    """Of the population, in one pass over the running count, mean and squared deviations."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(s, x):
        n = s["n"] + 1
        at = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), at.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - at)).alias("m2"))

    return F.aggregate(col(a), start, step, lambda s: F.try_divide(s["m2"], s["n"]))


def std(a) -> Column:
    return F.sqrt(variance(a))


def absolute(a) -> Column:
    return F.transform(col(a), F.abs)


def maximum(a, of_absolute: bool = False) -> Column:
    return F.array_max(absolute(a) if of_absolute else col(a))


def minimum(a, of_absolute: bool = False) -> Column:
    return F.array_min(absolute(a) if of_absolute else col(a))


def argmax(a) -> Column:
    """Place of the first maximum, -1 for an empty array."""
    return F.coalesce(F.array_position(col(a), F.array_max(col(a))) - 1, F.lit(-1)).cast("int")


def argmin(a) -> Column:
    return F.coalesce(F.array_position(col(a), F.array_min(col(a))) - 1, F.lit(-1)).cast("int")


def peaks(a, threshold: float = 0.0) -> Column:
    """Flags of strict local maxima above the threshold; the ends are none."""
    n = F.size(col(a))
    return F.transform(
        col(a),
        lambda x, i: F.when((i > 0) & (i < n - 1), (x > threshold) & (x > F.get(col(a), i - 1)) & (x > F.get(col(a), i + 1))).otherwise(F.lit(False)),
    )


def sorted_with_places(a, descending: bool = False) -> Column:
    """Array of (value, place); equal values keep their order."""
    pairs = F.transform(col(a), lambda x, i: F.struct((-x if descending else x).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: F.struct((-p["v"] if descending else p["v"]).alias("v"), p["i"].alias("i")))


def ring_get(a, pos) -> Column:
    """Value at a fractional place of a ring: linear between neighbours, wrapping around at both ends."""
    lo, n = F.floor(col(pos)), F.size(col(a))
    frac = col(pos) - lo
    return (1 - frac) * F.get(col(a), F.pmod(lo, n).cast("int")) + frac * F.get(col(a), F.pmod(lo + 1, n).cast("int"))


# --- distances ---------------------------------------------------------------------------------


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(col(a), col(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a, b) -> Column:
    return total(F.zip_with(col(a), col(b), lambda x, y: F.abs(x - y)))


def cosine(a, b) -> Column:
    """1 - cos; null if one vector is zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


# --- words -------------------------------------------------------------------------------------


def word_from_floats(a) -> Column:
    """Bit b + 1 of the word is set where element b is positive, for b up to 30."""
    return F.aggregate(
        F.transform(F.slice(col(a), 1, 31), lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i + 1).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x
    )


def floats_from_word(word) -> Column:
    """32 values of 1 and -1; the last is always -1, as its bit is beyond the word."""
    w = col(word)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.when((b < 31) & (F.pmod(F.floor(w / F.pow(F.lit(2.0), b + 1)), F.lit(2)) == 1), F.lit(1.0)).otherwise(F.lit(-1.0)))


def hamming(a, b) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))
