"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Rows are dealt to source partitions and counted.
2. The matrix (source partition x shard) is drawn from the multivariate hypergeometric law with the
   partition counts and the shard sizes as margins: what a uniformly random permutation of all rows
   would send from each partition to each shard. It has one number per partition and shard.
3. Every partition is permuted locally; consecutive runs of the lengths in its row go to the shards.
4. Rows are exchanged and every shard is permuted again, in ranges of the permutation key, so that
   no shard is sorted by a single task.

Shard sizes are at most one apart (law ``rows``). Everything on the rows is DataFrame code. The texts are
read once; equal rows are counted before they are dealt, so that a row that is repeated many times is
dealt to all partitions like any others. The matrix has at most MOST_CELLS numbers whatever the input:
beyond that, partitions grow instead of their number.

Nulls, empty texts: size 8, crc32 0. Very long texts are read whole. A null doc_id is a row like any other.
Repeated rows are rows of their own; ties of hashes are broken by the rows' values. An empty table gives
no rows. Columns beyond doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, written

#: Rows per source partition, and per range of a shard, that the sizes aim at.
ROWS_PER_PART = 25_000
#: Most numbers of the matrix, and most ranges of all shards; bounds the small joined tables (8 to 20 MB).
MOST_CELLS = 1 << 20
#: Copies of one row that are made by one step; a row with more copies is dealt over several tasks first.
COPIES = 10_000
#: numpy draws exactly below this margin.
NUMPY_MOST = 10**9


def _log_ratio(top: int, d: int) -> float:
    """log((top + d)! / top!) without loss of the small difference."""
    if top + d < 50 or top < 50:
        return math.lgamma(top + d + 1) - math.lgamma(top + 1)
    y = top + d
    # Stirling: both series, and the logarithms as one log1p
    return (top + 0.5) * math.log1p(d / top) + d * math.log(y) - d + (1 / y - 1 / top) / 12 - (1 / y**3 - 1 / top**3) / 360


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int, most: int = NUMPY_MOST) -> int:
    """How many of n draws without replacement are good, exactly, for margins of any size.

    Margins that numpy does not take are drawn by the ratio of uniforms under the hypergeometric law (fixed
    values: the two constants of the table mountain), with probabilities relative to the mode.
    """
    if not n or not good or not bad or n == good + bad:
        return min(n, good)
    if max(good, bad) < most:
        return int(rng.hypergeometric(good, bad, n))
    total, few, draws = good + bad, min(good, bad), min(n, good + bad - n)
    many = total - few
    mode = (draws + 1) * (few + 1) // (total + 2)
    p = few / total
    sd = math.sqrt(draws * p * (1 - p) * (total - draws) / (total - 1) + 0.5)
    centre, width = draws * p + 0.5, 1.7155277699214135 * sd + 0.8989161620588988
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        place = centre + width * (v - 0.5) / u
        if not 0 <= place < min(few, draws) + 1:
            continue
        x = int(place)
        d = x - mode
        log_p = -(_log_ratio(mode, d) + _log_ratio(few - mode, -d) + _log_ratio(draws - mode, -d) + _log_ratio(many - draws + mode, d))
        if 2 * math.log(u) <= log_p:
            break
    if n != draws:
        x = few - x
    return x if few == good else n - x


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Exact counts (len(counts) x len(sizes)) with these margins, as a uniform permutation makes them."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = [int(x) for x in sizes]
    out = np.zeros((len(counts), len(sizes)), dtype=np.int64)
    for i, n in enumerate(counts):
        todo, pool = int(n), sum(left)
        for j, size in enumerate(left):
            pool -= size
            out[i, j] = x = hypergeometric(rng, size, pool, todo)
            todo -= x
        left = [a - int(b) for a, b in zip(left, out[i], strict=True)]
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 20240501, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text_col, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    distinct = written(own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("n")), scratch(spark), "rows")
    total, most = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    steps = distinct.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}"))))
    if most > 100 * COPIES:
        steps = steps.repartition("doc_id", "text_crc32", "step")
    rows = steps.select(*own.columns, F.explode(F.sequence(F.expr(f"step * {COPIES}"), F.expr(f"least(n, (step + 1) * {COPIES}) - 1"))).alias("copy"))

    def draw(n: int):
        return F.xxhash64(F.lit(seed + n), "doc_id", "text_crc32", "size", "copy")

    n_parts = max(1, min(MOST_CELLS // shards, -(-total // ROWS_PER_PART)))
    rows = rows.withColumn("part", F.pmod(draw(0), F.lit(n_parts)))
    counts = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most MOST_CELLS / shards
    order = sorted(counts)
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    ends = np.cumsum(communication_matrix([counts[p] for p in order], sizes, seed), axis=1)
    matrix = spark.createDataFrame([(int(p), [int(x) for x in e]) for p, e in zip(order, ends, strict=True)], "part long, ends array<long>")
    # Ranges of the second permutation key: a row's place in its shard is its place in the range plus all lower ranges.
    n_ranges = max(1, min(MOST_CELLS // shards, -(-total // (shards * ROWS_PER_PART))))
    step = -(-(1 << 63) // n_ranges) if n_ranges > 1 else (1 << 63) - 1

    local = Window.partitionBy("part").orderBy("draw1", "doc_id", "text_crc32", "size", "copy")
    dealt = (
        rows.withColumn("draw1", draw(1))
        .withColumn("place", F.row_number().over(local))
        .join(F.broadcast(matrix), "part")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))).cast("int"))
        .withColumn("draw2", draw(2))
        .withColumn("range", F.expr(f"least(cast(shiftrightunsigned(draw2, 1) div {step}L as int), {n_ranges - 1})"))
        .select("doc_id", "size", "text_crc32", "copy", "shard", "draw2", "range")
    )
    in_range = Window.partitionBy("shard", "range").orderBy("draw2", "doc_id", "text_crc32", "size", "copy")
    placed = dealt.withColumn("in_range", F.row_number().over(in_range)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("shard", "range")))
    below = (
        placed.where("in_range = 1")
        .select("shard", "range", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    )  # at most MOST_CELLS rows
    return placed.join(F.broadcast(below), ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("before") + F.col("in_range") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
