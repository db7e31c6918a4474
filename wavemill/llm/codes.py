"""Vector code compression: product quantisation with integer Lloyd rounds, entries found by Exponion search.

Components become floor(1024 * x) and each vector is cut into PARTS consecutive parts. The codebook of a part
starts with that part of the vectors with the smallest ids, ascending. In every round each part goes to its nearest
entry (squared Euclidean distance, ties to the lower index), and each used entry becomes the componentwise
floor(sum / count) of its parts; unused entries stay. A last assignment gives the codes.

The nearest entry is searched from the entry of the round before (the first one in the first round): entries
lie sorted by their distance from it, and with D the squared distance of the part to it, only entries within
a squared distance of 4 D of it can be as near, by the triangle inequality. All of these are looked at, none
beyond. Distances are exact integers.

A round is one pass over the vectors, which lie with their codes in a written table that the next round reads;
tasks add up the parts of each entry, and only the sums of the codebooks' size (and as many counts) come to the
driver. The codebooks are broadcast: at most 256 entries of the vectors' length.

Vectors that are null or hold null or non-finite components take no part and have no row. Null ids come after all
others, so they start no entry unless there are too few ids; of equal ids the smaller vector comes first, and
repeated rows are entries of their own (of equal entries the lower index is used). With fewer vectors than entries
the codebooks are as small as that. The length of vectors is that of the first entry; a kept vector of another length
has null results. A length that the parts do not divide makes the first parts one longer. With components of
2**13 and more, or more than 2**14 of them, four times a squared distance may not fit 64 bits; they raise an error. Labels may be null, which
makes up a label of its own, and of any simple type. An empty table gives no rows. Columns beyond the three
named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Distances that are computed at once.
BLOCK = 1 << 20


class Book:
    """One part's codebook with the entries sorted by distance from each entry."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        apart = ((self.entries[:, None, :] - self.entries[None, :, :]) ** 2).sum(2)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.order, 1)

    def nearest(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each row, its squared distance, and how many entries were looked at in all."""
        code, dist, looked = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        by = np.argsort(start, kind="stable")
        edges = np.searchsorted(start[by], np.arange(len(self.entries) + 1))
        for a in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            rows = by[edges[a] : edges[a + 1]]
            radius = 4 * ((x[rows] - self.entries[a]) ** 2).sum(1)
            inside = np.searchsorted(self.apart[a], radius, side="right")
            rows, inside = rows[o := np.argsort(inside, kind="stable")], inside[o]
            at = 0
            while at < len(rows):
                # rows whose lists are up to twice as long as this row's go together, as many as fit
                most = int(inside[at]) * 2
                to = int(np.searchsorted(inside, most, side="right"))
                to = min(to, at + max(1, BLOCK // max(1, most * x.shape[1])))
                most = int(inside[to - 1])
                some = np.sort(self.order[a, :most])  # by index, so that the first smallest is the lowest
                d = ((x[rows[at:to], None, :] - self.entries[None, some, :]) ** 2).sum(2)
                best = d.argmin(1)
                code[rows[at:to]], dist[rows[at:to]] = some[best], d[np.arange(to - at), best]
                looked += most * (to - at)
                at = to
        return code, dist, looked


def cuts(length: int) -> list[int]:
    """Where the parts begin and end."""
    return [sum(length // PARTS + (k < length % PARTS) for k in range(p)) for p in range(PARTS + 1)]


def scaled(vector: str) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))


def _kept(vectors: DataFrame) -> DataFrame:
    whole = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")))
    small = F.forall("embedding", lambda v: F.abs(v.cast("double")) < float(1 << 13)) & (F.size("embedding") <= 1 << 14)
    kept = vectors.where(F.col("embedding").isNotNull() & whole)
    x = F.when(small, scaled("embedding")).otherwise(F.raise_error(F.concat(F.lit("too large or too many components in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))))
    return kept.select("vec_id", "label", x.alias("x"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("array<long>").alias("errors"))


def _assigned(rows: DataFrame, books: list[Book], length: int) -> DataFrame:
    """``rows`` with new codes (a byte a part) and errors; those of another length without."""
    edges = cuts(length)
    held = rows.sparkSession.sparkContext.broadcast(books)
    ddl = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            fit = np.array([len(v) == length for v in x], bool)
            if not fit.all():
                other = batch.filter(pa.array(~fit))
                yield other
                batch = batch.filter(pa.array(fit))
                x = batch.column("x")
            m = batch.num_rows
            if not m:
                continue
            values = x.flatten().to_numpy(zero_copy_only=False).reshape(m, length)
            old = batch.column("codes").to_pylist()
            start = np.zeros((m, PARTS), np.int64) if old[0] is None else np.frombuffer(b"".join(old), np.uint8).reshape(m, PARTS).astype(np.int64)
            found = [book.nearest(values[:, edges[p] : edges[p + 1]], start[:, p]) for p, book in enumerate(held.value)]
            codes = np.stack([c for c, _, _ in found], 1).astype(np.uint8)
            errors = np.stack([d for _, d, _ in found], 1)
            new = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "errors": pa.array(errors.tolist(), pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, ddl)


def _sums(rows: DataFrame, length: int) -> list:
    """(part, entry, place, n, s) over all rows, added up within tasks first; at most ENTRIES * length rows."""
    edges = cuts(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((PARTS, ENTRIES), np.int64), np.zeros((ENTRIES, length), np.int64)
        for batch in batches:
            m = batch.num_rows
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(m, PARTS)
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(m, length)
            for p in range(PARTS):
                n[p] += np.bincount(codes[:, p], minlength=ENTRIES)
                np.add.at(s[:, edges[p] : edges[p + 1]], codes[:, p], values[:, edges[p] : edges[p + 1]])
        for p in range(PARTS):
            used, width = np.flatnonzero(n[p]), edges[p + 1] - edges[p]
            if len(used) and width:
                cols = [np.full(len(used) * width, p), np.repeat(used, width), np.tile(np.arange(width), len(used)), np.repeat(n[p][used], width), s[used, edges[p] : edges[p + 1]].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["part", "entry", "place", "n", "s"])

    found = rows.where("codes is not null").select("x", "codes").mapInArrow(run, "part long, entry long, place long, n long, s long")
    return found.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()


def codebooks_digest(books: list[Book]) -> str:
    return sha256(",".join(str(v) for b in books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[Book]]:
    """The kept vectors (vec_id, label, x, codes, errors) by the final codebooks, and these."""
    spark = vectors.sparkSession
    folder = scratch(spark)
    rows = written(_kept(vectors), folder, "round0")
    first = rows.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(ENTRIES).collect()
    length = len(first[0]["x"]) if first else 0
    first, edges = [r["x"] for r in first if len(r["x"]) == length], cuts(length)
    entries = np.array(first, np.int64).reshape(len(first), length)
    books = [Book(entries[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for k in range(rounds + 1 if first else 0):
        rows = written(_assigned(rows, books, length), folder, f"round{k + 1}")
        discard(spark, folder, f"round{k}")
        if k < rounds:
            new = [b.entries.copy() for b in books]
            for r in _sums(rows, length):
                new[r["part"]][r["entry"], r["place"]] = r["s"] // r["n"]
            books = [Book(e) for e in new]
    return rows, books


def compress(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each kept row of (vec_id, embedding, label)."""
    rows, books = train(vectors.select("vec_id", "embedding", "label"))
    error = F.aggregate("errors", F.lit(0).cast("long"), lambda a, b: a + b)
    label = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    out = rows.select("vec_id", F.lower(F.hex("codes")).alias("code"), error.alias("error"), label.alias("_label"))
    sums = out.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n"))
    joined = spread_join(out, written(sums, scratch(vectors.sparkSession), "labels"), "_label", "_n", "vec_id")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
