"""Exact top-k inner-product search by tiled matrix products.

Vectors are packed into tiles of up to TILE_ROWS rows (one binary matrix per tile, of the smallest
integers that hold it). Candidate tiles are dealt to slices, whose number grows with the number of rows,
and every slice gets its own copy of the query tiles, so neither side is broadcast, one dimension is not
one task, and no pair of rows is ever emitted. Each meeting is one matrix product in a task, of which only
the k best per query leave the task (partial selection). Then the per-query lists are merged as a tree:
within slices, then within MERGE slices, then within MERGE of those, up to the whole.

Components become floor(256 * x) with x as double; scores are exact integers (a float64 product while
all sums stay below 2^53, Python integers otherwise; scores beyond 64 bits wrap around).

Null vectors and vectors with null or non-finite components take no part. Vectors only meet vectors
of their own dimension; vectors without components score 0 with each other. Ties go to the smaller
vec_id; a vec_id that is repeated is one candidate per row, and a query never meets its own id. Query rows
that share an id are ranked together: their candidates' scores are one list. An empty table gives no
rows. Rows with a null vec_id take no part. Columns beyond vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parts

#: Rows of a tile; at 1024 dimensions a tile is 32 MB.
TILE_ROWS = 4096
#: Lists that are merged in a step of the tree.
MERGE = 16
#: Candidate tiles in a slice, once there are more slices than shuffle partitions.
SLICE_TILES = 8
#: Scores held at once in a task.
BLOCK_SCORES = 1 << 21


def _packed(rows: DataFrame, tile_rows: int) -> DataFrame:
    """(dim, tile, ids binary, bytes, comps binary): whole rows packed by tile; the tile number is a hash of the ids."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, comps = held.pop(dim)
            x, names = np.concatenate(comps), np.array(ids, np.int64).tobytes()
            small = next(t for t in (np.int16, np.int32, np.int64) if not len(x) or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
            return pa.RecordBatch.from_pydict({"dim": [dim], "tile": [xxhash.xxh3_64_intdigest(names) >> 1], "ids": [names], "bytes": [np.dtype(small).itemsize], "comps": [x.astype(small).tobytes()]}, schema=schema)

        schema = pa.schema([("dim", pa.int32()), ("tile", pa.int64()), ("ids", pa.binary()), ("bytes", pa.int32()), ("comps", pa.binary())])
        for batch in batches:
            lists = batch.column(1).to_pylist()
            for i, v in zip(batch.column(0).to_pylist(), lists, strict=True):
                if i is None or v is None or any(x is None for x in v):
                    continue
                x = np.array(v, dtype=np.float64)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.floor(256 * x)
                if not np.isfinite(x).all() or (np.abs(x) >= 2.0**63).any():
                    raise ValueError(f"vector {i} has components that do not fit 64-bit integers")
                ids, comps = held.setdefault(len(v), ([], []))
                ids.append(i)
                comps.append(x.astype(np.int64))
                if len(ids) >= tile_rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(pack, "dim int, tile long, ids binary, bytes int, comps binary")


def _products(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, c = (np.frombuffer(row[f"{n}comps"], f"<i{row[f'{n}bytes']}").astype(np.int64).reshape(len(i), dim) for n, i in (("q_", qi), ("", ci)))
                most = (float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0))) * max(dim, 1)
                if most < 2.0**53:
                    cf = c.T.astype(np.float64)
                for at in range(0, len(qi), step := max(1, BLOCK_SCORES // max(1, len(ci)))):
                    ids = qi[at : at + step]
                    s = (q[at : at + step].astype(np.float64) @ cf).astype(np.int64) if most < 2.0**53 else q[at : at + step] @ c.T
                    mine = ids[:, None] == ci[None, :]
                    found: tuple[list, list, list] = ([], [], [])
                    if len(ci) > 4 * k:  # the k-th best score of each query bounds what can leave the tile
                        low = np.where(mine, np.iinfo(np.int64).min, s)
                        floor = np.partition(low, len(ci) - k, axis=1)[:, len(ci) - k]
                        r, j = np.nonzero((s >= floor[:, None]) & ~mine)
                    else:
                        r, j = np.nonzero(~mine)
                    order = np.lexsort((ci[j], -s[r, j].astype(object) if most >= 2.0**62 else -s[r, j], r))
                    r, j = r[order], j[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    r, j = r[rank < k], j[rank < k]
                    found = (ids[r], ci[j], s[r, j])
                    yield pa.RecordBatch.from_pydict({"query_id": found[0], "slice": np.full(len(r), row["slice"]), "vec_id": found[1], "score": found[2]}, schema=pa.schema([("query_id", pa.int64()), ("slice", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, tile_rows: int = TILE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query. Both inputs: (vec_id, embedding)."""
    both = [_packed(x.select(F.col("vec_id").cast("long"), "embedding"), tile_rows) for x in (queries, vectors)]
    tiles = -(-vectors.count() // tile_rows)
    slices = max(1, min(tiles, max(parts(vectors), -(-tiles // SLICE_TILES))))
    q = both[0].withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("dim", "slice", F.col("ids").alias("q_ids"), F.col("bytes").alias("q_bytes"), F.col("comps").alias("q_comps"))
    met = both[1].withColumn("slice", F.pmod(F.xxhash64("tile"), F.lit(slices)).cast("int")).join(q, ["dim", "slice"])
    best = met.mapInArrow(_products(k), "query_id long, slice long, vec_id long, score long")
    while slices > 1:
        best = _best(best, ["query_id", "slice"], k).withColumn("slice", F.expr(f"slice div {MERGE}"))
        slices = -(-slices // MERGE)
    return _best(best, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return lists.withColumn("rank", rank).where(F.col("rank") <= k)
