"""Merkle dataset manifest: a digest of every row, a tree for each group, one root, and every row's proof folded back.

A row's leaf is the digest H (SHA-256, lowercase hex) of its fields in the stated order, each ``-`` if null, else
its length in UTF-8 bytes, a colon and its value. Within a group the leaves stand in the order of the row id; while
a level has several nodes, every RUN consecutive ones (fewer at the end, even one) become their H, the digests
concatenated as hex text. What remains is the group's subroot. The subroots, in the order of the groups (null first,
then bytewise), make up one more such tree with the root.

The tree is built as large blocks below and a small tree above. Rows get their places by a range sort of
(group, id, leaf) and the counts of its partitions, so that a group of any size lies over many tasks. Then a block of
RUN ** LEVELS consecutive leaves is one row: a task reduces it to its top node. Such rounds are repeated, over
nodes instead of leaves, until at most TOP_NODES are left; only these go to the driver, which builds the upper trees
and sends back, for each block, its path to the root (the digests on its left and right at each level). Each
block is then rebuilt by a task, which finishes the proofs of its rows and folds every row's leaf.

A row is altered where ``tampered`` holds, by ``changes`` to its columns; its proof stays. ``verified`` says whether
the folded root equals the root.

Null fields have the digest of ``-``. A null id stands before all others and is not tampered with unless the condition
says so (null counts as false). Rows of one group that share an id stand in the order of their leaves; repeated
rows are leaves of their own, side by side, and it makes no difference which is which. An empty text differs from a null one. Very
long texts are hashed whole by one expression. An empty table gives no rows. Columns beyond the fields are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parts, scratch, written

#: Nodes that become one.
RUN = 3
#: Levels of a block: 2,187 leaves.
LEVELS = 7
#: Nodes that the driver takes; their paths are at most some 30 MB.
TOP_NODES = 8192
#: Rows of the table of places that may be broadcast (some 50 bytes each).
PLACES = 100_000


def digest(*inputs: str) -> str:
    return sha256("".join(inputs).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's fields; integers in decimal."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text)), 256)


def levels_of(nodes: list[str], most: int | None = None) -> list[list[str]]:
    """The levels of a tree from its lowest, up to a single node or ``most`` levels above."""
    out = [nodes]
    while len(out[-1]) > 1 if most is None else len(out) <= most:
        low = out[-1]
        out.append([digest(*low[i : i + RUN]) for i in range(0, len(low), RUN)])
    return out


def path_of(levels: list[list[str]], at: int) -> tuple[list[str], list[str]]:
    """What stands left and right of node ``at`` in its run at each level."""
    left, right = [], []
    for low in levels[:-1]:
        first = at - at % RUN
        left.append("".join(low[first:at]))
        right.append("".join(low[at + 1 : first + RUN]))
        at //= RUN
    return left, right


def fold(node: str, left: list[str], right: list[str]) -> str:
    for a, b in zip(left, right, strict=True):
        node = digest(a, node, b)
    return node


def _height(n: int, levels: int) -> int:
    """Levels above a block of a tree with n nodes at the block's lowest level."""
    if n > RUN**levels:
        return levels
    k = 0
    while n > 1:
        n, k = -(-n // RUN), k + 1
    return k


def _placed(rows: DataFrame, group: str, order: list[str], folder: str, name: str) -> DataFrame:
    """``rows`` with ``pos``, the place within the group, and ``n``, the group's size."""
    p = parts(rows)
    lying = rows.withColumn("_row", F.monotonically_increasing_id())  # no two rows are equal, so no range is hot
    lying = lying.repartitionByRange(p, F.asc_nulls_first(group), *(F.asc_nulls_first(c) for c in order), "_row").sortWithinPartitions(F.asc_nulls_first(group), *(F.asc_nulls_first(c) for c in order), "_row")
    lying = written(lying.drop("_row").withColumn("_at", F.monotonically_increasing_id()), folder, name).withColumn("_part", F.shiftright("_at", 33))
    runs = lying.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).withColumn("n", F.sum("_n").over(Window.partitionBy("_g")))
    runs = written(runs.drop("_n"), folder, f"{name}_runs")
    if runs.count() <= PLACES:
        runs = F.broadcast(runs)
    joined = lying.join(runs, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_g", "_p", "_first", "_before")


def _blocks(nodes: DataFrame, group: str, carried: list[str], levels: int, folder: str, name: str) -> DataFrame:
    """(group, block, n, nodes): RUN ** levels consecutive nodes as one row."""
    rows = nodes.groupBy(group, F.expr(f"pos div {RUN**levels}").alias("block"), "n").agg(F.array_sort(F.collect_list(F.struct("pos", *carried))).alias("nodes"))
    return written(rows, folder, name)


def _reduced(blocks: DataFrame, group: str, levels: int) -> DataFrame:
    """(group, pos, n, node): the top node of each block, placed in its tree."""
    kind = dict(blocks.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                (n,), (nodes,) = row.column("n").to_pylist(), row.column("nodes").to_pylist()
                top = levels_of([x["node"] for x in nodes], _height(n, levels))[-1][0]
                yield pa.RecordBatch.from_arrays([row.column(group), row.column("block"), pa.array([-(-n // RUN**levels)]), pa.array([top])], names=[group, "pos", "n", "node"])

    return blocks.select(group, "block", "n", "nodes").mapInArrow(run, f"`{group}` {kind}, pos long, n long, node string")


_PATH = "lefts array<string>, rights array<string>, subroot string, root string"


def _top(nodes: list, kind: str) -> tuple[list[tuple], str]:
    """Paths of all nodes of some trees to the root of the trees' roots, built in the driver."""
    trees: dict = {}
    for r in sorted(nodes, key=lambda r: r["pos"]):
        trees.setdefault(r[0], []).append(r["node"])
    names = sorted(trees, key=lambda g: (g is not None, g.encode() if isinstance(g, str) else g or 0))
    made = {g: levels_of(trees[g]) for g in names}
    above = levels_of([made[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        up = path_of(above, k)
        for at in range(len(trees[g])):
            own = path_of(made[g], at)
            out.append((g, at, own[0] + up[0], own[1] + up[1], made[g][-1][0], above[-1][0]))
    return out, f"`group` {kind}, pos long, {_PATH}"


def _paths(nodes: DataFrame, levels: int, most: int, folder: str, depth: int) -> tuple[DataFrame, bool]:
    """(group, pos, lefts, rights, subroot, root) of every node, and whether the table is small."""
    spark, kind = nodes.sparkSession, dict(nodes.dtypes)["group"]
    total = nodes.count()
    if total <= most:
        rows, ddl = _top(nodes.select("group", "pos", "node").collect(), kind)
        return spark.createDataFrame(rows, ddl), True
    if nodes.where("n > 1").limit(1).count():
        blocks = _blocks(nodes, "group", ["node"], levels, folder, f"blocks{depth}")
        up, small = _paths(written(_reduced(blocks, "group", levels), folder, f"nodes{depth}"), levels, most, folder, depth + 1)
        return _finished(blocks, up, small, "group", kind, levels), False
    # every tree is a single node: their roots, in order, are the nodes of one tree
    roots = _placed(nodes.select(F.lit(0).cast("long").alias("_one"), "group", "node"), "_one", ["group"], folder, f"roots{depth}")
    roots = written(roots, folder, f"placed{depth}")
    up, small = _paths(roots.select(F.col("_one").alias("group"), "pos", "n", "node"), levels, most, folder, depth + 1)
    up = up.select(F.col("pos").alias("_pos"), "lefts", "rights", "root")
    joined = roots.join(F.broadcast(up) if small else up, F.col("pos") == F.col("_pos"))
    return joined.select("group", F.lit(0).cast("long").alias("pos"), "lefts", "rights", F.col("node").alias("subroot"), "root"), False


def _finished(blocks: DataFrame, up: DataFrame, small: bool, group: str, kind: str, height: int) -> DataFrame:
    """Paths of a block's nodes: within the block, then those of its top node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                levels = levels_of([x["node"] for x in row["nodes"]], _height(row["n"], height))
                own = [path_of(levels, k) for k in range(len(levels[0]))]
                m = len(own)
                yield pa.RecordBatch.from_pydict({
                    "group": [row[group]] * m, "pos": [x["pos"] for x in row["nodes"]], "lefts": [a + row["lefts"] for a, _ in own], "rights": [b + row["rights"] for _, b in own],
                    "subroot": [row["subroot"]] * m, "root": [row["root"]] * m,
                }, schema=schema)

    schema = pa.schema([("group", pa.string() if kind == "string" else pa.int64()), ("pos", pa.int64()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])
    return _with_paths(blocks, up, small, group).mapInArrow(run, f"group {kind}, pos long, {_PATH}")


def _with_paths(blocks: DataFrame, up: DataFrame, small: bool, group: str) -> DataFrame:
    up = up.withColumnsRenamed({"group": "_g", "pos": "_b"})
    return blocks.join(F.broadcast(up) if small else up, F.col(group).eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")


def manifest(rows: DataFrame, fields: list[str], group: str, row_id: str, tampered: Column, changes: dict[str, Column], with_proofs: bool = True, levels: int = LEVELS, most: int = TOP_NODES) -> DataFrame:
    """row_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself (lefts, rights: digests by level) of every row; without it if so asked."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession)
    rows = rows.select(*fields)
    changed = leaf([changes.get(f, F.col(f)) for f in fields])
    ids = rows.schema[row_id].dataType.simpleString()
    leaves = rows.select(
        F.col(row_id).alias("id"), F.col(group).cast("string").alias("group"), leaf([F.col(f) for f in fields]).alias("node"),
        F.when(F.coalesce(tampered, F.lit(False)), changed).alias("changed"),
    )
    leaves = written(leaves, folder, "leaves")
    placed = _placed(leaves, "group", ["id", "node"], folder, "sorted")
    blocks = _blocks(placed, "group", ["id", "node", "changed"], levels, folder, "blocks")
    up, small = _paths(written(_reduced(blocks, "group", levels), folder, "nodes"), levels, most, folder, 1)
    arrow = spark.createDataFrame([], f"id {ids}").toArrow().schema.field(0).type
    names = [row_id, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lefts", "rights"]
    kinds = [arrow, *[pa.string()] * 5, pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string())]
    ddl = [ids, *["string"] * 5, "boolean", "array<string>", "array<string>"]
    if not with_proofs:
        names, kinds, ddl = names[:-2], kinds[:-2], ddl[:-2]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                nodes, root = row["nodes"], row["root"]
                tree = levels_of([x["node"] for x in nodes], _height(row["n"], levels))
                paths = [path_of(tree, k) for k in range(len(nodes))]
                paths = [(a + row["lefts"], b + row["rights"]) for a, b in paths]
                folded = [fold(x["changed"] or x["node"], *p) for x, p in zip(nodes, paths, strict=True)]
                proofs = [digest(*(s for pair in zip(*p, strict=True) for s in pair)) for p in paths]
                m = len(nodes)
                values = [[x["id"] for x in nodes], [x["node"] for x in nodes], [row["subroot"]] * m, [root] * m, proofs, folded, [f == root for f in folded], [p[0] for p in paths], [p[1] for p in paths]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=False)], schema=schema)

    return _with_paths(blocks, up, small, "group").mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in zip(names, ddl, strict=True)))
