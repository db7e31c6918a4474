"""Language-model scores of whole texts: context-tree weighting over bytes, beside a unigram base.

The model (``ctw``) sees a text as its UTF-8 bytes with A-Z in lower case, an edge before it and one behind it;
its score is the log10 probability of these bytes and the end, given counts of all learning texts. No text is
gathered anywhere, and nothing is capped: the trees hold every context of up to ``depth`` bytes of the corpus.

1. Texts are packed into slices of about ``Sizes.slice`` bytes (``_packed``), written once.
2. Each slice sends its distinct grams, with how often its learning texts have them, to shards by a hash of the
   gram, and its distinct words by the word. Both are summed there; how often the slices repeat a hot gram or
   word no longer matters.
3. Bottom up: grams lie by the last three bytes of their contexts and in order, so that tasks stream them
   and hold only the contexts that share their last four bytes (at most 2^24 grams). The nodes of three
   bytes are summed, then grouped by the last two (at most 65,280 nodes of a group); those of one byte and of
   none are one small table (at most 65,535 nodes) in the driver.
4. Top down: a node passes on p = a + b * (p of the longer context); each gram gets its log10 probability.
5. The shards answer the slices with what they asked for, and each slice scores its own texts.

What is exchanged grows with the distinct grams of the slices (a tenth of the bytes and less in prose).

``base_score`` sums log10((c + 1) / (N + V + 1)) over a text's words ``[^\\x20\\x09-\\x0D]+`` and one end, c being a
token's count, N all and V the distinct tokens of the learning texts. ``n_tokens`` counts the end.

A null text is an empty one: it has the end only. Rows are scored one by one, so repeated rows give repeated
results; repeated learning rows count as often as they stand. Null ids are kept (and whether such a row is
learnt from is the caller's condition; null counts as false). With nothing to learn from every byte has
probability 1/256 and base scores are 0. The probability of a byte is rounded to single precision. Very long texts are read whole, in windows. An empty table gives no rows. Columns beyond
doc_id and text are not read; an id of any type is kept as it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ctw
from .common import mixed, multipliers, parts, scratch, sliced, utf8_column, written

DEPTH = 6


class Sizes(NamedTuple):
    """Bytes of text in a slice (a longer text is a slice of its own), in a packed row, in a window of a pass, and for each
    shard of grams; grams that a task of the trees takes at once, if no context holds more. Results do not depend on them."""

    slice: int = 32 << 20
    row: int = 1 << 20
    window: int = 2 << 20
    shard: int = 64 << 20
    run: int = 1 << 20


_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_EDGE = bytes([ctw.EDGE])


def _zip(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=5).compress(data, asbytes=True)


def _unzip(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """(slice, ids, learnt, sizes, texts): texts in lower case in rows of bounded size, numbered by slices."""
    ids = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("slice", pa.int64()), ("ids", pa.list_(arrow)), ("learnt", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, in_slice = TaskContext.get().partitionId() << 32, 0
        held: tuple[list, list, list] = ([], [], [])
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([held[0]], schema.field("ids").type), pa.array([held[1]]), pa.array([[len(t) for t in held[2]]], pa.list_(pa.int64())), pa.array([_zip(b"".join(held[2]))])], schema=schema)

        for batch in sliced(batches, rows=1024):
            for i, learnt, text in zip(batch.column("doc_id").to_pylist(), batch.column("learnt").to_pylist(), utf8_column(batch, "text"), strict=True):
                for values, value in zip(held, (i, learnt, (text or b"").translate(_LOWER)), strict=True):
                    values.append(value)
                size += len(text or b"") + 1
                if size >= sizes.row:
                    yield out()
                    in_slice += size
                    held, size = ([], [], []), 0
                    if in_slice >= sizes.slice:
                        number, in_slice = number + 1, 0
        if held[0]:
            yield out()

    return docs.mapInArrow(run, f"slice long, ids array<{ids}>, learnt array<boolean>, sizes array<long>, texts binary")


def _texts(row: dict) -> list[bytes]:
    data, ends = _unzip(row["texts"]), np.cumsum(row["sizes"])
    return [data[e - n : e] for n, e in zip(row["sizes"], ends.tolist(), strict=True)]


def _windows(texts: list[bytes], depth: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, which text each belongs to) of texts with their edges, in windows; only grams of bytes of a text or its end."""
    held, owner, size = [], [], 0
    for k, t in enumerate(texts):
        whole = _EDGE * ctw.BEFORE + t + _EDGE
        for at in range(0, len(whole) - ctw.BEFORE, window):
            part = whole[at : at + window + ctw.BEFORE]
            held.append(part)
            owner.append((k, len(part)))
            size += len(part)
            if size >= window:
                yield _joined(held, owner, depth)
                held, owner, size = [], [], 0
    if held:
        yield _joined(held, owner, depth)


def _joined(held: list[bytes], owner: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([n for _, n in owner])
    # the gram of place p ends there; the first places of each part only give contexts
    inside = np.ones(sizes.sum(), bool)
    inside[((np.cumsum(sizes) - sizes)[:, None] + np.arange(ctw.BEFORE)).ravel()] = False
    return ctw.grams(b"".join(held), depth)[inside[ctw.BEFORE :]], np.repeat([k for k, _ in owner], sizes - ctw.BEFORE)


def _runs(batches, key: str = "slice") -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows one at a time with the value of ``key``, and None at the end."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row[key], row
    yield None, {}


_ASKED = pa.schema([("slice", pa.int64()), ("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("n", pa.binary())])


def _planes(values: np.ndarray) -> bytes:
    """Numbers, compressed byte by byte."""
    return _zip(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def _from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unzip(data), np.uint8).reshape(width, -1).T).view(kind).ravel()


def _delta(keys: np.ndarray) -> bytes:
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _undelta(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(data, np.uint64), dtype=np.uint64)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(shards)).astype(np.int64)


def _lines(words: list[bytes]) -> bytes:
    """Words have no line ends, so these part them."""
    return _zip(b"\n".join(words))


def _unlined(data: bytes) -> list[bytes]:
    lines = _unzip(data)
    return lines.split(b"\n") if lines else []


def _asked(packed: DataFrame, depth: int, shards: int, window: int) -> DataFrame:
    """What each slice has, by shard: distinct grams and distinct words, with their counts in learning texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, words = None, [], Counter()
        for number, row in _runs(batches):
            if number != now:
                if now is not None:
                    keys, counts = ctw.counted(*(np.concatenate(x) for x in zip(*found, strict=True)))
                    to = _shard(keys, shards)
                    order = np.argsort(to, kind="stable")
                    edges = np.searchsorted(to[order], np.arange(shards + 1))
                    lists: dict[int, list[bytes]] = {}
                    for w in sorted(words):
                        lists.setdefault(xxhash.xxh3_64_intdigest(w) % shards, []).append(w)
                    for s in range(shards):
                        j, mine = order[edges[s] : edges[s + 1]], lists.get(s, [])
                        if len(j) or mine:
                            n = np.array([words[w] for w in mine], np.int64)
                            yield pa.RecordBatch.from_pydict({"slice": [now], "shard": [s], "keys": [_delta(keys[j])], "counts": [_planes(counts[j])], "words": [_lines(mine)], "n": [_planes(n)]}, schema=_ASKED)
                now, found, words = number, [], Counter()
            if number is None:
                continue
            texts = _texts(row)
            for t, learnt in zip(texts, row["learnt"], strict=True):
                own = t.split()  # by the six signs of white space of ASCII
                words.update(own if learnt else dict.fromkeys(own, 0))
            learnt = np.array(row["learnt"], bool)
            for keys, owner in _windows(texts, depth, window):
                here = learnt[owner]
                for part, by in ((keys[here], 1), (keys[~here], 0)):
                    u, n = np.unique(part, return_counts=True)
                    found.append((u, n * by))
                if sum(len(u) for u, _ in found) > window:
                    found = [ctw.counted(*(np.concatenate(x) for x in zip(*found, strict=True)))]

    return packed.select("slice", "learnt", "sizes", "texts").mapInArrow(run, "slice long, shard int, keys binary, counts binary, words binary, n binary")


def _by_shard(rows: DataFrame, shards: int, *order) -> DataFrame:
    return rows.repartition(min(shards, 4 * parts(rows)), "shard").sortWithinPartitions("shard", *order)


def _summed(asked: DataFrame, shards: int) -> DataFrame:
    """(key, n): every distinct gram with its count in learning texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for shard, row in _runs(batches, "shard"):
            if now is not None and shard != now:
                keys, n = ctw.counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)].astype(np.int64)), pa.array(n[at : at + (1 << 16)])], names=["key", "n"])
                held = []
            now = shard
            if shard is not None:
                held.append((_undelta(row["keys"]), _from_planes(row["counts"], np.int64)))
                if sum(len(k) for k, _ in held[1:]) > 1 << 22:
                    held = [ctw.counted(*(np.concatenate(x) for x in zip(*held, strict=True)))]

    return _by_shard(asked.select("shard", "keys", "counts"), shards).mapInArrow(run, "key long, n long")


def _word_counts(asked: DataFrame, shards: int) -> DataFrame:
    """(shard, words, n, all, distinct): the words of each shard with their counts in learning texts, the sum of these and how many are above 0."""

    def merged(held: list[tuple[list[bytes], np.ndarray]]) -> tuple[list[bytes], np.ndarray]:
        table = pa.table([pa.chunked_array([pa.array(w, pa.binary()) for w, _ in held]), pa.chunked_array([pa.array(n, pa.int64()) for _, n in held])], names=["w", "n"])
        table = table.group_by("w").aggregate([("n", "sum")])
        return table.column("w").to_pylist(), table.column("n_sum").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for shard, row in _runs(batches, "shard"):
            if now is not None and shard != now:
                words, n = merged(held)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([now], pa.int32()), "words": [_lines(words)], "n": [_planes(n)], "all": [int(n.sum())], "distinct": [int((n > 0).sum())]})
                held = []
            now = shard
            if shard is not None:
                held.append((_unlined(row["words"]), _from_planes(row["n"], np.int64)))
                if len(held) > 1 and sum(len(n) for _, n in held[1:]) > 1 << 20:
                    held = [merged(held)]

    return _by_shard(asked.select("shard", "words", "n"), shards).mapInArrow(run, "shard int, words binary, n binary, all long, distinct long")


# --- the trees ------------------------------------------------------------------------------------


def _node(level: ctw.Level, b: int, at=slice(None)) -> np.ndarray:
    """Number of a node: its context, then 1 and the bits."""
    bits = np.uint64((1 << b) - 1)
    k = level.node[b][at]
    return ((k >> np.uint64(b) << np.uint64(8)) | (k & bits) | np.uint64(1 << b)).astype(np.int64)


def _from_nodes(node: np.ndarray, n0: np.ndarray, n1: np.ndarray, total: np.ndarray) -> tuple[ctw.Level, list[np.ndarray]]:
    """A level from numbered nodes, and the sums over longer contexts in its order."""
    level, sums = ctw.Level.__new__(ctw.Level), []
    level.node, level.n0, level.n1 = [], [], []
    code = node & 255
    for b in range(8):
        j = np.flatnonzero((code >> b) == 1)
        k = (node[j] >> 8 << b) | (code[j] - (1 << b))
        j = j[np.argsort(k)]
        level.node.append(np.sort(k).astype(np.uint64))
        level.n0.append(n0[j])
        level.n1.append(n1[j])
        sums.append(total[j])
    return level, sums


def _shorter(level: ctw.Level) -> tuple[ctw.Level, list[np.ndarray]]:
    """The level of the contexts that are one byte shorter, with the sums of log_w."""
    out = ctw.Level.__new__(ctw.Level)
    out.node, out.n0, out.n1, sums = [], [], [], []
    for b in range(8):
        bits = np.uint64(b)
        parent = (level.node[b] >> np.uint64(b + 8) << bits) | (level.node[b] & np.uint64((1 << b) - 1))
        u, at = np.unique(parent, return_inverse=True)
        out.node.append(u)
        out.n0.append(np.bincount(at, level.n0[b], len(u)).astype(np.int64))
        out.n1.append(np.bincount(at, level.n1[b], len(u)).astype(np.int64))
        sums.append(np.bincount(at, level.log_w[b], len(u)))
    return out, sums


_NODES = "node long, n0 long, n1 long, s double"


def _node_rows(level: ctw.Level, sums: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([_node(level, b) for b in range(8)], level.n0, level.n1, sums)], names=["node", "n0", "n1", "s"])


def _ordered_runs(batches: Iterator[pa.RecordBatch], depth: int, run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted grams and counts in runs of whole groups of contexts that share their last four bytes."""
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False).astype(np.uint64)])
        counts = np.concatenate([counts, batch.column("n").to_numpy(zero_copy_only=False)])
        if len(keys) >= run:
            group = keys >> np.uint64(8 * (depth - 3))
            cut = np.searchsorted(group, group[-1])
            if cut:
                yield keys[:cut], counts[:cut]
                keys, counts = keys[cut:], counts[cut:]
    if len(keys):
        yield keys, counts


def _own_coefficients(level: ctw.Level, a: list[np.ndarray], b: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of every node: p of a one there if the path ends here, and a, b of p = a + b * (p of the longer context), given those above it."""
    end, on_a, on_b = [], [], []
    for k in range(8):
        n0, n1, w = level.n0[k], level.n1[k], level.own[k]
        kt = (n1 + 0.5) / (n0 + n1 + 1.0)
        seen = n0 + n1 > 0
        end.append(np.where(seen, a[k] + b[k] * kt, np.nan))
        on_a.append(np.where(seen, a[k] + b[k] * w * kt, a[k]))
        on_b.append(np.where(seen, b[k] * (1 - w), b[k]))
    return end, on_a, on_b


def _below(level: ctw.Level, parent: ctw.Level, got: tuple[list, list, list], ended: list[np.ndarray]) -> tuple[list, list, list]:
    """``_own_coefficients`` of a level from those of the level above; ``ended`` has p where the paths of the parents end."""
    up = []
    for b in range(8):
        key = (level.node[b] >> np.uint64(b + 8) << np.uint64(b)) | (level.node[b] & np.uint64((1 << b) - 1))
        up.append(np.searchsorted(parent.node[b], key))
    end, a, b = _own_coefficients(level, [x[j] for x, j in zip(got[1], up, strict=True)], [x[j] for x, j in zip(got[2], up, strict=True)])
    return [np.where(np.isnan(e), p[j], e) for e, p, j in zip(end, ended, up, strict=True)], a, b


class _Top:
    """Contexts of one byte and of none: at most 65,535 nodes."""

    def __init__(self, rows: list) -> None:
        col = lambda k, t: np.array([r[k] for r in rows], t)
        self.one, sums = _from_nodes(col("node", np.int64), col("n0", np.int64), col("n1", np.int64), col("s", float))
        self.one.weigh(sums)
        self.none, sums = _shorter(self.one)
        self.none.weigh(sums)
        flat = [np.zeros(len(x)) for x in self.none.node], [np.ones(len(x)) for x in self.none.node]
        root = _own_coefficients(self.none, *flat)
        root = ([np.where(np.isnan(e), 0.5, e) for e in root[0]], *root[1:])
        self.got = _below(self.one, self.none, root, root[0])


def _tree(grams: DataFrame, depth: int, run_grams: int) -> DataFrame:
    """(ctx, code, end_p, a, b): what the nodes of each three-byte context pass on."""
    spark = grams.sparkSession

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _ordered_runs(batches, depth, run_grams):
            yield _node_rows(*_shorter(ctw.levels(keys, counts, depth, 4)[-1]))

    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "s")]
    three = written(grams.mapInArrow(up, _NODES).groupBy("node").agg(*sums), scratch(spark), "three").withColumn("ctx2", F.shiftright("node", 16))

    def middle(table: pa.Table) -> tuple[ctw.Level, ctw.Level]:
        level, total = _from_nodes(*(table.column(c).to_numpy() for c in ("node", "n0", "n1", "s")))
        level.weigh(total)
        two, total = _shorter(level)
        two.weigh(total)
        return level, two

    def shorten(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_node_rows(*_shorter(middle(table)[1]))])

    rows = three.groupBy("ctx2").applyInArrow(shorten, _NODES).groupBy("node").agg(*sums).collect()  # at most 65,280
    top = spark.sparkContext.broadcast(_Top(rows))

    def down(table: pa.Table) -> pa.Table:
        three, two = middle(table)
        held = top.value
        got = _below(two, held.one, held.got, held.got[0])
        got = _below(three, two, got, got[0])
        node = np.concatenate([_node(three, b) for b in range(8)])
        order = np.argsort(node)
        values = [np.concatenate(x)[order] for x in got]
        ctx = node[order] >> 8
        cut = np.concatenate([np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])), [len(ctx)]])
        code = (node[order] & 255).astype(np.uint8)
        pieces = [[x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (code, *values)]
        return pa.table([pa.array(ctx[cut[:-1]]), *(pa.array(x, pa.binary()) for x in pieces)], names=["ctx", "code", "end_p", "a", "b"])

    return three.groupBy("ctx2").applyInArrow(down, "ctx long, code binary, end_p binary, a binary, b binary")


def _dealt(held: list[tuple[np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    """Grams and values as one row a shard."""
    keys, v = (np.concatenate(x) for x in zip(*held, strict=True))
    to = _shard(keys, shards)
    order = np.lexsort((keys, to))
    edges = np.searchsorted(to[order], np.arange(shards + 1))
    some = [s for s in range(shards) if edges[s] < edges[s + 1]]
    cut = [order[edges[s] : edges[s + 1]] for s in some]
    return pa.RecordBatch.from_pydict({"shard": pa.array(some, pa.int32()), "keys": [_delta(keys[j]) for j in cut], "values": [_planes(v[j]) for j in cut]})


def _valued(grams: DataFrame, depth: int, n: int, run_grams: int, shards: int) -> DataFrame:
    """(shard, keys, values): log10 of every gram's probability in single precision, by ``n`` tasks."""
    shift = 8 * (depth - 2)
    lying = grams.withColumn("ctx", F.shiftright("key", shift)).repartition(n, "ctx").sortWithinPartitions("key")
    coefficients = _tree(lying, depth, run_grams)
    none = F.lit(None).cast("binary")
    both = coefficients.select("ctx", F.lit(-1).cast("long").alias("key"), F.lit(0).cast("long").alias("n"), "code", "end_p", "a", "b")
    both = both.unionByName(grams.select(F.shiftright("key", shift).alias("ctx"), "key", "n", *(none.alias(c) for c in ("code", "end_p", "a", "b"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column("key").to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(key < 0).tolist():
                    row = batch.slice(i, 1).to_pylist()[0]
                    t = np.full((3, 256), np.nan)
                    t[:, np.frombuffer(row["code"], np.uint8)] = [np.frombuffer(row[c]) for c in ("end_p", "a", "b")]
                    tables[row["ctx"]] = t
                yield batch.filter(pa.array(key >= 0))

        for keys, counts in _ordered_runs(watched(), depth, run_grams):
            made = ctw.levels(keys, counts, depth, 4)
            ctx, at = np.unique(keys >> np.uint64(shift), return_inverse=True)
            table = np.stack([tables[c] for c in ctx.tolist()])
            for old in [c for c in tables if c < ctx[-1]]:
                del tables[old]

            def above(b, node, one, p, table=table, at=at, keys=keys):
                code = (1 << b) | ((keys & np.uint64(255)) >> np.uint64(8 - b)).astype(np.int64)
                end, a, c = table[at, :, code].T
                longer = np.where(one, p, 1 - p)
                q = np.where(np.isnan(p), end, a + c * longer)
                return np.where(one, q, 1 - q)

            held.append((keys, ctw.mixed_bits(keys, made, above).astype(np.float32)))
            if sum(len(k) for k, _ in held) >= run_grams:
                yield _dealt(held, shards)
                held = []
        if held:
            yield _dealt(held, shards)

    return both.repartition(n, "ctx").sortWithinPartitions("ctx", "key").mapInArrow(run, "shard int, keys binary, values binary")


# --- answers and scores ---------------------------------------------------------------------------


_ANSWER = pa.schema([("slice", pa.int64()), ("keys", pa.binary()), ("values", pa.binary()), ("words", pa.binary()), ("n", pa.binary())])


def _answers(asked: DataFrame, valued: DataFrame, words: DataFrame, shards: int) -> DataFrame:
    """(slice, keys, values, words, n): what each slice asked for, by shard."""
    null = F.lit(None).cast("binary")
    rows = asked.select("shard", "slice", "keys", null.alias("values"), "words", null.alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known, keys = None, [], [], None
        for number, row in _runs(batches, "shard"):
            if number is None:
                return
            if number != now:
                now, held, known, keys = number, [], [], None
            if row["slice"] is None:
                if row["keys"] is not None:
                    held.append((_undelta(row["keys"]), _from_planes(row["values"], np.float32)))
                else:
                    known.append((pa.array(_unlined(row["words"]), pa.binary()), _from_planes(row["n"], np.int64)))
                continue
            if keys is None:
                keys, v = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.empty(0, np.uint64), np.empty(0, np.float32))
                order = np.argsort(keys)
                keys, v, held = keys[order], v[order], []
            mine, asked_words = _undelta(row["keys"]), pa.array(_unlined(row["words"]), pa.binary())
            at = pc.index_in(asked_words, value_set=known[0][0]).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_pydict({"slice": [row["slice"]], "keys": [row["keys"]], "values": [_planes(v[np.searchsorted(keys, mine)])], "words": [row["words"]], "n": [_planes(known[0][1][at])]}, schema=_ANSWER)

    both = valued.select("shard", F.lit(None).cast("long").alias("slice"), "keys", "values", null.alias("words"), null.alias("n"))
    both = both.unionByName(words.select("shard", F.lit(None).cast("long").alias("slice"), null.alias("keys"), null.alias("values"), "words", "n")).unionByName(rows)
    # without a slice first: what is known comes before the questions
    return _by_shard(both, shards, F.asc_nulls_first("slice")).mapInArrow(run, "slice long, keys binary, values binary, words binary, n binary")


class _Lookup:
    """Values by key: tables of keys and values by hash, each for the keys that lost their place in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables = []
        for multiplier in multipliers(64):
            shift = np.uint64(64 - max(1, len(keys).bit_length()))
            table = np.full((1 << int(64 - shift), 2), np.iinfo(np.uint64).max)  # no gram
            at = (keys * multiplier) >> shift
            table[at] = np.stack([keys, values.view(np.uint64)], 1)
            self.tables.append((multiplier, shift, table))
            lost = table[at, 0] != keys
            keys, values = keys[lost], values[lost]
            if not len(keys):
                return
        raise AssertionError("keys are distinct and multipliers odd")

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.empty(len(keys)), slice(None)
        for multiplier, shift, table in self.tables:
            found = table.take(((keys * multiplier) >> shift).astype(np.int64), axis=0)
            out[todo] = found[:, 1].copy().view(np.float64)
            lost = np.flatnonzero(found[:, 0] != keys)
            if not len(lost):
                break
            todo = lost if isinstance(todo, slice) else todo[lost]
            keys = keys[lost]
        return out


def _scored(packed: DataFrame, answers: DataFrame, n: int, v: int, ends: int, depth: int, tasks: int, window: int) -> DataFrame:
    """The scores of every packed text from its slice's answers."""
    base = np.log10(n + v + 1.0)

    def of_count(c: int) -> float:
        return float(np.log10(c + 1.0) - base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, find, of, fresh = None, [], None, {}, set()
        for number, row in _runs(batches):
            if number is None:
                return
            if number != now:
                now, held, find, of, fresh = number, [], None, {}, set()
            if row["keys"] is not None:
                held.append((_undelta(row["keys"]), _from_planes(row["values"], np.float32)))
                words, counts = _unlined(row["words"]), _from_planes(row["n"], np.int64)
                of.update(zip(words, (np.log10(counts + 1.0) - base).tolist(), strict=True))
                fresh.update(words[j] for j in np.flatnonzero(counts == 0).tolist())
                continue
            if find is None:
                find = _Lookup(np.concatenate([k for k, _ in held]), np.concatenate([v for _, v in held]).astype(np.float64))
                held = []
            texts = _texts(row)
            score = np.zeros(len(texts))
            for keys, owner in _windows(texts, depth, window):
                score += np.bincount(owner, find(keys), len(texts))
            found = [t.split() for t in texts]
            size = np.array([len(t) for t in texts])
            yield pa.RecordBatch.from_arrays([
                pa.array(row["ids"], schema[0].type), pa.array(row["learnt"]), pa.array([len(w) + 1 for w in found], pa.int64()),
                pa.array([len(w) - sum(map(fresh.__contains__, w)) + (ends > 0) for w in found], pa.int64()), pa.array(np.full(len(texts), n), pa.int64()),
                pa.array([sum(map(of.__getitem__, w)) + of_count(ends) for w in found], pa.float64()), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(size, 1)),
            ], schema=schema)

    ids = packed.schema["ids"].dataType.elementType.simpleString()
    arrow = packed.select(F.get("ids", F.lit(0)).alias("doc_id")).limit(0).toArrow().schema.field(0).type
    names = [("doc_id", arrow), ("learnt", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
    schema = pa.schema(names)
    every = answers.unionByName(packed, allowMissingColumns=True)
    # without ids first: the answers come before the texts
    lying = every.repartition(tasks, "slice").sortWithinPartitions("slice", F.col("ids").isNotNull())
    return lying.mapInArrow(run, f"doc_id {ids}, learnt boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")


def score(docs: DataFrame, learn: Column, depth: int = DEPTH, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of each row of ``docs`` (doc_id, text); learns where ``learn`` holds."""
    if not 3 < depth < 7:
        raise ValueError("the depth is 4, 5 or 6 bytes")
    folder = scratch(docs.sparkSession)
    packed = written(_packed(docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learnt")), sizes), folder, "packed")
    total = lambda column: F.sum(F.aggregate(column, F.lit(0).cast("long"), lambda a, b: a + b.cast("long")))
    size, ends, slices = packed.agg(total("sizes"), total("learnt"), F.countDistinct("slice")).first()
    shards = max(1, min(-(-(size or 0) // sizes.shard), 1 << 16))
    asked = written(_asked(packed, depth, shards, sizes.window), folder, "asked")
    summed = written(_summed(asked, shards), folder, "summed")
    words = written(_word_counts(asked, shards), folder, "words")
    n, v = words.agg(F.sum("all"), F.sum("distinct")).first()
    n, v, ends = n or 0, v or 0, ends or 0
    answers = _answers(asked, _valued(summed, depth, min(2 * shards, 4 * parts(docs)), sizes.run, shards), words, shards)
    return _scored(packed, answers, n + ends, v + (ends > 0), ends, depth, max(1, min(4 * slices, 4 * parts(docs))), sizes.window)
