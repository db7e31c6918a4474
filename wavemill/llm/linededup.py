"""Line deduplication by pairwise alignment.

1. Lines (split at newlines, stripped) are hashed. A line of at least MIN_CHARS characters can tell
   documents apart and is called strong.
2. Overlaps. A document's keys are its strong lines, and the runs from each strong line over short lines
   up to the next strong one, in both directions. Every key that several documents hold points to its
   first holder, the document with the smallest id. The first holders of all keys of a document, of
   common ones as of rare ones, are its partners. So a document has at most as many partners as keys
   (two a line), however often a line occurs, and no group of documents is ever paired with itself.
3. Each document is aligned with each partner by patience diff: lines that only one side holds are set
   aside, then common head and tail, then lines that are unique on both sides in longest increasing
   order, then the same within the gaps.
4. Aligned blocks (lines that follow each other on both sides, blank lines not counted) that hold a
   strong line are deleted from the later document with the blank lines inside. All is judged on the
   input texts.

First holders find what alignment with every earlier document that shares a strong line would delete,
but for lines that stand in another order, or more often, than in the first holder of each of their keys
(recall: README). ``exact=True`` closes that gap: keys whose lines are still there go on to all other
earlier holders. Those of a key with up to FEW holders are aligned one by one. Of a key with more, what
the holders of its strong line leave of it is found without pairing them: alignment sees of an earlier
document only the lines that both hold and where gaps are between them. So holders are reduced to their
cores (short lines, and strong lines that others hold, with gaps), equal cores are one class, named by its
smallest id, and in tiles of a line a document is aligned with each different remainder of a core once:
all classes that share but the line itself leave its occurrences only, others are found by the further line.
No holder is left out.

A document and its partners are met in chunks of CHUNK partners; a line or a first holder that a large
share of all rows points to is dealt over several tasks (``spread_join``).

A null text stays null and has no lines; an empty text has one blank line. Very long texts are hashed
and aligned whole. Documents with a null id keep their lines and are no one's partner. Of rows that
share an id the text with the smallest hash stands for the id; rows with the same id and text are
treated alike, others keep their lines. An empty table gives no rows. Columns named n_lines, n_removed
and emptied are replaced, all others are kept.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, takewhile

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, parts, released, scratch, sliced, spread_join, utf8_column, written

MIN_CHARS = 20
#: Partners that meet a document in one group of rows.
CHUNK = 64
#: A key with up to this many holders has them aligned one by one.
FEW = 16
#: Lines of classes, and documents, that meet in a tile of a line.
TILE_LINES, TILE_DOCS = 65_536, 16_384
#: Stands in a core for lines that no other document holds; no line has this hash.
GAP = -(1 << 63)


def line_hash(line: bytes) -> int:
    """Signed 64-bit hash: 0 for a blank line; odd if the line is strong, even if it is short."""
    line = line.strip()
    if not line:
        return 0
    h = xxhash.xxh3_64_intdigest(line) >> 1
    strong = len(line) >= MIN_CHARS and (len(line) >= 4 * MIN_CHARS or len(line.decode("utf-8", "replace")) >= MIN_CHARS)
    return (h << 1 | strong) - (1 << 63) if h or strong else 2


def run_keys(lines: list[int]) -> dict[int, list[int]]:
    """The keys of a document, each with the places of the lines at its ends, at every occurrence."""
    full = [(i, h) for i, h in enumerate(lines) if h]
    out: dict[int, list[int]] = {}
    for seed, way in ((1, full), (2, full[::-1])):
        run, start = 0, -1
        for i, h in way:
            if start >= 0:
                run = (run * 0x9E3779B97F4A7C15 + h) & MASK64
                out.setdefault((run ^ run >> 29) - (1 << 63), []).extend((start, i))
            if h & 1:
                run, start = (h * 0xD6E8FEB86659FD93 + seed) & MASK64, i
                out.setdefault(h, []).append(i)
    return out


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence of pairs, sorted by their first part, whose second parts increase."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tails, j)
        if k == len(tails):
            tails.append(j)
            at.append(i)
        else:
            tails[k], at[k] = j, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) with a[i] == b[j], increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {x: j for j, x in enumerate(b[blo:bhi], blo) if nb[x] == 1}
        anchors = increasing([(i, where[x]) for i, x in enumerate(a[alo:ahi], alo) if na[x] == 1 and x in where])
        if not anchors:
            continue
        pa_, pb = alo, blo
        for i, j in anchors:
            todo.append((pa_, i, pb, j))
            out.append((i, j))
            pa_, pb = i + 1, j + 1
        todo.append((pa_, ahi, pb, bhi))
    return sorted(out)


class Lines:
    """The lines of a document that are not blank, with their places, ready to be aligned with many others."""

    def __init__(self, lines: list[int]):
        self.at = [i for i, h in enumerate(lines) if h]
        self.full = [lines[i] for i in self.at]
        self.where: dict[int, list[int]] = {}
        for k, h in enumerate(self.full):
            self.where.setdefault(h, []).append(k)

    def deleted(self, earlier: list[int]) -> list[int]:
        """Places that lie in blocks, aligned with ``earlier``, that have a strong line."""
        other = [h for h in earlier if h]
        b = [k for k, h in enumerate(other) if h in self.where]
        a = sorted(k for h in {other[k] for k in b} for k in self.where[h])
        out: list[int] = []
        block: list[tuple[int, int]] = []
        for i, j in [*((a[i], b[j]) for i, j in patience([self.full[k] for k in a], [other[k] for k in b])), (-2, -2)]:
            if block and (i, j) != (block[-1][0] + 1, block[-1][1] + 1):
                if any(self.full[x] & 1 for x, _ in block):
                    out += range(self.at[block[0][0]], self.at[block[-1][0]] + 1)
                block = []
            block.append((i, j))
        return out


def deleted(later: list[int], earlier: list[int]) -> list[int]:
    """Places of ``later`` that lie in aligned blocks with a strong line."""
    return Lines(later).deleted(earlier)


def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("lines", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64()))])
    released()
    for batch in sliced(batches):
        texts = utf8_column(batch, "text")
        tid = [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
        lines = [[line_hash(x) for x in t.split(b"\n")] for t in texts]
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tid": tid, "lines": lines, "keys": [list(run_keys(x)) for x in lines]}, schema=schema)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document's chunk: its own lines (first is null), then those of partners."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("gone", pa.list_(pa.int32()))])
    held: tuple = ()
    for batch in sliced(batches, 32):
        found: dict[tuple[int, int], set[int]] = {}
        for row in batch.to_pylist():
            if row["first"] is None:
                held = row["doc_id"], row["tid"], Lines(row["lines"])
            elif held and row["doc_id"] == held[0]:
                found.setdefault(held[:2], set()).update(held[2].deleted(row["lines"]))
        found = {k: v for k, v in found.items() if v}
        if found:
            yield pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in found], "tid": [t for _, t in found], "gone": [sorted(v) for v in found.values()]}, schema=schema)


def _deletions(pairs: DataFrame, lines: DataFrame, folder: str, name: str) -> DataFrame:
    """(doc_id, tid, gone): places of ``doc_id`` deleted by alignment with its partners ``first``."""
    pairs = written(pairs, folder, f"pairs{name}")
    firsts = written(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("c")).join(lines.select(F.col("doc_id").alias("first"), "lines"), "first"), folder, f"firsts{name}")
    chunks = pairs.groupBy("doc_id").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    own = lines.join(chunks, "doc_id").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("first"), "tid", "lines")
    dealt = spread_join(pairs, firsts, "first", "c", "doc_id").join(chunks, "doc_id")
    other = dealt.select("doc_id", F.pmod(F.xxhash64("first"), F.col("chunks")).cast("int").alias("chunk"), "first", F.lit(None).cast("long").alias("tid"), "lines")
    met = own.unionAll(other).repartition(parts(lines), "doc_id", "chunk").sortWithinPartitions("doc_id", "chunk", F.col("first").asc_nulls_first())
    return met.select("doc_id", "tid", "first", "lines").mapInArrow(_align, "doc_id long, tid long, gone array<int>")


def reduced(lines: list[int], known) -> list[int]:
    """The lines of ``known`` in their order, a GAP for what stands between them."""
    out: list[int] = []
    for h in lines:
        if h in known:
            out.append(h)
        elif h and out and out[-1] != GAP:
            out.append(GAP)
    return out[:-1] if out and out[-1] == GAP else out


def _left(shared: DataFrame, lines: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, key, df, first, line, places): the rows of ``shared`` (doc_id, key, df, first) that ``gone`` has not deleted in whole, the strong line their run starts from and the places left."""
    ddl = "doc_id long, key long, df long, first long, line long, places array<int>"
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("df", pa.int64()), ("first", pa.int64()), ("line", pa.int64()), ("places", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 32):
            out: list[dict] = []
            for row in batch.to_pylist():
                x, lost, at = row["lines"], set(row["gone"] or ()), run_keys(row["lines"])
                for k in row["keys"]:
                    ends = at[k["key"]]
                    # a run's places come in pairs: from its strong line, in one direction or the other
                    every = ends if k["key"] == x[ends[0]] else [p for a, b in zip(ends[::2], ends[1::2], strict=True) for p in range(min(a, b), max(a, b) + 1)]
                    places = sorted(set(every) - lost)
                    if places:
                        out.append({"doc_id": row["doc_id"], "line": x[ends[0]], "places": places, **k})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    lost = gone.groupBy("doc_id").agg(F.flatten(F.collect_list("gone")).alias("gone"))
    some = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "df", "first")).alias("keys"))
    return lines.join(some, "doc_id").join(lost, "doc_id", "left").select("doc_id", "lines", "keys", "gone").mapInArrow(run, ddl)


def _by_classes(doc: int, own: Lines, line: int, places: set[int], classes: list[tuple[int, list[int]]], index: dict[int, list[int]], alone: dict[tuple[int, ...], list[int]]) -> set[int]:
    """Places deleted by alignment with the classes (first holder, core) before ``doc``, until all of ``places`` are.

    A class that shares a further line is aligned by what it shares; all others are the occurrences of ``line`` alone.
    """
    near = {n for h in own.where if h != line for n in index.get(h, ()) if classes[n][0] < doc}
    far = (p for p, some in alone.items() if any(n not in near for n in takewhile(lambda n: classes[n][0] < doc, some)))
    lost: set[int] = set()
    seen: set[tuple[int, ...]] = set()
    for x in chain(far, (tuple(reduced(classes[n][1], own.where)) for n in sorted(near))):
        if x not in seen:
            seen.add(x)
            lost.update(own.deleted(list(x)))
            if places <= lost:
                break
    return lost


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a tile of a line: classes (places is null) by their first holders, then documents."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("gone", pa.list_(pa.int32()))])
    tile = None
    for batch in sliced(batches):
        found: dict[tuple[int, int], set[int]] = {}
        for row in batch.to_pylist():
            if (row["key"], row["i"], row["j"]) != tile:
                tile = row["key"], row["i"], row["j"]
                classes: list[tuple[int, list[int]]] = []
                index: dict[int, list[int]] = {}
                alone: dict[tuple[int, ...], list[int]] = {}
            if row["places"] is None:
                for h in set(row["lines"]) - {GAP}:
                    index.setdefault(h, []).append(len(classes))
                alone.setdefault(tuple(reduced(row["lines"], {tile[0]})), []).append(len(classes))
                classes.append((row["doc_id"], row["lines"]))
            else:
                lost = _by_classes(row["doc_id"], Lines(row["lines"]), tile[0], set(row["places"]), classes, index, alone)
                found.setdefault((row["doc_id"], row["tid"]), set()).update(lost)
        found = {k: v for k, v in found.items() if v}
        if found:
            yield pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in found], "tid": [t for _, t in found], "gone": [sorted(v) for v in found.values()]}, schema=schema)


def _cores(lines: DataFrame, shared: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, core) of the documents ``ids``: short lines and the strong lines that other documents hold, with gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("core", pa.list_(pa.int64()))])
        for batch in sliced(batches):
            rows = zip(batch.column("lines").to_pylist(), batch.column("keys").to_pylist(), strict=True)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "core": [reduced(x, {h for h in x if h and not h & 1}.union(keys)) for x, keys in rows]}, schema=schema)

    held = shared.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))
    return lines.join(ids, "doc_id", "left_semi").join(held, "doc_id").select("doc_id", "lines", "keys").mapInArrow(run, "doc_id long, core array<long>")


def _hot_deletions(left: DataFrame, keys: DataFrame, holders: DataFrame, shared: DataFrame, lines: DataFrame, folder: str) -> DataFrame:
    """(doc_id, tid, gone): places of ``left`` (doc_id, line, places) deleted by alignment with all earlier holders of the line."""
    left = written(left.groupBy("doc_id", F.col("line").alias("key")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")), folder, "hot")
    some = written(left.groupBy("key").agg(F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("docs")).join(holders.select("key", "df"), "key"), folder, "hotlines")
    at = written(spread_join(keys, some, "key", "df", "doc_id").where("doc_id < last").select("doc_id", "key"), folder, "at")
    cores = _cores(lines, shared, at.select("doc_id").distinct())
    classes = written(at.join(cores, "doc_id").groupBy("key", "core").agg(F.min("doc_id").alias("doc_id")), folder, "classes")
    sizes = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(F.size("core")) / TILE_LINES).cast("int").alias("ci"))
    tiles = written(sizes.join(some.select("key", "docs", F.ceil(F.col("docs") / TILE_DOCS).cast("int").alias("cj")), "key"), folder, "tiles")
    draw = F.xxhash64("doc_id")
    dealt = spread_join(classes, tiles, "key", "n", "doc_id").select("key", F.pmod(draw, F.col("ci")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cj") - 1)).alias("j"), "doc_id", F.lit(None).cast("long").alias("tid"), F.col("core").alias("lines"), F.lit(None).cast("array<int>").alias("places"))
    own = spread_join(left, tiles, "key", "docs", "doc_id").join(lines, "doc_id").select("key", F.explode(F.sequence(F.lit(0), F.col("ci") - 1)).alias("i"), F.pmod(draw, F.col("cj")).cast("int").alias("j"), "doc_id", "tid", "lines", "places")
    met = dealt.unionAll(own).repartition(parts(lines), "key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("places").isNotNull(), "doc_id")
    return met.mapInArrow(_meet, "doc_id long, tid long, gone array<int>")


def dedup_lines(docs: DataFrame, exact: bool = False) -> DataFrame:
    """``docs`` with text as it is left, n_lines, n_removed and emptied (nothing but blank lines is left, and something went)."""
    folder = scratch(docs.sparkSession)
    known = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hashed = known.mapInArrow(_hash_lines, "doc_id long, tid long, lines array<long>, keys array<long>")
    lines = written(hashed.groupBy("doc_id").agg(F.min(F.struct("tid", "lines", "keys")).alias("x")).select("doc_id", "x.tid", "x.lines", "x.keys"), folder, "lines")
    keys = lines.select("doc_id", F.explode("keys").alias("key"))
    lines = lines.drop("keys")
    holders = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"), F.min("doc_id").alias("first")).where("df > 1"), folder, "holders")
    shared = spread_join(keys, holders, "key", "df", "doc_id")
    if exact:
        shared = written(shared.select("doc_id", "key", "df", "first"), folder, "shared")
    later = shared.where("doc_id > first")
    gone = _deletions(later.select("doc_id", "first").distinct(), lines, folder, "0")
    if exact:
        gone = written(gone, folder, "gone0")
        left = written(_left(later.where("df > 2"), lines, gone), folder, "left")
        few, many = left.where(F.col("df") <= FEW), left.where(F.col("df") > FEW)
        if not few.isEmpty():
            rest = few.select("key", F.col("doc_id").alias("_wm_doc"), "first").join(keys, "key").where("doc_id > first and doc_id < _wm_doc")
            rest = rest.select(F.col("_wm_doc").alias("doc_id"), F.col("doc_id").alias("first")).distinct()
            gone = gone.unionAll(_deletions(rest, lines, folder, "1"))
        if not many.isEmpty():
            gone = gone.unionAll(_hot_deletions(many, keys, holders, shared, lines, folder))
    gone = gone.groupBy("doc_id", "tid").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
    gone = gone.select(F.col("doc_id").alias("_wm_id"), F.col("tid").alias("_wm_tid"), F.col("gone").alias("_wm_gone"))

    docs = docs.drop("n_lines", "n_removed", "emptied")
    fields = [f.name for f in docs.schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, total, n, emptied = [], [], [], []
            for t, tid, places in zip(utf8_column(batch, "text"), batch.column("_wm_tid").to_pylist(), batch.column("_wm_gone").to_pylist(), strict=True):
                own = [] if t is None else t.split(b"\n")
                total.append(len(own))
                if not places or t is None or xxhash.xxh3_64_intdigest(t) - (1 << 63) != tid:
                    texts.append(t)
                    n.append(0)
                    emptied.append(False)
                    continue
                out = set(places)
                kept = [x for i, x in enumerate(own) if i not in out]
                texts.append(b"\n".join(kept))
                n.append(len(own) - len(kept))
                emptied.append(not any(x.strip() for x in kept))
            cols = {f: batch.column(f) for f in fields} | {"text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(total, pa.int64()), "n_removed": pa.array(n, pa.int64()), "emptied": pa.array(emptied, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_lines long, n_removed long, emptied boolean"])
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_wm_id"), "left").drop("_wm_id").mapInArrow(cut, ddl)
