"""N-gram Jaccard join and its components, as a join in the metric space of shingle sets.

The Jaccard distance d = 1 - |A n B| / |A u B| is a metric. Two documents link when d <= r.

Level 0, pivots that are parts of sets. With documents as pivots of a whole corpus almost all distances
are near 1 and the windows below copy every document into almost every region (measured: README), so
the first pivots are smaller. Shingle hashes form a binary tree. For a node v, A_v are A's
shingles below v, and d_v(A, B) = d(A_v, B_v). If d(A, B) <= r at a node, then d <= r at one of its
children (the node's shared and united shingles are the sums of the children's). Going down, a node is
reached where A_v u B_v has at most c < 1/r shingles; there d_v <= r means d_v = 0, i.e. A_v = B_v:
both lie on the same pivot, the part itself, and other pivots of the node are more than r away. So a
document is put into the region of each of its parts with at most c shingles whose parent has at
least (1 - r)(c + 1), which the triangle of sizes leaves for A, B and their union; every link lies in
a region that both documents share. Within a region, distances to fixed pivots (the shingle counts of
2^b hash ranges) bound d from below: only members whose windows of counts overlap stay connected.
Regions that share documents are then joined into one (connected components), so that each link is
in exactly one region.

Level 1 and up, pivots that are documents. Every region of three or more gets documents as pivots. Its members' distances
to them are computed. Members go to the Voronoi region of their nearest pivot p and, for exactness, into
every region q with d(x, q) <= d(x, p) + 2r (triangle inequality: if d(x, y) <= r then d(y, p) <= d(y, p_y)
+ 2r for x's pivot p). Members within r of a pivot are linked to it at once. A region whose members are all
connected by then is done, the others are joined recursively. A region of up to REGION_DOCS documents
goes through this recursion within one task (``pivot_links``), down to pairs or regions
that no longer shrink, which are joined by their intersection counts. Larger regions are spread over
tasks in chunks level by level; one that no longer shrinks is joined in tiles, the members outside its
largest connected class against all.

Identical sets are one node (a class) from the start, so exact copies cost nothing. No link between
different sets is lost, and no region, class or candidate list is capped. Shingles are 64-bit hashes.

A part that a large share of all classes holds is found in a sample of the classes and joined without
being gathered; which parts are found changes the work, not the result.

Null and empty texts have no shingles; they link with nothing and are their own component. A text of
fewer than k words is one shingle, its whole word sequence. Rows that share a doc_id are rows of that
id: each gets the component of its own set. A null doc_id never names a component that has another.
Very long texts are hashed whole. An empty table gives no rows. Columns beyond doc_id and text are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MASK64, WordHash, discard, mixed, multipliers, parts, rolling, scratch, sliced, streamed, utf8_column, written
from .graph import components, labels

#: Members of a part's region that are compared by their counts; larger regions are joined as they are.
PART_DOCS = 4096
#: Numbers that one block of count differences may hold.
COUNT_BLOCK = 1 << 23
#: Bits of the largest count vector; a set of n shingles has about n / 4 counts.
MOST_COUNT_BITS = 12
#: A region up to this many documents and shingles is joined in one task; leaves and pivots of the recursion there.
REGION_DOCS, REGION_SHINGLES = 192, 4_000_000
LEAF, LEAF_PIVOTS = 2, 4
#: One of this many classes is looked at for parts that many classes hold.
HOT_SAMPLE = 16
PIVOTS, CHUNK_DOCS, MOST_LEVELS = 16, 96, 4
#: Classes that a task remembers so as to send their parts once.
MOST_SEEN = 1_000_000
#: Candidates up to this number are broadcast to the texts; more are known by a bitmap there, of this many bits for each and MOST_BITS in all (16 MB).
BROADCAST_ROWS, CANDIDATE_BITS, MOST_BITS = 50_000, 16, 1 << 27


class Shingles:
    """Sorted distinct 64-bit hashes of a text's k-word shingles."""

    def __init__(self, k: int):
        self.k, self.hashes = k, WordHash()

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: lowers A-Z only, splits at \x20 \x09-\x0D
        if not words:
            return np.empty(0, np.uint64)
        h = self.hashes.of(words)
        if len(words) >= self.k:
            return np.unique(rolling(h, self.k))
        with np.errstate(over="ignore"):
            return mixed(np.array([np.sum(h * np.array(multipliers(self.k)[: len(h)])) + np.uint64(len(h))], dtype=np.uint64))


def class_of(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def _own(rows: list[dict], s: Shingles) -> tuple[list[dict], list[np.ndarray]]:
    """Rows of distinct classes with their sets; texts of another class (rows that share an id) are left out."""
    sets = {r["cid"]: (r, h) for r in rows if class_of(h := s.of(r["text"].encode())) == r["cid"]}
    return [r for r, _ in sets.values()], [h for _, h in sets.values()]


def part_sizes(num: int, den: int) -> tuple[int, int]:
    """(c, q) for r = 1 - num/den: most shingles of a part, fewest of its parent."""
    c = max(1, -(-den // (den - num)) - 1)
    return c, -(-num * (c + 1) // den)


def part_keys(sets: list[np.ndarray], c: int, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(set number, key) of all parts of at most c shingles whose parent node has at least q; sets are sorted."""
    h = np.concatenate([np.empty(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    level, node = multipliers(2)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    live = np.flatnonzero(size[owner] >= q) if len(h) else np.empty(0, np.int64)
    owners, keys = [], []
    for depth in range(1, 64):
        if not len(live):
            break
        prefix, who = h[live] >> np.uint64(64 - depth), owner[live]
        begin = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (who[1:] != who[:-1])]))
        n = np.diff(np.append(begin, len(live)))
        small = n <= c
        at = live[begin[small]]
        content = sums[at + n[small]] - sums[at]
        keys.append(mixed(content + np.uint64(depth * int(level) & MASK64) + prefix[begin[small]] * node))
        owners.append(who[begin[small]])
        live = live[np.repeat(n >= q, n)]
    return (np.concatenate(owners), np.concatenate(keys)) if owners else (np.empty(0, np.int64), np.empty(0, np.uint64))


def count_vector(h: np.ndarray) -> bytes:
    """Counts (up to 255) of shingles in 2^b equal hash ranges."""
    bits = min(MOST_COUNT_BITS, max(0, (len(h) // 4).bit_length()))
    at = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return np.minimum(np.bincount(at, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def may_link(n: np.ndarray, counts: list[bytes], num: int, den: int) -> list[tuple[int, int]]:
    """(member, first member) of the components that sizes and L1 distances of count vectors leave; n is sorted."""
    v = [np.frombuffer(x, np.uint8).astype(np.int16) for x in counts]
    width = min(map(len, v))
    # coarser ranges are sums of finer ones; a clipped count bounds nothing, so its members stay with all
    v = np.stack([x.reshape(width, -1).sum(axis=1, dtype=np.int16) for x in v])
    clipped = np.array([255 in x for x in counts])
    # only sizes of at least num/den of each other can link
    first = np.searchsorted(den * n, num * n)
    rows = max(1, COUNT_BLOCK // max(1, width * int((np.arange(len(n)) - first).max() + 1)))
    a, b = [], []
    for at in range(0, len(n), rows):
        end, lo = min(at + rows, len(n)), int(first[at])
        far = np.abs(v[at:end, None, :] - v[None, lo:end, :]).sum(axis=2, dtype=np.int32)
        # d <= r means |A - B| + |B - A| <= (1 - t) / (1 + t) * (|A| + |B|)
        ok = far * (den + num) <= (den - num) * (n[at:end, None] + n[None, lo:end])
        ok |= clipped[at:end, None] | clipped[None, lo:end]
        i, j = np.nonzero(ok)
        keep = j + lo < i + at
        a.append(i[keep] + at)
        b.append(j[keep] + lo)
    label = labels(len(n), np.concatenate(a), np.concatenate(b))
    return [(i, int(r)) for i, r in enumerate(label.tolist()) if i != r]


def _hashed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, tid, n, cid, counts, keys) of (doc_id, tid, text): set size and class (hash of the set) of each document, and once from each task
    that holds the class, its count vector and the regions (parts) that it is put into."""
    schema = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n", pa.int64()), ("cid", pa.int64()), ("counts", pa.binary()), ("keys", pa.list_(pa.int64()))])
    c, q = part_sizes(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seen = Shingles(k), set()
        for batch in sliced(batches):
            sets = [s.of(t) for t in utf8_column(batch, "text")]
            cid = [class_of(h) if len(h) else None for h in sets]
            fresh: dict[int, int] = {}
            for i, x in enumerate(cid):
                if x is not None and x not in seen:
                    fresh.setdefault(x, i)
            seen.update(fresh)
            if len(seen) > MOST_SEEN:
                seen.clear()
            at = sorted(fresh.values())
            owner, keys = part_keys([sets[i] if len(sets[i]) >= q else sets[i][:0] for i in at], c, q)
            order = np.argsort(owner, kind="stable")
            edge = np.searchsorted(owner[order], np.arange(len(at) + 1))
            signed = keys[order].view(np.int64)
            lists: list = [None] * len(sets)
            counts: list = [None] * len(sets)
            for j, i in enumerate(at):
                lists[i], counts[i] = signed[edge[j] : edge[j + 1]], count_vector(sets[i])
            cols = [batch.column("doc_id"), batch.column("tid"), pa.array([len(h) for h in sets], pa.int64()), pa.array(cid, pa.int64()), pa.array(counts, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return docs.mapInArrow(run, "doc_id long, tid long, n long, cid long, counts binary, keys array<long>")


def _hot_parts(postings: DataFrame) -> DataFrame | None:
    """(key) of at most 4 p parts that more than 1/(4 p) of the sampled (cid, key) name, p the number of shuffle partitions; None if there is none."""
    p = parts(postings)
    some = postings.where(F.pmod(F.xxhash64("cid"), F.lit(HOT_SAMPLE)) == 0).groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    total = some.agg(F.sum("c")).first()[0] or 0
    hot = some.where(F.col("c") > max(total // (4 * p), 2 * PART_DOCS // HOT_SAMPLE)).select("key").limit(4 * p)
    rows = [(r["key"],) for r in hot.collect()]  # at most 4 p numbers
    return postings.sparkSession.createDataFrame(rows, "key long") if rows else None


def _part_edges(shared: DataFrame, classes: DataFrame, folder: str, num: int, den: int) -> DataFrame:
    """(a, b) that connect the members of each part's region; shared has (key, cid, hub, c) with c members."""
    few = shared.where(F.col("c") <= PART_DOCS).join(classes.select("cid", "n"), "cid")
    lists = few.groupBy("key").agg(F.collect_set(F.struct("n", "cid")).alias("m"))  # at most PART_DOCS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of sizes without a gap that no link can cross; equal runs have equal names."""
        schema = pa.schema([("run", pa.int64()), ("cid", pa.int64())])
        for batch in sliced(batches):
            found: dict[int, list[int]] = {}
            for m in batch.column("m").to_pylist():
                m = sorted((x["n"], x["cid"]) for x in m)
                at = 0
                for i in range(1, len(m) + 1):
                    if i == len(m) or den * m[i - 1][0] < num * m[i][0]:
                        if i - at > 1:
                            ids = [c for _, c in m[at:i]]
                            found[xxhash.xxh3_64_intdigest(np.array(ids, np.int64).tobytes()) - (1 << 63)] = ids
                        at = i
            if found:
                yield pa.RecordBatch.from_pydict({"run": [k for k, ids in found.items() for _ in ids], "cid": [c for ids in found.values() for c in ids]}, schema=schema)

    runs = written(lists.mapInArrow(split, "run long, cid long").distinct(), folder, "runs")
    counted = runs.join(classes.select("cid", "n", "counts"), "cid").groupBy("run").agg(F.collect_list(F.struct("n", "cid", "counts")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in sliced(batches, 64):
            found: dict[tuple[int, int], None] = {}
            for m in batch.column("m").to_pylist():
                m.sort(key=lambda x: (x["n"], x["cid"]))
                for i, j in may_link(np.array([x["n"] for x in m]), [x["counts"] for x in m], num, den):
                    found[m[i]["cid"], m[j]["cid"]] = None
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=schema)

    many = shared.where((F.col("c") > PART_DOCS) & (F.col("cid") != F.col("hub"))).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    return counted.mapInArrow(compare, "a long, b long").unionAll(many).distinct()


def shared_counts(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Intersection sizes of all sets of a with all sets of b (or a), by products of 0/1 matrices over shared shingles."""
    sets = a if b is None else [*a, *b]
    sizes = np.array([len(s) for s in sets])
    if b is None and len(a) == 2:
        x = len(np.intersect1d(a[0], a[1], assume_unique=True))
        return np.array([[sizes[0], x], [x, sizes[1]]])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, keep = np.repeat(np.arange(len(sets)), sizes), n[at] > 1
    shared = np.flatnonzero(n > 1)
    col, row = np.searchsorted(shared, at[keep]), row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((len(a), len(a if b is None else b)), np.float64)
    step = max(64, (1 << 22) // max(1, len(sets)))
    for first in range(0, len(shared), step):
        lo, hi = np.searchsorted(col, [first, first + step])
        m = np.zeros((len(sets), min(step, len(shared) - first)), np.float32)
        m[row[lo:hi], col[lo:hi] - first] = 1
        out += m[: len(a)] @ (m if b is None else m[len(a) :]).T
    out = np.rint(out).astype(np.int64)
    if b is None:
        np.fill_diagonal(out, sizes)
    return out


def _linked(x: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return den * x >= num * (na[:, None] + nb[None, :] - x)


def _stars(linked: np.ndarray) -> list[tuple[int, int]]:
    """(member, first member of its component) for all but the first members, from a symmetric matrix of links."""
    size = len(linked)
    label = np.arange(size)
    while True:
        low = np.minimum(np.where(linked, label[None, :], size).min(axis=1), label)
        low = low[low]
        if (low == label).all():
            return [(i, int(r)) for i, r in enumerate(label.tolist()) if i != r]
        label = low


def pivot_links(sets: list[np.ndarray], num: int, den: int, leaf: int = LEAF, taken: list[str] | None = None) -> list[tuple[int, int]]:
    """(member, first member of its component) for all but the first members of a region.

    Pivots, Voronoi regions with windows, recursion; only leaves and regions that keep most of their members are joined pairwise.
    ``taken`` is told which way each step went.
    """
    n = np.array([len(s) for s in sets])
    label = np.arange(len(sets))
    todo = [label]
    while todo:
        own = todo.pop()
        if len(np.unique(label[own])) == 1:
            continue
        mine = [sets[i] for i in own]
        if taken is not None:
            taken.append("leaf" if len(own) <= leaf else "pivots")
        if len(own) <= leaf:
            found = [(own[i], own[j]) for i, j in _stars(_linked(shared_counts(mine), n[own], n[own], num, den))]
        else:
            pivots = own[np.linspace(0, len(own) - 1, min(LEAF_PIVOTS, len(own) - 1)).astype(int)]
            x = shared_counts(mine, [sets[i] for i in pivots])
            d = 1 - x / (n[own][:, None] + n[pivots][None, :] - x)
            found = [(own[i], pivots[j]) for i, j in zip(*np.nonzero(_linked(x, n[own], n[pivots], num, den)), strict=True)]
            window = d <= d.min(axis=1, keepdims=True) + 2 * (1 - num / den) + 1e-9
            children = [own[w] for w in window.T if w.sum() > 1]
            if any(len(c) > 0.7 * len(own) for c in children):
                label = _merged(label, found)
                if len(np.unique(label[own])) > 1:
                    if taken is not None:
                        taken.append("pairs")
                    found = [(own[i], own[j]) for i, j in _stars(_linked(shared_counts(mine), n[own], n[own], num, den))]
            else:
                todo += children
        label = _merged(label, found)
    return [(i, int(r)) for i, r in enumerate(label.tolist()) if i != r]


def _merged(label: np.ndarray, found: list[tuple[int, int]]) -> np.ndarray:
    if not found:
        return label
    a, b = np.array(found).T
    every = np.arange(len(label))
    return labels(len(label), np.concatenate([every, a]), np.concatenate([label, b]))


def _sorted_by(df: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return df.repartition(parts(df), *keys).sortWithinPartitions(*keys, *more)


def _joined_regions(members: DataFrame, keys: list[str], k: int, num: int, den: int) -> DataFrame:
    """(a, b) links that connect each region: members has (*keys, cid, text), regions fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, schema = Shingles(k), pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for rows in streamed(batches, keys):
            own, sets = _own(rows, s)
            if len(own) > 1:
                found = pivot_links(sets, num, den)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": [own[i]["cid"] for i, _ in found], "b": [own[j]["cid"] for _, j in found]}, schema=schema)

    return _sorted_by(members.select(*keys, "cid", "text"), keys).mapInArrow(run, "a long, b long")


def _pivot_distances(members: DataFrame, sizes: DataFrame, level: int, k: int, num: int, den: int) -> DataFrame:
    """(cell, cid, link, pivots, distances): per member the pivots of its Voronoi region and window, nearest first, and those within r."""
    draw = F.xxhash64(F.lit(level), "cid")
    pivots = members.groupBy("cell", F.pmod(F.xxhash64(F.lit(-1 - level), "cid"), F.lit(PIVOTS)).alias("slot")).agg(F.min_by(F.struct("cid", "text"), draw).alias("p"))
    chunks = sizes.select("cell", F.ceil(F.col("docs") / CHUNK_DOCS).cast("int").alias("chunks"))
    spread = pivots.join(chunks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("role"), "p.cid", "p.text")
    dealt = members.join(chunks, "cell").select("cell", F.pmod(draw, F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("role"), "cid", "text")
    r = 1 - num / den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Shingles(k)
        schema = pa.schema([("cell", pa.int64()), ("cid", pa.int64()), ("links", pa.list_(pa.int64())), ("pivots", pa.list_(pa.int64()))])
        for rows in streamed(batches, ["cell", "chunk"]):
            (piv, ps), (own, ms) = (_own([x for x in rows if x["role"] == k], s) for k in (0, 1))
            if not own or not piv:
                continue
            pn, mn = (np.array([len(x) for x in y]) for y in (ps, ms))
            x = shared_counts(ms, ps)
            d = 1 - x / (mn[:, None] + pn[None, :] - x)
            near, ids = _linked(x, mn, pn, num, den), np.array([p["cid"] for p in piv])
            window = d <= d.min(axis=1, keepdims=True) + 2 * r + 1e-9
            yield pa.RecordBatch.from_pydict({"cell": [o["cell"] for o in own], "cid": [o["cid"] for o in own], "links": [ids[v] for v in near], "pivots": [ids[v] for v in window]}, schema=schema)

    return _sorted_by(spread.unionAll(dealt), ["cell", "chunk"], "role").mapInArrow(run, "cell long, cid long, links array<long>, pivots array<long>")


def _split_large(members: DataFrame, folder: str, k: int, num: int, den: int) -> list[DataFrame]:
    """Links of the regions that are too large for a task; members has (cell, cid, n, text), each cid of a cell once.

    What several plans need is written, so that each plan is some exchanges long: the driver plans a query anew after
    every exchange, and one plan of a whole level took it hundreds of MB.
    """
    links: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        sizes = written(members.groupBy("cell").agg(F.count(F.lit(1)).alias("docs")), folder, f"sizes{level}")
        near = written(_pivot_distances(members, sizes, level, k, num, den), folder, f"near{level}")
        links.append(near.select(F.col("cid").alias("a"), F.explode("links").alias("b")).where("a <> b"))
        known = links[0]
        for x in links[1:]:
            known = known.unionAll(x)
        roots = components(known, folder, f"level{level}").withColumnRenamed("node", "cid")
        children = near.select("cell", "cid", F.explode("pivots").alias("pivot")).join(roots, "cid", "left").join(members.select("cell", "cid", "n"), ["cell", "cid"])
        children = written(children.select("cell", "cid", "n", F.xxhash64("cell", "pivot").alias("child"), F.coalesce("root", "cid").alias("root")), folder, f"children{level}")
        stats = children.groupBy("cell", "child").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("volume"), F.min("root").alias("low"), F.max("root").alias("top"))
        fits = F.expr(f"docs <= {REGION_DOCS} and volume <= {REGION_SHINGLES}")
        shrunk = F.expr("docs <= 0.7 * parent") & F.lit(level + 1 < MOST_LEVELS)
        # children whose members are all connected are done
        still = stats.where("low <> top").join(sizes.select("cell", F.col("docs").alias("parent")), "cell").select("child", F.when(fits, "task").when(shrunk, "deeper").otherwise("tiles").alias("way"))
        still = written(children.join(still, "child").select("cell", "cid", "n", "child", "root", "way"), folder, f"still{level}")
        ways = {r["way"] for r in still.select("way").distinct().collect()}  # three at most
        texts = members.select("cell", "cid", "text")

        def of(way: str, rows: DataFrame = still, texts: DataFrame = texts) -> DataFrame:
            return rows.where(F.col("way") == way).join(texts, ["cell", "cid"]).select(F.col("child").alias("cell"), "cid", "n", "text")

        # written, as the next level and the final components read them again
        if "task" in ways:
            links.append(written(_joined_regions(of("task"), ["cell"], k, num, den), folder, f"joined{level}"))
        if "tiles" in ways:
            # children that keep most of their parent overlap each other: they are joined as one
            stuck = written(still.where("way = 'tiles'").select("cell", "cid", "root").distinct(), folder, f"stuck{level}")
            main = stuck.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("cell").agg(F.max_by("root", "c").alias("main"))
            stuck = written(stuck.join(main, "cell").select("cell", "cid", (F.col("root") != F.col("main")).alias("other")), folder, f"others{level}")
            links.append(written(_joined_regions(_tiles(stuck, texts), ["cell", "i", "j"], k, num, den), folder, f"tiled{level}"))
        if "deeper" not in ways:
            break
        members = written(of("deeper"), folder, f"members{level}")
    return links


def _tiles(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(cell, i, j, cid, text): the chunks i of members (cell, cid, other) outside the main class against all chunks j."""
    others = F.ceil(F.sum(F.col("other").cast("int")) / CHUNK_DOCS).cast("int")
    count = rows.groupBy("cell").agg(others.alias("ci"), F.ceil(F.count(F.lit(1)) / CHUNK_DOCS).cast("int").alias("cj"))
    dealt = rows.join(count, "cell").where("ci > 0").join(texts, ["cell", "cid"])
    draw = F.xxhash64("cid")
    all_of = lambda c: F.transform(F.sequence(F.lit(0), F.col("ci" if c == "j" else "cj") - 1), lambda x: F.struct(*((x.alias("i"), F.pmod(draw, F.col("cj")).cast("int").alias("j")) if c == "j" else (F.pmod(draw, F.col("ci")).cast("int").alias("i"), x.alias("j")))))
    # a member is its chunk j of all chunks i, and if it is outside the main class its chunk i of all chunks j
    at = F.explode(F.concat(all_of("j"), F.when(F.col("other"), all_of("i")).otherwise(F.array())))
    return dealt.select("cell", at.alias("at"), "cid", "text").select("cell", "at.i", "at.j", "cid", "text")


def _texts_of(named: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """``named`` (rep, rep_tid and more, so many rows) with their texts, without shuffling all texts.

    Few rows are broadcast. Of more only a bitmap of hashes is; the texts that it lets through, and a few others, are joined by sorting.
    """
    docs = docs.where(F.col("text").isNotNull())
    if rows <= BROADCAST_ROWS:
        named = F.broadcast(named)
    else:
        bits = min(CANDIDATE_BITS * rows, MOST_BITS)
        slot = lambda tid: F.pmod(F.xxhash64(F.lit(7), tid), F.lit(bits))
        page, bit = (lambda c: F.shiftright(c, 15)), (lambda c: F.pmod(c, F.lit(1 << 15)))  # a page has 4 KB
        pages = named.select(slot("rep_tid").alias("s")).groupBy(page("s").alias("page")).agg(F.bitmap_construct_agg(bit(F.col("s"))).alias("bits"))
        # bit b of a page is bit b % 8 of byte b / 8
        byte = F.conv(F.hex(F.substring("bits", (F.shiftright("at", 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = (page("slot") == F.col("page")) & (byte.bitwiseAND(F.pow(F.lit(2), F.pmod(F.col("at"), F.lit(8))).cast("int")) != 0)
        docs = docs.withColumn("slot", slot("tid")).withColumn("at", bit(F.col("slot"))).join(F.broadcast(pages), held, "left_semi").drop("slot", "at")
    return docs.join(named, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("tid") == F.col("rep_tid")))


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id per row of ``docs`` (doc_id, text): documents link when den * |A n B| >= num * |A u B|."""
    spark = docs.sparkSession
    folder = scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tid"))
    base = written(_hashed(docs, k, num, den), folder, "base")  # texts are hashed once
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("x")
    classes = base.where("n > 0").groupBy("cid").agg(first, F.max("n").alias("n"), F.min("counts").alias("counts"))
    classes = written(classes.select("cid", F.col("x.doc_id").alias("rep"), F.col("x.tid").alias("rep_tid"), "n", "counts"), folder, "classes")
    postings = base.where("keys is not null").select("cid", F.explode("keys").alias("key"))
    hot, hot_edges = _hot_parts(postings), None
    if hot is not None:
        hot = F.broadcast(hot)
        hubs = postings.join(hot, "key").groupBy("key").agg(F.min("cid").alias("b"))
        hot_edges = postings.join(F.broadcast(hubs), "key").select(F.col("cid").alias("a"), "b").where("a <> b")
        postings = postings.join(hot, "key", "left_anti")
    # one exchange serves the counting and the join
    postings = postings.repartition(parts(docs), "key")
    cells = postings.groupBy("key").agg(F.min("cid").alias("hub"), F.max("cid").alias("top"), F.count(F.lit(1)).alias("c")).where("hub <> top").drop("top")
    shared = written(postings.join(cells, "key"), folder, "shared")
    edges = _part_edges(shared, classes, folder, num, den)
    edges = edges if hot_edges is None else edges.unionAll(hot_edges)
    regions = components(edges, folder, "regions").withColumnRenamed("node", "cid").withColumnRenamed("root", "cell")
    for name in ("shared", "runs"):
        discard(spark, folder, name)
    sizes = regions.join(classes.select("cid", "rep", "rep_tid", "n"), "cid").select("cell", "cid", "rep", "rep_tid", "n")
    sizes = written(sizes, folder, "candidates")
    stats = sizes.groupBy("cell").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
    stats = stats.select("cell", F.expr(f"docs > {REGION_DOCS} or shingles > {REGION_SHINGLES}").alias("large"))
    named = sizes.join(stats, "cell")
    members = written(_texts_of(named, docs, sizes.count()).select("cell", "cid", "n", "text", "large"), folder, "members")
    links = _joined_regions(members.where("not large"), ["cell"], k, num, den)
    large = members.where("large").drop("large")
    if not large.isEmpty():
        large = written(large.dropDuplicates(["cell", "cid"]), folder, "large")
        for more in _split_large(large, folder, k, num, den):
            links = links.unionAll(more)
        roots = components(written(links, folder, "links"), folder, "linked")
    else:
        links = written(links, folder, "links")  # already stars of whole components
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    for name in ("members", "large"):
        discard(spark, folder, name)
    named = roots.join(classes.select(F.col("cid").alias("node"), "rep"), "node")
    lowest = named.groupBy("root").agg(F.min("rep").alias("component"))
    joined = named.join(lowest, "root").select(F.col("node").alias("cid"), "component")
    final = classes.select("cid", "rep").join(joined, "cid", "left").select("cid", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    final = written(final, folder, "final")
    return base.select("doc_id", "n", "cid").join(final, "cid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("class_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("class_id"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"))
