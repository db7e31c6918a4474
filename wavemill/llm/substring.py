"""Substring deduplication by fixed-block anchors.

A window is ``window`` consecutive words (13). A word goes if it lies in a window of its document
whose word sequence also starts in a document with a smaller id. Any such window holds, in the
reference document, one whole block of BLOCK = (window + 1) // 2 words that starts at a multiple of
BLOCK: the anchor.

1. Index and probe. Documents are dealt to shards by the hash of their id. Each shard lists the
   fingerprints of all rolling BLOCK-word windows (the probes) and marks those that are reference
   blocks. The lists are exchanged by fingerprint range, as sorted and delta-coded arrays of about
   two to four bytes a word. A range returns to each shard those of its fingerprints that are
   anchors of something: a reference block somewhere, and seen more than once.
2. Extend. Each shard extends its hits to the full windows around them and sends the 96-bit hashes
   of these windows, with the smallest document of the shard that holds each, by hash range. What
   occurs more than once comes back with the smallest document of all.
3. Cut. Windows whose smallest document is another one are merged into maximal exact repeats, whose
   words are removed. Windows are judged on the input, not on what is left.

Fingerprints may collide, which only costs work in step 2; window hashes have 64 + 32 bits, so that even
10^13 windows are expected to hold less than one false repeat. No list is capped: a passage in every
document is one entry per shard.

Shards and ranges grow in number, not in size, with the input. Beyond GROUP of them lists take two steps,
so that their pieces do not grow with the square of the input: shards are grouped by GROUP, a first
exchange deals lists to (group, coarse range), where the lists of a group are merged into one, each entry
with its shard, and cut into fine ranges; answers go back the same way.

A null text has no words. Very long texts are processed whole (each lies in one shard). Documents without
a full window stay whole. A null id counts as larger than all others; rows with the same id, or without
one, never remove words from each other. Repeated rows under different ids are repeats. An empty table
gives no rows. Columns beyond doc_id and text are not read, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mixed, parts, rolling

SHARD_BYTES = 16 << 20
RANGE_ENTRIES = 2_000_000
#: Shards of a group, and coarse ranges.
GROUP = 4096


def pack(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as a first value and gaps of 2 or 4 bytes, with a list of the larger gaps."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    small, shift = (np.uint16, 16) if not len(gaps) or float(np.mean(gaps >> np.uint64(16) > 0)) < 0.15 else (np.uint32, 32)
    high = gaps >> np.uint64(shift)
    odd = np.flatnonzero(high)
    head = np.array([len(values), shift, len(odd), values[0]], dtype=np.uint64)
    return b"".join([head.tobytes(), odd.astype(np.uint32).tobytes(), high[odd].tobytes(), gaps.astype(small).tobytes()])


def unpack(blob: bytes) -> np.ndarray:
    if not blob:
        return np.empty(0, np.uint64)
    n, shift, n_odd, first = (int(x) for x in np.frombuffer(blob, np.uint64, 4))
    at = 32
    odd = np.frombuffer(blob, np.uint32, n_odd, at)
    high = np.frombuffer(blob, np.uint64, n_odd, at + 4 * n_odd)
    gaps = np.frombuffer(blob, np.uint16 if shift == 16 else np.uint32, n - 1, at + 12 * n_odd).astype(np.uint64)
    gaps[odd] += high << np.uint64(shift)
    out = np.empty(n, np.uint64)
    out[0] = first
    np.cumsum(gaps, out=out[1:])
    out[1:] += np.uint64(first)
    return out


class Shard:
    """Word hashes of a shard's documents, end to end, in the order of their ids."""

    def __init__(self, table: pa.Table):
        given = table.column("doc_id").to_pylist()
        none = np.array([i is None for i in given], dtype=bool)
        ids = np.array([0 if i is None else i for i in given], dtype=np.int64)
        self.order = np.lexsort((ids, none))
        self.ids, self.none = ids[self.order], none[self.order]
        texts = table.column("text").cast(pa.binary()).to_pylist()
        self.words = [(texts[i] or b"").split() for i in self.order.tolist()]
        self.n = np.array([len(w) for w in self.words], dtype=np.int64)
        self.start = np.cumsum(self.n) - self.n
        cache = WordHash()
        self.hashes = np.concatenate([np.empty(0, np.uint64), *map(cache.of, self.words)])
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.place = np.arange(len(self.hashes)) - np.repeat(self.start, self.n)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions at which a window of k words starts within one document, and all rolling hashes."""
        h = rolling(self.hashes, k)
        at = np.flatnonzero(self.place[: len(h)] + k <= self.n[self.doc[: len(h)]]) if len(h) else np.empty(0, np.int64)
        return at, h

    def wide_windows(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with a second, 32-bit hash."""
        at, h = self.windows(k)
        return at, h, (rolling(mixed(self.hashes ^ np.uint64(0x9E3779B97F4A7C15)), k) >> np.uint64(32)).astype(np.uint32)


def _found(sorted_values: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of x are in sorted_values, and where."""
    if not len(sorted_values):
        return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x, at


def _match(h: np.ndarray, x: np.ndarray, own_h: np.ndarray, own_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs own are among the pairs (h, x), sorted by h, and where."""
    found, at = _found(h, own_h)
    wrong = np.flatnonzero(found & (x[at] != own_x)) if len(h) else np.empty(0, np.int64)
    found[wrong] = False
    while len(wrong):  # equal 64-bit hashes of different windows
        at[wrong] += 1
        wrong = wrong[at[wrong] < len(h)]
        wrong = wrong[h[at[wrong]] == own_h[wrong]]
        hit = x[at[wrong]] == own_x[wrong]
        found[wrong[hit]] = True
        wrong = wrong[~hit]
    return found, np.minimum(at, max(len(h) - 1, 0))


def _slices(place: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of a sorted array."""
    if not len(place):
        return []
    begin = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return list(zip(place[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(place)], strict=True))


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


#: A list on its way: of shard (or group) ``own``, to range ``part`` (of group ``grp``).
_LIST = pa.schema([("grp", pa.int32()), ("part", pa.int32()), ("own", pa.int32()), ("data", pa.binary())])
_LIST_DDL = "grp int, part int, own int, data binary"
_ENTRY = [np.dtype("<u8"), np.dtype("<u4"), np.dtype("<i8"), np.dtype("u1"), np.dtype("<u2")]


def _write(columns: tuple[np.ndarray, ...]) -> bytes:
    """Hash, second hash, document, flags, shard of the group; numbers byte plane by byte plane, which the exchange compresses well."""
    return np.uint64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c.astype(t).view(np.uint8).reshape(-1, t.itemsize).T).tobytes() for c, t in zip(columns, _ENTRY, strict=True))


def _read(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """The columns of several lists, and the list of each entry."""
    out: list[list[np.ndarray]] = [[np.empty(0, t)] for t in [*_ENTRY, np.dtype(np.int64)]]
    for k, blob in enumerate(blobs):
        n, at = int(np.frombuffer(blob, np.uint64, 1)[0]), 8
        for c, t in enumerate(_ENTRY):
            planes = np.frombuffer(blob, np.uint8, n * t.itemsize, at).reshape(t.itemsize, n)
            out[c].append(np.ascontiguousarray(planes.T).view(t).reshape(-1))
            at += n * t.itemsize
        out[-1].append(np.full(n, k))
    return tuple(np.concatenate(c) for c in out)


#: Flags of an entry: several documents hold the window; the document is one without an id.
SEVERAL, NONE = 1, 2


def _minima(h: np.ndarray, x: np.ndarray, doc: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct (h, x), the smallest document of each (those without id last) and its flags; and the place there of each entry."""
    none = flags & NONE
    order = np.lexsort((doc, none, x, h))
    h, x, doc, none, flags = h[order], x[order], doc[order], none[order], flags[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (x[1:] != x[:-1])]) if len(h) else np.empty(0, bool)
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(h)) - 1 if len(at) else at
    several = (doc[at] != doc[last]) | (none[at] != none[last])
    if len(at):
        several |= np.bitwise_or.reduceat(flags & SEVERAL, at) > 0
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[at], x[at], doc[at], none[at] | (several * SEVERAL).astype(np.uint8), place


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, removed (word spans, end excluded) for each row of ``docs``."""
    block = (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a word and its blank take about 7 bytes; 16 fingerprint values a word leave few false hits
    bits = min(60, max(20, int(size // 7 + 1).bit_length() + 4))
    shards = max(2 * parts(docs), -(-size // SHARD_BYTES))
    ranges = max(parts(docs), -(-(size // 7) // RANGE_ENTRIES))
    group = GROUP
    grouped = max(shards, ranges) > group
    tag = max(1, (group - 1).bit_length()) if grouped else 0
    bits = min(bits, 62 - tag)
    per = -(-ranges // group)  # fine ranges of a coarse one
    width, wide_width = ((1 << n) // ranges + 1 for n in (bits, 64))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("own"))
    if docs.where("doc_id is null").take(1):
        # rows without an id are dealt by their texts
        dealt = dealt.withColumn("own", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(shards)).cast("int")).otherwise(F.col("own")))

    def of(fp: np.ndarray, w: int) -> np.ndarray:
        """The fine range of values, or the coarse one if lists are grouped."""
        fine = (fp // np.uint64(w)).astype(np.int64)
        return fine // per if grouped else fine

    def probes(s: Shard) -> tuple[np.ndarray, np.ndarray]:
        at, h = s.windows(block)
        return at, h[at] >> np.uint64(64 - bits)

    def listed(table: pa.Table) -> pa.Table:
        s, own = Shard(table), table.column("own")[0].as_py()
        at, fp = probes(s)
        aligned = (s.place[at] % block == 0).astype(np.uint64)
        v = np.sort((fp << np.uint64(1)) | aligned)
        first = np.concatenate([[True], v[1:] >> np.uint64(1) != v[:-1] >> np.uint64(1)]) if len(v) else np.empty(0, bool)
        begin = np.flatnonzero(first)
        n = np.diff(np.append(begin, len(v)))
        # a fingerprint with two flags: a reference block here; more than once here
        v = (v[begin] >> np.uint64(1) << np.uint64(2)) | ((v[begin + n - 1] & np.uint64(1)) << np.uint64(1)) | (n > 1).astype(np.uint64)
        return _table(_LIST, [(own // group, r, own, pack(v[a:b])) for r, a, b in _slices(of(v >> np.uint64(2), width))])

    def gathered(table: pa.Table) -> pa.Table:
        """The lists of a group in a coarse range as one, each entry with its shard, cut into fine ranges."""
        grp = table.column("grp")[0].as_py()
        v = np.sort(np.concatenate([(unpack(x) << np.uint64(tag)) | np.uint64(own % group) for x, own in zip(table.column("data").to_pylist(), table.column("own").to_pylist(), strict=True)]))
        fine = (v >> np.uint64(tag + 2)) // np.uint64(width)
        return _table(_LIST, [(grp, r, grp, pack(v[a:b])) for r, a, b in _slices(fine.astype(np.int64))])

    def anchors(table: pa.Table) -> pa.Table:
        lists = [unpack(x) for x in table.column("data").to_pylist()]
        v = np.sort(np.concatenate(lists)) >> np.uint64(tag)
        fp = v >> np.uint64(2)
        begin = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
        flags = np.bitwise_or.reduceat(v & np.uint64(3), begin)
        n = np.diff(np.append(begin, len(v)))
        hot = fp[begin][(flags & np.uint64(2) > 0) & ((n > 1) | (flags & np.uint64(1) > 0))]
        out = []
        for grp, part, own, mine in zip(*(table.column(c).to_pylist() for c in ("grp", "part", "own")), lists, strict=True):
            at = mine >> np.uint64(tag + 2)
            keep = _found(hot, at)[0]
            if keep.any():
                out.append((grp, part // per, own, pack((at[keep] << np.uint64(tag)) | (mine[keep] & np.uint64((1 << tag) - 1)))))
        return _table(_LIST, out)

    def returned(table: pa.Table) -> pa.Table:
        """The answers to a group from a coarse range, by shard."""
        grp = table.column("grp")[0].as_py()
        v = np.concatenate([unpack(x) for x in table.column("data").to_pylist()])
        own = (v & np.uint64((1 << tag) - 1)).astype(np.int64)
        order = np.lexsort((v, own))
        fp = v[order] >> np.uint64(tag)
        return _table(_LIST, [(grp, 0, grp * group + k, pack(fp[a:b])) for k, a, b in _slices(own[order])])

    def extended(docs_table: pa.Table, hits: pa.Table) -> pa.Table:
        if not docs_table.num_rows or not hits.num_rows:
            return _table(_LIST, [])
        s, own = Shard(docs_table), docs_table.column("own")[0].as_py()
        hot = np.sort(np.concatenate([unpack(x) for x in hits.column("data").to_pylist()]))
        at, fp = probes(s)
        hit = np.zeros(len(s.hashes) + 1, np.int64)
        hit[at[_found(hot, fp)[0]] + 1] = 1
        hit = np.cumsum(hit)
        wide, h, x = s.wide_windows(window)
        wide = wide[hit[wide + window - block + 1] > hit[wide]]
        h, x, doc, flags, _ = _minima(h[wide], x[wide], s.ids[s.doc[wide]], (s.none[s.doc[wide]] * NONE).astype(np.uint8))
        shard = np.full(len(h), own % group)
        return _table(_LIST, [(own // group, r, own, _write((h[a:b], x[a:b], doc[a:b], flags[a:b], shard[a:b]))) for r, a, b in _slices(of(h, wide_width))])

    def wide_gathered(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        *cols, _ = _read(table.column("data").to_pylist())
        order = np.argsort(cols[0], kind="stable")
        cols = [c[order] for c in cols]
        return _table(_LIST, [(grp, r, grp, _write(tuple(c[a:b] for c in cols))) for r, a, b in _slices((cols[0] // np.uint64(wide_width)).astype(np.int64))])

    def joined(table: pa.Table) -> pa.Table:
        h, x, doc, flags, shard, row = _read(table.column("data").to_pylist())
        _, _, low, told, place = _minima(h, x, doc, flags)
        keep = np.flatnonzero(told[place] & SEVERAL)
        keep = keep[np.argsort(row[keep], kind="stable")]
        names = list(zip(*(table.column(c).to_pylist() for c in ("grp", "part", "own")), strict=True))
        out = []
        for r, a, b in _slices(row[keep]):
            k = keep[a:b]
            grp, part, own = names[r]
            out.append((grp, part // per, own, _write((h[k], x[k], low[place[k]], told[place[k]], shard[k]))))
        return _table(_LIST, out)

    def wide_returned(table: pa.Table) -> pa.Table:
        grp = table.column("grp")[0].as_py()
        *cols, _ = _read(table.column("data").to_pylist())
        order = np.argsort(cols[4], kind="stable")
        cols = [c[order] for c in cols]
        return _table(_LIST, [(grp, 0, grp * group + k, _write(tuple(c[a:b] for c in cols))) for k, a, b in _slices(cols[4].astype(np.int64))])

    def cut(docs_table: pa.Table, hits: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed", pa.list_(pa.list_(pa.int32())))])
        if not docs_table.num_rows:
            return _table(schema, [])
        s = Shard(docs_table)
        gone = np.zeros(len(s.hashes) + 1, np.int64)
        if hits.num_rows:
            h, x, low, flags, _, _ = _read(hits.column("data").to_pylist())
            order = np.argsort(h, kind="stable")
            at, own, own_x = s.wide_windows(window)
            known, where = _match(h[order], x[order], own[at], own_x[at])
            at, where = at[known], order[where[known]]
            none, mine = flags[where] & NONE > 0, s.none[s.doc[at]]
            repeated = at[~none & (mine | (low[where] < s.ids[s.doc[at]]))]
            gone[repeated] += 1
            np.subtract.at(gone, repeated + window, 1)
        gone = np.cumsum(gone)[:-1] > 0
        out = []
        for i, (words, a, n) in enumerate(zip(s.words, s.start.tolist(), s.n.tolist(), strict=True)):
            mine = gone[a : a + n]
            doc = None if s.none[i] else int(s.ids[i])
            if not mine.any():
                out.append((doc, n, 0, b" ".join(words).decode("utf-8", "replace"), []))
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mine, [0]]))).tolist()
            kept = [words[j] for j in np.flatnonzero(~mine).tolist()]
            out.append((doc, n, n - len(kept), b" ".join(kept).decode("utf-8", "replace"), list(zip(edge[::2], edge[1::2], strict=True))))
        return _table(schema, out)

    def by(df: DataFrame, *keys: str):
        return df.groupBy(*keys)

    lists = by(dealt, "own").applyInArrow(listed, _LIST_DDL)
    if grouped:
        lists = by(lists, "grp", "part").applyInArrow(gathered, _LIST_DDL)
    hits = by(lists, "part").applyInArrow(anchors, _LIST_DDL)
    if grouped:
        hits = by(hits, "grp", "part").applyInArrow(returned, _LIST_DDL)
    lists = by(dealt, "own").cogroup(by(hits, "own")).applyInArrow(extended, _LIST_DDL)
    if grouped:
        lists = by(lists, "grp", "part").applyInArrow(wide_gathered, _LIST_DDL)
    repeats = by(lists, "part").applyInArrow(joined, _LIST_DDL)
    if grouped:
        repeats = by(repeats, "grp", "part").applyInArrow(wide_returned, _LIST_DDL)
    return by(dealt, "own").cogroup(by(repeats, "own")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_text string, removed array<array<int>>")


def kept_digest(kept_text):
    return F.sha2(F.encode(kept_text, "UTF-8"), 256)
