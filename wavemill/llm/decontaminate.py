"""Benchmark decontamination with one FM-index per training shard.

Words are runs of ASCII letters and digits and of non-ASCII characters, after lower-casing A-Z. A test
phrase is a window of ``window`` consecutive words of a benchmark item (the whole item if it is
shorter). A shard is what a task gathers before its index is built: SHARD_WORDS indexed words or
SHARD_BYTES of text. Only stretches of words that occur in the benchmark and are at least as long as
the shortest phrase are indexed; nothing else can hold a phrase.

The index of a shard has the Burrows-Wheeler transform of its word ids in a wavelet matrix (bit planes
with sampled ranks) and every SAMPLE-th suffix position. All phrases are searched backwards at once,
each step being two wavelet ranks; occurrences are located by walking to sampled positions. Their
spans are merged per document.

The benchmark is sent to the executors once, as symbols of its words (about a byte for each byte of text).
Phrases are made from it in blocks of BLOCK_PHRASES, and all blocks are searched in one index of a shard.
Only a benchmark of more than MOST_BENCH_BYTES takes a further pass for each such part.

A null or empty text has no words. Items without words or id are no items; repeated items count once by
their id. Very long texts are indexed whole (they make a shard of their own). Repeated documents are
searched one by one. Without items no document is contaminated; an empty table gives no rows. Columns
named n_words, item_ids, hit_spans and clean_text are replaced, all others are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, utf8_column, written

SHARD_WORDS = 1 << 20
SHARD_BYTES = 24 << 20
SAMPLE = 8
MOST_BENCH_BYTES = 64 << 20
BLOCK_PHRASES = 200_000
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WaveletMatrix:
    """Rank and access on a sequence of small non-negative integers."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        n = len(seq)
        self.words: list[np.ndarray] = []
        self.ranks: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            packed = np.packbits(np.pad(bit.astype(np.uint8), (0, 64 - n % 64)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ranks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            one = bit.astype(bool)
            self.zeros.append(int(n - one.sum()))
            seq = np.concatenate([seq[~one], seq[one]])
        # where each symbol's run begins after the last level
        symbols = np.arange(sigma)
        self.base = self._down(symbols, np.zeros(sigma, np.int64))

    def _ones(self, level: int, i: np.ndarray) -> np.ndarray:
        at = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ranks[level][at] + np.bitwise_count(self.words[level][at] & mask)

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.bits):
            ones = self._ones(level, i)
            i = np.where((c >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before place i."""
        return self._down(c, i) - self.base[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and its rank there."""
        c = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            bit = (self.words[level][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, i)
            c = (c << 1) | bit.astype(np.int64)
            i = np.where(bit.astype(bool), self.zeros[level] + ones, i - ones)
        return c, i - self.base[c]


def suffix_array(text: np.ndarray, sigma: int) -> np.ndarray:
    """Order of all suffixes; text ends in a unique smallest symbol. Sorts groups that are still tied by doubling."""
    n, width = len(text), max(1, int(sigma - 1).bit_length())
    per = max(1, 62 // width)
    padded = np.concatenate([text.astype(np.int64), np.zeros(per, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(per):
        key = (key << width) | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    k = per
    tied = np.flatnonzero(~(first & np.concatenate([first[1:], [True]])))
    while len(tied):
        pos = sa[tied]
        group, follow = rank[pos], rank[np.minimum(pos + k, n)]
        order = np.lexsort((follow, group))
        pos, group, follow = pos[order], group[order], follow[order]
        sa[tied] = pos
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (follow[1:] != follow[:-1])])
        rank[pos] = np.maximum.accumulate(np.where(first, tied, 0))
        tied = tied[~(first & np.concatenate([first[1:], [True]]))]
        k *= 2
    return sa


class FMIndex:
    """Counts and locates patterns of symbols 1.. in a text of symbols >= 1 (0 is the end)."""

    def __init__(self, text: np.ndarray, sigma: int):
        text = np.append(text, 0)
        sa = suffix_array(text, sigma)
        self.wave = WaveletMatrix(text[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        marked = sa % SAMPLE == 0
        self.marked = np.cumsum(np.concatenate([[0], marked])).astype(np.int32)
        self.sampled = sa[marked].astype(np.int32)
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of left-aligned patterns (rows of symbols, padded) by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(patterns.shape[1]):
            live = np.flatnonzero((lo < hi) & (lengths > step))
            c = patterns[live, lengths[live] - 1 - step]
            lo[live] = self.before[c] + self.wave.rank(c, lo[live])
            hi[live] = self.before[c] + self.wave.rank(c, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by stepping back to a sampled position."""
        out = np.zeros(len(rows), np.int64)
        todo, row = np.arange(len(rows)), rows.astype(np.int64)
        for step in range(SAMPLE):
            hit = self.marked[row + 1] > self.marked[row]
            out[todo[hit]] = self.sampled[self.marked[row[hit]]] + step
            todo, row = todo[~hit], row[~hit]
            if not len(todo):
                break
            c, r = self.wave.access(row)
            row = self.before[c] + r
        return out


class Phrases:
    """The test phrases of benchmark items: windows of words, or whole items of fewer words."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        # symbol 0 ends the text, 1 separates stretches
        self.vocab: dict[bytes, int] = {}
        same: dict[bytes, list[str]] = {}
        for item, text in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 2) for w in words(text)], dtype=np.int32)
            if len(ids):
                same.setdefault(ids.tobytes(), []).append(item)
        self.window = window
        #: the items of each distinct text
        self.owners = [sorted(set(v)) for v in same.values()]
        texts = [np.frombuffer(k, np.int32) for k in same]
        n = np.array([len(t) for t in texts], dtype=np.int64)
        self.symbols = np.concatenate([*texts, np.zeros(window, np.int32)])
        self.ends = np.cumsum(n)
        self.shortest = int(np.minimum(n, window).min(initial=window))
        # places of all words but those within window - 1 words of an end, and the first place of each short item
        left = np.repeat(self.ends, n) - np.arange(len(self.symbols) - window)
        first = np.zeros(len(left), bool)
        first[self.ends - n] = True
        self.starts = np.flatnonzero((left >= window) | (first & (left < window))).astype(np.int32)
        self.held: list = []

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(patterns padded by 0, lengths, place in owners)."""
        if self.held:
            yield from self.held
            return
        for at in range(0, len(self.starts), BLOCK_PHRASES):
            start = self.starts[at : at + BLOCK_PHRASES]
            owner = np.searchsorted(self.ends, start, side="right")
            lengths = np.minimum(self.ends[owner] - start, self.window)
            patterns = self.symbols[start[:, None] + np.arange(self.window)]
            patterns[np.arange(self.window) >= lengths[:, None]] = 0
            if len(self.starts) <= BLOCK_PHRASES:
                self.held = [(patterns, lengths, owner)]
            yield patterns, lengths, owner

    def hits(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(document, first word, last word + 1, place in owners) of every occurrence in the shard."""
        texts, docs_of, starts, at = [], [], [], 0
        gap = np.ones(1, np.int64)
        for d, ids in enumerate(docs):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= self.shortest:
                    texts += [ids[a:b], gap]
                    docs_of.append(d)
                    starts.append((at, a))
                    at += b - a + 1
        if not texts or not len(self.starts):
            return
        text = np.concatenate(texts)
        index = FMIndex(text, len(self.vocab) + 2)
        here = np.zeros(len(self.vocab) + 2, bool)
        here[text] = here[0] = True
        begin, inside, of = np.array([s for s, _ in starts]), np.array([a for _, a in starts]), np.array(docs_of)
        for patterns, lengths, owner in self.blocks():
            some = here[patterns].all(axis=1)
            if not some.any():
                continue
            lo, hi = index.search(patterns[some], lengths[some])
            n = hi - lo
            phrase = np.repeat(np.flatnonzero(some), n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            place = index.locate(rows)
            run = np.searchsorted(begin, place, side="right") - 1
            word = place - begin[run] + inside[run]
            yield from zip(of[run].tolist(), word.tolist(), (word + lengths[phrase]).tolist(), owner[phrase].tolist(), strict=True)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what lies between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


_ADDED = {"n_words": ("long", pa.int64()), "item_ids": ("array<string>", pa.list_(pa.string())), "hit_spans": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))), "clean_text": ("string", pa.string())}


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, with_text: bool = False) -> DataFrame:
    """``docs`` with n_words, item_ids (sorted as strings), hit_spans (merged word spans, end excluded) and, if asked for, clean_text (the text without them)."""
    spark = docs.sparkSession
    bench = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = max(1, -(-size // MOST_BENCH_BYTES))
    names = ["n_words", "item_ids", "hit_spans", *(["clean_text"] if with_text else [])]
    docs = docs.drop(*names)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    folder = scratch(spark) if pieces > 1 else ""
    for piece in range(pieces):
        rows = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(pieces)) == piece).collect()
        # at most about MOST_BENCH_BYTES
        held = spark.sparkContext.broadcast(Phrases(sorted((r["item_id"], r["text"].encode()) for r in rows), window))
        docs = docs.mapInArrow(_search(held, names), ", ".join(kept + [f"{n} {_ADDED[n][0]}" for n in names]))
        if pieces > 1:
            docs = written(docs, folder, f"pass{piece}")
    return docs


def _search(held, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = held.value
        get = phrases.vocab.get
        waiting: list[tuple[pa.RecordBatch, list[bytes | None], list[int]]] = []
        ids: list[np.ndarray] = []
        held_words = held_bytes = 0

        def flush() -> Iterator[pa.RecordBatch]:
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for d, a, b, owner in phrases.hits(ids):
                spans.setdefault(d, []).append((a, b))
                items.setdefault(d, set()).update(phrases.owners[owner])
            d = 0
            for batch, texts, n in waiting:
                cols: dict[str, list] = {"n_words": n, "item_ids": [], "hit_spans": [], "clean_text": []}
                earlier = {c: batch.column(c).to_pylist() for c in ("item_ids", "hit_spans") if c in batch.schema.names}
                for i, text in enumerate(texts):
                    found = merged(spans.get(d, []) + [tuple(s) for s in earlier.get("hit_spans", {i: ()})[i] or ()])
                    cols["hit_spans"].append(found)
                    cols["item_ids"].append(sorted(items.get(d, set()) | set(earlier.get("item_ids", {i: ()})[i] or ())))
                    if "clean_text" in names:
                        cols["clean_text"].append(without(text, found).decode("utf-8", "replace") if found else text.decode("utf-8", "replace") if text is not None else None)
                    d += 1
                own = [c for c in batch.schema.names if c not in names]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(cols[n], _ADDED[n][1]) for n in names)], names=[*own, *names])
            waiting.clear()
            ids.clear()

        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, n = utf8_column(batch, "text"), []
                for t in texts:
                    w = words(t)
                    n.append(len(w))
                    x = np.fromiter(map(get, w, repeat(0)), dtype=np.int64, count=len(w))
                    ids.append(x)
                    held_words += int(np.count_nonzero(x))
                    held_bytes += len(t or b"") + 8 * len(w)
                waiting.append((batch, texts, n))
                if held_words >= SHARD_WORDS or held_bytes >= SHARD_BYTES:
                    yield from flush()
                    held_words = held_bytes = 0
        if waiting:
            yield from flush()

    return run
