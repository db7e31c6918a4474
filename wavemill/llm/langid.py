"""Language identification by nearest centroid.

A text becomes a TF-IDF vector of hashed byte 2- and 3-grams of its letters (lower case, everything
else a blank), of length one. Each language has several centroids, found by spherical k-means on a
bounded, hash-chosen sample of labelled rows (``per_lang`` distinct texts for each language that occurs;
the IDF weights are part of the fit). A text takes the language of the centroid with the largest cosine, which is its
score. It is rejected if its distance (1 - cosine) is beyond the centroid's radius for texts of its
length: short texts have few n-grams and lie farther out. The radii come from pieces of the sample rows
of 8, 16, 32 ... bytes and the rows themselves: the ``quantile`` of their distances to their own
language's centroids, plus ``slack`` of what is left to 1 (more where there are few pieces).

Null texts and texts without a letter are ``und`` with score 0 and rejected. One-letter texts are
classified like others. Rows are independent of each other, so repeated rows give repeated results.
Ties go to the language that sorts first. With nothing to learn from, every text is ``und``. Very long
texts are read whole. An empty table gives no rows. Columns named lang_pred, score and rejected are
replaced, all others kept. Ids play no part but in the choice of the sample, where they may repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, sliced, utf8_column

#: Hash buckets of the n-gram vector.
DIMS = 1 << 13
#: Texts whose vectors are in memory at once.
BATCH = 256
#: Radii are by length of the text's letters: 2^3 bytes or less, 2^4 ... 2^12 or more.
LENGTHS = range(3, 13)
#: Pieces that tell a centroid's radius for a length; with fewer, those of the whole language do.
FEW = 50
_KEEP = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[a-z]")


def letters(text: bytes | None) -> bytes | None:
    """Lower-case words joined and framed by blanks; None if there is no letter."""
    if not text:
        return None
    plain = text.isascii()
    s = (text if plain else text.decode("utf-8", "replace").lower().encode()).translate(_KEEP)
    if not _ASCII_LETTER.search(s) and (plain or not any(c.isalpha() for c in text.decode("utf-8", "replace"))):
        return None
    return b" " + b" ".join(s.split()) + b" "


def counts(s: bytes) -> np.ndarray:
    """Counts of hashed 2- and 3-grams."""
    b = np.frombuffer(s, dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(256) + b[1:]
    three = two[:-1] * np.uint32(256) + b[2:]
    # Fibonacci hashing of the packed bytes
    h = np.concatenate([two + np.uint32(0x5BD1E995), three]) * np.uint32(2654435769) >> np.uint32(32 - 13)
    return np.bincount(h, minlength=DIMS).astype(np.float32)


def length(s: bytes) -> int:
    """The place in LENGTHS of letters ``s``."""
    return min(max(len(s).bit_length() - 1, LENGTHS[0]), LENGTHS[-1]) - LENGTHS[0]


def pieces(s: bytes, at: int) -> list[bytes]:
    """``s`` and, for each shorter one of LENGTHS, words of ``s`` that just reach it, from a place that differs with ``at``."""
    out = [s]
    for n in (1 << k for k in LENGTHS if 1 << k < len(s) - 1):
        start = s.rfind(b" ", 0, at * 7919 % (len(s) - n) + 1)
        end = s.find(b" ", start + n - 1)
        out.append(s[start : end + 1])
    return out


@dataclass
class CentroidModel:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one per row
    owner: np.ndarray  # its language
    radius: np.ndarray  # of a centroid, for each of LENGTHS

    def vectors(self, texts: list[bytes]) -> np.ndarray:
        x = np.stack([counts(s) for s in texts])
        np.sqrt(x, out=x)
        x *= self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        cleaned = [(i, s) for i, t in enumerate(texts) if (s := letters(t)) is not None] if self.langs else []
        for at in range(0, len(cleaned), BATCH):
            some = cleaned[at : at + BATCH]
            cos = self.vectors([s for _, s in some]) @ self.centroids.T
            best = cos.argmax(axis=1)
            for (i, s), b, c in zip(some, best.tolist(), cos[np.arange(len(some)), best].tolist(), strict=True):
                lang[i], score[i], out[i] = self.langs[self.owner[b]], min(max(c, 0.0), 1.0), 1 - c > self.radius[b, length(s)]
        return lang, score, out


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; empty clusters go."""
    seeds = [x.mean(axis=0)]
    near = x @ seeds[0]
    for _ in range(min(k, len(x)) - 1):
        seeds.append(x[near.argmin()])
        near = np.maximum(near, x @ seeds[-1])
    c = np.stack(seeds)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
        home = (x @ c.T).argmax(axis=1)
        c = np.stack([x[home == j].sum(axis=0) for j in np.unique(home)])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)


def _radii(model: CentroidModel, c: np.ndarray, rows: list[bytes], quantile: float, slack: float) -> np.ndarray:
    """For each centroid of a language and each of LENGTHS, the distance beyond which a text is rejected."""
    cut = [p for at, s in enumerate(rows) for p in pieces(s, at)]
    cos = np.concatenate([model.vectors(cut[at : at + BATCH]) @ c.T for at in range(0, len(cut), BATCH)])
    home, far, size = cos.argmax(axis=1), 1 - cos.max(axis=1), np.array([length(p) for p in cut])
    out = np.zeros((len(c), len(LENGTHS)))
    for k in range(len(LENGTHS)):
        for j in range(len(c)):
            # the nearest shorter length stands in for one without enough pieces
            some = [d for d in (far[(size == k) & (home == j)], far[size == k]) if len(d) >= FEW]
            if not some and k:
                out[j, k] = out[j, k - 1]
                continue
            d = some[0] if some else far
            edge = float(np.quantile(d, quantile, method="higher"))
            out[j, k] = edge + max(slack, min(0.8, 20 / len(d))) * (1 - edge)
    return np.minimum(out, 1 - 1e-6)  # a text without a known n-gram is always rejected


def fit(rows: list[tuple[bytes, str]], clusters: int = 4, slack: float = 0.25, quantile: float = 0.99) -> CentroidModel:
    rows = [(s, lang) for t, lang in rows if lang is not None and (s := letters(t)) is not None]
    langs = sorted({lang for _, lang in rows})
    none = np.zeros((0, DIMS), np.float32), np.zeros(0, int), np.zeros((0, len(LENGTHS)))
    if not rows:
        return CentroidModel([], np.ones(DIMS, np.float32), *none)
    df = sum((counts(s) > 0).astype(np.float32) for s, _ in rows)
    model = CentroidModel(langs, (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32), *none)
    cents, owner, radius = [], [], []
    for k, lang in enumerate(langs):
        own = [s for s, y in rows if y == lang]
        c = _clusters(model.vectors(own), clusters)
        cents.append(c)
        owner += [k] * len(c)
        radius.append(_radii(model, c, own, quantile, slack))
    model.centroids, model.owner, model.radius = np.concatenate(cents), np.array(owner), np.concatenate(radius)
    return model


def sample(docs: DataFrame, per_lang: int) -> list[tuple[bytes, str]]:
    """About per_lang texts of each language, at most, chosen by the hash of id and text. Reads text and lang."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sizes.count()
    sizes = F.broadcast(sizes) if langs <= 100_000 else sizes
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 40))
    some = labelled.withColumn("draw", draw).join(sizes, "lang").where(F.col("draw") < (1 << 40) * F.least(F.lit(1.0), 1.2 * (per_lang + 20) / F.col("n")))
    # repeated rows are one; the limit only guards the driver, as the draw leaves about 1.2 * per_lang of each language
    rows = some.select("lang", "text", "draw").distinct().orderBy("draw").limit(2 * (per_lang + 20) * langs).collect()
    rows.sort(key=lambda r: (r["draw"], r["text"]))
    taken: dict[str, int] = {}
    out = []
    for r in rows:
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_lang:
            out.append((r["text"].encode(), r["lang"]))
    return out


def identify(docs: DataFrame, learn: DataFrame | None = None, per_lang: int = 500, clusters: int = 4, slack: float = 0.25) -> DataFrame:
    """``docs`` with lang_pred, score and rejected. Learns from (doc_id, text, lang) of ``learn``, else of ``docs``."""
    source = docs if learn is None else learn
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(source, per_lang), clusters, slack))  # about 130 KB per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in sliced(batches):
            lang, score, out = held.value.predict(utf8_column(batch, "text"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(out, pa.bool_())], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    clash = [c for c in docs.columns if c in ("lang_pred", "score", "rejected")]
    docs = docs.drop(*clash)
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["lang_pred string, score double, rejected boolean"])
    return docs.mapInArrow(run, ddl)
