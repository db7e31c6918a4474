"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words and runs of other signs. The features of a text are its hashed tokens and token
pairs, weighted by the square root of their share, so that every vector has length one. Training runs
FTRL-proximal updates over a bounded, hash-chosen sample of labelled rows (``most_rows``); a score is
the logistic function of the sparse dot product of features and weights plus the bias.

A null or empty text has no features: its score is that of the bias. Labels that are null are not
used; of several labels of one id the mean decides (0.5 counts as 1). Rows are scored one by one, so
repeated rows give repeated results. With nothing to learn from all scores are 0.5. Very long texts are
read whole. An empty table gives no rows. A column named score is replaced, all others are kept. Rows that
share a labelled id are labelled alike; the sample is of distinct texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, mixed, multipliers, sliced, utf8_column

BITS = 18
_TOKEN = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")


class Features:
    """Indexes and weights of a text's features."""

    def __init__(self) -> None:
        self.hashes = WordHash()

    def of(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text) if text else []
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        h = self.hashes.of(tokens)
        a, b = multipliers(2)
        both = np.concatenate([h, mixed(h[:-1] * a + h[1:] * b)]) >> np.uint64(64 - BITS)
        index, n = np.unique(both, return_counts=True)
        return index.astype(np.int64), np.sqrt(n / len(both))


def train(rows: list[tuple[bytes, int]], epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.1) -> np.ndarray:
    """Weights by FTRL-proximal; the last one is the bias."""
    f = Features()
    made = [(*f.of(t), float(y)) for t, y in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(z[at]) <= l1, 0.0, w)

    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in rng.permutation(len(made)):
            index, x, y = made[k]
            at, v = np.append(index, 1 << BITS), np.append(x, 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(len(z)))


def sample(docs: DataFrame, labels: DataFrame, most_rows: int) -> list[tuple[bytes, int]]:
    """At most most_rows distinct labelled texts, those whose ids (then texts) have the smallest hashes."""
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 40))
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y")).withColumn("draw", draw)
    n = known.count()
    limit = int(min(1.0, 1.1 * (most_rows + 20) / max(n, 1)) * (1 << 40))
    some = known.where(F.col("draw") < limit)
    # the ids are as bounded as the sample itself; texts are filtered by the same draw before they meet
    texts = docs.where(F.col("text").isNotNull() & (draw < limit)).select("doc_id", "text")
    rows = texts.join(some, "doc_id").select("draw", "text", "y").distinct().orderBy("draw", F.xxhash64("text"), "text").limit(most_rows).collect()
    return [(r["text"].encode(), r["y"]) for r in rows]


def score(docs: DataFrame, learn: DataFrame, labels: DataFrame, most_rows: int = 6000) -> DataFrame:
    """``docs`` with a column score. Learns from (doc_id, text) of ``learn`` and (doc_id, quality) of ``labels``."""
    rows = sample(learn, labels, most_rows)
    held = docs.sparkSession.sparkContext.broadcast((train(rows) if rows else np.zeros((1 << BITS) + 1)).astype(np.float32))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, w = Features(), held.value.astype(np.float64)
        for batch in sliced(batches):
            dots = []
            for t in utf8_column(batch, "text"):
                index, x = f.of(t)
                dots.append(w[index] @ x + w[-1])
            s = 1 / (1 + np.exp(-np.clip(np.array(dots, dtype=float), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*batch.schema.names, "score"])

    docs = docs.drop("score")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["score double"])
    return docs.mapInArrow(run, ddl)
