"""Helpers shared by the training-data operators: reading tables, scratch storage, words, hashes.

``scratch`` and ``written`` keep intermediate tables in the folder that the session names in
``spark.checkpoint.dir``. Only a local master may do without that setting; it gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Words kept in a worker's word cache before it is emptied; bounds the memory of one worker.
CACHE_WORDS = 300_000
#: Rows of an Arrow batch of whole texts; Spark's 10,000 are tens of MB in the JVM and again in the worker.
TEXT_ROWS = 1000
#: Called by ``released``: each gives back what its operator keeps in a worker between tasks.
KEPT: list = []


def released() -> None:
    """Called where another operator begins in a worker: tables that an earlier one left there are given back."""
    for free in KEPT:
        free()


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to TEXT_ROWS."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_ROWS:
        spark.conf.set(key, str(TEXT_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint folder, deleted when the session's JVM ends."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        held = jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavemill-"))
            held = jsc.sc().getCheckpointDir()
        top = held.get()
    path = jvm.org.apache.hadoop.fs.Path(f"{top}/wavemill-{uuid.uuid4().hex}")
    path.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cuts the lineage: writes ``df`` to shared storage and reads it again."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def discard(spark: SparkSession, folder: str, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_join(many: DataFrame, one: DataFrame, key: str, size: str, by: str, how: str = "inner") -> DataFrame:
    """Joins many rows per ``key`` with one row per key; ``one`` has the number of the key's rows in ``size``.

    A key that holds more than 1/(4 p) of all rows, p the number of shuffle partitions, is dealt over
    several tasks by the hash of ``by``, and its single row is repeated for each. There are at most 4 p such
    keys, so the table of them may be broadcast whatever the input. ``one`` is read twice: write it first.
    """
    p = parts(many)
    total = one.agg(F.sum(size)).first()[0] or 0
    each = max(total // (4 * p), 1000)
    hot = one.where(F.col(size) > each).select(F.col(key).alias("_wm_hot"), F.ceil(F.col(size) / each).cast("int").alias("_wm_n")).limit(4 * p)
    if not hot.take(1):
        return many.join(one, key, how)
    hot = F.broadcast(hot)
    salted = many.join(hot, F.col(key) == F.col("_wm_hot"), "left").withColumn("_wm_salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("_wm_n")).cast("int"), F.lit(0))).drop("_wm_hot", "_wm_n")
    copies = one.join(hot, F.col(key) == F.col("_wm_hot"), "left").withColumn("_wm_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_wm_n", F.lit(1)) - 1))).drop("_wm_hot", "_wm_n")
    return salted.join(copies, [key, "_wm_salt"], how).drop("_wm_salt")


def learn_side(doc_id) -> object:
    """True for the rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1. False without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1, F.lit(False))


class WordHash(dict):
    """64-bit hashes of words, computed once for each word; emptied when it grows too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def multipliers(k: int) -> list[np.uint64]:
    """k odd 64-bit numbers, by rule."""
    return [np.uint64(xxhash.xxh3_64_intdigest(b"place %d" % i) | 1) for i in range(k)]


def streamed(batches, keys: list[str]):
    """Runs of rows (dicts) with equal keys, from sorted partitions."""
    held: list[dict] = []
    for batch in sliced(batches):
        for row in batch.to_pylist():
            if held and any(row[k] != held[0][k] for k in keys):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of k values of h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i, m in enumerate(multipliers(k)):
        out += h[i : i + n] * m
    return mixed(out)


def sliced(batches, rows: int = 256, most_bytes: int = 16 << 20):
    """The batches in slices of few rows and bytes (a longer row is alone), so that only these are Python objects at a time."""
    for batch in batches:
        todo = [(at, min(rows, batch.num_rows - at)) for at in range(0, batch.num_rows, rows)][::-1]
        while todo:
            at, n = todo.pop()
            part = batch.slice(at, n)
            if n > 1 and part.nbytes > most_bytes:
                todo += [(at + n // 2, n - n // 2), (at, n // 2)]
            else:
                yield part


def utf8_column(batch, name: str) -> list[bytes | None]:
    """The texts of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    column = batch.column(name)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return column.cast(pa.binary()).to_pylist()
