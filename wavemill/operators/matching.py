"""Fingerprint matching that bears bit errors and loses no offset.

If the words of two signals at an offset differ by ``most_bits`` on average, at least one pair of them differs by no more. Words
that differ by at most d bits share one of d + 1 pieces of their bits (pigeonhole), so a join by pieces finds every such pair;
it runs over distinct words, however often they occur, and a pair that shares several pieces counts under the first. Runs of equal words
then give the offsets at which a pair of words meets, as intervals, and each offset found is compared word by word.

The fewer bits, the longer the pieces and the cheaper the join: at 8 of 32 bits a piece has three or four bits, and about one pair in two
of the distinct words is compared. ``word_bits`` below ``most_bits`` finds only offsets with a pair of words that near.

Long signals would meet at nearly every offset, and word by word that is all pairs of words. Where every offset is asked for
(``word_bits`` is not below ``most_bits``), they are compared by transforms of their segments instead (``correlated``).

Rows with a null take no part; of rows with an equal place the smallest word counts. An empty side gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places after which a run of equal words is cut, so that no signal has to go through one task.
CUT = 4096
#: Keys among which the runs of one word are dealt.
DEALT = 16
#: Places of a segment, and the words that segments hold on average from which on they are correlated by transforms.
SEGMENT, LONG = 16_384, 256


def pieces(width: int, bits: int) -> list[tuple[int, int]]:
    """(start, length) of bits + 1 pieces of ``width`` bits; one empty piece, which all words share, if every two words are that near."""
    if bits >= width:
        return [(0, 0)]
    edges = [width * k // (bits + 1) for k in range(bits + 2)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _piece(word: Column, start: int, length: int) -> Column:
    return F.shiftrightunsigned(word, start).bitwiseAND(F.lit((1 << length) - 1).cast("long"))


def near_words(a: DataFrame, b: DataFrame, bits: int, width: int = 32) -> DataFrame:
    """(word, other): every pair of distinct words of both sides within ``bits`` bits, once."""
    cut = pieces(width, bits)
    keyed = lambda df: df.select("word").distinct().select("word", F.posexplode(F.array(*[_piece(F.col("word"), *p) for p in cut])).alias("p", "key"))
    apart = F.col("word").bitwiseXOR(F.col("other"))
    # no piece before this one is equal
    first = F.lit(True)
    for n, p in enumerate(cut[:-1]):
        first = first & ((F.col("p") <= n) | (_piece(apart, *p) != 0))
    return keyed(a).join(keyed(b).withColumnRenamed("word", "other"), ["p", "key"]).where((F.bit_count(apart) <= bits) & first).select("word", "other")


def _whole(df: DataFrame, width: int) -> DataFrame:
    rows = df.select("signal_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("word").cast("long").alias("word")).dropna()
    fits = (F.shiftrightunsigned("word", width) == 0) if width < 64 else F.lit(True)
    rows = rows.withColumn("word", F.when(fits, F.col("word")).otherwise(F.raise_error(F.lit(f"a word has more than {width} bits")).cast("long")))
    return rows.groupBy("signal_id", "block_idx").agg(F.min("word").alias("word"))


def runs(words: DataFrame) -> DataFrame:
    """(signal_id, word, first, last): places that follow each other and hold an equal word."""
    part = F.floor(F.col("block_idx") / CUT)
    w = Window.partitionBy("signal_id", "part").orderBy("block_idx")
    new = F.coalesce((F.lag("word").over(w) != F.col("word")) | (F.lag("block_idx").over(w) != F.col("block_idx") - 1), F.lit(True))
    marked = words.withColumn("part", part).withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(w))
    return marked.groupBy("signal_id", "part", "run").agg(F.min("word").alias("word"), F.min("block_idx").alias("first"), F.max("block_idx").alias("last")).drop("part", "run")


def run_starts(words: DataFrame) -> DataFrame:
    """The rows whose word is not that of the row before in their signal. Rows go by parts of CUT places; of other parts only the last word is looked at."""
    placed = words.withColumn("part", F.floor(F.col("block_idx") / CUT))
    ends = placed.groupBy("signal_id", "part").agg(F.max_by("word", "block_idx").alias("end"))
    ends = ends.select("signal_id", "part", F.lag("end").over(Window.partitionBy("signal_id").orderBy("part")).alias("end"))
    w = Window.partitionBy("signal_id", "part").orderBy("block_idx")
    marked = placed.withColumns({"n": F.row_number().over(w), "before": F.lag("word").over(w)}).join(ends, ["signal_id", "part"])
    before = F.when(F.col("n") == 1, F.col("end")).otherwise(F.col("before"))
    return marked.where(before.isNull() | (before != F.col("word"))).select(*words.columns)


def met_words(offsets: DataFrame, q: DataFrame, c: DataFrame) -> DataFrame:
    """(query_id, signal_id, offset, words, bits) of given offsets, without those at which no words meet.

    Parts of CUT places of both sides are rows; two parts that meet do so once, with all their offsets.
    """
    parts = lambda df, *names: df.groupBy(F.col("signal_id").alias(names[0]), F.floor(F.col("block_idx") / CUT).cast("long").alias(names[1])).agg(F.collect_list(F.struct("block_idx", "word")).alias(names[2]))
    a, b = parts(q, "query_id", "qs", "qv"), parts(c, "signal_id", "cs", "cv")
    asked = q.select(F.col("signal_id").alias("query_id"), F.floor(F.col("block_idx") / CUT).cast("long").alias("qs")).distinct()
    low = F.col("qs") * CUT + F.col("offset")
    spread = offsets.join(asked, "query_id").withColumn("cs", F.explode(F.sequence(F.floor(low / CUT), F.floor((low + (CUT - 1)) / CUT))))
    pairs = spread.groupBy("query_id", "qs", "signal_id", "cs").agg(F.collect_list("offset").alias("offsets"))
    met = pairs.join(a, ["query_id", "qs"]).join(b, ["signal_id", "cs"]).select("query_id", "signal_id", "qs", "cs", "offsets", "qv", "cv")
    cut = CUT

    def dense(rows: pa.ListScalar, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each place of a part: its word, whether it is there, whether its word is null."""
        word, there, null = np.zeros(cut, np.uint64), np.zeros(cut, bool), np.zeros(cut, bool)
        at = rows.values.field("block_idx").to_numpy(zero_copy_only=False) - part * cut
        values = rows.values.field("word")
        word[at] = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        there[at], null[at] = True, values.is_null().to_numpy(zero_copy_only=False)
        return word, there, null

    def run(batches):
        for batch in batches:
            for i, (qs, cs) in enumerate(zip(batch.column("qs").to_pylist(), batch.column("cs").to_pylist(), strict=True)):
                (x, xt, xn), (y, yt, yn) = dense(batch.column("qv")[i], qs), dense(batch.column("cv")[i], cs)
                found = []
                for offset in batch.column("offsets")[i].as_py():
                    by = (qs - cs) * cut + offset  # place k of the one part meets place k + by of the other
                    u, v = slice(max(0, -by), min(cut, cut - by)), slice(max(0, by), min(cut, cut + by))
                    both = xt[u] & yt[v]
                    known = both & ~xn[u] & ~yn[v]
                    if n := int(both.sum()):
                        found.append((offset, n, int(known.sum()), int(np.bitwise_count(x[u] ^ y[v])[known].sum())))
                if found:
                    keys = [batch.column(k).take(pa.array([i] * len(found))) for k in ("query_id", "signal_id")]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(v, pa.int64()) for v in zip(*found, strict=True))], names=["query_id", "signal_id", "offset", "words", "known", "apart"])

    kinds = dict(met.dtypes)
    parts_met = met.mapInArrow(run, f"query_id {kinds['query_id']}, signal_id {kinds['signal_id']}, offset long, words long, known long, apart long")
    return parts_met.groupBy("query_id", "signal_id", "offset").agg(F.sum("words").alias("words"), F.try_divide(F.sum("apart"), F.sum("known")).alias("bits"))


def _segments(rows: DataFrame, name: str, s: str) -> DataFrame:
    return rows.select(F.col("signal_id").alias(name), F.floor(F.col("block_idx") / SEGMENT).cast("long").alias(s), "block_idx", "word")


def correlated(q: DataFrame, c: DataFrame, width: int = 32) -> DataFrame:
    """(query_id, signal_id, offset, words, bits) of every offset at which words meet.

    Each segment of a query meets each segment of a signal in one task. Bits are 1 or -1, and 0 where no word is; the product of their
    transforms gives how many bits agree less how many do not at every offset, whole numbers of at most width * SEGMENT,
    far from a transform's rounding. A pair costs SEGMENT * log(SEGMENT) a bit instead of SEGMENT ** 2.
    """
    a, b = _segments(q, "query_id", "qs"), _segments(c, "signal_id", "cs")
    keys = ["query_id", "qs", "signal_id", "cs"]
    a, b = a.crossJoin(F.broadcast(b.select("signal_id", "cs").distinct())), b.crossJoin(F.broadcast(a.select("query_id", "qs").distinct()))
    a, b = (x.select(*[F.col(n).alias(n) for n in (*keys, "block_idx", "word")]) for x in (a, b))  # names of their own
    kinds = dict(a.dtypes)

    def transform(places: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros(n)
        x[places] = bits
        return np.fft.rfft(x)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sides = []
        for t in (left, right):
            at, word = t.column("block_idx").to_numpy(), t.column("word").to_numpy().view(np.uint64)
            sides.append((at.min() if len(at) else 0, at, word))
        (la, pa_, wa), (lb, pb, wb) = sides
        schema = pa.schema([(k, left.schema.field(k).type) for k in ("query_id", "signal_id")] + [(k, pa.int64()) for k in ("offset", "words", "apart")])
        if not len(pa_) or not len(pb):
            return schema.empty_table()
        pa_, pb = pa_ - la, pb - lb
        n = 1 << int(pa_.max() + pb.max() + 1).bit_length()
        met = np.rint(np.fft.irfft(np.conj(transform(pa_, np.ones(len(pa_)), n)) * transform(pb, np.ones(len(pb)), n), n)).astype(np.int64)
        total = np.zeros(n // 2 + 1, complex)
        for bit in range(width):
            x, y = (2.0 * ((w >> np.uint64(bit)) & np.uint64(1)).astype(float) - 1 for w in (wa, wb))
            total += np.conj(transform(pa_, x, n)) * transform(pb, y, n)
        agree = np.rint(np.fft.irfft(total, n)).astype(np.int64)
        some = np.flatnonzero(met)
        offset = np.where(some > pb.max(), some - n, some) + lb - la
        names = [pa.array([left.column(k)[0].as_py()] * len(some), left.schema.field(k).type) for k in ("query_id", "signal_id")]
        return pa.Table.from_arrays([*names, pa.array(offset, pa.int64()), pa.array(met[some]), pa.array((width * met[some] - agree[some]) // 2)], schema=schema)

    found = a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, f"query_id {kinds['query_id']}, signal_id {kinds['signal_id']}, offset long, words long, apart long")
    return found.groupBy("query_id", "signal_id", "offset").agg(F.sum("words").alias("words"), (F.sum("apart") / F.sum("words")).alias("bits"))


def _long(rows: DataFrame) -> bool:
    segments = _segments(rows, "id", "s").groupBy("id", "s").agg(F.count(F.lit(1)).alias("n"))
    return (segments.agg(F.avg("n")).first()[0] or 0) >= LONG


def match_within(queries: DataFrame, corpus: DataFrame, most_bits: float = 4.0, word_bits: int | None = None, width: int = 32) -> DataFrame:
    """(query_id, signal_id, offset, words, bits): all offsets at which the words that meet differ by at most ``most_bits`` bits on average.

    Both sides are (signal_id, block_idx, word); word ``block_idx + offset`` of the signal meets word ``block_idx`` of the query.
    """
    bits = int(most_bits) if word_bits is None else word_bits
    if most_bits < 0 or bits < 0:
        raise ValueError("bits must not be negative")
    q, c = _whole(queries, width), _whole(corpus, width)
    # an offset within the average has a pair of words that near, so nothing is added by leaving out the search for such pairs
    if bits >= int(most_bits) and _long(q) and _long(c):
        return correlated(q, c, width).where(F.col("bits") <= most_bits)
    rq = runs(q).select(F.col("signal_id").alias("query_id"), "word", F.col("first").alias("qa"), F.col("last").alias("qb"))
    rc = runs(c).select("signal_id", F.col("word").alias("other"), F.col("first").alias("ca"), F.col("last").alias("cb"))
    # a word that many places hold is dealt to DEALT keys on the corpus' side and meets each of them
    rc = rc.withColumn("deal", F.pmod(F.xxhash64("signal_id", "ca"), F.lit(DEALT)).cast("int"))
    met = rq.join(near_words(q, c, bits, width), "word").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    offsets = met.join(rc, ["other", "deal"]).select("query_id", "signal_id", F.explode(F.sequence(F.col("ca") - F.col("qb"), F.col("cb") - F.col("qa"))).alias("offset")).distinct()
    asked = q.select(F.col("signal_id").alias("query_id"), F.col("block_idx").alias("qi"), F.col("word").alias("qw"))
    both = offsets.join(asked, "query_id").withColumn("block_idx", F.col("qi") + F.col("offset")).join(c, ["signal_id", "block_idx"])
    apart = F.bit_count(F.col("qw").bitwiseXOR(F.col("word")))
    return both.groupBy("query_id", "signal_id", "offset").agg(F.count(F.lit(1)).alias("words"), F.avg(apart).alias("bits")).where(F.col("bits") <= most_bits)
