"""Matching with bit errors against all offsets of all pairs."""

import numpy as np
import pytest

from wavemill.operators import matching as M

DDL = "signal_id long, block_idx long, word long"


def every_offset(q, c, most):
    """{(query, signal, offset): (words, bits)} of {signal: {place: word}}."""
    out = {}
    for a, x in q.items():
        for b, y in c.items():
            for offset in {j - i for i in x for j in y}:
                bits = [(x[i] ^ y[i + offset]).bit_count() for i in x if i + offset in y]
                if bits and sum(bits) / len(bits) <= most:
                    out[a, b, offset] = (len(bits), sum(bits) / len(bits))
    return out


def table(spark, signals):
    return spark.createDataFrame([(s, i, w) for s, v in signals.items() for i, w in v.items()], DDL).repartition(3)


def found(df):
    return {(r["query_id"], r["signal_id"], r["offset"]): (r["words"], r["bits"]) for r in df.collect()}


@pytest.mark.parametrize("most", [0.0, 2.5, 6.0])
def test_all_offsets_of_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(M, "CUT", 8)
    rng = np.random.default_rng(1)
    signals = {s: {i: int(w) for i, w in enumerate(rng.integers(0, 1 << 32, 40))} for s in range(3)}
    for i in range(12):  # a copy in which every word has two to four wrong bits, so that no word is equal
        wrong = sum(1 << int(b) for b in rng.choice(32, rng.integers(2, 5), replace=False))
        signals[1][20 + i] = signals[0][5 + i] ^ wrong
    query = {7: {i: signals[0][5 + i] for i in range(12)}, 8: {i: 0 for i in range(5)}}
    for i in range(10, 30):
        signals[2][i] = 0  # silence, longer than a cut
    del signals[2][15]  # and with a gap
    got, want = found(M.match_within(table(spark, query), table(spark, signals), most)), every_offset(query, signals, most)
    assert set(got) == set(want) and all(got[k][0] == want[k][0] and np.isclose(got[k][1], want[k][1]) for k in want)
    assert ((7, 1, 20) in got) == (most > 4) and (7, 0, 5) in got and (8, 2, 11) in got


def test_pieces_cover_the_word_and_near_words_are_whole(spark):
    for bits in range(33):
        cut = M.pieces(32, bits)
        assert sum(n for _, n in cut) == (32 if bits < 32 else 0) and all(n > 0 for _, n in cut) == (bits < 32)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 32, 60)
    b = np.array([w ^ sum(1 << int(k) for k in rng.choice(32, n % 7, replace=False)) for n, w in enumerate(a.tolist())])
    frames = [spark.createDataFrame([(int(w),) for w in [*x, *x]], "word long") for x in (a, b)]
    got = [tuple(r) for r in M.near_words(*frames, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == {(x, y) for x in a.tolist() for y in b.tolist() if (x ^ y).bit_count() <= 4}


def test_odd_rows(spark):
    q = spark.createDataFrame([(1, 0, 5), (1, 0, 9), (1, None, 5), (None, 0, 5), (1, 1, None)], DDL)
    assert found(M.match_within(q, q, 0.0)) == {(1, 1, 0): (1, 0.0)}
    none = spark.createDataFrame([], DDL)
    assert M.match_within(none, q).count() == 0 and M.match_within(q, none).count() == 0
    with pytest.raises(Exception, match="more than 32 bits"):
        M.match_within(spark.createDataFrame([(1, 0, 1 << 32)], DDL), q).count()
    with pytest.raises(ValueError, match="negative"):
        M.match_within(q, q, -1.0)


def test_long_signals_by_transforms_of_segments(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(f"s{n}", int(b) - 40, int(w)) for n in range(3) for b, w in zip(np.flatnonzero(rng.random(260) < 0.8), rng.integers(0, 1 << 32, 260), strict=False)]
    rows += [("s1", 500 + b, rows[b][2] ^ (b % 7)) for b in range(60)]  # words of s0 again, with bit errors
    w = spark.createDataFrame(rows, "signal_id string, block_idx long, word long")
    found = lambda most: sorted(tuple(r) for r in M.match_within(w, w, most).collect())
    joined = {most: found(most) for most in (2.5, 8.0, 14.0)}
    monkeypatch.setattr(M, "LONG", 1)
    monkeypatch.setattr(M, "near_words", None)  # words are not joined
    for segment in (64, 16_384):
        monkeypatch.setattr(M, "SEGMENT", segment)
        for most, want in joined.items():
            got = found(most)
            assert [r[:4] for r in got] == [r[:4] for r in want] and len(got) >= 3
            assert np.allclose([r[4] for r in got], [r[4] for r in want], rtol=0, atol=1e-12)


def test_words_meet_at_given_offsets_in_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "CUT", 8)
    rng = np.random.default_rng(8)
    signals = {s: {i: int(w) for i, w in enumerate(rng.integers(0, 1 << 32, n)) if i % 9 != s} for s, n in ((0, 40), (1, 70), (2, 3))}
    signals[1][30] = signals[0][12] = None
    offsets = [(0, s, o) for s in signals for o in (-90, -33, -8, -1, 0, 1, 7, 16, 65)]
    df = table(spark, signals)
    got = found(M.met_words(spark.createDataFrame(offsets, "query_id long, signal_id long, offset long"), df.where("signal_id = 0"), df))
    want = {}
    for q, s, o in offsets:
        both = [(w, signals[s][i + o]) for i, w in signals[q].items() if i + o in signals[s]]
        bits = [(a ^ b).bit_count() for a, b in both if a is not None and b is not None]
        if both:
            want[q, s, o] = (len(both), sum(bits) / len(bits) if bits else None)
    assert got == want and len(got) > 12


def test_starts_of_runs_over_parts(spark, monkeypatch):
    monkeypatch.setattr(M, "CUT", 4)
    words = {0: [5, 5, 5, 5, 5, 6, None, 6, 6, 7, 7, 7, 7, 7, 7, 7, 7, 7], 1: [7, 7]}
    df = table(spark, {s: dict(enumerate(v)) for s, v in words.items()})
    got = sorted((r["signal_id"], r["block_idx"], r["word"]) for r in M.run_starts(df).where("word is not null").collect())
    assert got == [(0, 0, 5), (0, 5, 6), (0, 7, 6), (0, 9, 7), (1, 0, 7)]
