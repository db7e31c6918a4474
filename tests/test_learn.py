import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.functions import matrices
from wavemill.operators import framing, learn, music


def table(spark, rows):
    return spark.createDataFrame([(i, int(y), [float(v) for v in f]) for i, (f, y) in enumerate(rows)], "obs_id long, label int, f array<double>")


def rings(n=96):
    a = 2 * np.pi * np.arange(n) / n
    return [((-5 + np.cos(t), 5 + np.sin(t)), 0) for t in a] + [((5 + np.cos(t), -5 + np.sin(t)), 1) for t in a]


def test_vote_breaks_ties_by_distance_then_by_fewer_neighbours():
    assert learn.vote([1, 2, 2], [0.1, 0.2, 0.3]) == 2
    assert learn.vote([1, 2], [0.1, 0.2]) == 1
    assert learn.vote([1, 2, 3], [0.5, 0.5, 0.5]) in (1, 2, 3)
    assert learn.vote([4], [0.0]) == 4


def test_knn_uses_the_normalised_query(spark):
    train = table(spark, [((0, 0), 0), ((1, 1000), 1), ((0.1, 900), 0), ((0.9, 100), 1)])
    got = learn.knn(train, table(spark, [((0.05, 990), 9)]), 1, "minmax").collect()
    assert got[0]["predicted"] == 0


def test_leave_one_out_and_custom_classifier(spark):
    obs = table(spark, [((0.0,), 0), ((0.1,), 0), ((0.2,), 0), ((5.0,), 1), ((5.1,), 1), ((5.2,), 1)])
    assert learn.leave_one_out(obs, 1).first()["accuracy"] == 1
    assert learn.leave_one_out(obs, classify=lambda train, q: learn.knn(train, q, 1)).first()["accuracy"] == 1


def test_forward_selection_leaves_noise_for_last(spark):
    rng = np.random.default_rng(3)
    rows = [((rng.random(), y + 0.1 * rng.random(), rng.random()), y) for y in (0, 1) for _ in range(8)]
    found = learn.forward_selection(table(spark, rows))
    assert found[0] == (1, 1.0) and len(found) == 3


def test_kmeans_and_gmm_separate_rings(spark):
    obs = table(spark, rings())
    out, centres = learn.kmeans(obs, np.array([[0.0, 1.0], [1.0, 0.0]]))
    assert sorted(np.round(centres).tolist()) == [[-5, 5], [5, -5]]
    assert out.groupBy("cluster").count().orderBy("cluster").collect()[0]["count"] == 96
    m = learn.gmm(obs, np.array([[-4.0, 4.0], [4.0, -4.0]]), 30)
    assert m.prior == pytest.approx([0.5, 0.5]) and m.mu == pytest.approx(np.array([[-5, 5], [5, -5]]), abs=1e-6)
    models = learn.gmm_classifier(obs, 1, 5)
    hit = learn.score_mixtures(obs, models).join(obs, "obs_id").agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]
    assert hit == 1


def test_empty_cluster_restarts(spark):
    obs = table(spark, rings(8))
    _, centres = learn.kmeans(obs, np.array([[-5.0, 5.0], [500.0, 500.0]]))
    assert np.isfinite(centres).all() and np.abs(centres).max() < 10


def test_covariance_and_pca(spark):
    x = np.array([[-2.5, -2], [-1.5, -1], [-0.5, -1], [0.5, 1], [1.5, 1], [2.5, 2], [0, 0], [0, 0]])
    obs = table(spark, [(r, 0) for r in x])
    p, values, _ = learn.pca(obs)
    expected = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert values == pytest.approx(expected)
    got = np.array([r["components"] for r in p.orderBy("obs_id").collect()])
    assert (got**2).sum() == pytest.approx((x**2).sum())
    c = {(r["i"], r["j"]): r["cov"] for r in learn.covariance(obs).collect()}
    assert c[0, 1] == pytest.approx(np.cov(x.T)[0, 1])
    with pytest.raises(ValueError):
        learn.svd(table(spark, [((1, 2, 3), 0), ((1, 0, 0), 0)]))


def test_svd_of_a_tall_table(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 6)) * [1e4, 10, 1, 1, 1e-3, 1e-5]
    u, w, v = learn.svd(table(spark, [(r, 0) for r in x]).repartition(40))
    got = np.array([r["u"] for r in u.orderBy("obs_id").collect()])
    assert w == pytest.approx(np.linalg.svd(x, compute_uv=False), rel=1e-9)  # also the small ones, which a Gram matrix would lose
    assert got * w @ v.T == pytest.approx(x, abs=1e-9) and v.T @ v == pytest.approx(np.eye(6), abs=1e-12)
    assert got[:, :4].T @ got[:, :4] == pytest.approx(np.eye(4), abs=1e-9)
    flat, w, _ = learn.svd(table(spark, [((a, 2 * a), 0) for a in (1.0, 2.0, 3.0)]))
    assert w[1] < 1e-12 and {r["u"][1] for r in flat.collect()} == {0.0}


def plain_em(x, means, rounds, ridge=0.0):
    """EM with one density at a time, in logarithms."""
    k, n = len(means), len(x)
    prior, mu = np.full(k, 1 / k), np.array(means, float)
    sigma = [np.cov(x.T) + ridge * np.eye(x.shape[1])] * k
    for _ in range(rounds):
        p = np.zeros((n, k))
        for i in range(n):
            for j in range(k):
                d = x[i] - mu[j]
                p[i, j] = np.log(prior[j]) - 0.5 * d @ np.linalg.inv(sigma[j]) @ d - 0.5 * np.linalg.slogdet(sigma[j])[1]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        prior, mu = p.sum(axis=0) / n, (p.T @ x) / p.sum(axis=0)[:, None]
        sigma = [((p[:, j : j + 1] * (x - mu[j])).T @ (x - mu[j])) / p[:, j].sum() + ridge * np.eye(x.shape[1]) for j in range(k)]
    return prior, mu, sigma


def test_mixtures_of_many_dimensions(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(90, 40)) * 0.01
    b = rng.normal(size=(90, 40)) * 0.02 + 0.02
    obs = table(spark, [(r, 0) for r in a] + [(r, 1) for r in b] + [((0.5,) * 40, 2)] * 3)
    both = obs.where("label < 2")
    means = np.array([np.full(40, -0.01), np.full(40, 0.03)])
    m = learn.gmm(both, means, 3)
    prior, mu, sigma = plain_em(np.concatenate([a, b]), means, 3)
    assert m.prior == pytest.approx(prior) and m.mu == pytest.approx(mu, abs=1e-9) and m.sigma == pytest.approx(np.array(sigma), abs=1e-9)
    assert np.linalg.det(m.sigma[0]) < 1e-100  # smaller than any fixed bound on determinants
    # all labels at once are as each alone; a label of equal rows needs the ridge
    models = learn.gmm_classifier(obs, 2, 4, ridge=1e-3)
    assert list(models) == [0, 1, 2]
    for y in (0, 1):
        own = both.where(F.col("label") == y)
        start = np.array([r["f"] for r in own.orderBy(F.xxhash64("obs_id"), "obs_id").limit(2).collect()])
        alone = learn.gmm(own, start, 4, ridge=1e-3)
        assert models[y].mu == pytest.approx(alone.mu, abs=1e-9) and models[y].sigma == pytest.approx(alone.sigma, abs=1e-9)
    out = learn.score_mixtures(obs, models).join(obs, "obs_id").collect()
    assert np.mean([r["predicted"] == r["label"] for r in out]) > 0.95 and all(np.isfinite(r["log_density"]) for r in out)
    assert learn.Mixture([1.0], [[0.0, 0.0]], [[[1.0, 1.0], [1.0, 1.0]]]).density(np.zeros((1, 2))) == [0.0]


def test_labels_may_be_null(spark):
    obs = spark.createDataFrame([(1, 0, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (3, None, [5.0, 5.0]), (4, 0, None), (5, 0, [0.0, 0.0])], "obs_id long, label int, f array<double>")
    assert list(learn.gmm_classifier(obs, 1, 2, ridge=0.1)) == [0]
    assert learn.gmm_classifier(obs.where("label > 5"), 1) == {}


def test_nmf_rebuilds_a_rank_two_matrix():
    rng = np.random.default_rng(5)
    x = rng.random((8, 2)) @ rng.random((2, 13))
    w, h, est, cost = learn.nmf_matrix(x, rng.random((8, 2)), rng.random((2, 13)))
    assert w.sum(axis=0) == pytest.approx([1, 1]) and np.abs(est - x).mean() < 0.1


def test_moving_average_matches_kernel(spark):
    rng = np.random.default_rng(1)
    v = rng.random(40)
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(v)], "signal_id string, block_idx long, v double")
    from wavemill import kernels as K

    for m in (1, 2, 7):
        got = [r["y"] for r in framing.moving_average_zero_phase(df, "v", m, "y").orderBy("block_idx").collect()]
        assert got == pytest.approx(K.moving_average_zero_phase(v[None, :], m)[0])


def test_names():
    assert music.chord_code("F# Major") == 6 and music.chord_code("Gb Minor") == 18 and music.chord_code("No Chord") == 24
    with pytest.raises(ValueError):
        music.chord_code("H Major")


def test_matrix_editing(spark):
    m = matrices.eye(spark, 3)
    m = matrices.set_row(m, 0, spark.createDataFrame([(0, 5.0), (2, 7.0)], "j long, v double"))
    got = {(r["i"], r["j"]): r["v"] for r in matrices.swap_rows(m, 0, 2).collect()}
    assert got == {(2, 0): 5, (2, 2): 7, (1, 1): 1, (0, 2): 1}
    col = {(r["i"], r["j"]): r["v"] for r in matrices.set_column(matrices.eye(spark, 2), 1, spark.createDataFrame([(0, 2.0)], "i long, v double")).collect()}
    assert col == {(0, 0): 1, (0, 1): 2}
    small = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 4.0]), (2, [1.0, 2.0, 2.0, 4.0])], "k int, m array<double>")
    rows = {r["k"]: r for r in matrices.determinants(small, "m", ["k"]).collect()}
    assert rows[1]["det"] == pytest.approx(8) and rows[1]["inv"] == [0.5, 0, 0, 0.25]
    assert rows[2]["det"] == 0 and rows[2]["inv"] is None


def test_leave_out_in_groups(spark):
    rng = np.random.default_rng(3)
    o = spark.createDataFrame([(i, i % 2, [float(i % 2) + 0.2 * float(v), float(v)]) for i, v in enumerate(rng.random(40))], "obs_id long, label int, f array<double>")
    found = learn.leave_one_out(o, classify=lambda train, query: learn.knn(train, query, 1), folds=4).first()
    assert found["n"] == 40 and found["accuracy"] == learn.leave_one_out(o, 1).first()["accuracy"] == 1.0


def test_fingerprint_matches_against_plain_comparison(spark):
    from wavemill.operators import music

    rng = np.random.default_rng(4)
    words = {s: rng.integers(1, 1 << 40, 30).tolist() for s in range(3)}
    words[1][10:22] = words[0][3:15]
    words[2][5:15] = [7] * 10  # a steady sound
    words[0][20:30] = [7] * 10
    df = spark.createDataFrame([(s, i, w) for s, v in words.items() for i, w in enumerate(v)], "signal_id long, block_idx long, word long")
    got = {(r["query_id"], r["signal_id"], r["offset"]): (r["words"], round(r["bits"], 9)) for r in music.match_fingerprints(df.where("signal_id = 0"), df, most_bits=40).collect()}

    def plain(s, offset):
        at = [(words[0][i], words[s][i + offset]) for i in range(30) if 0 <= i + offset < 30]
        return len(at), round(float(np.mean([bin(a ^ b).count("1") for a, b in at])), 9)

    assert set(got) == {(0, 0, 0), (0, 1, 7), (0, 2, -15)} and all(got[k] == plain(*k[1:]) for k in got)
    assert set(music.match_fingerprints(df.where("signal_id = 0"), df, most_bits=40, least_hits=5).select("signal_id").toPandas()["signal_id"]) == {0, 1}


def plain_nearest(q, qi, t, ti, k, exclude_self):
    out = []
    for row, own in zip(q, qi, strict=True):
        d = np.sqrt(((row[None, :] - t) ** 2).sum(axis=1))
        d[~np.isfinite(d) | (exclude_self & (ti == own))] = np.inf
        out.append([(float(d[j]), int(ti[j])) for j in np.lexsort((ti, d))[:k] if np.isfinite(d[j])])
    return out


@pytest.mark.parametrize("kind", ["drawn", "ties", "far", "odd"])
@pytest.mark.parametrize("exclude_self", [False, True])
def test_products_leave_the_neighbours_of_plain_differences(kind, exclude_self):
    rng = np.random.default_rng(4)
    t, q = rng.normal(size=(4500, 3)), rng.normal(size=(70, 3))
    ti, qi = rng.permutation(4500), rng.integers(0, 4500, 70)
    if kind == "ties":
        t, q, ti = np.round(t * 2) / 2, np.round(q * 2) / 2, rng.integers(0, 3000, 4500)
    if kind == "far":
        t, q = t * 1e-3 + 1e6, q * 1e-3 + 1e6
    if kind == "odd":
        t[7], t[8], q[3] = np.nan, np.inf, 1e200
    i, j, d = learn.Near(t, ti).search(q, qi, 3, exclude_self)
    with np.errstate(all="ignore"):
        want = plain_nearest(q, qi, t, ti, 3, exclude_self)
    assert [[(float(d[n]), int(ti[j[n]])) for n in np.flatnonzero(i == row)] for row in range(len(q))] == want


def test_neighbours_send_rows_to_cells_and_join_nothing(spark):
    rng = np.random.default_rng(2)
    obs = table(spark, [(x, i % 3) for i, x in enumerate(rng.normal(size=(400, 4)))])
    near = learn.neighbours(obs, obs, 3, True)
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()  # a joined side was broadcast or packed into rows of a megabyte
    x = np.array([r["f"] for r in obs.orderBy("obs_id").collect()])
    got = [[(r["d"], r["train_id"]) for r in near.where(f"obs_id = {i}").orderBy("rank").collect()] for i in (0, 399)]
    assert got == plain_nearest(x[[0, 399]], np.array([0, 399]), x, np.arange(400), 3, True)


@pytest.mark.parametrize("picked", [[], [1], [2, 0]])
@pytest.mark.parametrize("digits", [1, 9])
def test_selection_meets_windows_of_sorted_rows(picked, digits):
    rng = np.random.default_rng(6)
    t = np.round(rng.normal(size=(1500, 3)), digits)
    ti, rest = rng.permutation(1500), [v for v in range(3) if v not in picked]
    d, j = learn.nearest_of_each(t[:90], ti[:90], t, ti, picked, rest, width=8)
    order = np.argsort(ti)
    for n, v in enumerate(rest):
        all_ = sum(((t[:90, None, u] - t[None, :, u]) ** 2 for u in picked), np.zeros((90, 1500))) + (t[:90, None, v] - t[None, :, v]) ** 2
        all_[ti[:90, None] == ti[None, :]] = np.inf
        best = order[all_[:, order].argmin(axis=1)]
        assert (best == j[:, n]).all() and (all_[np.arange(90), best] == d[:, n]).all()


def test_forward_selection_over_many_strips(spark, monkeypatch):
    rng = np.random.default_rng(11)
    f = np.round(rng.normal(size=(700, 4)), 1)  # many equal values
    f[:5, 1], f[5, 2] = 50.0, np.nan
    label = (f[:, 2] + f[:, 0] > 0).astype(int)
    label[5] = 0
    want, chosen = [], []
    for _ in range(3):
        best = None
        for v in [v for v in range(4) if v not in chosen]:
            d = sum((f[:, None, u] - f[None, :, u]) ** 2 for u in [*chosen, v])
            d[np.isnan(d)] = np.inf
            np.fill_diagonal(d, np.inf)
            some = np.isfinite(d.min(axis=1))
            acc = float((label[d.argmin(axis=1)] == label)[some].mean())
            best = max(best or (-1.0, -1), (acc, v))
        want.append((best[1], best[0]))
        chosen.append(best[1])
    data = spark.createDataFrame([(i, int(label[i]), f[i].tolist()) for i in range(700)], "obs_id long, label int, f array<double>")
    for rows, strip in ((65_536, 64), (40, 300)):
        monkeypatch.setattr(learn, "HELD_ROWS", rows)
        monkeypatch.setattr(learn, "STRIP_ROWS", strip)
        got = learn.forward_selection(data, most=3)
        assert [v for v, _ in got] == [v for v, _ in want] and np.allclose([a for _, a in got], [a for _, a in want])
