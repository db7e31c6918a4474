"""Neighbours by regions against neighbours in tiles."""

import numpy as np
import pytest

from wavemill.operators import learn, regions

SCHEMA = "obs_id long, label int, f array<double>"


def clustered(spark, n, clusters=12, dims=6, hot=0.35, seed=3):
    """Rows around some centres, a share of them in one cluster; every seventh row repeats the one before."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(clusters, dims)) * 20
    home = np.where(rng.random(n) < hot, 0, rng.integers(0, clusters, n))
    x = np.round(centre[home] + rng.normal(size=(n, dims)), 2)
    x[7::7] = x[6:-1:7]
    return spark.createDataFrame([(i, int(home[i]), x[i].tolist()) for i in range(n)], SCHEMA)


def rows(df):
    return sorted((r["obs_id"], r["rank"], r["train_id"], r["label"], r["d"]) for r in df.collect())


@pytest.mark.parametrize("cell_rows", [regions.CELL_ROWS, 5])
def test_the_same_rows_as_tiles_with_ties_and_a_hot_cluster(spark, cell_rows):
    o = clustered(spark, 1500)
    index = regions.Regions(o, cell_rows=cell_rows)
    assert index.cells.n.sum() == 1500 and (index.cells.slices > 1).any() == (cell_rows == 5)
    assert rows(index.neighbours(o, 3, True)) == rows(learn.neighbours(o, o, 3, True))
    other = clustered(spark, 70, seed=9)
    assert rows(index.neighbours(other, 5)) == rows(learn.neighbours(o, other, 5))


def test_most_pairs_of_clustered_rows_are_skipped(spark):
    # alone the clusters, skipped as wholes, would leave 0.18 of the pairs
    n = 30_000
    o = clustered(spark, n)
    met = regions.Regions(o).compared(o, 3, True).collect()
    assert len(met) == n
    assert sum(r["compared"] for r in met) < 0.1 * n * n


def test_queries_that_many_share_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(regions, "QUERY_ROWS", 40)
    o = clustered(spark, 600)
    assert rows(regions.Regions(o).neighbours(o, 2, True)) == rows(learn.neighbours(o, o, 2, True))


def test_odd_rows(spark):
    good = [(1, 4, [0.0, 1.0]), (2, None, [0.0, 2.0]), (2, 5, [0.0, 2.0]), (3, 6, [9.0, 9.0])]
    odd = [(None, 1, [0.0, 0.0]), (7, 1, None), (8, 1, [None, 1.0]), (9, 1, [float("nan"), 1.0]), (10, 1, [float("inf"), 1.0])]
    train = spark.createDataFrame(good + odd, SCHEMA)
    got = rows(regions.neighbours(train, train, 9).drop("label").withColumn("label", learn.F.lit(0)))
    want = rows(learn.neighbours(train, spark.createDataFrame(good, SCHEMA), 9).where("train_id <= 3").drop("label").withColumn("label", learn.F.lit(0)))
    assert got == want and {r[0] for r in got} == {1, 2, 3}
    # both rows of id 2 are left out for id 2
    assert {r["train_id"] for r in regions.neighbours(train, train, 9, True).where("obs_id = 2").collect()} == {1, 3}
    null_label = regions.neighbours(train, train.where("obs_id = 1"), 9).where("train_id = 2").collect()
    assert sorted(str(r["label"]) for r in null_label) == ["5", "None"]
    empty = spark.createDataFrame([], SCHEMA)
    assert regions.neighbours(empty, train).count() == 0 and regions.neighbours(train, empty).count() == 0


def test_equal_rows_only(spark):
    same = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(200)], SCHEMA)
    got = regions.Regions(same, cell_rows=16, rings=1).neighbours(same, 2, True)
    assert rows(got) == rows(learn.neighbours(same, same, 2, True))


def test_votes_by_regions(spark):
    o = clustered(spark, 400)
    by = {r["obs_id"]: r["predicted"] for r in learn.knn(o, o, 3, exclude_self=True, search=regions.neighbours).collect()}
    assert by == {r["obs_id"]: r["predicted"] for r in learn.knn(o, o, 3, exclude_self=True).collect()}


def test_slices_are_searched_by_products(spark):
    o = clustered(spark, 60)
    rows_of = o.collect()
    near = learn.Near(np.array([r["f"] for r in rows_of]), np.array([r["obs_id"] for r in rows_of]))
    x = learn.pa.RecordBatch.from_pylist([{"cell": 0, "slice": 0, "j": 0, "kind": k, "obs_id": r["obs_id"], "label": r["label"], "f": r["f"], "tau": None} for k in (0, 1) for r in rows_of])
    (key, part, (index, ids, _)), = regions._meetings([x])
    assert key == (0, 0, 0) and part.num_rows == 60 and isinstance(index, learn.Near) and ids.tolist() == list(range(60))
    want = near.search(near.t, near.ti, 2, True)
    assert all((a == b).all() for a, b in zip(index.search(near.t, ids, 2, True), want, strict=True))


def test_queries_are_sent_to_blocks_not_to_cells(spark):
    # nothing can be skipped among independent dimensions: every query needs nearly every cell
    x = np.random.default_rng(5).normal(size=(1500, 24))
    o = spark.createDataFrame([(i, i % 3, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    index = regions.Regions(o)
    sent = index._further(index._first(o, 3, True)).count()
    assert len(index.cells.n) > 15 and sent <= 8 * 1500
    assert rows(index.neighbours(o, 3, True)) == rows(learn.neighbours(o, o, 3, True))
