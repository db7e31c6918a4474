import random

import numpy as np
import pytest

from wavemill.llm import jaccard

SCHEMA = "text string, doc_id long, n_shingles string"


def brute(rows, k, num, den):
    sets = {}
    for text, doc, _ in rows:
        w = (text or "").encode().lower().split()
        g = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        sets[doc] = g
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x = len(sets[a] & sets[b])
            if x and den * x >= num * (len(sets[a]) + len(sets[b]) - x):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: (len(sets[d]), find(d)) for d in sets}


def documents(seed, families, copies, edits, words=60):
    rnd = random.Random(seed)
    out = []
    for f in range(families):
        base = [f"w{rnd.randrange(400)}" for _ in range(words)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rnd.randint(0, edits)):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    out += ["", None, "  \n ", "one", "one", "ONE", "two words", "two  words", "É é", "a b c", "a b c d"]
    rnd.shuffle(out)
    return [(t, i, "clash") for i, t in enumerate(out)]


def result(spark, rows, **kw):
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def test_small_regions(spark):
    rows = documents(1, 12, 6, 3)
    assert result(spark, rows, k=3, num=90, den=100) == brute(rows, 3, 90, 100)


def test_five_words_default(spark):
    rows = documents(2, 10, 5, 2)
    assert result(spark, rows) == brute(rows, 5, 80, 100)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_regions_split_by_pivots(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "REGION_DOCS", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 4)
    rows = documents(seed, 2, 40, 6) + [(f"common phrase in all of these number {i}", 10_000 + i, "x") for i in range(12)]
    assert result(spark, rows, k=3, num=80, den=100) == brute(rows, 3, 80, 100)


def test_shared_ids_in_large_regions(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "REGION_DOCS", 6)
    monkeypatch.setattr(jaccard, "PIVOTS", 3)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 4)
    rnd = random.Random(9)
    rows = []
    for start in (0, 5):  # ids 5 to 29 have a text of each family
        base = [f"f{start}w{i}" for i in range(60)]
        for i in range(30):
            w = list(base)
            w[rnd.randrange(60)] = f"x{start}y{i}"
            rows.append((" ".join(w), start + i, "x"))
    want = brute([(t, i, x) for i, (t, _, x) in enumerate(rows)], 3, 80, 100)
    lowest = {}
    for i, (_, doc, _) in enumerate(rows):
        lowest[want[i][1]] = min(doc, lowest.get(want[i][1], doc))
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=3, num=80, den=100).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((doc, want[i][0], lowest[want[i][1]]) for i, (_, doc, _) in enumerate(rows))


def test_the_query_goes_through_pivots_and_equals_its_sql(spark, monkeypatch, sf_dir):
    """Whole query on the table, with regions of two documents taken as large and every part taken as hot."""
    import duckdb

    from wavemill.llm import catalog

    want = duckdb.sql(f"create or replace view documents as select * from '{sf_dir}/documents.parquet'") or duckdb.sql(catalog.oracle_sql()["op1_jaccard"]).fetchall()
    split = []
    large = jaccard._split_large
    monkeypatch.setattr(jaccard, "_split_large", lambda *a: split.append(1) or large(*a))
    for settings in ({"REGION_DOCS": 1}, {"REGION_DOCS": 1, "HOT_SAMPLE": 1, "PART_DOCS": 0}, {}):
        with monkeypatch.context() as m:
            for k, v in settings.items():
                m.setattr(jaccard, k, v)
            got = [tuple(r) for r in catalog.op1_jaccard(spark, sf_dir).collect()]
        assert sorted(got) == sorted(want)
    assert len(split) == 2


def test_links_within_a_task_against_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    for num, den, leaf in ((80, 100, 2), (90, 100, 3), (60, 100, 12)):
        for _ in range(60):
            bases = [rng.integers(0, 1 << 60, int(rng.integers(3, 60)), dtype=np.uint64) for _ in range(int(rng.integers(1, 4)))]
            sets = []
            for _ in range(int(rng.integers(1, 50))):
                b = bases[int(rng.integers(len(bases)))]
                sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.15], rng.integers(0, 1 << 60, int(rng.integers(1, 4)), dtype=np.uint64)])))
            n = np.array([len(x) for x in sets])
            assert sorted(jaccard.pivot_links(sets, num, den, leaf)) == sorted(jaccard._stars(jaccard._linked(jaccard.shared_counts(sets), n, n, num, den)))


def test_very_long_texts_largest_id_and_many_rows_without_id(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    top = (1 << 63) - 1
    rows = [(long, top, "x"), (long + " end", None, "x"), ("q " * 90_000, 5, "x"), *((f"text number {i} has no id at all here", None, "x") for i in range(40))]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("n_shingles", "doc_id", "component_id").collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["n_shingles"] > 50_000 and r["doc_id"]) == [(top, top)]
    assert [r["component_id"] for r in got if r["n_shingles"] > 50_000] == [top, top] and len(got) == len(rows)


def test_empty_table_and_null_ids(spark):
    assert result(spark, []) == {}
    got = jaccard.near_duplicates(spark.createDataFrame([("a b c d e f", None, "x"), ("a b c d e f", 7, "x"), ("q r s t u v", None, "x")], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=str) == [(7, 7), (None, 7), (None, None)]


@pytest.mark.parametrize(("num", "den"), [(90, 100), (80, 100), (70, 100)])
def test_linked_sets_share_a_part_and_pass_the_counts(num, den):
    """The two filters of level 0 lose no link."""
    import numpy as np

    rng = np.random.default_rng(num)
    c, q = jaccard.part_sizes(num, den)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64) << np.uint64(1)
        b = np.concatenate([a[rng.random(n) > rng.random() * 0.25], rng.integers(0, 1 << 63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        x = len(np.intersect1d(a, b))
        if not len(b) or den * x < num * (len(a) + len(b) - x) or len(a) == len(b) == x:
            continue
        owner, keys = jaccard.part_keys([a, b], c, q)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())
        first, second = sorted((a, b), key=len)
        assert jaccard.may_link(np.array([len(first), len(second)]), [jaccard.count_vector(first), jaccard.count_vector(second)], num, den) == [(1, 0)]


def test_two_texts_of_one_id(spark):
    rows = [("a b c d e f g h i j", 1, "x"), ("q r s t u v w x y z", 1, "x"), ("q r s t u v w x y z z", 2, "x"), ("a b c d e f g h i j j", 3, "x"), ("k l m n o p", 4, "x")]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), k=2, num=80, den=100).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(1, 9, 1), (1, 9, 1), (2, 10, 1), (3, 10, 1), (4, 5, 4)]


def test_many_candidates_find_their_texts_by_a_bitmap(spark, tmp_path):
    x = spark.range(90_000).selectExpr("if(id = 6, null, id) doc_id", "xxhash64(id) tid", "concat('text ', id) text")
    x.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    rows = jaccard.BROADCAST_ROWS + 1
    named = docs.where("text = 'text 6' or doc_id % 45 = 0").selectExpr("doc_id rep", "tid rep_tid", "text is not null large")
    out = jaccard._texts_of(named, docs, rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # what is broadcast has a page number and bits, not the candidates
    assert plan.count("strategy=broadcast") == 1 and "LeftSemi" in plan and "bitmap_construct_agg" in plan
    assert sorted(r["text"] for r in out.collect()) == sorted(["text 6", *(f"text {i}" for i in range(0, 90_000, 45))])


def test_candidates_by_bitmap_give_the_same_components(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want


def test_small_regions_go_through_pivots():
    rng = np.random.default_rng(8)
    base = [np.sort(rng.choice(1 << 40, 100, replace=False)).astype(np.uint64) for _ in range(4)]
    near = [np.sort(np.append(b[:-2], rng.integers(1 << 41, 1 << 42, 2).astype(np.uint64))) for b in base for _ in range(3)]
    for sets in ([base[0], *near[:2]], [base[0], base[1], base[2]], [*base, *near]):
        taken: list[str] = []
        found = jaccard.pivot_links(sets, 90, 100, taken=taken)
        x = jaccard.shared_counts(sets)
        n = np.array([len(s) for s in sets])
        want = jaccard._stars(jaccard._linked(x, n, n, 90, 100))
        assert sorted(found) == sorted((int(i), int(j)) for i, j in want) and taken[0] == "pivots"
    assert jaccard.pivot_links(base[:2], 90, 100) == []


def test_large_regions_are_joined_in_short_plans(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = rng.integers(0, 10**6, (6, 60))
    rows = []
    for i in range(300):
        w = words[i % 6].copy()
        w[rng.integers(0, 60, 2)] = rng.integers(0, 10**6, 2)
        rows.append((" ".join(f"w{x}" for x in w), i, "x"))
    docs = spark.createDataFrame(rows, SCHEMA)
    exchanges = {}
    written = jaccard.written

    def told(df, folder, name):
        exchanges[name] = df._jdf.queryExecution().executedPlan().toString().count(" Exchange ")
        return written(df, folder, name)

    monkeypatch.setattr(jaccard, "written", told)
    want = {tuple(r) for r in jaccard.near_duplicates(docs).collect()}
    assert "near0" not in exchanges
    monkeypatch.setattr(jaccard, "REGION_DOCS", 2)
    monkeypatch.setattr(jaccard, "CHUNK_DOCS", 8)
    assert {tuple(r) for r in jaccard.near_duplicates(docs).collect()} == want
    # the driver plans a query anew after each exchange
    assert "near0" in exchanges and max(exchanges.values()) <= 16, exchanges
