import gc
import random
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from wavemill.llm import catalog, graph, sharding, topk
from wavemill.llm.common import scratch


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    order = sorted(want.columns)
    shape = lambda d: d[order].astype(str).sort_values(order).reset_index(drop=True)
    pd.testing.assert_frame_equal(shape(got), shape(want))


def test_top_k_ties_bad_vectors_and_tiles(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(150)]
    rows += [(150, None), (151, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (152, [float("nan")] * 6), (200, [1.0, 2.0]), (250, [0.5, 0.5]), (None, [1.0] * 6), (300, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, tile_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = {i: np.floor(256 * np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    for q in (0, 50, 100, 200, 250):
        s = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:5]
        assert got[q] == [(i, -x) for x, i in s]
    assert 150 not in got and 300 not in got
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(empty, empty).count() == 0


def test_top_k_of_repeated_ids_and_deep_trees(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE_TILES", 1)
    monkeypatch.setattr(topk, "MERGE", 2)
    rng = np.random.default_rng(4)
    rows = [(i % 120, [float(x) for x in rng.integers(-9, 9, 3) * 1000.5]) for i in range(400)] + [(50, None), (50, [None, 1.0, 2.0]), (0, [float("inf"), 0.0, 0.0])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, tile_rows=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ok = [(i, np.floor(256 * np.array(v))) for i, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    want = {q: [(i, -x) for x, i in sorted((-int(a @ b), j) for i, a in ok if i == q for j, b in ok if j != q)[:4]] for q in (0, 50, 100)}
    assert got == want


def plain_shards(rows, shards, seed):
    """The same shuffle with lists: (doc_id, size, crc, copy) -> (shard, slot)."""

    def draw(n, row):
        h = xxhash.xxh64_intdigest(struct.pack("<i", seed + n), seed=42)
        for v in (row[0], row[2], row[1], row[3]):
            h = h if v is None else xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
        return h - (1 << 64) if h >> 63 else h

    n_parts = max(1, -(-len(rows) // sharding.ROWS_PER_PART))
    parts = {}
    for row in rows:
        parts.setdefault(draw(0, row) % n_parts, []).append(row)
    sizes = [len(rows) // shards + (j < len(rows) % shards) for j in range(shards)]
    matrix = sharding.communication_matrix([len(parts[p]) for p in sorted(parts)], sizes, seed)
    dealt = [[] for _ in range(shards)]
    for p, line in zip(sorted(parts), matrix, strict=True):
        own = iter(sorted(parts[p], key=lambda r: (draw(1, r), r[0] is not None, r[0], r[2], r[1], r[3])))
        for j, n in enumerate(line):
            dealt[j] += [next(own) for _ in range(n)]
    top = lambda r: (draw(2, r) % 2**64) >> 1
    n_ranges = max(1, -(-len(rows) // (shards * sharding.ROWS_PER_PART)))
    step = -(-(1 << 63) // n_ranges)
    out = {}
    for j, own in enumerate(dealt):
        for slot, r in enumerate(sorted(own, key=lambda r: (min(top(r) // step, n_ranges - 1), draw(2, r), r[0] is not None, r[0], r[2], r[1], r[3]))):
            out[r] = (j, slot)
    return out


def test_shards_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_PART", 40)
    monkeypatch.setattr(sharding, "COPIES", 3)
    texts = [(i % 300, f"t{i % 7}" if i % 5 else None) for i in range(900)] + [(None, "n")] * 30 + [(5, "same row")] * 400
    got = sharding.shuffle_into_shards(spark.createDataFrame(texts, "doc_id long, text string"), 5, seed=3).collect()
    seen, rows = {}, []
    for d, t in texts:
        key = (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        rows.append((*key, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    want = sorted((str(r[0]), r[1], r[2], *place) for r, place in plain_shards(rows, 5, 3).items())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
    hot = [r["shard"] for r in got if r["doc_id"] == 5 and r["size"] == 16]
    assert min(hot.count(j) for j in range(5)) > 50  # copies of one row go everywhere


def test_large_margins_are_drawn_from_the_same_law():
    rng = np.random.default_rng(7)
    for good, bad, n in ((30, 50, 20), (50, 30, 60), (5, 400, 100), (400, 5, 100), (1000, 1500, 900), (7, 7, 7)):
        x = [np.bincount([sharding.hypergeometric(rng, good, bad, n, most) for _ in range(6000)], minlength=n + 1) for most in (0, 10**9)]
        some = x[0] + x[1] > 20
        chi = ((x[0] - x[1])[some] ** 2 / (x[0] + x[1])[some]).sum()
        assert chi < some.sum() + 5 * (2 * some.sum()) ** 0.5
    big = [sharding.hypergeometric(rng, 3 * 10**11, 7 * 10**11, 10**10) for _ in range(300)]
    sd = (10**10 * 0.3 * 0.7 * 0.99) ** 0.5
    assert abs(np.mean(big) - 3 * 10**9) < 5 * sd / 300**0.5 and 0.8 < np.std(big) / sd < 1.2


def test_shards_are_exact_uniform_and_gapless(spark):
    texts = [(i, ["", None, "é", "x" * 1000][i % 4], "clash") for i in range(1003)] + [(None, "t", "c"), (5, "dup", "c"), (5, "dup", "c")]
    out = sharding.shuffle_into_shards(spark.createDataFrame(texts, "doc_id long, text string, shard string"), 24).toPandas()
    assert len(out) == len(texts)
    n = out.groupby("shard").size()
    assert len(n) == 24 and n.max() - n.min() <= 1 and set(out["law"]) == {"rows"} and out["grown_shard"].isna().all()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    for r in out.dropna(subset=["doc_id"]).itertuples():
        if r.doc_id != 5:
            t = (texts[int(r.doc_id)][1] or "").encode()
            assert (r.size, r.text_crc32) == (len(t) + 8, zlib.crc32(t))
    # neither shard nor slot follows the ids
    known = out.dropna(subset=["doc_id"])
    assert abs(np.corrcoef(known["doc_id"].astype(float), known["shard"])[0, 1]) < 0.1
    again = sharding.shuffle_into_shards(spark.createDataFrame(texts, "doc_id long, text string, shard string").repartition(3), 24).toPandas()
    key = ["shard", "slot", "size", "text_crc32"]
    pd.testing.assert_frame_equal(out.sort_values(key)[key].reset_index(drop=True), again.sort_values(key)[key].reset_index(drop=True))
    assert sharding.shuffle_into_shards(spark.createDataFrame([], "doc_id long, text string"), 24).count() == 0


def test_communication_matrix_margins():
    m = sharding.communication_matrix([5, 0, 17, 3], [7, 6, 6, 6], 1)
    assert m.sum(axis=1).tolist() == [5, 0, 17, 3] and m.sum(axis=0).tolist() == [7, 6, 6, 6] and (m >= 0).all()
    big = sharding.communication_matrix([3 * 10**9, 10**9], [2 * 10**9, 2 * 10**9], 2)
    assert big.sum(axis=1).tolist() == [3 * 10**9, 10**9] and (big >= 0).all()


def test_sharding_plan_is_native(spark, sf_dir):
    plan = catalog.op10_sharding(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_components_of_paths_stars_and_cliques(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200)] + [(7, 7)]
    rnd.shuffle(edges)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long"), scratch(spark), "t").collect()}
    want = {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert got == want
    assert graph.components(spark.createDataFrame([], "a long, b long"), scratch(spark), "e").count() == 0


def test_components_in_star_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "FIT_EDGES", 0)
    test_components_of_paths_stars_and_cliques(spark)


def test_scratch_of_a_cluster_must_be_named():
    class Held:
        def isEmpty(self):
            return True

    class Stand:
        def __getattr__(self, name):
            return {"master": "spark://somewhere:7077", "getCheckpointDir": Held}.get(name) or Stand()

        def __call__(self, *args):
            return None if args else Stand()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch(Stand())


def plain_pipeline(docs, bench, learn):
    """The five stages one document after the other: {doc_id: token ids}."""
    import regex
    from tokenizers import Tokenizer

    from wavemill.llm import langid, linededup

    model = langid.fit(learn)
    kept = {}
    for d, t in docs:
        lang, _, out = model.predict([None if t is None else t.encode()])
        if not out[0]:
            kept[d] = t
    hashed = {d: [linededup.line_hash(x.encode()) for x in t.split("\n")] for d, t in kept.items()}
    after = {}
    for d, t in kept.items():
        gone = set().union(*(linededup.deleted(hashed[d], hashed[e]) for e in hashed if e < d))
        lines = [x for i, x in enumerate(t.split("\n")) if i not in gone]
        if not gone or any(x.strip() for x in lines):
            after[d] = "\n".join(lines)
    sets = {}
    for d, t in after.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for i, a in enumerate(order):
        for b in order[:i]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    word = regex.compile("[0-9A-Za-z\x80-\U0010ffff]+")
    fold = lambda x: "".join(c.lower() if c.isascii() else c for c in x)
    windows = {}
    for _, t in bench:
        w = [fold(x) for x in word.findall(t or "")]
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(k, set()).add(tuple(w[i : i + k]))
    tok = Tokenizer.from_file(catalog.tokenizer_path(catalog.WORD_BPE))
    out = {}
    for d, t in after.items():
        if top(d) != d:
            continue
        at = [m.span() for m in word.finditer(t)]
        w = [fold(t[a:b]) for a, b in at]
        hit = {i + j for k, some in windows.items() for i in range(len(w) - k + 1) if tuple(w[i : i + k]) in some for j in range(k)}
        if hit and len(hit) == len(w):
            continue
        clean, last = "", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                clean += t[last : at[i][0]]
            last = at[i][1]
        out[d] = tok.encode(clean + t[last:], add_special_tokens=False).ids
    return out


def test_pipeline_against_a_plain_version(spark, sf_dir):
    import corpus_pipeline as p
    from wavemill.llm import common, langid

    docs = common.table(spark, sf_dir, "documents")
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    want = plain_pipeline([(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()], bench, langid.sample(docs.where(common.learn_side("doc_id")), 500))
    got = {r["doc_id"]: r["ids"] for r in p.run(spark, sf_dir).collect()}
    assert got == want and 50 < len(got) < docs.count()


def test_pipeline_line_dedup_goes_on_to_all_earlier_holders(spark):
    import corpus_pipeline as p

    line = "a line that many documents hold somewhere in their text"
    texts = [line, *(f"{line}\nown line of document number {k}" for k in range(30)), f"{line}\nown words of this one document\n{line}", f"{line}\nown words of that other document\n{line}"]
    rows = [(d, t, "en", "web", len(t)) for d, t in enumerate(texts)]
    got = {r["doc_id"]: r["text"] for r in p.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert got[0] == line and got[1] == "own line of document number 0"
    # the first holder has the line once, the document before has it twice
    assert got[31] == f"own words of this one document\n{line}" and got[32] == "own words of that other document"


def test_pipeline_line_dedup_of_the_table_against_all_pairs(spark, sf_dir):
    import corpus_pipeline as p
    from wavemill.llm import common, linededup

    docs = p.language_id(spark, common.table(spark, sf_dir, "documents").select(*p.COLUMNS), sf_dir).cache()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    hashed = {d: [linededup.line_hash(x.encode()) for x in t.split("\n")] for d, t in sorted(texts.items())}
    want = {}
    for d, x in hashed.items():
        # a document that shares no strong line deletes nothing
        gone = set().union(*(linededup.deleted(x, y) for e, y in hashed.items() if e < d))
        left = [s for i, s in enumerate(texts[d].split("\n")) if i not in gone]
        if not gone or any(s.strip() for s in left):
            want[d] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in p.line_dedup(spark, docs, sf_dir).collect()} == want


def test_pipeline_of_odd_rows_and_an_empty_table(spark, tmp_path):
    import corpus_pipeline as p

    long = "the cat and the dog went out " * 8000
    rows = [(1, long), (1, long), (None, "the cat and the dog are here today"), (2, None), (3, ""), (4, "the dog and the cat went home again"), (4, "the dog and the cat stay at home now"), (None, None)]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame([(d, t, "en", "s", 1, "x") for d, t in some], "doc_id long, text string, lang string, source string, n_chars long, n_lines string").write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(9, None)], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
        got = p.run(spark, str(tmp_path / name)).collect()
        assert {r["doc_id"] for r in got} == {d for d, t in some if t} and len(got) == sum(bool(t) for _, t in some)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    line = lambda k: f"the quick brown fox number {k} jumps over the lazy dog and runs away into the forest again"
    base = "\n".join(line(k) for k in range(12))
    near = base.replace("quick brown fox number 3", "slow brown fox number 3").replace("\n", " ")
    bench = "a benchmark passage of exactly twelve words that nobody should ever see"
    texts = [base, base, base.replace("\n", " "), near, "12345 678", None, "", f"some clean words come first {bench} and then others follow", "a clean and short text"]
    for name, rows, ddl in (
        ("documents", [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"),
        ("benchmark", [(1, bench)], "item_id long, text string"),
    ):
        spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in p.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.toPandas().set_index("doc_id")
        if name != "encoding":
            assert docs.columns == p.COLUMNS
    assert set(seen["language_id"].index) == {0, 1, 2, 3, 7, 8}
    assert set(seen["line_dedup"].index) == {0, 2, 3, 7, 8}
    assert set(seen["jaccard_join"].index) == {0, 7, 8}
    assert "benchmark" not in seen["decontamination"].loc[7, "text"] and seen["decontamination"].loc[7, "n_chars"] == len(seen["decontamination"].loc[7, "text"])
    assert set(seen["encoding"].index) == {0, 7, 8} and (seen["encoding"]["n_tokens"] > 0).all()
    assert [r["doc_id"] for r in p.run(spark, str(tmp_path)).orderBy("doc_id").collect()] == [0, 7, 8]
    assert p.ORACLE_SQL is None


def test_scratch_reads_the_session(tmp_path):
    """The folder that the session names is used; asked of a stand-in, as a session's setting is fixed at its start."""

    class Conf:
        def get(self, key, default=None):
            return str(tmp_path) if key == "spark.checkpoint.dir" else default

    class Path:
        def __init__(self, p):
            self.p = p

        def getFileSystem(self, conf):
            return self

        def deleteOnExit(self, path):
            return True

        def toString(self):
            return self.p

    class Stand:
        conf = Conf()

        def __getattr__(self, name):
            return Stand()

        def __call__(self, *args):
            return Path(args[0]) if args else Stand()

    assert scratch(Stand()).startswith(f"{tmp_path}/wavemill-")


def test_stages_leave_no_tables_in_workers_and_send_few_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline as p
    from wavemill.llm import bpe, catalog, common

    path = catalog.tokenizer_path(catalog.WORD_BPE)
    bpe.automaton(path).encode("some words")
    assert bpe.automaton.cache_info().currsize == 1
    common.released()
    assert bpe.automaton.cache_info().currsize == 0 and gc.get_freeze_count() == 0
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        p.encoding(spark, common.table(spark, sf_dir, "documents"), sf_dir)
        assert spark.conf.get(key) == "1000"
        spark.conf.set(key, "7")
        p.encoding(spark, common.table(spark, sf_dir, "documents"), sf_dir)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
