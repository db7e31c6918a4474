import collections
import hashlib
import hmac
import ipaddress
import json
import random
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from wavemill.llm import bpe, catalog, common, decontaminate, langid, linededup, pii, quality, substring

ODD = ["", None, "   \n\t ", "x", "É", "12 34", "a" * 70_000, "word " * 20_000, "same text here", "same text here"]


def frame(spark, texts, **more):
    """Documents with a clashing extra column."""
    cols = {"score": ["clash"] * len(texts), "text": texts, "doc_id": list(range(len(texts))), **more}
    ddl = "score string, text string, doc_id long" + "".join(f", {k} {'int' if k in ('quality', 'toxic') else 'string'}" for k in more)
    return spark.createDataFrame([tuple(r) for r in zip(*cols.values(), strict=True)], ddl)


# --- encoding ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(catalog.tokenizer_path(catalog.WORD_BPE))


def test_bpe_equals_the_library(spark, tokenizer):
    rnd = random.Random(3)
    words = "the playing don't we're it's 4.56 straße ΑΣΣΟΣ İstanbul naïve école 日本語 한국어 😀👍🏽 <|endoftext|> x<|startoftext|>y --- aaaaaaaa mississippi".split()
    texts = [*ODD, *(rnd.choice([" ", "\n", "", "\x1c", " "]).join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(300)), *("".join(rnd.choice("abcdehinorstuwyé'ßλΣ1.-_ \t²Ⅷ́") for _ in range(rnd.randint(0, 50))) for _ in range(300))]
    docs = frame(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, catalog.tokenizer_path(catalog.WORD_BPE)).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want)
        assert got[i]["decoded"] == tokenizer.decode(want, skip_special_tokens=False)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_bpe_of_an_empty_table(spark):
    assert bpe.encode_decode(frame(spark, []), catalog.tokenizer_path(catalog.WORD_BPE)).count() == 0


def test_compiled_automaton_against_plain_merging():
    rnd = random.Random(5)
    for suffix in ("", "$"):
        for _ in range(40):
            symbols = [*"abc", *(c + suffix for c in "abc" if suffix)]
            tokens, merges = list(symbols), []
            while len(merges) < 14:
                u, v = rnd.choice(tokens), rnd.choice(tokens)
                if suffix and u.endswith(suffix) or u + v in tokens:
                    continue
                tokens.append(u + v)
                merges.append(f"{u} {v}")
            spec = {"model": {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges, "end_of_word_suffix": suffix}, "pre_tokenizer": {"pretokenizers": [{"type": "Split", "pattern": {"Regex": "\\S+"}}]}}
            auto = bpe.MergeAutomaton(spec)
            for _ in range(60):
                word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 14)))
                want = [*word[:-1], word[-1] + suffix]
                for rule in merges:
                    u, v = rule.split(" ")
                    i = 0
                    while i < len(want) - 1:
                        if want[i] == u and want[i + 1] == v:
                            want[i : i + 2] = [u + v]
                        i += 1
                assert [tokens[i] for i in auto.word(word)] == want


def test_bpe_keeps_its_table_bounded(monkeypatch, tokenizer):
    monkeypatch.setattr(bpe, "MOST_STATES", 50)
    with open(catalog.tokenizer_path(catalog.WORD_BPE), encoding="utf-8") as f:
        auto = bpe.MergeAutomaton(json.load(f))
    rnd = random.Random(2)
    for _ in range(500):
        w = "".join(rnd.choice("aehinorst") for _ in range(rnd.randint(1, 20)))
        assert auto.word(w) == tokenizer.encode(w, add_special_tokens=False).ids and len(auto.members) < 50 + 25


# --- language -----------------------------------------------------------------------------------------


def test_language_id_held_out_accuracy(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    out = catalog.op3_langid(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    assert catalog.op3_langid(spark, sf_dir).where("score < 0 or score > 1 or lang_pred is null").count() == 0


def test_language_id_of_odd_texts(spark):
    learn = frame(spark, ["the cat and the dog are here"] * 3 + ["der hund und die katze sind hier"] * 3, lang=["en"] * 3 + ["de"] * 3)
    got = langid.identify(frame(spark, [*ODD, "the dog", "die katze und der hund"]), learn).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got[:3]] == ["und"] * 3 and got[5]["lang_pred"] == "und"
    assert [r["lang_pred"] for r in got[-2:]] == ["en", "de"]
    assert all(r["lang_pred"] in ("en", "de", "und") for r in got)
    none = langid.identify(frame(spark, ["text"]), frame(spark, [], lang=[])).first()
    assert none["lang_pred"] == "und" and none["rejected"]


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri.",
]


def test_language_id_rejects_foreign_and_random_letters_but_not_short_clean_texts(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    rnd = random.Random(8)
    noise = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(rnd.choice([100, 200, 600]))) for _ in range(100)]
    words = [r["text"].split() for r in docs.where(~common.learn_side("doc_id")).orderBy("doc_id").collect()]
    clean = [" ".join(w[:n]) for w in words for n in (3, 6, 12) if len(w) >= n]
    texts = [*FOREIGN, *noise, *clean]
    out = [r["rejected"] for r in langid.identify(frame(spark, texts), docs.where(common.learn_side("doc_id"))).orderBy("doc_id").collect()]
    assert all(out[: len(FOREIGN)])
    assert np.mean(out[len(FOREIGN) : len(FOREIGN) + len(noise)]) >= 0.95
    assert np.mean(out[len(FOREIGN) + len(noise) :]) <= 0.01


# --- quality ------------------------------------------------------------------------------------------


def test_quality_separates_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    out = catalog.op4_quality(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r["score"] for r in out if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_quality_of_odd_texts(spark):
    learn = frame(spark, ["good clean words"] * 4 + ["$$$ bad ***"] * 4)
    labels = spark.createDataFrame([(i, int(i < 4)) for i in range(8)] + [(0, 1), (9, None), (None, 1)], "doc_id long, quality int")
    got = quality.score(frame(spark, [*ODD, "clean words", "*** $$$"]), learn, labels).orderBy("doc_id").collect()
    assert all(0 <= r["score"] <= 1 for r in got) and got[-2]["score"] > 0.5 > got[-1]["score"]
    assert got[0]["score"] == got[1]["score"] and got[8]["score"] == got[9]["score"]
    assert quality.score(frame(spark, ["x"]), learn, labels.limit(0)).first()["score"] == 0.5


# --- decontamination ----------------------------------------------------------------------------------


def plain_hits(text, items, window):
    words = decontaminate.words((text or "").encode())
    hit, found = set(), set()
    for item, t in items:
        w = decontaminate.words((t or "").encode())
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in grams:
                hit.update(range(i, i + n))
                found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("pieces", [1 << 30, 40])
def test_decontamination_against_plain_search(spark, monkeypatch, pieces):
    monkeypatch.setattr(decontaminate, "MOST_BENCH_BYTES", pieces)
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 50)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(12)] + ["Über", "x9"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(1, text(9)), (2, text(3)), (10, text(2)), (3, ""), (4, None), (2, "w1, w2; w3")]
    texts = [*ODD, *(text(rnd.randint(0, 40)) for _ in range(60)), "pre " + items[0][1].upper() + " post"]
    out = decontaminate.contaminated_spans(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=4, with_text=True)
    for r in out.collect():
        n, hit, found = plain_hits(texts[r["doc_id"]], items, 4)
        assert (r["n_words"], sum(b - a for a, b in r["hit_spans"]), r["item_ids"]) == (n, hit, found)
        if texts[r["doc_id"]] is not None and texts[r["doc_id"]].isascii():
            assert len(decontaminate.words(r["clean_text"].encode())) == n - hit
        assert r["score"] == "clash"


def plain_language(model, text):
    """Nearest centroid once more: n-grams as a dictionary, one cosine at a time."""
    low = "".join(c.lower() if c.isalpha() and (c.isascii() or not text.isascii()) else c for c in text)
    kept = "".join(c if c in "abcdefghijklmnopqrstuvwxyz" or not c.isascii() else " " for c in low)
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    b = (" " + " ".join(kept.split(" ")) + " ").encode()
    b = b" " + b" ".join(b.split()) + b" "
    grams = collections.Counter()
    for k in (2, 3):
        for i in range(len(b) - k + 1):
            packed = 0
            for x in b[i : i + k]:
                packed = (packed * 256 + x) % 2**32
            grams[((packed + (0x5BD1E995 if k == 2 else 0)) % 2**32 * 2654435769) % 2**32 >> 19] += 1
    vec = {g: n**0.5 * float(model.idf[g]) for g, n in grams.items()}
    size = sum(v * v for v in vec.values()) ** 0.5
    cos = [sum(v * float(c[g]) for g, v in vec.items()) / size for c in model.centroids]
    best = max(range(len(cos)), key=lambda i: cos[i])
    return model.langs[model.owner[best]], cos[best]


def test_language_id_against_a_plain_version(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    model = langid.fit(langid.sample(docs.where(common.learn_side("doc_id")), 500))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in catalog.op3_langid(spark, sf_dir).collect()}
    for r in docs.collect():
        lang, cos = plain_language(model, r["text"]) if r["text"] else ("und", 0.0)
        assert got[r["doc_id"]][0] == lang and got[r["doc_id"]][1] == pytest.approx(max(cos, 0.0), abs=1e-5)


def test_every_language_is_learned_and_repeated_rows_agree(spark):
    words = {f"l{i:03}": f"{chr(97 + i % 26)}{chr(97 + i // 26)}q{chr(97 + i % 7)} x{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(230)}
    learn = frame(spark, [f"{w} {w}" for w in words.values() for _ in range(2)], lang=[k for k in words for _ in range(2)])
    rows = langid.sample(learn.withColumn("doc_id", F.lit(1)), 5)
    assert len({lang for _, lang in rows}) == 230 == len(rows)  # one id, and equal rows are one
    got = langid.identify(frame(spark, list(words.values()) * 2).withColumn("lang_pred", F.lit(7)), learn).orderBy("doc_id").collect()
    assert [(r["lang_pred"], r["score"]) for r in got[:230]] == [(r["lang_pred"], r["score"]) for r in got[230:]]
    assert sum(r["lang_pred"] == k for r, k in zip(got, words, strict=False)) > 200
    assert langid.identify(frame(spark, []), learn).count() == 0 and langid.identify(frame(spark, ["abc"]), frame(spark, [], lang=[])).first()["lang_pred"] == "und"


def test_quality_against_plain_dot_products(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    rows = quality.sample(docs.where(common.learn_side("doc_id")), labels.where(common.learn_side("doc_id")), 6000)
    w = quality.train(rows).astype(np.float32).astype(float)
    got = {r["doc_id"]: r["score"] for r in catalog.op4_quality(spark, sf_dir).collect()}
    for r in docs.collect():
        tokens = regex.findall(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+", (r["text"] or "").encode())
        h = [xxhash.xxh3_64_intdigest(t) for t in tokens]
        a, b = map(int, common.multipliers(2))
        both = [x >> 46 for x in h] + [int(common.mixed(np.array([(x * a + y * b) % 2**64], np.uint64))[0]) >> 46 for x, y in zip(h, h[1:], strict=False)]
        dot = sum(w[i] * (n / len(both)) ** 0.5 for i, n in collections.Counter(both).items()) + w[-1]
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-dot)), abs=1e-6)


def test_quality_of_shared_ids_and_empty_tables(spark):
    docs = frame(spark, ["good words here"] * 40 + ["bad words there"] * 40).withColumn("doc_id", F.col("doc_id") % 2 + F.when(F.col("text").startswith("g"), 0).otherwise(10))
    labels = spark.createDataFrame([(0, 1), (1, 1), (10, 0), (11, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.sample(docs, labels, 6000)
    assert len(rows) == 4 and len(quality.sample(docs, labels, 3)) == 3
    got = quality.score(docs, docs, labels).collect()
    assert len({(r["text"], r["score"]) for r in got}) == 2 and len(got) == 80
    assert quality.score(frame(spark, []), docs, labels).count() == 0
    assert quality.score(frame(spark, ["a"]), frame(spark, []), labels).first()["score"] == 0.5


def plain_spans(texts, items, window):
    """Per text: number of words, hit words, ids of items with occurring windows."""
    cut = lambda t: [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in regex.findall("[0-9A-Za-z\\x80-\U0010ffff]+", t or "")]
    out = []
    for t in texts:
        w, hit, ids = cut(t), set(), set()
        for item, text in items:
            b = cut(text)
            k = min(window, len(b))
            for p in {tuple(b[i : i + k]) for i in range(len(b) - k + 1) if k}:
                at = [i for i in range(len(w) - k + 1) if tuple(w[i : i + k]) == p]
                hit.update(i + j for i in at for j in range(k))
                ids |= {str(item)} if at else set()
        out.append((len(w), sorted(hit), sorted(ids)))
    return out


def test_phrases_in_blocks_against_plain_windows(monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_PHRASES", 3)
    rnd = random.Random(12)
    text = lambda n: " ".join(rnd.choice("abcdé") for _ in range(rnd.randint(0, n)))
    items = [(i, text(9)) for i in range(12)] + [(20, "a b"), (21, "A, b"), (22, ""), (23, "zz top")]
    texts = [text(60) for _ in range(30)]
    p = decontaminate.Phrases([(str(i), t.encode()) for i, t in items], 4)
    ids = [np.array([p.vocab.get(w, 0) for w in decontaminate.words(t.encode())], np.int64) for t in texts]
    hit, found = {}, {}
    for d, a, b, owner in p.hits(ids):
        hit.setdefault(d, set()).update(range(a, b))
        found.setdefault(d, set()).update(p.owners[owner])
    want = plain_spans(texts, items, 4)
    assert [(sorted(hit.get(d, ())), sorted(found.get(d, ()))) for d in range(30)] == [w[1:] for w in want] and len(list(p.blocks())) > 5


def test_decontamination_replaces_its_own_columns_only(spark):
    docs = frame(spark, ["a b c d", None]).withColumn("hit_spans", F.lit("clash")).withColumn("item_ids", F.lit("clash"))
    got = decontaminate.contaminated_spans(docs, spark.createDataFrame([(5, "B c"), (6, "x"), (None, "a")], "item_id long, text string"), with_text=True).orderBy("doc_id").collect()
    assert got[0]["hit_spans"] == [[1, 3]] and got[0]["item_ids"] == ["5"] and got[0]["clean_text"].split() == ["a", "d"] and got[0]["score"] == "clash"
    assert got[1]["hit_spans"] == [] and got[1]["clean_text"] is None


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 5, 400)
    index = decontaminate.FMIndex(text, 5)
    patterns = rng.integers(1, 5, (50, 4))
    lo, hi = index.search(patterns, np.full(50, 4))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(397) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_no_benchmark(spark):
    out = decontaminate.contaminated_spans(frame(spark, ["a b c"]), spark.createDataFrame([], "item_id long, text string"))
    assert out.first()["hit_spans"] == [] and decontaminate.contaminated_spans(frame(spark, []), spark.createDataFrame([(1, "a")], "item_id long, text string")).count() == 0


# --- line dedup -----------------------------------------------------------------------------------------

LINE = "this is line number {} of a longer passage"


def test_lines_are_deleted_from_later_documents(spark):
    block = "\n".join(LINE.format(i) for i in range(5))
    own = lambda k: f"only document {k} has this particular line"
    texts = [f"{own(0)}\n{block}", f"{own(1)}\n\n{block}\n{own(11)}", block, "ok\nok", "ok\nok", None, "", f"{own(7)}\n{LINE.format(3)}\n{LINE.format(1)}", own(8)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got[0]["text"] == texts[0] and got[1]["text"] == f"{own(1)}\n\n{own(11)}" and got[1]["n_removed"] == 5
    assert got[2]["emptied"] and got[2]["text"] == ""
    assert got[3]["text"] == got[4]["text"] == "ok\nok"  # short lines alone are no block
    assert got[5]["text"] is None and got[6]["text"] == "" and not got[6]["emptied"]
    assert got[7]["n_removed"] == 1  # crossing lines: one of the two is aligned
    assert got[8]["text"] == own(8) and got[0]["score"] == "clash"
    assert linededup.dedup_lines(frame(spark, [])).count() == 0


def all_pairs(texts):
    """Places that alignment with every earlier document that shares a strong line deletes."""
    hashed = [[linededup.line_hash(x.encode()) for x in t.split("\n")] for t in texts]
    strong = [{x for x in h if x & 1} for h in hashed]
    return [set().union(*(linededup.deleted(hashed[d], hashed[e]) for e in range(d) if strong[d] & strong[e])) for d in range(len(texts))]


def test_line_dedup_against_all_pairs(spark):
    rnd = random.Random(4)
    lines = [LINE.format(i) for i in range(40)] + ["", "short", "other short"]
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(1, 12))) for _ in range(60)]
    # passages that several documents share, whose lines first stand apart in other documents
    block = "\n".join([LINE.format("a"), "short", "", "tiny", LINE.format("b"), "x"])
    texts += [LINE.format("b"), LINE.format("a"), block, f"{LINE.format('own')}\n{block}\n{LINE.format('end')}"]
    want = all_pairs(texts)
    cut = lambda t, gone: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
    docs = frame(spark, texts)
    exact = {r["doc_id"]: r for r in linededup.dedup_lines(docs, exact=True).collect()}
    assert all(exact[d]["text"] == cut(t, want[d]) and exact[d]["n_removed"] == len(want[d]) for d, t in enumerate(texts))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[len(texts) - 1]["text"] == f"{LINE.format('own')}\n{LINE.format('end')}"
    assert sum(r["n_removed"] for r in got.values()) >= 0.9 * sum(map(len, want))
    assert all(got[d]["n_removed"] <= len(want[d]) for d in got)


def test_line_dedup_of_the_table_against_all_pairs(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in rows], all_pairs([r["text"] or "" for r in rows]), strict=True))
    got = {r["doc_id"]: r["n_removed"] for r in catalog.op2_linededup(spark, sf_dir).collect()}
    assert sum(got.values()) >= 0.95 * sum(map(len, want.values())) > 0 and all(got[d] <= len(want[d]) for d in got)


def test_line_dedup_of_hot_lines_and_long_texts(spark):
    hot = LINE.format("everywhere")
    texts = ["\n".join(LINE.format(i) for i in range(30_000)), "\n".join(LINE.format(i) for i in [*range(15_000, 30_000), *range(15_000)])]
    texts += [f"document number {k} has its own line\n{hot}" for k in range(3000)]
    docs = frame(spark, texts).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 15_000
    assert got[2]["n_removed"] == 0 and all(got[d]["n_removed"] == 1 and got[d]["n_lines"] == 2 for d in range(3, len(texts)))


def test_line_dedup_of_shared_and_null_ids(spark):
    block = "\n".join(LINE.format(i) for i in range(3))
    rows = [(1, block), (1, block), (2, block), (2, block), (None, block), (2, LINE.format("other")), (3, f"{block}\nown")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r["n_removed"] == 0 for r in got if r["doc_id"] in (None, 1))
    assert [r["text"] for r in got if r["doc_id"] == 3] == ["own"]


def test_long_swaps_are_aligned_in_time():
    import time

    a = list(range(1, 60_001))
    began = time.perf_counter()
    assert len(linededup.deleted([2 * x + 1 for x in [*a[30_000:], *a[:30_000]]], [2 * x + 1 for x in a])) == 30_000
    assert time.perf_counter() - began < 1.5


def test_line_dedup_keeps_no_common_line_beside_a_rare_one(spark):
    rare, common_lines = LINE.format("rare"), "\n".join(LINE.format(i) for i in range(3))
    texts = [rare, *(f"document {k} has a line of its own\n{common_lines}" for k in range(40)), f"{rare}\nown words in between the two\n{common_lines}"]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert got[41]["text"] == "own words in between the two" and got[41]["n_removed"] == 4
    assert got[0]["text"] == texts[0] and got[1]["text"] == texts[1] and all(got[k]["n_removed"] == 3 for k in range(2, 41))


def test_line_dedup_query_aligns_with_every_earlier_holder(spark, sf_dir):
    rows = common.table(spark, sf_dir, "documents").orderBy("doc_id").collect()
    want = dict(zip([r["doc_id"] for r in rows], map(len, all_pairs([r["text"] or "" for r in rows])), strict=True))
    assert {r["doc_id"]: r["n_removed"] for r in catalog.op2_linededup(spark, sf_dir).collect()} == want


@pytest.mark.parametrize("few", [2, 16])
def test_line_dedup_of_hot_lines_in_other_orders(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "FEW", few)
    monkeypatch.setattr(linededup, "TILE_LINES", 40)
    monkeypatch.setattr(linededup, "TILE_DOCS", 7)
    rnd = random.Random(11)
    hot = [LINE.format(f"hot {i}") for i in range(3)]
    some = [*hot * 4, *(LINE.format(i) for i in range(25)), "", "", "short", "tiny"]
    # the first holders hold each hot line once, alone
    texts = [*hot, *(f"{rnd.choice(hot)}\nown line of document number {k}" for k in range(40))]
    texts += ["\n".join(rnd.choice(some) for _ in range(rnd.randint(2, 9))) for _ in range(120)]
    texts += [f"{hot[0]}\nown words of the last document\n{hot[0]}\n\nshort\n{hot[2]}\n{hot[1]}", f"{hot[0]}\nmore own words of the very last\n{hot[0]}"]
    want = all_pairs(texts)
    got = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, texts), exact=True).collect()}
    for d, t in enumerate(texts):
        assert got[d]["text"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[d]), d
    plain = {r["doc_id"]: r["n_removed"] for r in linededup.dedup_lines(frame(spark, texts)).collect()}
    assert sum(plain.values()) < sum(map(len, want))


def test_patience_alignment_is_increasing():
    rnd = random.Random(6)
    for _ in range(200):
        a, b = ([rnd.randrange(9) for _ in range(rnd.randint(0, 20))] for _ in range(2))
        got = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]


# --- PII ------------------------------------------------------------------------------------------------


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


class PlainSurrogates:
    """The rules of the surrogates once more, without Spark: one value, one document at a time."""

    def __init__(self, key):
        self.key = key.encode()
        self.patterns = {k: regex.compile(v) for k, v in pii.PATTERNS.items()}
        self.titles = regex.compile("^" + pii._TITLES)

    def draw(self, *parts):
        return hmac.new(self.key, "|".join(map(str, parts)).encode(), hashlib.sha256).hexdigest()

    def pair(self, tweak, hi, a, lo, b):
        for i in range(1, 9):
            if i % 2:
                hi = (hi + int(self.draw(tweak, i, lo)[:15], 16)) % a
            else:
                lo = (lo + int(self.draw(tweak, i, hi)[:15], 16)) % b
        return hi, lo

    def chars(self, tweak, text, alphabets=("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        cut = len(text) // 2
        halves = [text[:cut], text[cut:]]
        for i in range(1, 7):
            seed = self.draw(tweak, i, halves[i % 2])
            out = ""
            for k, c in enumerate(halves[1 - i % 2]):
                n = int(self.draw(seed, k // 16)[4 * (k % 16) :][:4], 16)
                own = next((x for x in alphabets if c in x), c)
                out += own[(own.index(c) + n) % len(own)]
            halves[1 - i % 2] = out
        return "".join(halves)

    def fixed(self, kind, v):
        d = "".join(c for c in v if c.isdigit())
        if kind == "phone":
            head, ten = d[:-10], d[-10:]
            real = ten[0] > "1"
            hi, lo = self.pair(f"phone|{head}|{str(real).lower()}", int(ten[:5]) - 20000 * real, 80000 if real else 20000, int(ten[5:]), 10**5)
            new = f"{head}{hi + 20000 * real:05}{lo:05}"
        elif kind == "ssn":
            area, group, serial = int(d[:3]), int(d[3:5]), int(d[5:])
            areas = [x for x in range(1, 900) if x != 666]
            if area in areas:
                hi, lo = self.pair("ssn", areas.index(area) * 100 + group, 89800, serial, 10**4)
                new = f"{areas[hi // 100]:03}{hi % 100:02}{lo:04}"
            else:
                hi, lo = self.pair(f"ssn|{area}", group, 100, serial, 10**4)
                new = f"{area:03}{hi:02}{lo:04}"
        elif kind == "card":
            u = (len(d) - 2) // 2
            w = len(d) - 2 - u
            hi, lo = self.pair(f"card|{d[0]}|{len(d)}", int(d[1 : 1 + u]), 10**u, int(d[1 + u : -1]), 10**w)
            new = f"{d[0]}{hi:0{u}}{lo:0{w}}"
            new += next(c for c in "0123456789" if luhn(new + c))
        elif kind == "ip":
            return self.ip(v)
        elif kind == "email":
            local, domain = v.lower().split("@")
            head, last = domain.rsplit(".", 1)
            new = f"{self.chars(f'email|{domain}', local)}@{self.chars('domain', head)}.{last}.example"
            return new.upper() if v == v.upper() else new
        else:
            for case in (str.lower, str.upper):
                if v == case(v) and regex.fullmatch("[0-9a-fA-F]+", v):
                    return case(self.chars("secret", v.lower(), ("0123456789abcdef",)))
            head = v[:3] if v.startswith("sk-") else v[:4]
            return head + self.chars(f"secret|{head}", v[len(head) :])
        left = iter(new)
        return "".join(next(left) if c.isdigit() else c for c in v)

    def ip(self, v):
        def name(n):
            if n >> 24 == 0:
                return 5
            if n >> 28 >= 14:
                return 6 + (n >> 28) - 14
            return next((k for k, (first, size) in enumerate(pii.BLOCKS) if first <= n < first + size), "public")

        n = int(ipaddress.ip_address(v))
        kind = name(n)
        if kind == "public":
            before = sum(size for first, size in pii.BLOCKS if first < n)
            hi, lo = self.pair("ip|public", (n - (1 << 24) - before) >> 16, 56558, (n - (1 << 24) - before) & 65535, 65536)
            out = (hi << 16) + lo + (1 << 24)
            for first, size in pii.BLOCKS:
                out += size if out >= first else 0
        else:
            first, size = [*pii.BLOCKS, (0, 1 << 24), (224 << 24, 16 << 24), (240 << 24, 16 << 24)][kind]
            hi, lo = self.pair(f"ip|{kind}", (n - first) >> 8, size >> 8, n & 255, 256)
            out = first + (hi << 8) + lo
        assert name(out) == kind
        return str(ipaddress.ip_address(out))

    def kind(self, v):
        for k, p in self.patterns.items():
            if p.fullmatch(v):
                return k if k != "card" or luhn([c for c in v if c.isdigit()]) else "none"
        return "word"

    def names(self, texts):
        """Per text, what its names with titles and its name words become."""
        runs, lead_name, lead_word, titled = [], collections.Counter(), collections.Counter(), []
        for t in texts:
            runs.append({tuple(w[i : i + k]) for r in regex.findall(pii.RUN, t) for w in [r.lower().split(" ")] for k in (2, 3) for i in range(len(w) - k + 1)})
            found = {m[0] for m in regex.finditer(pii.ANY, t) if self.kind(m[0]) == "name"}
            titled.append([(v, self.gender(v), tuple(self.titles.sub("", v).lower().split(" "))) for v in found])
        for rows in titled:
            for _, g, words in rows:
                lead_name[words] += {"m": 1, "f": -1}.get(g, 0)
        known = {w for rows in titled for _, _, w in rows if len(w) > 1}
        for g, words in {(g, w) for rows in titled for _, g, w in rows if g}:
            for w in words[:-1]:
                lead_word[w] += {"m": 1, "f": -1}[g]
        mentions = [rows + [(None, None, w) for w in grams & known] for rows, grams in zip(titled, runs, strict=True)]

        def kinds(g, words):
            for i, w in enumerate(words):
                if i == len(words) - 1:
                    yield "family", w
                else:
                    leads = [lead_name[words] if len(words) > 1 else 0, lead_word[w]]
                    yield "given_" + (g or next(("m" if x > 0 else "f" for x in leads if x), None) or ("m" if int(self.draw("gender", w)[0], 16) % 2 == 0 else "f")), w

        made = self.dictionary({x for rows in mentions for _, g, w in rows for x in kinds(g, w)})
        out = []
        for rows in mentions:
            best = {}
            for v, g, words in rows:
                new = [made[x] for x in kinds(g, words)]
                if v:
                    best["v:" + v] = (0, " ".join(new))
                for (kind, w), sur in zip(kinds(g, words), new, strict=True):
                    best["w:" + w] = min(best.get("w:" + w, (2, "")), (int(kind != "family"), sur))
            out.append({k: v[1] for k, v in best.items()})
        return out

    def gender(self, v):
        said = set((self.titles.match(v) or [""])[0].replace(".", "").split())
        return "f" if said & set(pii.FEMALE_TITLES.split("|")) else "m" if said & set(pii.MALE_TITLES.split("|")) else None

    def dictionary(self, words):
        forms, attempt = {w for _, w in words}, dict.fromkeys(words, 0)
        while True:
            drawn = {}
            for kind, w in words:
                script = "cyrillic" if regex.search(r"\p{Cyrillic}", w) else "latin"
                pool = (pii.SYLLABLES[script] if kind == "family" else pii.GIVEN[f"{script}_{kind[-1]}"]).lower().split()
                digits = self.draw(kind, w, attempt[kind, w])
                n = attempt[kind, w] + (3 if kind == "family" else 1)
                drawn.setdefault(("" if kind == "family" else "-").join(pool[int(digits[i % 64], 16)] for i in range(n)), []).append((w, kind))
            again = [x for sur, found in drawn.items() for x in found if x != min(found) or sur in forms]
            if not again:
                return {(kind, w): sur for sur, found in drawn.items() for w, kind in found}
            for w, kind in again:
                attempt[kind, w] += 1

    def all(self, texts):
        def cased(word, sur):
            return sur.upper() if len(word) > 1 and word == word.upper() else "-".join(x[:1].upper() + x[1:] for x in sur.split("-"))

        def replaced(m):
            v = m[0]
            kind = self.kind(v)
            if kind == "name":
                title = self.titles.match(v)[0]
                return title + " ".join(map(cased, v[len(title) :].split(" "), names["v:" + v].split(" ")))
            if kind == "word":
                return cased(v, names["w:" + v.lower()]) if "w:" + v.lower() in names else v
            return v if kind == "none" else self.fixed(kind, v)

        out = []
        for t, names in zip(texts, self.names(texts), strict=True):
            out.append(regex.sub(pii.ANY_OR_WORD if names else pii.ANY, replaced, t))
        return out


def test_surrogates_against_a_plain_version(spark, sf_dir):
    rnd = random.Random(9)
    texts = [r["text"] for r in common.table(spark, sf_dir, "documents").where("text is not null").orderBy("doc_id").collect()]
    people = [f"{a} {b}" for a in ("John", "Alex", "Jane", "Иван", "Anne-Marie") for b in ("Smith", "O'Brien", "Jones", "Петров", "Alex")]
    for _ in range(120):
        parts = [f"{rnd.choice(['Mr. ', 'Mrs ', 'Dr. ', 'Prof. Dr. ', 'Г-н ', '', ''])}{rnd.choice([str, str, str.upper])(rnd.choice([p, p.split()[-1], p.split()[0]]))}" for p in rnd.choices(people, k=4)]
        parts += [".".join(str(rnd.choice([0, 10, 127, 169, 172, 192, 168, 254, 8, 230, 250])) for _ in range(4)), f"{rnd.randrange(1000):03}-{rnd.randrange(100):02}-{rnd.randrange(10000):04}"]
        parts += [f"+1 ({rnd.randrange(1000):03}) 555-{rnd.randrange(10000):04}", "".join(rnd.choice("0123456789abcdef") for _ in range(40)), "sk-" + "".join(rnd.choice("019azAZ") for _ in range(24)), f"{rnd.choice('aé_.')}{rnd.choice('aB3')}@{rnd.choice('xyz')}.a-1.COM"]
        parts += [f"4{rnd.randrange(10**15):015}", "JOE@SITE.ORG", "'s went away.", "Monday Morning"]
        rnd.shuffle(parts)
        texts.append(rnd.choice([" ", "\n", ", "]).join(parts))
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(frame(spark, texts), key="some key").collect()}
    want = PlainSurrogates("some key").all(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(a != b for a, b in zip(texts, want, strict=True)) > 120


def test_surrogates_are_consistent_and_distinct(spark):
    mails = [f"{a}{b}@site.org" for a in "abcdefghij" for b in "abcdefghij"]
    texts = ["Call +1 (743) 555-3824 or +1-743-555-3824, card 4111-1111-1111-1111, Foo.Bar9@mail.example.com 10.1.2.3", " ".join(mails), "FOO.BAR9@MAIL.EXAMPLE.COM and 4111111111111111", "Mrs Jane SMITH met Mr. John Smith. Г-жа Анна Петрова", None, "", "nothing 123", "a@b.de", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "a@b.de", "no card 4111111111111112"]
    got = {r["doc_id"]: r for r in pii.surrogates(frame(spark, texts), key="k").collect()}
    first = got[0]["text"]
    phones = [w for w in ("".join(c for c in p if c.isdigit()) for p in (first.split(" or ")[0][5:], first.split(" or ")[1].split(",")[0]))]
    assert phones[0] == phones[1] != "17435553824" and phones[0][0] == "1"
    card = first.split("card ")[1][:19]
    assert card.count("-") == 3 and luhn(card.replace("-", "")) and card.replace("-", "") in got[2]["text"]
    assert first.split()[-1].startswith("10.") and first.split()[-1] != "10.1.2.3"
    new = got[1]["text"].split()
    assert len(set(new)) == 100 and not set(new) & set(mails) and all(m.split("@")[0].isalnum() for m in new)
    assert got[2]["text"].split()[0].lower() in first
    assert got[3]["text"].startswith("Mrs ") and " met Mr. " in got[3]["text"] and "Smith" not in got[3]["text"] and "Петрова" not in got[3]["text"]
    assert any("а" <= c <= "я" for c in got[3]["text"].split("Г-жа")[1])
    assert got[4]["text"] is None and got[5]["text"] == "" and got[6]["text"] == "nothing 123" and got[6]["n_entities"] == 0
    assert got[7]["text"] == got[9]["text"] != "a@b.de"
    assert len(got[8]["text"]) == len(texts[8]) and "24be" not in got[8]["text"]
    assert got[10]["text"] == texts[10] and got[10]["n_entities"] == 0 and got[0]["kinds"] == "card,email,ip,phone"
    again = {r["doc_id"]: r["text"] for r in pii.surrogates(frame(spark, texts), key="other").collect()}
    assert again[1] != got[1]["text"]
    assert pii.surrogates(frame(spark, []), key="k").count() == 0
    with pytest.raises(ValueError):
        pii.surrogates(frame(spark, []), key="")


def test_names_stay_one_person_and_do_not_leak(spark):
    texts = ["Mr. John Smith, Mr. Smith, Dr. Smith and Dr. John Smith", "John Smith called. Smith again, but no smith and no Smithson", "the smith Smith", "JOHN SMITH's"]
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(frame(spark, texts).withColumn("kinds", F.lit("clash")), key="k").collect()}
    given, family = got[0].removeprefix("Mr. ").split(",")[0].split(" ")
    assert got[0] == f"Mr. {given} {family}, Mr. {family}, Dr. {family} and Dr. {given} {family}"
    assert got[1] == f"{given} {family} called. {family} again, but no smith and no Smithson"
    assert got[2] == texts[2]  # nothing tells a person there
    assert got[3] == f"{given} {family}'s".upper().replace("'S", "'s")
    assert given.split("-")[0] in pii.GIVEN["latin_m"].split()


def test_dense_kinds_and_very_long_values(spark):
    block = [f"192.168.{a}.{b}" for a in range(256) for b in range(256)]
    texts = [" ".join(block), "x@a" + ".b" * 100_000 + " end", "x@a" + ".b" * 2000 + " end", "Mr. " + "A" * 70_000, "1234 " * 20_000, "X@" * 20_000, " ".join(f"{a}@b.de" for a in "abcdefghijklmnopqrstuvwxyz")]
    got = {r["doc_id"]: r for r in pii.surrogates(frame(spark, texts), key="k").collect()}
    assert sorted(got[0]["text"].split()) == sorted(block) and got[0]["text"] != texts[0] and got[0]["n_entities"] == 65_536
    assert got[1]["text"].endswith(".example end") and len(got[1]["text"]) == len(texts[1]) + 8 and got[1]["text"][:20] != texts[1][:20]
    assert got[2]["n_entities"] == 1 and got[3]["n_entities"] == 1 and got[5]["n_entities"] == 0
    assert len({m.split("@")[0] for m in got[6]["text"].split()}) == 26


def test_surrogates_of_texts_that_share_an_id(spark):
    rows = [(1, "Mr. John Smith"), (1, "a@b.de and Smith"), (None, "Mrs. Smith"), (1, "Mr. John Smith"), (None, None)]
    got = sorted((str(r["text"]), r["n_entities"]) for r in pii.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), key="k").collect())
    assert len(got) == 5 and sum("Smith" in t for t, _ in got) == 1  # a bare surname of an unknown person
    names = [t for t, _ in got if t.startswith("Mr")]
    assert len(set(names)) == 2 and len({t.split()[-1] for t in names}) == 1


def test_pii_plan_is_native(spark, sf_dir):
    plan = catalog.op7_pii(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- substring dedup ---------------------------------------------------------------------------------------


def plain_removed(texts, window):
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = []
    for d, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append(b" ".join(x for i, x in enumerate(w) if i not in gone).decode())
    return out


def test_substring_dedup_against_plain_windows(spark):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    texts = list(ODD)
    for _ in range(80):
        w = [f"u{rnd.randrange(10**6)}" for _ in range(rnd.randint(0, 40))]
        a, n = rnd.randrange(50), rnd.randint(5, 40)
        at = rnd.randint(0, len(w))
        texts.append(" ".join(w[:at] + passage[a : a + n] + w[at:]))
    got = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(frame(spark, texts)).collect()}
    want = plain_removed(texts, 13)
    assert [got[i] for i in range(len(texts))] == want
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_of_nulls_shared_and_largest_ids_in_grouped_lists(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(30))
    top = (1 << 63) - 1
    rows = [(top, f"a {passage}"), (None, f"b {passage}"), (None, f"c {passage}"), (top - 1, "nothing here"), (None, None), (3, "x y"), (7, " ".join(f"q{i}" for i in range(20))), (7, " ".join(f"q{i}" for i in range(20)))]
    rnd = random.Random(3)
    texts = [" ".join(f"w{rnd.randrange(12)}" for _ in range(rnd.randint(0, 60))) for _ in range(50)]
    for settings in ({}, {"GROUP": 2}, {"GROUP": 3}):
        for k, v in settings.items():
            monkeypatch.setattr(substring, k, v)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))
        got = sorted((str(r["doc_id"]), r["kept_text"], r["n_removed"]) for r in substring.remove_repeats(docs).collect())
        want = [(top, f"a {passage}", 0), (None, "b", 30), (None, "c", 30), (top - 1, "nothing here", 0), (None, "", 0), (3, "x y", 0), (7, rows[6][1], 0), (7, rows[6][1], 0)]
        assert got == sorted((str(d), t, n) for d, t, n in want)
        some = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(frame(spark, texts), window=3).collect()}
        assert [some[i] for i in range(len(texts))] == plain_removed(texts, 3)


def test_windows_with_equal_first_hashes_are_told_apart():
    h, x = np.array([5, 5, 5, 9], np.uint64), np.array([1, 2, 3, 1], np.uint32)
    found, at = substring._match(h, x, np.array([5, 5, 9, 9, 4], np.uint64), np.array([3, 7, 1, 2, 1], np.uint32))
    assert found.tolist() == [True, False, True, False, False] and at[0] == 2 and at[2] == 3
    entries = tuple(np.arange(6).astype(t) * 3 for t in substring._ENTRY)
    again = substring._read([substring._write(entries), substring._write(tuple(c[:0] for c in entries))])
    assert all((a == b).all() for a, b in zip(entries, again[:5], strict=True)) and again[5].tolist() == [0] * 6


def test_packed_lists_round_trip():
    rng = np.random.default_rng(2)
    for top in (10, 1 << 20, 1 << 45, 1 << 63):
        v = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        assert (substring.unpack(substring.pack(v)) == v).all()
    assert len(substring.unpack(substring.pack(np.empty(0, np.uint64)))) == 0


def test_slices_are_bounded_and_whole():
    import pyarrow as pa

    texts = ["x" * n for n in (1, 5000, 10, 10, 90_000, 3, 3, 3)]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "text": texts})
    parts = list(common.sliced([batch, batch.slice(0, 0)], 6, 10_000))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(8))
    assert all(p.num_rows == 1 or p.nbytes <= 10_000 for p in parts) and max(p.num_rows for p in parts) > 1


def test_learning_side_is_crc32(spark):
    got = {r["id"]: r["x"] for r in spark.range(50).select("id", common.learn_side("id").alias("x")).collect()}
    assert all(got[i] == (zlib.crc32(str(i).encode()) % 3 != 1) for i in range(50))
