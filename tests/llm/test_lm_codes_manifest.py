"""Context-tree scores, vector codes and the manifest against plain versions, and odd tables."""

import math
import re
from collections import Counter, defaultdict
from functools import cache
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import codes, common, ctw, lm, manifest

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


# --- context-tree weighting -----------------------------------------------------------------------


class PlainTree:
    """Context-tree weighting with dictionaries and a recursion over contexts."""

    def __init__(self, texts: list[bytes], depth: int) -> None:
        self.depth, self.n, self.longer = depth, Counter(), defaultdict(set)
        for t in texts:
            whole = b"\xff" * depth + t + b"\xff"
            for at in range(depth, len(whole)):
                for d in range(depth + 1):
                    context = whole[at - d : at]
                    if d:
                        self.longer[context[1:]].add(context)
                    for b in range(8):
                        self.n[context, b, whole[at] >> (8 - b), whole[at] >> (7 - b) & 1] += 1
        self.weighted = cache(self._weighted)

    def counts(self, context, b, bits):
        return self.n[context, b, bits, 0], self.n[context, b, bits, 1]

    def kt(self, context, b, bits):
        n0, n1 = self.counts(context, b, bits)
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.log(math.pi) - math.lgamma(n0 + n1 + 1)

    def _weighted(self, context, b, bits):
        kt = self.kt(context, b, bits)
        if len(context) == self.depth:
            return kt
        return np.logaddexp(kt, sum(self.weighted(c, b, bits) for c in self.longer[context])) - math.log(2)

    def bit(self, context, b, bits, one, d=0):
        """The mixed probability from contexts of length d on; None without counts."""
        c = context[len(context) - d :]
        n = self.counts(c, b, bits)
        if not sum(n):
            return None
        own = (n[one] + 0.5) / (sum(n) + 1)
        longer = self.bit(context, b, bits, one, d + 1) if d < self.depth else None
        if longer is None:
            return own
        w = math.exp(self.kt(c, b, bits) - math.log(2) - self.weighted(c, b, bits))
        return w * own + (1 - w) * longer

    def score(self, t: bytes) -> float:
        whole, out = b"\xff" * self.depth + t + b"\xff", 0.0
        for at in range(self.depth, len(whole)):
            for b in range(8):
                p = self.bit(whole[at - self.depth : at], b, whole[at] >> (8 - b), whole[at] >> (7 - b) & 1)
                out += math.log10(0.5 if p is None else p)
        return out


def plain_base(texts: list[bytes], learnt: list[bool]):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", t) + [b"\xff"] for t in texts]
    c = Counter(w for ws, x in zip(words, learnt, strict=True) if x for w in ws)
    n, v = sum(c.values()), len(c)
    return [(len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for w in words]


@pytest.mark.parametrize("depth", [4, 6])
def test_scores_against_a_plain_tree(spark, depth):
    texts = ["The cat sat on the mat. The cat!", "", None, "a", "The rat sat on the hat", "Ünder über  the\n\nmat", "the the the the the", "xyzzy \x00 q", "The cat sat on the mat. The cat!"]
    learnt = [True, True, True, False, True, True, False, False, None]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, learnt, strict=True))], "doc_id long, text string, learn boolean")
    got = {r["doc_id"]: r for r in lm.score(df, F.col("learn"), depth).collect()}
    raw = [(t or "").encode().translate(LOW) for t in texts]
    tree = PlainTree([t for t, x in zip(raw, learnt, strict=True) if x], depth)
    base = plain_base(raw, [bool(x) for x in learnt])
    assert len(got) == len(texts)
    for i, t in enumerate(raw):
        r = got[i]
        assert r["score"] == pytest.approx(tree.score(t), rel=1e-6)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == base[i][:3]
        assert r["base_score"] == pytest.approx(base[i][3], abs=1e-9)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / max(1, len(t)))


def test_bytes_of_every_context_sum_to_one():
    rng = np.random.default_rng(3)
    text = bytes(rng.choice([97, 98, 99, 32], 400).tolist())
    keys, n = np.unique(ctw.grams(b"\xff" * 7 + text + b"\xff", 5), return_counts=True)
    for context in [text[7:12], b"zzzzz", b"\xff" * 5]:
        every = np.concatenate([ctw.grams(b"ab" + context + bytes([b]), 5) for b in range(256)])
        all_keys, all_n = ctw.counted(np.concatenate([keys, every]), np.concatenate([n, np.zeros(256, np.int64)]))
        p = 10 ** ctw.mixed_bits(every, ctw.levels(all_keys, all_n, 5, 0))
        assert p.sum() == pytest.approx(1)


def test_kt_of_large_counts():
    for a, b in [(0, 0), (3, 0), (20_000, 5), (10**7, 10**6)]:
        want = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
        assert ctw.log_kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_slices_shards_and_windows_make_no_difference(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text").where("doc_id < 60")
    learn = F.col("doc_id") % 3 != 0
    whole = {r["doc_id"]: r for r in lm.score(docs, learn).collect()}
    small = lm.Sizes(slice=3000, row=1000, window=501, shard=7000, run=300)
    cut = {r["doc_id"]: r for r in lm.score(docs.repartition(3), learn, sizes=small).collect()}
    assert whole.keys() == cut.keys()
    for i, r in whole.items():
        assert r["score"] == pytest.approx(cut[i]["score"], rel=1e-6) and r["base_score"] == pytest.approx(cut[i]["base_score"], abs=1e-8)
        assert [r[c] for c in ("n_tokens", "n_known", "train_tokens")] == [cut[i][c] for c in ("n_tokens", "n_known", "train_tokens")]


def test_scores_of_odd_tables(spark):
    ddl = "doc_id string, text string, n_tokens long, score double"
    assert lm.score(spark.createDataFrame([], ddl), F.lit(True)).collect() == []
    same = spark.createDataFrame([("a", "x y", 1, 0.5), (None, "x y", 2, 0.5), ("a", "x y", None, None)], ddl)
    rows = lm.score(same, F.lit(True)).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1 and rows[0]["train_tokens"] == 9
    none = lm.score(same, F.lit(None).cast("boolean")).first()
    assert none["score"] == pytest.approx(4 * math.log10(1 / 256)) and none["base_score"] == 0 and none["n_known"] == 0


def test_the_model_beats_the_base_on_held_out_texts(spark):
    docs = common.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    rows = lm.score(docs, F.col("doc_id") % 7 != 2).where("not learnt and n_tokens > 50").collect()
    assert len(rows) > 800 and sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


# --- vector codes ---------------------------------------------------------------------------------


def plain_codes(vectors, rounds=4):
    """(codes, errors, codebooks) by looking at all entries; vectors in the order of their ids."""
    x = np.array([[math.floor(1024 * v) for v in row] for row in vectors], object)
    edges, codes_, errors, books = codes.cuts(x.shape[1]), [], [], []
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part = x[:, a:b]
        book = part[:256].copy()

        def nearest(part=part):
            d = [[sum((u - w) ** 2 for u, w in zip(row, e, strict=True)) for e in book] for row in part]  # noqa: B023
            return [min(range(len(book)), key=lambda j: (r[j], j)) for r in d], [min(r) for r in d]  # noqa: B023

        for _ in range(rounds):
            at, _ = nearest()
            for j in range(len(book)):
                mine = [row for row, k in zip(part, at, strict=True) if k == j]
                if mine:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        at, d = nearest()
        codes_.append(at)
        errors.append(d)
        books.append(book)
    return ["".join(f"{c:02x}" for c in r) for r in zip(*codes_, strict=True)], [sum(e) for e in zip(*errors, strict=True)], books


def test_codes_against_looking_at_all_entries(spark):
    rng = np.random.default_rng(5)
    vectors = np.concatenate([rng.normal(0, 0.2, (280, 10)), np.zeros((30, 10)), rng.integers(-2, 3, (40, 10)) / 4])
    labels = [None if i % 7 == 0 else i % 3 for i in range(len(vectors))]
    rows = [(3 * i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(vectors, labels, strict=True))]
    odd = [(1, None, 0), (2, [0.1] * 9 + [None], 0), (4, [0.1] * 9 + [float("nan")], 0), (5, [0.1] * 9 + [float("inf")], None)]
    df = spark.createDataFrame(rows[::-1] + odd, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: r for r in codes.compress(df).collect()}
    code, error, books = plain_codes(vectors)
    assert sorted(got) == [r[0] for r in rows]
    total = Counter()
    for lab, e in zip(labels, error, strict=True):
        total[lab] += e
    digest = sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    for i, c, e, lab in zip((r[0] for r in rows), code, error, labels, strict=True):
        assert (got[i]["code"], got[i]["error"], got[i]["label_error"], got[i]["codebooks_sha256"]) == (c, e, total[lab], digest)


def test_exponion_skips_entries_and_keeps_ties():
    rng = np.random.default_rng(1)
    entries = np.concatenate([rng.integers(-50, 50, (100, 3)), rng.integers(950, 1050, (100, 3)), [[0, 0, 0], [2, 0, 0], [2, 0, 0]]])
    book = codes.Book(entries)
    x = np.concatenate([rng.integers(-50, 50, (500, 3)), [[1, 0, 0]]])
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    for start in (np.zeros(len(x), np.int64), d.argmin(1), rng.integers(0, len(entries), len(x))):
        code, dist, looked = book.nearest(x, start)
        assert (code == d.argmin(1)).all() and (dist == d.min(1)).all()
    assert book.nearest(x, d.argmin(1))[2] < 0.3 * d.size


def test_codes_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, label string, code string, error int"
    assert codes.compress(spark.createDataFrame([], ddl)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, "a", "", 0)], ddl)).collect() == []
    rows = [(None, [1.0, 2.0, 3.0], "a", "", 0), (7, [1.0, 2.0, 3.0], "a", "", 0), (7, [1.0, 2.0, 3.0], None, "", 0), (8, [1.0], "", "", 0), (9, [0.5, 2.0, 3.0], None, "", 0)]
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in codes.compress(spark.createDataFrame(rows, ddl)).collect()), key=str)
    # two equal vectors start two entries: the lower one is used; the short vector has no code; null ids start last
    assert got == [(7, "00000000", 0, 0), (7, "00000000", 0, 0), (8, None, None, None), (9, "02000000", 0, 0), (None, "00000000", 0, 0)]
    empty = codes.compress(spark.createDataFrame([(1, [], "a", "", 0)], ddl)).first()
    assert (empty["code"], empty["error"]) == ("00000000", 0)


# --- the manifest ---------------------------------------------------------------------------------

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*x):
    return sha256("".join(x).encode()).hexdigest()


def plain_manifest(rows, tampered):
    """{row number: the results} from whole trees and paths by hand."""

    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def steps(nodes, at):
        out = []
        while len(nodes) > 1:
            first = at - at % 3
            out.append(([x for x in nodes[first:at]], [x for x in nodes[at + 1 : first + 3]]))
            nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], at // 3
        return nodes[0], out

    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[r[1]].append(((r[0] is not None, r[0] or 0), leaf(r), k))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    leaves = {g: [x[1] for x in sorted(groups[g])] for g in order}
    subroots = [steps(leaves[g], 0)[0] for g in order]
    out = {}
    for j, g in enumerate(order):
        for at, (_, own, k) in enumerate(sorted(groups[g])):
            subroot, low = steps(leaves[g], at)
            root, high = steps(subroots, j)
            x = leaf([*rows[k][:4], rows[k][4].replace("\n", "")]) if tampered(rows[k][0]) and rows[k][4] is not None else own
            for a, b in low + high:
                x = h(*a, x, *b)
            out[k] = (own, subroot, root, h(*(s for a, b in low + high for s in a + b)), x, x == root)
    return out


@pytest.mark.parametrize("levels,top", [(7, 8192), (1, 4), (2, 3), (1, 1)])
def test_manifest_against_whole_trees(spark, levels, top):
    rng = np.random.default_rng(2)
    names = [None, "", "é", "z", "a", "Z", "b1", "b2", "b3", "b4", "b5", "b6"]
    rows = [(int(i), names[0 if i % 3 == 0 else int(rng.integers(0, len(names)))], None if i % 11 == 0 else "en", int(i) * 2, None if i % 13 == 0 else f"Text {i}\n" * int(rng.integers(0, 4))) for i in range(70)]
    rows += [(None, "z", None, None, "x\ny"), (5, "z", "en", 1, "twin"), (5, "z", "en", 1, "twin"), (5, "z", "en", 1, "another\n"), (71, "only", "en", 1, "lone\n")]
    df = spark.createDataFrame([(*r, "clash", k) for k, r in enumerate(rows)], "doc_id long, source string, lang string, n_chars long, text string, root string, leaf long").repartition(6)
    tampered = lambda i: i is not None and i % 2 == 0
    got = manifest.manifest(df, FIELDS, "source", "doc_id", F.col("doc_id") % 2 == 0, {"text": F.translate("text", "\n", "")}, levels=levels, most=top).collect()
    want = plain_manifest(rows, tampered)
    columns = ["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((str(r["doc_id"]), *(r[c] for c in columns)) for r in got) == sorted((str(rows[k][0]), *v) for k, v in want.items())
    for r in got:
        assert manifest.fold(r["leaf"], r["lefts"], r["rights"]) == r["root"]


def test_manifest_of_odd_tables(spark):
    ddl = "doc_id long, source string, lang string, n_chars long, text string"
    never = F.lit(None).cast("boolean")
    assert manifest.manifest(spark.createDataFrame([], ddl), FIELDS, "source", "doc_id", never, {}).collect() == []
    one = manifest.manifest(spark.createDataFrame([(None, None, None, None, None)], ddl), FIELDS, "source", "doc_id", never, {}, with_proofs=False).collect()
    assert len(one) == 1 and one[0]["root"] == one[0]["leaf"] == h("-----") and one[0]["proof_sha256"] == h("") and one[0]["verified"]
    assert one[0].asDict().keys() == {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"}
