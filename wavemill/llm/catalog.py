"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, codes, decontaminate, jaccard, langid, linededup, lm, manifest, pii, quality, sharding, substring, topk
from .common import learn_side, table

WORD_BPE = "word_bpe_49k.json"
#: For results that can be compared only; whoever knows the key can rebuild the surrogates.
COMPARISON_KEY = "a key that is no secret"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), F.char_length("text").cast("long").alias("kept_chars"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs.select("doc_id", "text"), docs.where(learn_side("doc_id")))
    return out.select("doc_id", (~learn_side("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = quality.score(docs, docs.where(learn_side("doc_id")), labels.where(learn_side("doc_id")))
    return out.select("doc_id", (~learn_side("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), with_ids=False)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), key=COMPARISON_KEY)
    return out.select("doc_id", "text", "n_entities", "kinds")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return out.select("doc_id", "n_words", "n_removed", substring.kept_digest("kept_text").alias("kept_sha256"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shuffle_into_shards(table(spark, sf_dir, "documents"), shards=24)


def op11_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(False))
    out = lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), learn)
    return out.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "source", "doc_id", tampered, {"text": F.translate("text", "\n", "")}, with_proofs=False)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard, op2_linededup, op3_langid, op4_quality, op5_bpe, op6_decontaminate, op7_pii, op8_substring, op9_topk, op10_sharding, op11_lm, op12_codes, op13_manifest)}


#: The CRC-32 of a value's decimal text, bit by bit.
_CRC32 = """xor(4294967295, list_reduce(list_transform(range(0, 8 * length({0}::varchar)), lambda j: case when j % 8 = 0 then ascii(substr({0}::varchar, j // 8 + 1, 1))::bigint else 0 end),
                    lambda c, v: xor(xor(c, v) >> 1, case when xor(c, v) & 1 = 1 then 3988292384 else 0 end), 4294967295))"""


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar)::varchar || ':' || {f}::varchar, '-')" for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _codes_sql() -> str:
    """Rounds as common table expressions: c are codebook entries (p, j, v), a the nearest entries (i, p, j, d)."""
    near = """a{k} as materialized (select i, p, arg_min({{'j': j, 'd': d}}, {{'d': d, 'j': j}}) m from (
                select i, v.p, j, (list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x))::bigint d from v join c{k} c using (p)) group by i, p)"""
    step = """c{n} as materialized (select p, j, coalesce(m.x, c.x) x from c{k} c left join (
                select p, j, list(x order by q) x from (select p, a.m.j j, q, floor(sum(v.x[q]) / count(*)) x from v join a{k} a using (i, p), unnest(range(1, len(v.x) + 1)) t(q) group by all) group by p, j) m using (p, j))"""
    rounds = ",\n            ".join(f"{near.format(k=k)},\n            {step.format(k=k, n=k + 1)}" for k in range(4))
    return f"""
            with e as (select row_number() over (order by vec_id) i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) x from embeddings
                       where embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x::double))) = 0),
            v as materialized (select i, p, x[p * (len(x) // 4) + 1 : (p + 1) * (len(x) // 4)] x from e, unnest(range(0, 4)) t(p)),
            c0 as materialized (select p, i - 1 j, x from v where i <= 256),
            {rounds},
            {near.format(k=4)},
            o as (select i, string_agg(printf('%02x', m.j::int), '' order by p) code, sum(m.d)::bigint error from a4 group by i),
            h as (select sha256(string_agg(array_to_string(list_transform(x, lambda y: y::bigint), ','), ',' order by p, j)) s from c4)
            select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, s codebooks_sha256 from e join o using (i), h"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": r"""
            with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents),
            s as (select distinct doc_id, array_to_string(ws[i : i + least(3, len(ws)) - 1], ' ') g from w, unnest(range(1, len(ws) - least(3, len(ws)) + 2)) t(i) where len(ws) > 0),
            n as (select doc_id, count(*) n from s group by doc_id),
            p as (select a.doc_id a, b.doc_id b, count(*) x from s a join s b using (g) where a.doc_id < b.doc_id group by all),
            l as (select a, b from p join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * x >= 90 * (na.n + nb.n - x)),
            e as (select a, b from l union select b, a from l),
            r(doc_id, c) as (select doc_id, doc_id from w union select e.b, r.c from r join e on e.a = r.doc_id)
            select r.doc_id, coalesce(any_value(n.n), 0)::bigint n_shingles, min(c) component_id from r left join n using (doc_id) group by r.doc_id""",
        "op6_decontaminate": r"""
            with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
            b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark where item_id is not null),
            p as (select distinct item_id, least(10, len(ws)) n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') s
                  from b, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) t(i) where len(ws) > 0),
            x as (select doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') s from w, (select distinct n from p) k, unnest(range(1, len(ws) - n + 2)) t(i) where len(ws) >= n),
            h as (select doc_id, i, p.n, item_id from x join p using (n, s)),
            c as (select doc_id, count(distinct i + j) n_hit from h, unnest(range(0, n)) t(j) group by doc_id),
            m as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct doc_id, item_id::varchar item_id from h) group by doc_id)
            select w.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
                   sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
            from w left join c using (doc_id) left join m using (doc_id)""",
        "op8_substring": r"""
            with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
            x as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') s from w, unnest(range(1, len(ws) - 11)) t(i) where len(ws) >= 13),
            r as (select x.doc_id, i from x join (select s, min(doc_id) d from x group by s) m using (s) where m.d < x.doc_id),
            g as (select distinct doc_id, i + j k from r, unnest(range(0, 13)) t(j)),
            a as (select doc_id, list(k) ks from g group by doc_id),
            k as (select w.doc_id, len(ws) n, coalesce(len(ks), 0) n_removed,
                         case when ks is null then ws else list_filter(ws, lambda x, i: not list_contains(ks, i)) end kept
                  from w left join a using (doc_id))
            select doc_id, n::bigint n_words, n_removed::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k""",
        "op9_topk": """
            with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v from embeddings
                       where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
                         and len(list_filter(embedding, lambda x: not isfinite(x::double))) = 0),
            s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint score
                  from e q join e c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
            r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int "rank" from s)
            select query_id, "rank", vec_id, score from r where "rank" <= 5""",
        "op12_codes": _codes_sql(),
        "op13_manifest": r"""
            with recursive
            d as (select *, """ + _CRC32.format("doc_id") + """ % 2 = 0 crc32_even from documents),
            l as (select source, doc_id, row_number() over (partition by source order by doc_id nulls first) - 1 pos, count(*) over (partition by source) n,
                         """ + _leaf_sql("text") + """ leaf, case when crc32_even and text is not null then """ + _leaf_sql(r"replace(text, chr(10), '')") + r""" end changed from d),
            t as (select source, 0 lev, pos, n, leaf h from l
                  union all select source, lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by source, lev, pos // 3, n),
            s as (select source, h subroot, lev top, row_number() over (order by source nulls first) - 1 pos, count(*) over () n from t where n = 1),
            u as (select 0 lev, pos, n, subroot h from s
                  union all select lev + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' order by pos)) from u where n > 1 group by lev, pos // 3, n),
            pairs as (select a.source, a.lev, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') lo, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') hi
                      from t a join t b on a.source is not distinct from b.source and a.lev = b.lev and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
            tops as (select a.lev, a.pos, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos < a.pos), '') lo, coalesce(string_agg(b.h, '' order by b.pos) filter (where b.pos > a.pos), '') hi
                     from u a join u b on a.lev = b.lev and a.pos // 3 = b.pos // 3 where a.n > 1 group by all),
            steps as (select l.source, l.pos, p.lev k, lo, hi from l join pairs p on l.source is not distinct from p.source and l.pos // (3 ** p.lev)::bigint = p.pos
                      union all select l.source, l.pos, s.top + q.lev, lo, hi from l join s on l.source is not distinct from s.source join tops q on s.pos // (3 ** q.lev)::bigint = q.pos),
            proofs as (select source, pos, string_agg(lo || hi, '' order by k) proof, max(k) last from steps group by source, pos),
            f as (select source, pos, coalesce(changed, leaf) h, 0 k from l
                  union all select f.source, f.pos, sha256(lo || h || hi), f.k + 1 from f join steps x on f.source is not distinct from x.source and f.pos = x.pos and f.k = x.k)
            select l.doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) proof_sha256, f.h folded_root, f.h = root verified
            from l join s on l.source is not distinct from s.source cross join (select h root from u where n = 1) top
            left join proofs p on l.source is not distinct from p.source and l.pos = p.pos
            join f on l.source is not distinct from f.source and l.pos = f.pos and f.k = coalesce(p.last + 1, 0)""",
    }
