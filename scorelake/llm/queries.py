"""Registered queries of the operators, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import bond, bpe, common, decontaminate, langid, mtree, pii, ppm, prefixtree, quality, simhash, tokencount, toxicity, wavelet
from scorelake.session import materialize, new_table_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


@query("op1_ppm_scores")
def ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.is_remainder("doc_id", 7, 2)
    found = ppm.scores(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_pii_anchors")
def pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_byte_bpe")
def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op5_decontaminate")
def decontaminate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op6_mtree_search")
def mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False))))


@query("op7_language")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs))
    held_out = common.is_remainder("doc_id", 5, 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "rejected")


@query("op8_wavelet_shards")
def wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "wavelet-shards")
    wavelet.write(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return wavelet.read_documents(spark, path)


@query("op9_simhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.grouped(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op10_quality")
def quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False)))
    model = quality.fit(docs, labels)
    held_out = common.is_remainder("doc_id", 5, 0).alias("held_out")
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    scored = quality.mark_top(materialize(quality.score(docs, model)), share=0.7)
    return scored.select("doc_id", held_out, "score", predicted, "raw", "selected")


@query("op11_toxicity")
def toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").where(F.coalesce(common.id_remainder("doc_id", 5) != 0, F.lit(False)))
    held_out = common.is_remainder("doc_id", 5, 0).alias("held_out")
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", held_out, "score", predicted)


@query("op12_bond_negatives")
def bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(vectors, label, F.col("vec_id") % 50 == 0)


@query("op13_prefix_tree")
def prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtree.tree(prefixtree.forked(prefixtree.turns(common.table(spark, sf_dir, "conversations"))))


ORACLES["op6_mtree_search"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     q as (select * from v where vec_id % 50 = 0),
     s as (select q.vec_id query_id, v.vec_id,
                  list_sum(list_transform(list_zip(q.v, v.v), lambda z: cast(z[1] as hugeint) * z[2])) score
           from q join v on q.vec_id <> v.vec_id and len(q.v) = len(v.v)),
     r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select cast(query_id as bigint) query_id, cast(rank as int) rank, cast(vec_id as bigint) vec_id, cast(score as bigint) score
from r where rank <= 5"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op5_decontaminate"] = f"""
with d as (select doc_id, {_WORDS} w from documents),
     b as (select cast(item_id as varchar) item, {_WORDS} w from benchmark),
     windows as (
       select distinct item, least(len(w), 10) n, array_to_string(list_slice(w, j, j + least(len(w), 10) - 1), ' ') k
       from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) j from b where len(w) > 0)),
     places as (
       select doc_id, n, pos, array_to_string(list_slice(w, pos, pos + n - 1), ' ') k
       from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) pos from d, (select distinct n from windows) where len(w) >= n)),
     found as (select doc_id, pos, windows.n, item from places join windows using (n, k)),
     hits as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(pos, pos + n)) p from found) group by doc_id),
     items as (
       select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, item from found)
       group by doc_id),
     doc_words as (select doc_id, unnest(w) word, unnest(range(0, len(w))) p from d),
     item_words as (select i, unnest(w) word, unnest(range(0, len(w))) q from (select row_number() over () i, w from b)),
     met as (select doc_id, i, p, p - q shift, p - row_number() over (partition by doc_id, i, p - q order by p) island
             from doc_words join item_words using (word)),
     matches as (select doc_id, min(p) s, count(*) n from met group by doc_id, i, shift, island
                 having count(*) >= (select min(least(len(w), 10)) from b where len(w) > 0)),
     longest as (select doc_id, max(n) longest, arg_min(s, (-n, s)) longest_at from matches group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(names, '')) items_sha256, n_hit is not null contaminated, cast(coalesce(longest, 0) as bigint) longest,
       cast(coalesce(longest_at, 0) as bigint) longest_at
from d left join hits using (doc_id) left join items using (doc_id) left join longest using (doc_id)"""

ORACLES["op12_bond_negatives"] = """
with v as (select cast(vec_id as bigint) id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label,
                  list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) v from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
     s as (select a.id a, b.id b, a.label = b.label same,
                  cast(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: cast(z[1] as hugeint) * z[2])), 0) as bigint) score
           from v a join v b on a.id % 50 = 0 and a.id <> b.id and len(a.v) = len(b.v)),
     p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
     n as (select p.a, p.b p, p.score p_score, s.b, s.score, row_number() over (partition by p.a, p.b order by s.score desc, s.b) rank
           from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a anchor_id, p positive_id, cast(rank as int) rank, b negative_id, p_score positive_score, score negative_score
from n where rank <= 3"""

# CRC-32 of the decimal id, bit by bit; paths as lists of digests; every node under each of its ancestors
ORACLES["op13_prefix_tree"] = r"""
with t as (select cast(conv_id as bigint) c, sha256(cast(length(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) d,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) n,
                  row_number() over (partition by conv_id order by turn nulls first, d) p from conversations where conv_id is not null),
     crc as (select c, xor(list_reduce(list_concat([cast(4294967295 as bigint)], list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
                    lambda a, b: list_reduce(list_concat([xor(a, b)], cast(range(8) as bigint[])),
                                             lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 h
             from (select distinct c from t)),
     parts as (select crc.c, 0 k, t.p, t.d, t.n from crc join t on t.c = crc.c - crc.c % 20 and t.p <= h
               union all select crc.c, 1, t.p, t.d, t.n from crc join t on t.c = crc.c and t.p > h),
     lists as (select c, list(d order by k, p) ds, list(n order by k, p) ns from parts group by c),
     paths as (select crc.c, coalesce(ds, []) ds, coalesce(ns, []) ns from crc left join lists on lists.c = crc.c),
     steps as (select c, unnest(range(0, len(ds) + 1)) depth, ds, ns from paths),
     nodes as (select array_to_string(list_slice(ds, 1, depth), ',') k, depth, min(c) conv_id, count(*) n_convs,
                      min(array_to_string(list_slice(ds, 1, depth - 1), ',')) up, min(case when depth = 0 then 0 else ns[depth] end) words,
                      arg_min(ds, c) ds,
                      sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where len(ds) = depth), '')) ends_sha256
               from steps group by 1, 2),
     kids as (select up, depth - 1 depth, count(*) n from nodes where depth > 0 group by 1, 2),
     full_nodes as (select nodes.*, coalesce(kids.n, 0) n_children from nodes left join kids on kids.up = nodes.k and kids.depth = nodes.depth),
     lines as (select n_children, n_convs, words, ds, depth, unnest(range(0, depth + 1)) a from full_nodes),
     sums as (select array_to_string(list_slice(ds, 1, a), ',') k, a depth, count(*) filter (where n_children = 0) n_leaves,
                     sum((n_convs - 1) * words) saved from lines group by 1, 2)
select x.conv_id, cast(x.depth as bigint) depth, y.conv_id parent_conv_id, x.n_convs, cast(x.n_children as bigint) n_children,
       cast(s.n_leaves as bigint) n_leaves, cast(s.saved as bigint) saved_tokens, x.ends_sha256
from full_nodes x join sums s on s.k = x.k and s.depth = x.depth
left join full_nodes y on x.depth > 0 and y.k = x.up and y.depth = x.depth - 1"""
