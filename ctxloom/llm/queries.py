"""The queries of the training-data operators, each over its whole table, and their SQL where SQL has the words for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctxloom.llm import conversations, lines, minhash, mixing, multi_index, negatives, packing, pii, quality, substrings, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_optimal_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"))


def op4_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op7_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_read(spark, sf_dir, "documents"))


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_read(spark, sf_dir, "documents"))


def op9_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(_read(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(_read(spark, sf_dir, "documents"), numbers=True)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(_read(spark, sf_dir, "embeddings"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_read(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_read(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_optimal_packing": op1_optimal_packing,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity_cnn": op4_toxicity_cnn,
    "op5_multi_index_dedup": op5_multi_index_dedup,
    "op6_attention_quality": op6_attention_quality,
    "op7_pivotal_mixing": op7_pivotal_mixing,
    "op8_pii_spans": op8_pii_spans,
    "op9_warc_reassembly": op9_warc_reassembly,
    "op10_fuzzy_line_dedup": op10_fuzzy_line_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL = {
    "op1_optimal_packing": packing.pack_sql(),
    "op2_minhash_near_dedup": rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select distinct doc_id, array_to_string(w[i:i + 4], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
both_ as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
near as (select x, y from both_ join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
edges as (select x, y from near union select y, x from near),
reach as (select x as doc_id, x as r from edges union select reach.doc_id, edges.y from reach join edges on edges.x = reach.r),
least_ as (select doc_id, min(r) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id) as component_id,
       d.doc_id = coalesce(component_id, d.doc_id) as kept
from documents d left join sizes on sizes.doc_id = d.doc_id left join least_ on least_.doc_id = d.doc_id
""",
    "op3_exact_topk": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings where vec_id is not null and len(embedding) = 64),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e, c.e)::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
""",
    "op5_multi_index_dedup": """
with recursive v as (select vec_id, embedding::double[64] as e from embeddings),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id where array_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select x as vec_id, y as r from links union select reach.vec_id, links.y from reach join links on links.x = reach.r),
n as (select x as vec_id, count(*) as n_links from links group by x),
c as (select vec_id, min(r) as component_id from reach group by vec_id)
select v.vec_id, coalesce(n_links, 0)::bigint as n_links, least(coalesce(component_id, v.vec_id), v.vec_id) as component_id,
       v.vec_id = least(coalesce(component_id, v.vec_id), v.vec_id) as kept
from v left join n on n.vec_id = v.vec_id left join c on c.vec_id = v.vec_id
""",
    "op9_warc_reassembly": """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n from pages),
k as (select page_id, n, sha1(h) as d, max(page_id) over (partition by h) as keep from p)
select page_id, n::bigint as payload_bytes, d as payload_digest,
       case when n >= 1000 and page_id < keep then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < keep then keep end as refers_to from k
""",
    "op11_hard_negatives": """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as l, list_transform(embedding, lambda x: floor(256 * x::double)) as e
           from embeddings where vec_id is not null and label is not null and embedding is not null),
s as (select a.vec_id as a, c.vec_id as c, a.l = c.l as same, list_inner_product(a.e, c.e)::bigint as score from v a join v c on a.vec_id <> c.vec_id where a.vec_id % 50 = 0),
p as (select a, c, score from (select *, row_number() over (partition by a order by score desc, c) as r from s where same) where r <= 5),
n as (select p.a, p.c as p, p.score as ps, s.c as n, s.score as ns, row_number() over (partition by p.a, p.c order by s.score desc, s.c) as r
      from p join s on s.a = p.a and not same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, p as positive_id, r::integer as rank, n as negative_id, ps as positive_score, ns as negative_score from n where r <= 3
""",
    "op12_substring_dedup": r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select r, w, unnest(generate_series(1, len(w) - 34)) as i from w where len(w) >= 35)),
twice as (select h from g group by h having count(*) > 1),
gone as (select distinct r, unnest(generate_series(i, i + 34)) as i from g join twice using (h)),
words as (select r, unnest(generate_series(1, len(w))) as i, unnest(w) as x from w),
kept as (select r, string_agg(x, ' ' order by i) as t from words anti join gone using (r, i) group by r),
n as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join kept using (r) left join n using (r)
""",
    "op13_conversation_repair": conversations.REPAIR_SQL,
}
