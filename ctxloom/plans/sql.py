"""SQL, for DuckDB, that says in its own words what the registered queries compute."""

from __future__ import annotations

from ctxloom.functions.text import BASELINE_STOPWORDS, LOWER, STOPWORDS, UPPER

FILES = """
files as (
  select doc_id, text, sha256(text) as blob,
         concat(source, '/', case when doc_id % 7 = 0 then 'tests/' else 'src/' end, 'doc_', doc_id,
                case lang when 'de' then '.c' when 'en' then '.py' when 'fr' then '.go' when 'es' then '.md' else '.txt' end) as path,
         case lang when 'de' then 1 when 'en' then 7 when 'fr' then 3 else 0 end as lang,
         case when doc_id % 7 = 0 then 'tests' else 'code' end as side
  from documents)"""
PLACED = FILES + """,
placed as (
  select blob, lang, sha256(concat_ws(chr(31), lang::varchar, symbol, content)) as chunk, symbol, content, n as start_line, n as end_line
  from (select blob, lang, n, content, regexp_extract(content, '^[^ ]*') as symbol
        from (select blob, lang, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as n
              from (select distinct blob, lang, text from files where lang > 0)) where trim(content) <> '')),
shown as (select blob, lang, side, path from files where lang > 0 and doc_id % 5 <> 4),
locs as (select p.chunk, s.side, s.path, p.start_line, p.end_line from placed p join shown s using (blob, lang)),
chunks as (select distinct chunk, symbol, content from placed)"""


def fold(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def words(x: str) -> str:
    return rf"list_filter(regexp_extract_all({x}, '[A-Za-z0-9_\x{{80}}-\x{{10FFFF}}]+'), lambda w: strlen(w) between 2 and 64)"


def parts(x: str) -> str:
    cut = rf"regexp_replace(regexp_replace({x}, '([A-Z])([A-Z][a-z0-9])', '\1_\2', 'g'), '([a-z0-9])([A-Z])', '\1_\2', 'g')"
    return f"list_filter(string_split({fold(cut)}, '_'), lambda p: strlen(p) >= 2)"


def emitted(x: str) -> str:
    return f"list_concat([{fold(x)}], case when len({parts(x)}) >= 2 then {parts(x)} else [] end)"


def names(ws: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(set(ws))) + ")"


ASKED = f"""
qwords as (select item_id as qid, unnest({words('text')}) as w from benchmark),
asked as (select distinct qid, t as term from (select qid, unnest({emitted('w')}) as t from qwords) where t not in {names(STOPWORDS)})"""


def bm25(name: str, key: str, columns: dict[str, float], source: str) -> str:
    """CTEs that end in name(qid, key, score)."""
    every = " union all ".join(f"select {key}, {w}::double as f, unnest({words(c)}) as w from {source}" for c, w in columns.items())
    return f"""
{name}_w as ({every}),
{name}_d as (select {key}, count(*) as d from {name}_w group by all),
{name}_n as (select (select count(*) from {source})::double as docs, (select sum(d) from {name}_d)::double as words),
{name}_h as (select {key}, term, sum(f) as f from (select {key}, f, unnest(list_distinct({emitted('w')})) as term from {name}_w)
            where term in (select term from asked) group by all),
{name}_i as (select term, greatest(ln((docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) as idf, any_value(words / docs) as mean from {name}_h, {name}_n group by term, docs),
{name} as (select qid, {key}, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / mean))), 6) as score
          from {name}_h join {name}_i using (term) join {name}_d using ({key}) join asked using (term) group by all)"""


CHUNK_BM25 = ASKED + "," + bm25("cs", "chunk", {"symbol": 2.0, "content": 1.0}, "chunks")
FILE_BM25 = """
whole as (select blob, lang, string_agg(content, chr(10)) as content from placed group by all),""" + bm25("fs", "blob, lang", {"content": 1.0}, "whole")


def lane(name: str, scores: str, k: int, item: str = "chunk") -> str:
    """The k best visible of each side, and files by first chunk."""
    return f"""
{name} as (select * from (select *, row_number() over (partition by qid, side order by score desc, {item}) as rank
          from {scores} join (select distinct chunk, side from locs) using (chunk)) where rank <= {k}),
{name}_f as (select qid, side, path, row_number() over (partition by qid, side order by f, path) as rank
            from (select qid, side, path, min(rank) as f from {name} join locs using (chunk, side) group by all))"""


def by_document(k: int) -> str:
    return f"""
doc_best as (select * from (select *, row_number() over (partition by qid, side order by score desc, blob, lang) as rank
            from fs join (select distinct blob, lang, side from shown) using (blob, lang)) where rank <= {k}),
doc_f as (select qid, side, path, row_number() over (partition by qid, side order by doc_best.rank, path) as rank from doc_best join shown using (blob, lang, side))"""


def fuse(lanes: list[tuple[str, list[str], float]], k: int) -> str:
    """CTEs ff(qid, side, path, score, rank) and fc(qid, side, chunk, score, rank)."""
    total = sum(w for _, _, w in lanes)
    f = " union all ".join(f"select qid, side, path, {w / len(fs)}::double / (60 + rank) as s from {x}" for _, fs, w in lanes for x in fs)
    c = " union all ".join(f"select qid, side, chunk, {w / total}::double / (60 + rank) as s, rank from {n}" for n, _, w in lanes)
    return f"""
ff as (select *, row_number() over (partition by qid, side order by score desc, path) as rank from (select qid, side, path, round(sum(s), 9) as score from ({f}) group by all)),
fc_t as (select qid, side, chunk, sum(s) as s, min(rank) as best from ({c}) group by all),
fc_p as (select t.qid, t.side, t.chunk, min(ff.rank) as fr from fc_t t join locs l using (chunk, side) join ff on ff.qid = t.qid and ff.side = t.side and ff.path = l.path group by all),
fc as (select qid, side, rank, chunk, score from (select *, row_number() over (partition by qid, side order by score desc, best, chunk) as rank
      from (select qid, side, chunk, best, round(s + coalesce(1.0::double / (60 + fr), 0), 9) as score from fc_t join fc_p using (qid, side, chunk))) where rank <= {k})"""


VECTOR = """
ve as (select row_number() over (order by vec_id) - 1 as spot, embedding, count(*) over () as n from embeddings),
vq as (select item_id as qid, embedding as q from benchmark join ve on spot = item_id % n),
vs0 as (select qid, spot, n, round(list_cosine_similarity(q::double[], embedding::double[]), 6) as score from vq, ve),
vs as (select qid, chunk, score from (select distinct chunk, ('0x' || substr(chunk, 1, 8))::bigint as h from placed) join vs0 on spot = h % n)"""

GREP = f"""
gt as (select distinct qid, t as term from (select item_id as qid, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as t from benchmark)
       where length(t) >= 4 and lower(t) not in {names(BASELINE_STOPWORDS)}),
gw as (select distinct path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) as term from files),
gh as (select * from gw where term in (select term from gt)),
gi as (select term, round(ln(1 + ((select count(*) from files) - count(*) + 0.5) / (count(*) + 0.5)), 9) as idf from gh group by term),
gk as (select qid, term, idf from (select *, row_number() over (partition by qid order by idf desc, term) as r from gt join gi using (term)) where r <= 20),
grep as (select qid, path, round(sum(idf), 6) as score from gh join gk using (term) group by all)"""
