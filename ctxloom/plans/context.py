"""Queries of context assembly and of function-level evaluation, with the SQL that gives the same rows.

Documents stand in for source code too: every line is the comment of a function of its own (corpus.code_of), so that tags,
diffs and functions have known places. Every fiftieth document is a change: its diff touches some of its functions, and words of two of
its lines ask for it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxloom.functions import diffs
from ctxloom.functions.text import BASELINE_STOPWORDS
from ctxloom.operators import corpus, curate, evaluate, lexical, playbook, truth
from ctxloom.operators.lexical import ranked
from ctxloom.operators.written import written
from ctxloom.plans import sql
from ctxloom.plans.catalogue import LEX_ROUTE, LEXICAL, asked, corpus_of, query, route, table
from ctxloom.streaming import requests

BUDGET, ANSWER = 400, 50


# --- budget and merging ---------------------------------------------------------------------------


def fold_sql(items: str, tokens: int, name: str = "fold") -> str:
    """CTEs that end in name(qid, item, rank, level, cost, spent) from items (qid, item, rank, full_, signature, summary, reference)."""
    left = "f.left_ - i.later"
    pick = lambda use: " ".join(["case", *[f"when i.{c} <= {left} then {v}" for c, v in use], "else"])
    level = pick([("full_", "'full'"), ("signature", "'signature'"), ("summary", "'summary'")]) + " 'reference' end"
    cost = pick([("full_", "i.full_"), ("signature", "i.signature"), ("summary", "i.summary")]) + " i.reference end"
    return f"""
{name}_i as materialized (select *, row_number() over (partition by qid order by rank) as n,
  coalesce(sum(reference) over (partition by qid order by rank rows between 1 following and unbounded following), 0) as later from ({items})),
{name}_r as (select distinct qid, 0::bigint as n, ''::varchar as item, 0::bigint as rank, {tokens}::bigint as left_, ''::varchar as level, 0::bigint as cost from {name}_i
  union all select i.qid, i.n, i.item, i.rank, (f.left_ - {cost})::bigint, {level}, ({cost})::bigint from {name}_r f join {name}_i i on i.qid = f.qid and i.n = f.n + 1),
{name} as (select qid, item, rank, level, cost, {tokens} - left_ as spent from {name}_r where n > 0)"""


def priced_sql(source: str) -> str:
    head = r"regexp_extract(content, '(?s)\A(.{0,600}?)(?:[ \t]*\{|:[ \t]*(?:\n|\z))', 1)"
    signature = rf"left(case when {head} <> '' then {head} else regexp_extract(content, '\A[^\n]*') end, {curate.SIGNATURE_BYTES})"
    cost = lambda x: f"ceil(strlen({x}) / 3.0)::bigint"
    return f"select qid, item, rank, {cost('content')} as full_, {cost(signature)} as signature, {cost('summary')} as summary, {cost('place')} as reference from ({source})"


CONVERSED = """select conv_id as qid, concat(conv_id, '-', turn) as item, turn as rank, text as content, concat('conversations/', conv_id, ':', turn) as place,
  case when role = 'system' then left(text, 60) end as summary from conversations"""


@query("budget_assembly", f"with recursive {fold_sql(priced_sql(CONVERSED), BUDGET)} select * from fold")
def budget_assembly(spark, d):
    """The turns of a conversation as one answer; system turns have a summary."""
    t = table(spark, d, "conversations")
    items = t.select(F.col("conv_id").alias("qid"), F.concat("conv_id", F.lit("-"), "turn").alias("item"), F.col("turn").alias("rank"), F.col("text").alias("content"),
                     F.concat(F.lit("conversations/"), "conv_id", F.lit(":"), "turn").alias("place"), F.when(F.col("role") == "system", F.left("text", F.lit(60))).alias("summary"))
    return curate.assembled(curate.priced(items), BUDGET)


def answer_items(spark, d):
    """What a query's answer would show: its best whole files and its best chunks in turn, with their first places on any branch."""
    c, q = corpus_of(spark, d).written(), asked(spark, d)
    whole = ranked(lexical.file_scores(c.placed, q, ANSWER), ["qid"], F.desc("score"), "blob", "lang", k=ANSWER)
    paths = c.files.groupBy("blob", "lang").agg(F.min(F.struct("path", "text")).alias("f"))
    whole = whole.join(paths, ["blob", "lang"]).select("qid", F.concat("blob", F.lit(":"), "lang").alias("item"), (F.col("rank") * 2 - 1).alias("rank"), F.col("f.path").alias("path"),
                                                       F.lit(1).alias("start"), F.size(F.split("f.text", "\n", -1)).alias("stop"), F.col("f.text").alias("content"))
    best = ranked(lexical.chunk_scores(c.placed.select("chunk", "symbol", "content"), q, ANSWER), ["qid"], F.desc("score"), "chunk", k=ANSWER)
    places = c.placed.join(c.files.select("blob", "lang", "path"), ["blob", "lang"])
    places = places.join(best.select("chunk").distinct(), "chunk").groupBy("chunk").agg(F.min(F.struct("path", "start_line", "end_line", "content")).alias("p"))
    best = best.join(places, "chunk").select("qid", F.col("chunk").alias("item"), (F.col("rank") * 2).alias("rank"), F.col("p.path").alias("path"),
                                             F.col("p.start_line").alias("start"), F.col("p.end_line").alias("stop"), F.col("p.content").alias("content"))
    return written(whole.unionByName(best), "answers")


ITEMS = f"""
wf as (select * from (select *, row_number() over (partition by qid order by score desc, blob, lang) as rank from fs) where rank <= {ANSWER}),
wp as (select blob, lang, min(path) as path, any_value(text) as content from files group by all),
cf as (select * from (select *, row_number() over (partition by qid order by score desc, chunk) as rank from cs) where rank <= {ANSWER}),
cp as (select chunk, min(struct_pack(path := path, line := start_line, content := content)) as p from placed join files using (blob, lang) group by chunk),
items as materialized (select qid, concat(blob, ':', lang) as item, 2 * rank - 1 as rank, path, 1 as start, len(string_split(content, chr(10))) as stop, content from wf join wp using (blob, lang)
  union all select qid, chunk, 2 * rank, p.path, p.line, p.line, p.content from cf join cp using (chunk))"""
MERGE = rf"""
mi as (select *, max(stop) over w as prior from items window w as (partition by qid, path order by start, stop desc, rank rows between unbounded preceding and 1 preceding)),
mo as (select *, case when prior >= stop then last_value(case when prior is null or prior < stop then item end ignore nulls) over (partition by qid, path order by start, stop desc, rank
       rows between unbounded preceding and 1 preceding) end as within_ from mi),
mb as (select qid, coalesce(within_, item) as item, min(rank) as rank from mo group by all),
mw as (select item, regexp_extract_all(lower(any_value(content)), '[^\x20\x09-\x0D]+') as w from mo where within_ is null group by item),
mz as materialized (select item, case when len(w) = 0 then [] else list_distinct(list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:])[:greatest(len(w) - 4, 1)], lambda x: concat_ws(' ', x[1], x[2], x[3], x[4], x[5]))) end as s from mw),
ms as materialized (select mb.qid, item, mb.rank, row_number() over (partition by mb.qid order by mb.rank) as n, s from mb join mo using (qid, item) join mz using (item) where within_ is null),
mq as materialized (select distinct a.item as x, b.item as y from ms a join ms b using (qid) where a.n < b.n and len(a.s) > 0 and len(b.s) > 0 and 100 * least(len(a.s), len(b.s)) >= 75 * greatest(len(a.s), len(b.s))),
me as materialized (select x, y from (select x, y, a.s as s, b.s as t, len(list_intersect(a.s, b.s)) as c from mq join mz a on a.item = x join mz b on b.item = y) where 100 * c >= 75 * (len(s) + len(t) - c)),
mn as materialized (select qid, b.n, list(a.n order by a.n) as better from ms a join ms b using (qid) join me on x = a.item and y = b.item where a.n < b.n group by all),
mk as (select qid, 0::bigint as n, []::bigint[] as kept from (select distinct qid from ms)
       union all select k.qid, k.n + 1, case when list_has_any(coalesce(better, []), kept) then kept else list_append(kept, k.n + 1) end
       from mk k join ms on ms.qid = k.qid and ms.n = k.n + 1 left join mn on mn.qid = k.qid and mn.n = k.n + 1),
md as (select ms.qid, ms.item, ms.rank, list_contains(kept, ms.n) as shown, list_min(list_intersect(coalesce(better, []), kept)) as into_n
       from ms join mk on mk.qid = ms.qid and mk.n = ms.n left join mn on mn.qid = ms.qid and mn.n = ms.n),
merged as (select md.qid, md.item, md.rank, md.shown, case when not md.shown then 'copy' end as why, o.item as "into" from md left join ms o on o.qid = md.qid and o.n = md.into_n
       union all select qid, item, rank, false, 'inside', within_ from mo where within_ is not null)"""
MERGING = LEXICAL.replace("with ", "with recursive ", 1) + f",{ITEMS},{MERGE}"


@query("context_merge", f"{MERGING} select * from merged")
def context_merge(spark, d):
    return curate.merged(answer_items(spark, d))


PACKED = """select qid, item, merged.rank as rank, content, concat(path, ':', start) as place, null::varchar as summary from merged join items using (qid, item) where shown"""


@query("context_pack", f"{MERGING},{fold_sql(priced_sql(PACKED), 2000)} select * from fold")
def context_pack(spark, d):
    """An answer as it is served: merged, then cut to a budget by lowering what comes late."""
    items = answer_items(spark, d)
    shown = curate.merged(items).where("shown").select("qid", "item", "rank")
    once = items.groupBy("qid", "item").agg(F.min(F.struct("rank", "path", "start", "content")).alias("r"))
    rows = shown.join(once, ["qid", "item"]).select("qid", "item", "rank", F.col("r.content").alias("content"), F.concat("r.path", F.lit(":"), "r.start").alias("place"), F.lit(None).cast("string").alias("summary"))
    return curate.assembled(curate.priced(rows), 2000)


REPLIES = f"""{LEX_ROUTE},
told as (select qid, string_agg(concat(side, ':', rank, ':', left(chunk, 12)), ' ' order by side, rank) as t from fc where rank <= 3 group by qid),
calls as (select concat('{{{{"jsonrpc":"2.0","id":', item_id, ',"result":{{{{"content":[{{{{"type":"text","text":"', coalesce(t, 'KeyError: no answer'), '"}}}}],"isError":', t is null, '}}}}}}}}') as reply from benchmark left join told on qid = item_id),
turns as (select case when conv_id % 17 = 0 then '{{{{"jsonrpc":"2.0","id":null,"error":{{{{"code":-32700,"message":"parse error"}}}}}}}}'
  when role = 'user' then concat('{{{{"jsonrpc":"2.0","id":"', conv_id, '-', turn, '","result":{{{{"content":[{{{{"type":"text","text":"ValueError: unknown tool None"}}}}],"isError":true}}}}}}}}')
  when turn % 2 = 0 then concat('{{{{"jsonrpc":"2.0","id":"', conv_id, '-', turn, '","result":{{{{}}}}}}}}') end as reply from conversations)
select reply, count(*) as n from (select reply from calls union all select reply from turns where reply is not null) group by reply""".replace("{{", "{").replace("}}", "}")


@query("request_replies", REPLIES)
def request_replies(spark, d):
    """A call for each benchmark item, answered by the lexical route, among the requests that conversations stand for."""
    calls = table(spark, d, "benchmark").select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("item_id").alias("id"), F.lit("tools/call").alias("method"),
                                                F.struct(F.lit(requests.TOOL).alias("name"), F.struct(F.col("text").alias("query")).alias("arguments")).alias("params"))).alias("value"))

    def answers(queries):
        best = route(spark, d, "lexical")[3].where("rank <= 3").select(F.col("qid").alias("item"), "side", "rank", "chunk")
        said = best.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("side", "rank", "chunk"))).alias("c"))  # six at most
        said = said.select("item", F.array_join(F.transform("c", lambda x: F.concat(x["side"], F.lit(":"), x["rank"], F.lit(":"), F.left(x["chunk"], F.lit(12)))), " ").alias("text"))
        known = table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.xxhash64("text").alias("qid")).join(said, "item")
        return known.groupBy("qid").agg(F.min(F.struct("item", "text")).alias("s")).select("qid", "s.text")

    lines = calls.unionByName(requests.as_requests(table(spark, d, "conversations")))
    return requests.replies(lines, answers).groupBy("reply").agg(F.count("*").alias("n"))


# --- playbook and sessions ---------------------------------------------------------------------------

#: The test vectors' cosines stay under 0.61, so the query's threshold is lower than the operator's.
ALIKE = 0.4


@query("playbook_merge", f"""
with recursive b as (select concat('b', vec_id) as id, concat('bullet ', vec_id) as content, label::bigint as helpful, (vec_id % 3)::bigint as harmful, embedding::double[] as v from embeddings where vec_id % 5 <> 0),
n as (select sha256(concat('lesson ', vec_id)) as id, label::bigint as helpful, (vec_id % 2)::bigint as harmful, embedding::double[] as v, concat('r', vec_id % 4) as ref from embeddings where vec_id % 5 = 0),
near as (select id, bullet from (select n.id, b.id as bullet, row_number() over (partition by n.id order by round(list_cosine_similarity(n.v, b.v), 6) desc, b.id) as r from n, b where round(list_cosine_similarity(n.v, b.v), 6) >= {ALIKE}) where r = 1),
l as (select *, row_number() over (order by id) as k from n anti join near using (id)),
p as (select y.k, list(x.k order by x.k) as less from l x, l y where x.k < y.k and round(list_cosine_similarity(x.v, y.v), 6) >= {ALIKE} group by y.k),
f as (select 0::bigint as k, 0::bigint as leader, []::bigint[] as leads union all
  select f.k + 1, coalesce(list_min(list_intersect(coalesce(less, []), leads)), f.k + 1), case when list_has_any(coalesce(less, []), leads) then leads else list_append(leads, f.k + 1) end
  from f left join p on p.k = f.k + 1 where f.k < (select count(*) from l)),
added as (select m.id, sum(l.helpful)::bigint as helpful, sum(l.harmful)::bigint as harmful, string_agg(distinct l.ref, ',' order by l.ref) as refs from f join l using (k) join l m on m.k = f.leader group by m.id),
more as (select id, sum(helpful)::bigint as h, sum(harmful)::bigint as x, string_agg(distinct ref, ',' order by ref) as r from (
  select bullet as id, helpful, harmful, ref from near join n using (id) union all select concat('b', vec_id), 1, 0, 'named' from embeddings where vec_id % 5 <> 0 and vec_id % 7 = 0) group by id)
select id, helpful + coalesce(h, 0) as helpful, harmful + coalesce(x, 0) as harmful, coalesce(r, '') as refs, case when h is null then 'kept' else 'counted' end as change from b left join more using (id)
union all select id, helpful, harmful, refs, 'appended' from added""")
def playbook_merge(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("v"), F.col("label").cast("long").alias("helpful"))
    none = F.array().cast("array<string>")
    say = lambda word: F.concat(F.lit(word), F.col("vec_id").cast("string"))
    bullets = e.where("vec_id % 5 <> 0").select(say("b").alias("id"), say("bullet ").alias("content"), "helpful", (F.col("vec_id") % 3).alias("harmful"), "v", none.alias("refs"))
    named = e.where("vec_id % 5 <> 0 and vec_id % 7 = 0").select(say("b").alias("id"), F.lit("").alias("content"), F.lit(1).cast("long").alias("helpful"), F.lit(0).cast("long").alias("harmful"), "v", F.array(F.lit("named")).alias("refs"))
    fresh = e.where("vec_id % 5 = 0").select(F.lit(None).cast("string").alias("id"), say("lesson ").alias("content"), "helpful", (F.col("vec_id") % 2).alias("harmful"), "v", F.array(F.concat(F.lit("r"), (F.col("vec_id") % 4).cast("string"))).alias("refs"))
    out = playbook.merged(bullets, named.unionByName(fresh), ALIKE)
    return out.select("id", "helpful", "harmful", F.array_join("refs", ",").alias("refs"), "change")


@query("session_replacement", """
with h as (select user_id as session, event_id as step, concat(event_type, '-', event_id % 7) as chunk from events),
l as (select concat(event_type, '-', event_id % 7) as chunk, min(concat('about ', event_type)) as lesson from events where event_id % 7 < 3 group by all)
select session, step, chunk, case when step = first then 'full' when lesson is null then 'reference' else 'lesson' end as form, case when step > first then lesson end as lesson
from (select *, min(step) over (partition by session, chunk) as first from h) left join l using (chunk)""")
def session_replacement(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("step"), F.concat("event_type", F.lit("-"), F.col("event_id") % 7).alias("chunk"), "event_type")
    lessons = e.where(F.col("step") % 7 < 3).select("chunk", F.concat(F.lit("about "), "event_type").alias("content"))
    return playbook.shown(e.select("session", "step", "chunk"), lessons)


# --- functions --------------------------------------------------------------------------------------

#: Each line of a document as a function: where it stands, what it is called, and how the code reads.
CODE = rf"""{sql.FILES},
fl as (select doc_id, path, lang, unnest(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x00-\x1F\x7F\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g'))) as line,
       generate_subscripts(string_split(text, chr(10)), 1) as i from files where lang > 0),
fn as materialized (select doc_id, path, lang, i, line, case lang when 7 then 3 * i - 1 when 1 then 4 * i - 3 else 4 * i - 2 end as start, case lang when 7 then 3 * i + 1 when 1 then 4 * i else 4 * i + 1 end as stop,
       concat(path, '::', case lang when 7 then concat('Doc', doc_id, '::f', i) when 1 then concat('f', i) else concat('docs::Doc', doc_id, '::F', i) end) as name,
       case lang when 7 then concat('    def f', i, '(self):', chr(10), '        # ', line, chr(10), '        return ', i)
                 when 1 then concat('int f', i, '(int x) {{', chr(10), '    // ', line, chr(10), '    return ', i, ';', chr(10), '}}')
                 else concat('func (t *Doc', doc_id, ') F', i, '() int {{', chr(10), chr(9), '// ', line, chr(10), chr(9), 'return ', i, chr(10), '}}') end as code from fl)"""


def code_files(spark, d):
    return corpus.code_of(table(spark, d, "documents"))


@query("symbol_scan", f"with {CODE} select path, start::integer as start, stop::integer as stop, name, ceil(strlen(code) / 3.0)::bigint as tokens from fn")
def symbol_scan(spark, d):
    """Every function of the code with its exact extent, by the chunker."""
    return written(truth.tags(code_files(spark, d)), "tags")


EVERY = 50


def changes(spark, d):
    """(qid, query, diff): every fiftieth document. Its diff touches every third function, inserts a line, adds a file, removes one, and touches line 1."""
    files = table(spark, d, "documents").where(F.col("doc_id") % EVERY == 0).select("doc_id", "text").join(code_files(spark, d).select("doc_id", "path", "lang"), "doc_id")
    lines = F.split("text", "\n", -1)
    start = lambda i: F.when(F.col("lang") == 7, i * 3 - 1).when(F.col("lang") == 1, i * 4 - 3).otherwise(i * 4 - 2)
    touched = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: i % 3 == 1)
    one = F.transform(touched, lambda i: F.concat(F.lit("@@ -"), (start(i) + 1).cast("string"), F.when(i % 2 == 0, F.lit(",2")).otherwise(F.lit("")), F.lit(" +"), (start(i) + 1).cast("string"), F.lit(" @@\n---- a/old\n+new\n")))
    name = lambda mark: F.concat(F.lit(mark), "path", F.lit("\n"))
    new = F.concat(F.lit("src/new_"), F.col("doc_id").cast("string"), F.lit(".py"))
    parts = [F.lit("diff --git a/x b/x\nindex 1..2 100644\n"), name("--- a/"), name("+++ b/"), F.lit("@@ -1 +1 @@\n-a\n+b\n@@ -2,0 +3,2 @@\n+c\n+d\n"), F.array_join(one, ""),
             F.lit("diff --git a/x b/x\nnew file mode 100644\n--- /dev/null\n+++ b/"), new, F.lit("\n@@ -0,0 +1,2 @@\n+a\n+b\n"),
             F.lit("diff --git a/x b/x\ndeleted file mode 100644\n--- a/old/gone.go\n+++ /dev/null\n@@ -1,9 +0,0 @@\n-a\n")]
    asks = F.concat_ws(" ", F.get(lines, F.lit(0)), F.get(lines, F.lit(3)))
    return files.select(F.col("doc_id").alias("qid"), asks.alias("query"), F.concat(*parts).alias("diff"))


TOUCHED = f"""{CODE},
dl as (select fn.doc_id as qid, path, start + 1 as line from fn where doc_id % {EVERY} = 0 and i % 3 = 1
  union all select doc_id, path, start + 2 from fn where doc_id % {EVERY} = 0 and i % 3 = 1 and i % 2 = 0
  union all select distinct doc_id, path, 1 from fn where doc_id % {EVERY} = 0),
do_ as (select qid, fn.name, count(distinct dl.line) as n from dl join fn on fn.path = dl.path and dl.line between fn.start and fn.stop group by all),
dp as (select distinct doc_id as qid, path, lang from fn where doc_id % {EVERY} = 0),
truth as (select qid, 'function' as kind, name as item, n from do_
  union all select qid, 'file', path, 1 from dp union all select qid, 'file', 'old/gone.go', 1 from dp
  union all select qid, 'added', concat('src/new_', qid, '.py'), 1 from dp
  union all select qid, 'outside', path, 1 from dp where lang in (7, 3))"""


@query("function_truth", f"with {TOUCHED} select * from truth")
def function_truth(spark, d, tags=None):
    return truth.changed(diffs.files_of(changes(spark, d).select("qid", "diff")), symbol_scan(spark, d) if tags is None else tags)


QUESTIONS = f"""
fq as (select doc_id as qid, concat_ws(' ', l[1], l[4]) as query from (select doc_id, string_split(text, chr(10)) as l from files where lang > 0 and doc_id % {EVERY} = 0)),
fi as (select qid, unnest(regexp_extract_all(query, '{truth.IDENTIFIER}')) as w from fq),
ft as (select distinct qid, t as term from (
  select qid, unnest(list_concat([lower(w)], case when len(p) > 1 then list_transform(p, lambda x: lower(x)) else [] end)) as t
  from (select qid, w, list_filter(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]+[a-z0-9]*|[a-z0-9]+'), lambda x: x <> '_') as p from fi))
  where length(t) >= 2 and t not in {sql.names(BASELINE_STOPWORDS)}),
fg as (select distinct qid, lower(w) as term from fi where length(w) >= 4 and lower(w) not in {sql.names(BASELINE_STOPWORDS)}),
fw as materialized (select path, name, term, count(*) as n from (
  select path, name, lower(unnest(regexp_extract_all(code, '{truth.IDENTIFIER}'))) as term from fn
  union all select path, null, lower(unnest(regexp_extract_all(case lang when 7 then concat('class Doc', doc_id) else 'package docs' end, '{truth.IDENTIFIER}'))) from (select distinct path, doc_id, lang from fn where lang in (7, 3))) group by all),
fd as (select term, round(ln(1 + ((select count(*) from files where lang > 0) - count(distinct path) + 0.5) / (count(distinct path) + 0.5)), 9) as idf from fw
       where term in (select term from ft union all select term from fg) group by term)"""
FUNC_BM25 = f"""{QUESTIONS},
fb_l as (select path, name, sum(n) as dl from fw where name is not null group by all),
fb_c as (select distinct qid, path from fw join ft using (term)),
fb_m as (select qid, greatest(1, avg(dl)) as mean from fb_c join fb_l using (path) group by qid),
fb as (select qid, name, round(sum(idf * n * 1.9 / (n + 0.9 * (0.6 + 0.4 * dl / mean))), 6) as score
       from fw join ft using (term) join fd using (term) join fb_l using (path, name) join fb_m using (qid) group by all),
fr as (select * from (select *, row_number() over (partition by qid order by score desc, name) as rank from fb) where rank <= 50)"""


def ranked_functions(spark, d, scores, tags=None):
    tags = symbol_scan(spark, d) if tags is None else tags
    return ranked(scores(code_files(spark, d).select("path", "text"), tags, changes(spark, d).select("qid", "query"), 50), ["qid"], F.desc("score"), "name", k=50)


@query("function_bm25_baseline", f"with {CODE},{FUNC_BM25} select * from fr")
def function_bm25_baseline(spark, d):
    return ranked_functions(spark, d, truth.bm25_functions)


@query("function_grep_baseline", f"""with {CODE},{QUESTIONS},
gk as (select qid, term, idf from (select *, row_number() over (partition by qid order by idf desc, term) as r from fg join fd using (term)) where r <= 20),
gs as (select qid, name, round(sum(idf), 6) as score from (select distinct qid, name, term, idf from fw join gk using (term) where name is not null) group by all)
select * from (select *, row_number() over (partition by qid order by score desc, name) as rank from gs) where rank <= 50""")
def function_grep_baseline(spark, d):
    return ranked_functions(spark, d, truth.grep_functions)


def function_truths(spark, d, tags):
    return function_truth(spark, d, tags).where("kind = 'function'").select("qid", "item")


KS = (5, 10, 50)
FUNC_METRICS = f"""with {TOUCHED},{FUNC_BM25},
tz as (select qid, count(*) as size from truth where kind = 'function' group by qid),
th as (select fr.qid, rank from fr join truth on truth.qid = fr.qid and truth.item = fr.name and kind = 'function'),
pq as (select tz.qid, {", ".join(f"round(count(*) filter (rank <= {k}) / any_value(size)::double, 6) as recall_{k}, (count(*) filter (rank <= {k}) = any_value(size))::integer::double as acc_{k}" for k in KS)},
  round(coalesce(1.0::double / min(rank), 0), 6) as mrr,
  round(coalesce(sum(case when rank <= 10 then 1 / log2(rank + 1) end), 0) / any_value(list_sum(list_transform(range(1, least(size, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) as ndcg_10
  from tz left join th using (qid) group by tz.qid)"""
FUNC_MACRO = " union all ".join(f"select '{m}' as metric, round(avg({m}), 6) as mean, count({m}) as n from pq" for m in [*(f"recall_{k}" for k in KS), *(f"acc_{k}" for k in KS), "mrr", "ndcg_10"])


@query("function_metrics", f"{FUNC_METRICS} {FUNC_MACRO}")
def function_metrics(spark, d):
    tags = symbol_scan(spark, d)  # written once for both sides
    found = ranked_functions(spark, d, truth.bm25_functions, tags).select("qid", F.col("name").alias("item"), "rank")
    return evaluate.macro(evaluate.per_query(written(found, "found"), function_truths(spark, d, tags), KS))


CURVE_BUDGETS = (40, 80, 160, 320)


@query("budget_curve", f"""with {TOUCHED},{FUNC_BM25},
tz as (select qid, count(*) as size from truth where kind = 'function' group by qid),
cu as (select fr.qid, fr.name, fr.rank, sum(ceil(strlen(code) / 3.0)) over (partition by fr.qid order by fr.rank) as upto from fr join fn using (name) where rank <= 10),
ch as (select cu.qid, upto from cu join truth on truth.qid = cu.qid and truth.item = cu.name and kind = 'function'),
cb as (select unnest([{", ".join(map(str, CURVE_BUDGETS))}, null])::bigint as budget),
cr as (select budget, round(avg(hits / size::double), 6) as recall from (select budget, tz.qid, any_value(size) as size, count(upto) filter (budget is null or upto <= budget) as hits
       from tz cross join cb left join ch using (qid) group by budget, tz.qid) group by budget)
select coalesce(budget, -1) as budget, recall, coalesce(budget, 9223372036854775807) = (select min(coalesce(budget, 9223372036854775807)) from cr where recall >= round((select recall from cr where budget is null) - 0.02, 6)) as "least" from cr""")
def budget_curve(spark, d):
    tags = symbol_scan(spark, d)  # written once for both sides
    found = written(ranked_functions(spark, d, truth.bm25_functions, tags), "found")
    found = found.join(tags.select("name", "tokens"), "name").select("qid", F.col("name").alias("item"), "rank", "tokens")
    return truth.budget_curve(found, function_truths(spark, d, tags), budgets=CURVE_BUDGETS)
