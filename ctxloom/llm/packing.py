"""Packing by optimal length buckets.

Texts become pieces of at most `window` tokens. The histogram of piece lengths, `window` entries at most whatever
the input, goes to the driver; dynamic programming over it picks `buckets` boundaries that pad least when every
piece is padded to its boundary. Inside a bucket, batches of a token budget take the pieces in an order shuffled by
md5, so only the last batch of a bucket is short: a global place is the offset of a shard (4096 shards a bucket)
plus the place within it.

A token is a run of non-space characters, or what `tokens` counts. Defined cases: null and empty texts have no pieces and
no rows. Repeated rows give repeated rows. Null ids are packed like others. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.llm.common import WORD, plain, stash


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Boundaries that minimise the padded size; ties go to the lower boundary before. lengths ascend."""
    m = len(lengths)
    if not m:
        return []
    below = np.cumsum(counts)
    cost, back = lengths * below, []
    for _ in range(min(buckets, m) - 1):
        # cost[a] + lengths[b] * (below[b] - below[a]) for a < b
        each = cost[:, None] + lengths[None, :] * (below[None, :] - below[:, None])
        each[np.tril_indices(m)] = np.iinfo(np.int64).max // 2
        each[cost >= np.iinfo(np.int64).max // 2] = np.iinfo(np.int64).max // 2
        back.append(each.argmin(axis=0))
        cost = each.min(axis=0)
    out, at = [m - 1], m - 1
    for step in reversed(back):
        at = int(step[at])
        out.append(at)
    return [int(lengths[i]) for i in reversed(out)]


def pack(docs: DataFrame, window: int = 2048, buckets: int = 8, budget: int = 16384, tokens: Column | None = None) -> DataFrame:
    """documents (doc_id, text) -> doc_id, piece, start_token, n_tokens, boundary, batch, slot.

    batch counts from 0 within a boundary; a batch holds budget // boundary pieces, and one where the boundary is over the budget."""
    n = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) if tokens is None else tokens
    sized = plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), n.cast("long").alias("n")).where("n > 0")
    last = F.ceil(F.col("n") / window) - 1
    pieces = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    start = F.col("piece") * window
    pieces = pieces.select("doc_id", "piece", start.alias("start_token"), F.least(F.lit(window), F.col("n") - start).cast("long").alias("n_tokens"))
    pieces = stash(pieces, "pieces")
    table = sorted((r[0], r[1]) for r in pieces.groupBy("n_tokens").count().collect())  # `window` rows at most
    ends = boundaries(np.array([x for x, _ in table], dtype=np.int64), np.array([c for _, c in table], dtype=np.int64), buckets)
    boundary = F.lit(None).cast("long")
    for end in reversed(ends):
        boundary = F.when(F.col("n_tokens") <= end, F.lit(end).cast("long")).otherwise(boundary)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("piece").cast("string")).cast("binary"))
    placed = pieces.withColumn("boundary", boundary).withColumn("_key", key).withColumn("_shard", F.substring("_key", 1, 3))
    sizes = placed.groupBy("boundary", "_shard").count()
    by = W.partitionBy("boundary").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("boundary", "_shard", F.coalesce(F.sum("count").over(by), F.lit(0)).alias("_offset"))  # 4096 rows a bucket at most
    own = W.partitionBy("boundary", "_shard").orderBy("_key", "doc_id", "piece", "n_tokens")
    placed = placed.withColumn("_at", F.row_number().over(own) - 1).join(F.broadcast(offsets), ["boundary", "_shard"])
    at, room = F.col("_at") + F.col("_offset"), F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1))
    return placed.select("doc_id", "piece", "start_token", "n_tokens", "boundary", F.floor(at / room).cast("long").alias("batch"), (at % room).cast("long").alias("slot"))


def pack_sql(window: int = 2048, buckets: int = 8, budget: int = 16384) -> str:
    """The same in SQL, the dynamic programming unrolled over the buckets."""
    steps = "".join(f"""
f{k} as (
  select h.l, min(f.cost + h.l * (h.below - p.below)) as cost,
         arg_min(list_append(f.path, h.l), (f.cost + h.l * (h.below - p.below)) * {2 * window} + f.l) as path
  from h join f{k - 1} f on f.l < h.l join h p on p.l = f.l group by h.l),""" for k in range(2, buckets + 1))
    return rf"""
with sized as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n from documents),
pieces as (
  select doc_id, piece, piece * {window} as start_token, least({window}, n - piece * {window}) as n_tokens
  from (select doc_id, n, unnest(generate_series(0, ((n + {window} - 1) // {window}) - 1)) as piece from sized where n > 0)),
h as (select l, sum(c) over (order by l)::bigint as below from (select n_tokens as l, count(*) as c from pieces group by 1)),
f1 as (select l, l * below as cost, [l] as path from h),{steps}
ends as (select unnest(path) as boundary from f{buckets} where l = (select max(l) from h)),
placed as (
  select p.*, (select min(boundary) from ends where boundary >= p.n_tokens) as boundary,
         md5(p.doc_id::varchar || ':' || p.piece::varchar) as k from pieces p),
numbered as (select *, row_number() over (partition by boundary order by k, doc_id, piece, n_tokens) - 1 as i from placed)
select doc_id, piece::bigint as piece, start_token::bigint as start_token, n_tokens::bigint as n_tokens, boundary::bigint as boundary,
       (i // ({budget} // boundary))::bigint as batch, (i % ({budget} // boundary))::bigint as slot from numbered
"""
