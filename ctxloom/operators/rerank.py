"""Reranking of each side's best chunks by a scorer, and what follows for the files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.functions.names import embed_text, rrf
from ctxloom.functions.text import document_tokens, query_terms
from ctxloom.operators.lexical import ranked


def overlap_score(terms: Column, document: Column) -> Column:
    """The offline scorer: the share of the query's terms that the document has."""
    return F.round(F.size(F.array_intersect(terms, document_tokens(document))) / F.greatest(F.size(terms), F.lit(1)), 6)


def rerank(chunks: DataFrame, queries: DataFrame, texts: DataFrame, pool: int = 50, max_bytes: int = 16384, fuse: bool = False,
           sides: tuple[str, ...] = ("code", "tests"), scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """(qid, side, chunk, rank, score) -> the same chunks in a new order. Below the pool, scores descend from its worst.

    One pass: a chunk of the pool gets its score beside the row, and windows of a query's side do the rest."""
    asked = queries.select("qid", query_terms(F.col("query")).alias("terms"))  # once a query
    inside = (F.col("rank") <= pool) & F.col("side").isin(*sides)
    rows = chunks.select("qid", "side", "chunk", "rank", "score").join(texts, "chunk").join(asked, "qid")
    rows = rows.select("qid", "side", "chunk", F.col("rank").alias("old"), F.col("score").alias("fused"), inside.alias("inside"),
                       F.when(inside, scorer(F.col("terms"), embed_text(F.col("symbol"), F.col("content"), max_bytes))).alias("s"))
    by = W.partitionBy("qid", "side")
    order = lambda c: by.orderBy(F.when(F.col("inside"), 0).otherwise(1), F.desc(c), "old")
    rows = rows.withColumn("rank", F.row_number().over(order("s")))
    if fuse:
        rows = rows.withColumn("s", F.when(F.col("inside"), F.round(rrf(F.col("old")) + rrf(F.col("rank")), 9))).withColumn("rank", F.row_number().over(order("s")))
    floor = F.min("s").over(by)
    score = F.when(F.col("inside"), F.col("s")).when(F.col("side").isin(*sides), floor - (F.col("old") - pool)).otherwise(F.col("fused"))
    return rows.withColumn("score", score).select("qid", "side", "chunk", "rank", "score")


def files_after(chunks: DataFrame, files: DataFrame, locations: DataFrame, policy: str = "derive") -> DataFrame:
    """Files once chunks have a new order: keep, derive (by the chunks, the rest behind), or fuse both orders."""
    if policy == "keep":
        return files.select("qid", "side", "path", "rank", "score")
    seen = chunks.join(locations.select("chunk", "side", "path").distinct(), ["chunk", "side"])
    seen = seen.groupBy("qid", "side", "path").agg(F.min(F.struct("rank", "score")).alias("best"))
    placed = files.select("qid", "side", "path", F.col("rank").alias("old")).join(seen, ["qid", "side", "path"], "left")
    by = W.partitionBy("qid", "side")
    placed = placed.withColumn("rank", F.row_number().over(by.orderBy(F.col("best.rank").asc_nulls_last(), F.when(F.col("best").isNull(), F.col("old")), "path")))
    under = chunks.groupBy("qid", "side").agg(F.min("score").alias("under"))
    out = placed.join(under, ["qid", "side"], "left").withColumn("score", F.coalesce("best.score", F.coalesce("under", F.lit(0.0)) - F.col("rank")))
    if policy == "derive":
        return out.select("qid", "side", "path", "rank", "score")
    both = out.withColumn("score", F.round(rrf(F.col("rank")) + rrf(F.col("old")), 9)).drop("rank")
    return ranked(both, ["qid", "side"], F.desc("score"), "path").select("qid", "side", "path", "rank", "score")
