"""Lanes of a route, and their weighted reciprocal-rank fusion into code and test groups.

A lane is (qid, side, chunk, rank) and any number of file lists (qid, side, path, rank). Files are fused first,
because a chunk's score holds its best file's place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.names import rrf
from ctxloom.operators.lexical import ranked

PLACES = 9


@dataclass
class Lane:
    chunks: DataFrame
    files: list[DataFrame] = field(default_factory=list)
    weight: float = 1.0


def visible_top(scores: DataFrame, locations: DataFrame, k: int) -> DataFrame:
    """(qid, chunk, score, perhaps side) -> the k best of each query and side that the branch shows, with rank. Filtering comes before ranking; scores with a side are filtered."""
    seen = scores if "side" in scores.columns else scores.join(locations.select("chunk", "side").distinct(), "chunk")
    return ranked(seen, ["qid", "side"], F.desc("score"), F.asc("chunk"), k=k)


def files_by_first_chunk(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Paths in the order in which ranked chunks first show them."""
    first = chunks.select("qid", "side", "chunk", "rank").join(locations, ["chunk", "side"]).groupBy("qid", "side", "path").agg(F.min("rank").alias("first"))
    return ranked(first, ["qid", "side"], "first", "path").select("qid", "side", "path", "rank")


def files_by_document(scores: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(qid, blob, lang, score, perhaps side) -> paths of the k best whole files of each side, flattened in order."""
    seen = scores if "side" in scores.columns else scores.join(paths.select("blob", "lang", "side").distinct(), ["blob", "lang"])
    best = ranked(seen, ["qid", "side"], F.desc("score"), "blob", "lang", k=k).withColumnRenamed("rank", "doc_rank")
    flat = best.join(paths, ["blob", "lang", "side"])
    return ranked(flat, ["qid", "side"], "doc_rank", "path").select("qid", "side", "path", "rank")


def fused_files(lanes: list[Lane]) -> DataFrame:
    """(qid, side, path, score, rank), not cut. A lane's weight is shared among its lists; a lane without lists is left out."""
    parts = [f.select("qid", "side", "path", (F.lit(lane.weight / len(lane.files)) * rrf(F.col("rank"))).alias("s")) for lane in lanes for f in lane.files]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.groupBy("qid", "side", "path").agg(F.round(F.sum("s"), PLACES).alias("score"))
    return ranked(total, ["qid", "side"], F.desc("score"), "path")


def fused_chunks(lanes: list[Lane], files: DataFrame, locations: DataFrame, k: int) -> DataFrame:
    """(qid, side, chunk, score, rank): the lanes' shares over all weights, plus the share of the best file's place."""
    weights = sum(lane.weight for lane in lanes)
    every = None
    for lane in lanes:
        p = lane.chunks.select("qid", "side", "chunk", (F.lit(lane.weight / weights) * rrf(F.col("rank"))).alias("s"), "rank")
        every = p if every is None else every.unionByName(p)
    total = every.groupBy("qid", "side", "chunk").agg(F.sum("s").alias("s"), F.min("rank").alias("best_rank"))
    # Few chunks are ranked: their places are looked up before they are made distinct.
    place = total.select("qid", "side", "chunk").join(locations.select("chunk", "side", "path"), ["chunk", "side"]).distinct()
    place = place.join(files.select("qid", "side", "path", F.col("rank").alias("file_rank")), ["qid", "side", "path"]).groupBy("qid", "side", "chunk").agg(F.min("file_rank").alias("file_rank"))
    out = total.join(place, ["qid", "side", "chunk"], "left")
    out = out.withColumn("score", F.round(F.col("s") + F.coalesce(rrf(F.col("file_rank")), F.lit(0.0)), PLACES))
    return ranked(out, ["qid", "side"], F.desc("score"), "best_rank", "chunk", k=k).select("qid", "side", "rank", "chunk", "score")


def results(chunks: DataFrame, files: DataFrame, locations: DataFrame, symbols: DataFrame) -> DataFrame:
    """The nested answer of each query as JSON: {code: {chunks, files}, tests: ...}."""
    ranked_ = chunks.select("chunk", "side").distinct()
    where = locations.join(ranked_, ["chunk", "side"], "left_semi").groupBy("chunk", "side").agg(F.array_sort(F.collect_list(F.struct("path", "start_line", "end_line"))).alias("where"))
    c = chunks.join(where, ["chunk", "side"]).join(symbols.select("chunk", "symbol").join(ranked_, "chunk", "left_semi"), "chunk").groupBy("qid", "side").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk", "score", "symbol", "where"))).alias("chunks"))
    f = files.groupBy("qid", "side").agg(F.array_sort(F.collect_list(F.struct("rank", "path", "score"))).alias("files"))
    both = c.join(f, ["qid", "side"], "full_outer").withColumn("group", F.struct("chunks", "files"))
    by = both.groupBy("qid").agg(F.first(F.when(F.col("side") == "code", F.col("group")), ignorenulls=True).alias("code"), F.first(F.when(F.col("side") == "tests", F.col("group")), ignorenulls=True).alias("tests"))
    return by.select("qid", F.to_json(F.struct("code", "tests")).alias("result"))
