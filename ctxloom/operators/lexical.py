"""BM25 over chunks and whole files, for many queries at once.

A document is one row with those of its terms that a query may ask for, written once; scores are added up in blocks of documents and queries (blocks.py), and a
document's length is the number of its word positions. Statistics cover the whole corpus, all branches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.functions.text import fold, query_terms, sub_words, words
from ctxloom.operators import blocks
from ctxloom.operators.written import written

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: The bits of a filter of words; a multiple of 64.
BITS = 1 << 16
#: What a chunk's columns weigh.
CHUNK = {"symbol": 2.0, "content": 1.0}


def terms_of(queries: DataFrame) -> DataFrame:
    """(qid, query) -> (qid, term)."""
    return queries.select("qid", F.explode(query_terms(F.col("query"))).alias("term"))


def read(docs: DataFrame, key: list[str], columns: dict[str, float]) -> DataFrame:
    """docs (key, text columns), a row for each document -> (key, d, t_ and a column's name): the length in word positions, and of each column all terms, a word's own ones once."""
    # Most words have no sub-words, so texts are folded as a whole. The generator keeps the words a column: what reads them would cut the text again.
    each = docs.select(*key, F.inline(F.array(F.struct(*[x for c in columns for x in (words(fold(F.col(c))).alias(f"w_{c}"), sub_words(F.col(c)).alias(f"s_{c}"))]))))
    return each.select(*key, sum(F.size(f"w_{c}") for c in columns).cast("long").alias("d"), *[F.concat(f"w_{c}", f"s_{c}").alias(f"t_{c}") for c in columns])


def may_ask(asked: DataFrame) -> Callable[[Column], Column]:
    """asked (term) -> a filter of words: all asked ones pass, and the few that fall on one of their BITS. Its size is fixed, however many are asked."""
    at = asked.select(F.pmod(F.xxhash64("term"), F.lit(BITS)).alias("at"))
    rows = at.groupBy(F.expr("at div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits"))
    bits = {r["i"]: r["bits"] for r in rows.collect()}  # BITS / 64 numbers at most
    known = F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(BITS // 64))), ",").cast("array<bigint>")
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(BITS))
    return lambda w: F.getbit(F.get(known, (place(w) / 64).cast("int")), (place(w) % 64).cast("int")) == 1


def thinned(seen: DataFrame, key: list[str], columns: dict[str, float], passes: Callable[[Column], Column]) -> DataFrame:
    """read() with only the terms that pass, as one string with spaces between: a tenth of the bytes of an array of all."""
    return seen.select(*key, "d", *[F.array_join(F.filter(f"t_{c}", passes), " ").alias(f"t_{c}") for c in columns])


def frequencies(seen: DataFrame, columns: dict[str, float], asked: DataFrame) -> DataFrame:
    """(term, n): in how many documents of read() the asked terms are. They are joined before anything is shuffled."""
    names = [f"t_{c}" if c else "t" for c in columns]
    each = [F.split(c, " ") if seen.schema[c].dataType.simpleString() == "string" else F.col(c) for c in names]
    terms = F.array_distinct(F.concat(*each))
    probe = asked.select("term").distinct()  # Spark broadcasts it where its size allows
    return seen.select(F.explode(terms).alias("term")).join(probe, "term").groupBy("term").agg(F.count("*").alias("n"))


def idf(docs: Column, n: Column) -> Column:
    return F.greatest(F.log((docs - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))


def bm25(docs: DataFrame, key: list[str], columns: dict[str, float], queries: DataFrame, several: bool = False, repeated: bool = False, keep: int | None = None, sides: DataFrame | None = None) -> DataFrame:
    """docs (key, text columns), queries (qid, query) -> (qid, key, score), rounded to 6 places.

    several: a document may lie over several rows, whose words are added up; repeated: it may be there several times, and counts once. keep: no more than can be among the `keep` best of a query.
    sides (key, side): only documents that are on a side are scored, with side, and `keep` holds for each; statistics cover all documents."""
    asked = terms_of(queries)
    # Texts are read where they lie: lengths and asked terms are all that is shuffled.
    seen = thinned(read(docs, key, columns), key, columns, may_ask(asked))
    if several:
        seen = seen.groupBy(*key).agg(F.sum("d").alias("d"), *[F.array_join(F.collect_list(F.when(F.col(f"t_{c}") != "", F.col(f"t_{c}"))), " ").alias(f"t_{c}") for c in columns])
    seen = written(seen.dropDuplicates(key) if repeated else seen, "terms")
    count, total = seen.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    n = frequencies(seen, columns, asked)
    known = asked.join(n.select("term", idf(F.lit(float(count)), F.col("n")).alias("idf")), "term").withColumn("mean", F.lit(total / max(count, 1)))
    known = written(known, "asked")
    hit = seen.where(F.concat(*[f"t_{c}" for c in columns]) != "")
    shown = hit if sides is None else hit.join(sides.select(*key, "side").distinct(), key)
    return blocks.scored(shown, known, key, total, count, {f"t_{c}": w for c, w in columns.items()}, K1, B, keep)


def chunk_scores(chunks: DataFrame, queries: DataFrame, keep: int | None = None, sides: DataFrame | None = None) -> DataFrame:
    """(chunk, symbol, content), a chunk once or several times -> (qid, chunk, score); a hit in the symbol weighs twice."""
    return bm25(chunks, ["chunk"], CHUNK, queries, repeated=True, keep=keep, sides=sides)


def file_scores(placed: DataFrame, queries: DataFrame, keep: int | None = None, sides: DataFrame | None = None) -> DataFrame:
    """Whole files: the words of all their chunks, a chunk that is placed twice counted twice."""
    return bm25(placed.select("blob", "lang", "content"), ["blob", "lang"], {"content": 1.0}, queries, several=True, keep=keep, sides=sides)


def ranked(scores: DataFrame, by: list[str], *order: Column, k: int | None = None) -> DataFrame:
    """Adds rank from 1 within by; at most k rows of each."""
    out = scores.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if k is None else out.where(F.col("rank") <= k)
