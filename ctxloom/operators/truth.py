"""Function-level evaluation: tags, what a change touched, baselines by function, and recall under a token budget.

A tag is a function with its exact extent: (path, start, stop, name), name being path::symbol. A line belongs to the innermost tag around
it (the shortest, then by name), on the side of the truth as on that of the baselines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.functions import diffs
from ctxloom.functions.chunking import FUNCTION, chunk_files
from ctxloom.functions.names import eval_symbol
from ctxloom.functions.paths import eval_is_code
from ctxloom.functions.text import baseline_terms, grep_terms
from ctxloom.operators import blocks
from ctxloom.operators.evaluate import B, K1, _idf, innermost, line_owners
from ctxloom.operators.lexical import frequencies, may_ask, ranked
from ctxloom.operators.written import written

#: Queries in a block of functions: a query's terms go to each block of documents, a document to each block of queries.
QUERIES = 16_384
#: Functions and words in a block: the more, the fewer rows are among the best of one.
SIZE = (131_072, 8_000_000)
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
# Words that a parser may report as a method though they are not one, and the budgets and tolerance of the curve.
JUNK = ("if", "else", "for", "while", "do", "switch", "case", "try", "catch", "finally", "return", "this", "super")
BUDGETS = (2000, 4000, 8000, 16000)
TOLERANCE = 0.02


def tags(files: DataFrame) -> DataFrame:
    """files (path, blob, lang, text) -> (path, start, stop, name, tokens): every function; a blob is parsed once for all its paths.

    tokens: what the function costs as it stands."""
    chunks = chunk_files(files).where((F.col("kind") == FUNCTION) & (F.col("symbol") != ""))
    last = F.element_at(F.split("symbol", "::"), -1)
    chunks = chunks.where(~F.lower(last).isin(*JUNK) & (F.col("end_line") >= F.col("start_line")))
    # The paths meet names and sizes; the code itself isn't shuffled again.
    known = chunks.select("blob", "lang", F.col("start_line").alias("start"), F.col("end_line").alias("stop"), eval_symbol(F.col("symbol")).alias("symbol"),
                          F.ceil(F.octet_length(F.regexp_replace("content", r"^\n+|\n+$", "")) / 3).cast("long").alias("tokens"))
    return files.select("path", "blob", "lang").join(known, ["blob", "lang"]).select("path", "start", "stop", F.concat("path", F.lit("::"), "symbol").alias("name"), "tokens")


def changed(diff_files: DataFrame, spans: DataFrame) -> DataFrame:
    """diffs.files_of and tags -> (qid, kind, item, n): what a change touched.

    file: code that was there before; added: new code, which nothing can retrieve; function: innermost tags of touched
    lines, n lines each; outside: hunks of a file that touch no function."""
    code = diff_files.where(eval_is_code(F.col("path")))
    one = lambda rows, kind: rows.select("qid", F.lit(kind).alias("kind"), F.col("path").alias("item")).distinct().withColumn("n", F.lit(1).cast("long"))
    ranges = diffs.ranges_of(code).distinct()
    lines = ranges.select("qid", "path", "start", "stop", F.explode(F.sequence("start", "stop")).alias("line"))
    owner = innermost(lines.select("path", "line").distinct(), spans.select("path", "start", "stop", "name"))
    lines = lines.join(owner, ["path", "line"], "left")
    touched = lines.where("name is not null").groupBy("qid", F.col("name").alias("item")).agg(F.count_distinct("line").alias("n"))
    outside = lines.groupBy("qid", "path", "start", "stop").agg(F.count("name").alias("inside")).where("inside = 0").groupBy("qid", F.col("path").alias("item")).agg(F.count("*").alias("n"))
    out = one(code.where("status <> 'A'"), "file").unionByName(one(code.where("status = 'A'"), "added"))
    for rows, kind in ((touched, "function"), (outside, "outside")):
        out = out.unionByName(rows.select("qid", F.lit(kind).alias("kind"), "item", "n"))
    return out


def owned_words(files: DataFrame, spans: DataFrame, asked: DataFrame) -> DataFrame:
    """files (path, text), tags, asked (term) -> (path, name, d, t): of each function that owns lines, how many identifiers they have, and those that may be asked for, in small letters with spaces between; name is null outside of functions.

    A line is one row: its identifiers are counted and thinned before anything is shuffled."""
    lines = files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    words = lines.select("path", (F.col("line") + 1).alias("line"), F.inline(F.array(F.struct(F.transform(F.regexp_extract_all("t", F.lit(IDENTIFIER), F.lit(0)), lambda w: F.lower(w)).alias("w")))))
    words = words.select("path", "line", F.size("w").cast("long").alias("d"), F.array_join(F.filter("w", may_ask(asked)), " ").alias("t")).where("d > 0")
    owner = line_owners(spans.select("path", "start", "stop", "name"))
    own = words.join(owner, ["path", "line"], "left").groupBy("path", "name")
    return written(own.agg(F.sum("d").alias("d"), F.array_join(F.collect_list(F.when(F.col("t") != "", F.col("t"))), " ").alias("t")), "words")


def by_file(words: DataFrame) -> DataFrame:
    """owned_words -> (path, words, functions, t): what the functions of a file have, and the terms of the whole file, as a written table."""
    inside = F.col("name").isNotNull()
    return written(words.groupBy("path").agg(F.sum(F.when(inside, F.col("d")).otherwise(0)).alias("words"), F.count("name").alias("functions"),
                                             F.array_join(F.collect_set(F.when(F.col("t") != "", F.col("t"))), " ").alias("t")), "words-by-file")


def idf_of(whole: DataFrame, terms: DataFrame, files: DataFrame) -> DataFrame:
    """by_file -> (term, idf) of the asked terms, by the number of files that have them."""
    df = frequencies(whole.select("path", "t"), {"": 1.0}, terms).withColumnRenamed("n", "df")
    total = files.agg(F.count("*").alias("docs"))  # one row
    return df.crossJoin(F.broadcast(total)).select("term", F.round(_idf(F.col("docs"), F.col("df")), 9).alias("idf"))


def bm25_functions(files: DataFrame, spans: DataFrame, queries: DataFrame, keep: int | None = None) -> DataFrame:
    """(qid, name, score): a function is a document of its own; idf counts files. Lengths are averaged over the functions of the files that share a term with the query. keep: no more than can be among the `keep` best of a query."""
    terms = written(queries.select("qid", F.explode(F.array_distinct(baseline_terms(F.col("query")))).alias("term")), "asked")
    words = owned_words(files, spans, terms)
    whole = by_file(words)
    hit = whole.where("t <> ''")
    count, total = hit.agg(F.count("*"), F.coalesce(F.sum("words"), F.lit(0))).first()
    sums = blocks.candidates(hit.select("path", F.col("words").alias("d"), "functions", "t"), terms, ["path"], total, count, {"t": 1.0}, QUERIES, ("d", "functions"))
    mean = sums.select("qid", F.greatest(F.lit(1.0), F.col("d") / F.col("functions")).alias("mean"))
    return _scored(words, terms.join(idf_of(whole, terms, files), "term").join(mean, "qid"), K1, B, keep)


def grep_functions(files: DataFrame, spans: DataFrame, queries: DataFrame, keep: int | None = None, most: int = 20) -> DataFrame:
    """(qid, name, score): the sum of idf over the query's rarest identifiers that a function's lines have, each counted once; small and large letters are alike. keep: as above."""
    terms = written(queries.select("qid", F.explode(F.array_distinct(F.transform(grep_terms(F.col("query")), lambda w: F.lower(w)))).alias("term")), "asked")
    words = owned_words(files, spans, terms)
    top = ranked(terms.join(idf_of(by_file(words), terms, files), "term"), ["qid"], F.desc("idf"), "term", k=most)
    # An idf has 9 places, so its sums are whole numbers of billionths.
    return _scored(words, top.select("qid", "term", F.round(F.col("idf") * 1e9).alias("idf"), F.lit(1.0).alias("mean")), 0.0, 0.0, keep, 1e9)


def _scored(words: DataFrame, known: DataFrame, k1: float, b: float, keep: int | None, unit: float = 1.0) -> DataFrame:
    """owned_words, known (qid, term, idf, mean) -> (qid, name, score) of the functions that share a term with a query."""
    inside = words.where("name is not null and t <> ''").select("name", "d", "t")
    count, total = inside.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    return blocks.scored(inside, written(known.select("qid", "term", "idf", "mean"), "asked"), ["name"], total, count, {"t": 1.0}, k1, b, keep, unit, QUERIES, SIZE)


def budget_curve(found: DataFrame, truth: DataFrame, k: int = 10, budgets: tuple[int, ...] = BUDGETS, tolerance: float = TOLERANCE) -> DataFrame:
    """found (qid, item, rank, tokens), truth (qid, item) -> (budget, recall, least): mean recall at k of what fits a budget in the order of rank; budget -1 is no limit.

    One pass: each hit knows the tokens up to and with its item, so all budgets are counted at once. least marks B*, the smallest
    budget whose recall is at most `tolerance` under that without a limit."""
    upto = found.where(F.col("rank") <= k).withColumn("upto", F.sum("tokens").over(W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)))
    hit = upto.join(truth.select("qid", "item").distinct(), ["qid", "item"])
    size = truth.groupBy("qid").agg(F.count_distinct("item").alias("size"))
    limits = [*budgets, None]
    counts = [F.count_distinct(F.when(F.lit(True) if b is None else F.col("upto") <= b, F.col("item"))).alias(f"h{i}") for i, b in enumerate(limits)]
    rows = size.join(hit.groupBy("qid").agg(*counts), "qid", "left")
    means = rows.agg(*[F.round(F.avg(F.coalesce(f"h{i}", F.lit(0)) / F.col("size")), 6).alias(f"m{i}") for i in range(len(limits))])
    last = F.col(f"m{len(limits) - 1}")
    long = means.select(F.inline(F.array(*[F.struct(F.lit(-1 if b is None else b).cast("long").alias("budget"), F.col(f"m{i}").alias("recall"), last.alias("whole")) for i, b in enumerate(limits)])))
    enough = F.col("recall") >= F.round(F.col("whole") - tolerance, 6)
    order = F.when(F.col("budget") >= 0, F.col("budget")).otherwise(F.lit((1 << 63) - 1))
    first = F.min(F.when(enough, order)).over(W.partitionBy(F.lit(0)))  # five rows
    return long.select("budget", "recall", F.coalesce(order == first, F.lit(False)).alias("least"))
