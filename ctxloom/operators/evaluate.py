"""Retrieval metrics, two baselines that share no words, statistics or weights with the engine (only the sums over blocks), and the rules of the query set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.text import baseline_terms, fold, grep_terms
from ctxloom.operators import blocks
from ctxloom.operators.lexical import ranked
from ctxloom.operators.written import written

K1, B = 0.9, 0.4
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def recall(found: Column, truth: Column, k: int) -> Column:
    """Of the truth, the share among the first k; duplicates use up places; null where there is no truth."""
    return F.when(F.size(truth) > 0, F.size(F.array_intersect(F.slice(found, 1, k), truth)) / F.size(F.array_distinct(truth)))


def accuracy(found: Column, truth: Column, k: int) -> Column:
    """1 where the whole truth is among the first k."""
    return F.when(F.size(truth) > 0, (F.size(F.array_except(truth, F.slice(found, 1, k))) == 0).cast("double"))


def reciprocal_rank(found: Column, truth: Column) -> Column:
    """1 over the place of the first hit, else 0."""
    first = F.array_min(F.filter(F.transform(found, lambda x, i: F.when(F.array_contains(truth, x), i + 1)), lambda i: i.isNotNull()))
    return F.when(F.size(truth) > 0, F.coalesce(1.0 / first, F.lit(0.0)))


def ndcg(found: Column, truth: Column, k: int = 10) -> Column:
    top = F.slice(found, 1, k)
    gain = lambda i: 1.0 / F.log2(i + 2.0)
    have = F.aggregate(F.transform(top, lambda x, i: F.when(F.array_contains(truth, x), gain(i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    best = F.aggregate(F.transform(F.sequence(F.lit(0), F.least(F.size(F.array_distinct(truth)), F.lit(k)) - 1), gain), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(truth) > 0, have / best)


def per_query(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """found (qid, item, rank), truth (qid, item) -> the metrics of each query that has a truth.

    Hits are joined and counted, so neither a ranking nor a truth is one list."""
    truth = truth.select("qid", "item").distinct()
    size = truth.groupBy("qid").agg(F.count("*").alias("size"))
    hit = found.select("qid", "item", "rank").join(truth, ["qid", "item"])
    within = [F.count_distinct(F.when(F.col("rank") <= k, F.col("item"))).alias(f"h_{k}") for k in ks]
    gain = F.sum(F.when(F.col("rank") <= 10, 1.0 / F.log2(F.col("rank") + 1.0))).alias("gain")
    rows = size.join(hit.groupBy("qid").agg(*within, F.min("rank").alias("first"), gain), "qid", "left")
    have = lambda k: F.coalesce(f"h_{k}", F.lit(0))
    best = F.aggregate(F.sequence(F.lit(1), F.least("size", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + 1.0))
    cols = [F.round(have(k) / F.col("size"), 6).alias(f"recall_{k}") for k in ks] + [(have(k) == F.col("size")).cast("double").alias(f"acc_{k}") for k in ks]
    return rows.select("qid", *cols, F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.coalesce("gain", F.lit(0.0)) / best, 6).alias("ndcg_10"))


def macro(metrics: DataFrame) -> DataFrame:
    """(metric, mean, n): means over the queries where a metric is defined."""
    names = [c for c in metrics.columns if c != "qid"]
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("m")).select("m.*")
    return long.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    """(metric, mean, n) of several sets -> their mean weighted by n."""
    return parts.groupBy("metric").agg(F.round(F.sum(F.col("mean") * F.col("n")) / F.sum("n"), 6).alias("mean"), F.sum("n").alias("n"))


def _idf(docs: Column, df: Column) -> Column:
    return F.log(1 + (docs - df + 0.5) / (df + 0.5))


def _read(files: DataFrame, every) -> DataFrame:
    """(path, text) -> (path, d, t): the identifiers of a path, each in small letters for BM25; a path may lie over several rows."""
    files = files.groupBy("path").agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
    words = files.select("path", F.inline(F.array(F.struct(every(F.col("text")).alias("t")))))
    return written(words.select("path", F.size("t").cast("long").alias("d"), "t"), "identifiers")


def _frequencies(seen: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df): in how many paths the asked terms are."""
    hit = seen.select(F.explode(F.array_distinct("t")).alias("term")).join(terms.select("term").distinct(), "term")
    return hit.groupBy("term").agg(F.count("*").alias("df"))


def grep_baseline(files: DataFrame, queries: DataFrame, most: int = 20, keep: int | None = None) -> DataFrame:
    """(path, text) -> (qid, path, score): the sum of idf over the query's 20 rarest identifiers that a file has. keep: no more than can be among the `keep` best of a query.

    An idf has 9 places, so its sums are whole numbers of billionths: exact, whatever the order."""
    terms = queries.select("qid", F.explode(grep_terms(F.col("query"))).alias("term"))
    seen = _read(files, lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(IDENTIFIER), F.lit(0))))
    count, words = seen.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    known = terms.join(_frequencies(seen, terms), "term").withColumn("idf", F.round(_idf(F.lit(files.count()), F.col("df")), 9))
    top = ranked(known, ["qid"], F.desc("idf"), "term", k=most)
    top = written(top.select("qid", "term", F.round(F.col("idf") * 1e9).alias("idf"), F.lit(1.0).alias("mean")), "asked")
    return blocks.scored(seen, top, ["path"], words, count, {"t": 1.0}, 0.0, 0.0, keep, unit=1e9)


def bm25_baseline(files: DataFrame, queries: DataFrame, keep: int | None = None) -> DataFrame:
    """(path, text) -> (qid, path, score): whole identifiers, k1 0.9, b 0.4; the mean length is that of candidate files, df that of all. keep: no more than can be among the `keep` best of a query."""
    terms = queries.select("qid", F.explode(F.array_distinct(baseline_terms(F.col("query")))).alias("term"))
    seen = _read(files, lambda t: F.regexp_extract_all(fold(t), F.lit(IDENTIFIER), F.lit(0)))
    count, words = seen.agg(F.count("*"), F.coalesce(F.sum("d"), F.lit(0))).first()
    mean = blocks.candidates(seen, terms, ["path"], words, count, {"t": 1.0}).select("qid", (F.col("d") / F.col("n")).alias("mean"))
    known = terms.join(_frequencies(seen, terms), "term").join(mean, "qid").select("qid", "term", _idf(F.lit(files.count()), F.col("df")).alias("idf"), "mean")
    return blocks.scored(seen, written(known, "asked"), ["path"], words, count, {"t": 1.0}, K1, B, keep)


def innermost(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """points (path, line), spans (path, start, stop, name) -> the innermost span of each point: the shortest, then by name.

    Spans are dealt over buckets of `width` lines, so the range condition becomes an equality and a filter."""
    b = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("stop") / width))))
    p = points.withColumn("bucket", F.floor(F.col("line") / width))
    hit = p.join(b, ["path", "bucket"]).where(F.col("line").between(F.col("start"), F.col("stop")))
    return hit.groupBy("path", "line").agg(F.min(F.struct((F.col("stop") - F.col("start")).alias("w"), "name")).alias("m")).select("path", "line", F.col("m.name").alias("name"))


def line_owners(spans: DataFrame) -> DataFrame:
    """Every line of a span with its innermost owner."""
    lines = spans.select("path", F.explode(F.sequence("start", "stop")).alias("line"), (F.col("stop") - F.col("start")).alias("w"), "name")
    return lines.groupBy("path", "line").agg(F.min(F.struct("w", "name")).alias("m")).select("path", "line", F.col("m.name").alias("name"))


def gate(failed: int, attempted: int, ceiling: float = 0.02) -> None:
    """No report where more than 2 % of the queries failed."""
    if attempted and failed / attempted > ceiling:
        raise RuntimeError(f"{failed} of {attempted} queries failed; no report above {ceiling:.0%}")


def report(means: list[dict]) -> str:
    """A Markdown table of systems by metrics; a missing metric is a dash."""
    names = sorted({k for m in means for k in m if k != "system"})
    cell = lambda v: "—" if v is None else f"{v:.3f}"
    rows = ["| " + " | ".join([m["system"], *[cell(m.get(n)) for n in names]]) + " |" for m in means]
    return "\n".join(["| system | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1), *rows])
