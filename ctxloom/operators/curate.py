"""Context assembly: what is shown twice is merged, a token budget with fidelity levels, diversity, and a scan for secrets.

What has to go through an answer in the order of its ranks (the budget, the merging of near copies) is a fold over sorted
rows: a task holds the state of one answer, not its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.functions.names import token_estimate
from ctxloom.operators.written import written

REFERENCE_TOKENS, SIGNATURE_TOKENS = 10, 60


def budget(items: DataFrame, tokens: float) -> DataFrame:
    """items (qid, rank, chunk, content) -> level and running cost: full while the full text fits, then signature, then reference.

    Nothing is dropped; an item that doesn't fit is shown at a lower level."""
    full = F.round(token_estimate(F.col("content")), 6)
    by = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    running = items.withColumn("tokens", full).withColumn("running", F.round(F.sum(full).over(by), 6))
    level = F.when(F.col("running") <= tokens, "full").when(F.col("running") - F.col("tokens") <= tokens, "signature").otherwise("reference")
    return running.select("qid", "rank", "chunk", "tokens", "running", level.alias("level"))


LEVELS = ("full", "signature", "summary", "reference")
#: A signature is its comment and header, of so many bytes (60 tokens) at most.
SIGNATURE_BYTES = 3 * SIGNATURE_TOKENS


def signature(content: Column) -> Column:
    """What stands before the body of a definition: up to the first brace, or the colon that ends a line, within 600 characters; else the first line."""
    head = F.regexp_extract(content, r"(?s)\A(.{0,600}?)(?:[ \t]*\{|:[ \t]*(?:\n|\z))", 1)
    return F.left(F.when(head != "", head).otherwise(F.regexp_extract(content, r"\A[^\n]*", 0)), F.lit(SIGNATURE_BYTES))


def priced(items: DataFrame) -> DataFrame:
    """items (qid, item, rank, content, place, summary) -> (qid, item, rank, full, signature, summary, reference): what each level costs in whole tokens.

    place: `path:line`, all that a reference shows. summary: made offline, null where there is none."""
    cost = lambda c: F.ceil(F.octet_length(c) / 3).cast("long")
    return items.select("qid", "item", "rank", cost(F.col("content")).alias("full"), cost(signature(F.col("content"))).alias("signature"), cost(F.col("summary")).alias("summary"), cost(F.col("place")).alias("reference"))


def folded(rows: DataFrame, start: Callable, step: Callable, kind: str) -> DataFrame:
    """rows (qid, rank, ...) -> step(state, row) for each row in the order of rank; start() makes the state of an answer."""
    names = [f.split()[0] for f in kind.split(", ")]

    def run(batches):
        import pyarrow as pa

        own, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["qid"] != own:
                    own, state = row["qid"], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], types[n]) for n in names], names=names)

    import pyarrow as pa

    flat = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32()}
    types = {f.split()[0]: flat[f.split()[1]] for f in kind.split(", ")}
    return rows.repartition("qid").sortWithinPartitions("qid", "rank").mapInArrow(run, kind)


def assembled(costs: DataFrame, tokens: int) -> DataFrame:
    """priced items -> (qid, item, rank, level, cost, spent): by rank, each item takes the highest level that fits what is left of the budget.

    Nothing is dropped. The references of all later items are set aside first, so as long as those fit, the budget is kept; an item that
    fits in no way is a reference nonetheless. spent: up to and with the item."""
    total = costs.groupBy("qid").agg(F.sum("reference").alias("all"))
    upto = W.partitionBy("qid").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    rows = costs.withColumn("past", F.sum("reference").over(upto)).join(total, "qid").withColumn("later", F.col("all") - F.col("past")).drop("all", "past")

    def step(state, row):
        left = tokens - state["spent"] - row["later"]
        level = next((x for x in LEVELS if row[x] is not None and row[x] <= left), LEVELS[-1])
        state["spent"] += row[level]
        return row | {"level": level, "cost": row[level], "spent": state["spent"]}

    return folded(rows, lambda: {"spent": 0}, step, "qid long, item string, rank long, level string, cost long, spent long")


def outermost(items: DataFrame) -> DataFrame:
    """items (qid, item, rank, path, start, stop) -> within: the outermost other item of the answer whose lines hold all of this one's, or null.

    Rows sorted by start: one that reaches no further than a row before is inside the last one that set the mark."""
    by = W.partitionBy("qid", "path").orderBy("start", F.desc("stop"), "rank")
    past = by.rowsBetween(W.unboundedPreceding, -1)
    rows = items.withColumn("inside", F.coalesce(F.max("stop").over(past) >= F.col("stop"), F.lit(False)))
    rows = rows.withColumn("within", F.when(F.col("inside"), F.last(F.when(~F.col("inside"), F.col("item")), ignorenulls=True).over(past)))
    return rows.drop("inside")


def shingled(texts: DataFrame, width: int = 5) -> DataFrame:
    """texts (..., content) -> set in place of content: the sorted distinct hashes of each `width` words in a row, in small letters; of fewer words, one of them all; none of no words."""
    own = [c for c in texts.columns if c != "content"]
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # The generator keeps the words a column: a lambda over an expression would cut the text again for each of them.
    w = F.col("w")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(width))))
    each = texts.select(*own, F.inline(F.array(F.struct(words.alias("w")))))
    return each.select(*own, F.when(F.size(w) > 0, F.sort_array(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>")).alias("set"))


def near_copies(items: DataFrame, percent: int = 75) -> DataFrame:
    """items (qid, item, set), the sets of an answer all different -> (qid, a, b): those with 100 * common >= percent * all, a < b.

    Two such sets share one of the first elements of each, in whatever order all sets are sorted, if as many are
    taken as the larger set may lack and one more. So items meet by those alone."""
    sets = items.where("size(set) > 0")
    need = F.ceil(F.size("set") * percent / 100)
    first = sets.select("qid", "item", F.size("set").alias("n"), F.explode(F.slice("set", F.lit(1), (F.size("set") - need + 1).cast("int"))).alias("x"))
    a, b = first.toDF("qid", "a", "n", "x"), first.toDF("qid", "b", "m", "x")
    met = a.join(b, ["qid", "x"]).where(f"a < b and 100 * least(n, m) >= {percent} * greatest(n, m)").select("qid", "a", "b").distinct()
    full = lambda name: sets.select("qid", F.col("item").alias(name), F.col("set").alias(f"set_{name}"))
    both = met.join(full("a"), ["qid", "a"]).join(full("b"), ["qid", "b"]).withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(F.col("common") * 100 >= (F.size("set_a") + F.size("set_b") - F.col("common")) * percent).select("qid", "a", "b")


def merged(items: DataFrame, percent: int = 75) -> DataFrame:
    """items (qid, item, rank, path, start, stop, content) -> (qid, item, rank, shown, why, into): an answer without what it shows twice.

    A repeated item is one, at its best rank. An item whose lines another one holds goes into the outermost such (why: inside), which takes
    the best rank of the two. Of near copies the best ranked stays: in the order of rank, an item goes (why: copy) if one that stays is
    near it. into is what stands for an item that isn't shown; a container may be shown as its own copy."""
    once = items.groupBy("qid", "item").agg(F.min(F.struct("rank", "path", "start", "stop", "content")).alias("r")).select("qid", "item", "r.*")
    once = written(once.withColumn("text", F.xxhash64("content")), "answer-items")
    placed = written(outermost(once.drop("content")).withColumn("rank", F.col("rank").cast("long")), "placed")
    # A text that many answers show is cut in shingles once.
    texts = once.join(placed.where("within is null").select("qid", "item"), ["qid", "item"], "left_semi").dropDuplicates(["text", "item"])
    sets = written(shingled(texts.select("text", "item", "content")), "sets")
    inside = placed.where("within is not null").select("qid", "item", "rank", F.lit(False).alias("shown"), F.lit("inside").alias("why"), F.col("within").alias("into"))
    best = placed.groupBy("qid", F.coalesce("within", "item").alias("item")).agg(F.min("rank").alias("best"))
    outer = placed.where("within is null").join(best, ["qid", "item"]).join(sets, ["text", "item"]).select("qid", "item", F.col("best").alias("rank"), "set")
    # Items of equal sets are one: whatever becomes of the best ranked becomes of all.
    outer = outer.withColumn("key", F.when(F.size("set") > 0, F.xxhash64("set")).otherwise(F.xxhash64(F.lit("alone"), "item")))
    heads = written(outer.groupBy("qid", "key", "set").agg(F.min(F.struct("rank", "item")).alias("h")).select("qid", "key", "set", "h.rank", "h.item"), "heads")
    links, ranks = near_copies(heads, percent), heads.select("qid", "item", "rank")
    both = links.join(ranks.toDF("qid", "a", "ra"), ["qid", "a"]).join(ranks.toDF("qid", "b", "rb"), ["qid", "b"])
    end = lambda rank, item: F.struct(F.col(rank).alias("rank"), F.col(item).alias("item"))
    ends = F.when(F.col("ra") < F.col("rb"), F.struct(F.col("b").alias("item"), end("ra", "a").alias("to"))).otherwise(F.struct(F.col("a").alias("item"), end("rb", "b").alias("to")))
    better = both.select("qid", ends.alias("l")).groupBy("qid", "l.item").agg(F.sort_array(F.collect_list("l.to")).alias("better"))  # as many as the answer has items

    def step(kept, row):
        into = next((b["item"] for b in row["better"] or () if b["rank"] in kept), None)
        if into is None:
            kept.add(row["rank"])
        return row | {"into": into}

    rows = heads.select("qid", "key", "item", "rank").join(better, ["qid", "item"], "left").select("qid", "key", F.col("item").alias("head"), "rank", "better")
    fate = folded(rows, set, step, "qid long, key long, head string, into string")
    out = outer.select("qid", "item", "rank", "key").join(fate, ["qid", "key"])
    shown = (F.col("item") == F.col("head")) & F.col("into").isNull()
    out = out.select("qid", "item", "rank", shown.alias("shown"), F.when(~shown, "copy").alias("why"), F.when(~shown, F.coalesce("into", "head")).alias("into"))
    return out.unionByName(inside)


def diverse(items: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """items (qid, chunk, score, v) -> (qid, chunk, pick): maximal marginal relevance, one small group per query."""

    def pick(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["score", "chunk"], ascending=[False, True]).reset_index(drop=True)
        v = np.array(pdf["v"].tolist(), dtype=np.float64)
        v /= np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-300)[:, None]
        score, near = pdf["score"].to_numpy(float), np.zeros(len(pdf))
        left, out = np.ones(len(pdf), bool), []
        while len(out) < min(k, len(pdf)):
            gain = np.where(left, weight * score - (1 - weight) * near, -np.inf)
            i = int(gain.argmax())
            out.append(i)
            left[i] = False
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"qid": pdf["qid"].iloc[out].to_numpy(), "chunk": pdf["chunk"].iloc[out].to_numpy(), "pick": np.arange(1, len(out) + 1)})

    kind = f"qid long, chunk {items.schema['chunk'].dataType.simpleString()}, pick long"
    return items.groupBy("qid").applyInPandas(pick, kind)


# Shapes of credentials.
SECRETS = {
    "aws_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github_token": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}\b",
    "pem_header": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}


def entropy(word: Column) -> Column:
    """Bits per character of a string."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    n = F.size(chars)
    each = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return -F.aggregate(each, F.lit(0.0), lambda a, p: a + p * F.log2(p))


def secrets(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the count of each kind of credential in a text."""
    return rows.select("*", *[F.regexp_count(text, F.lit(p)).cast("long").alias(f"n_{k}") for k, p in SECRETS.items()])
