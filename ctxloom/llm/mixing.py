"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same fractional number of copies, its source's target over its source's
size. The whole part is taken; the fraction is rounded in pairs: two documents pass words between each other, in a
random direction that keeps both expectations, until one of the two is whole. What a pair passes on is counted in
words, so the sum of the source stays at its target through every step, and only the one document that is left
at the end moves it, by half of its size at most. The first level runs over buckets of about `bucket` documents,
each a sorted run that a task streams with one document in memory; what is left of them meets in a tree.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. A source takes `cap` times its size at
most; what that cuts off is shared again by weight among the others.

Defined cases: null or empty texts have size 0 and take 0. A null source is a source. Repeated rows and ids are
documents of their own. Extra columns are ignored. Reruns agree: the draws come from bucket numbers and the order of
(size, id). An empty table gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.llm.common import WORD, checked, masked, plain, stash

WEIGHTS = (5.0, 2.0, 1.0)
FAN = 64
BROADCAST_ROWS = 100_000


def words(text):
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, size) -> source, place, n_docs, source_size, target."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = W.partitionBy(F.lit(0))
    per = per.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1))
    per = per.withColumn("full_at", F.lit(cap) * F.col("source_size") / F.col("weight"))
    by = one.orderBy("full_at", "place")
    per = per.withColumn("before", F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
    per = per.withColumn("level", (F.lit(share) * F.sum("source_size").over(one) - F.col("before")) / F.col("open"))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(one)
    per = per.withColumn("level", first["level"])
    full = F.col("level").isNull() | (F.col("full_at") <= F.col("level"))
    return per.select("source", "place", "n_docs", "source_size", F.when(full, F.lit(cap) * F.col("source_size"))
                      .otherwise(F.col("weight") * F.col("level")).alias("target"))


def pair(p: float, s: int, q: float, t: int, u: float) -> tuple[float, float]:
    """Passes words between two fractions p, q of sizes s, t until one is 0 or 1; u draws the direction. p*s + q*t stays."""
    up = min((1 - p) * s, q * t)
    down = min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0, q - up / t) if (1 - p) * s <= q * t else (p + up / s, 0.0)
    return (0.0, q + down / t) if p * s <= (1 - q) * t else (p - down / s, 1.0)


def _whole(p: float) -> bool:
    return p < 1e-9 or p > 1 - 1e-9


CARRIED = "place int, bucket long, doc_id long, size long, p double, whole int"


def _round(level: int):
    """Streams sorted runs of one bucket; returns each document with its fraction rounded, and at most one per bucket that isn't."""

    def run(batches):
        import pyarrow as pa

        kind = pa.schema([("place", pa.int32()), ("bucket", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("whole", pa.int32())])
        at, held, draw = None, None, None

        def close(out):
            if held is not None:
                out.append((*at, *held))

        for batch in batches:
            out = []
            for place, bucket, doc, size, p, whole in zip(*(batch.column(c).to_pylist() for c in ("place", "bucket", "doc_id", "size", "p", "whole"))):
                if (place, bucket) != at:
                    close(out)
                    at, held, draw = (place, bucket), None, random.Random((place * 1_000_003 + bucket) * 64 + level)
                if size == 0 or _whole(p):
                    out.append((place, bucket, doc, size, 0.0 if size == 0 else float(round(p)), whole))
                elif held is None:
                    held = (doc, size, p, whole)
                else:
                    a, b = pair(held[2], held[1], p, size, draw.random())
                    two, held = ((*held[:2], a, held[3]), (doc, size, b, whole)), None
                    for x in two:
                        if _whole(x[2]):
                            out.append((place, bucket, *x[:2], float(round(x[2])), x[3]))
                        else:
                            held = x
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), kind)], schema=kind)

    return run


def mix(units: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, bucket: int = 4096) -> DataFrame:
    """(doc_id, source, size) -> doc_id, source, size, source_size, target, copies, taken."""
    sized = stash(plain(units, "doc_id", "source", "size").select(F.col("doc_id").cast("long"), "source", "size"), "sized")
    per = stash(targets(sized, share, cap, weights), "targets")
    n, most = per.agg(F.count("*"), F.max("n_docs")).first()
    # A checked size: beyond it Spark joins by shuffling and splits skewed sources.
    small = F.broadcast(per) if n <= BROADCAST_ROWS else per
    rows = sized.withColumnRenamed("source", "own").join(small, F.col("own").eqNullSafe(F.col("source")))
    buckets = F.ceil(F.col("n_docs") / bucket)
    rows = rows.withColumn("f", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rows = rows.select("place", F.pmod(F.xxhash64("doc_id", "size"), buckets).alias("bucket"), "doc_id", "size",
                       (F.col("f") - F.floor("f")).alias("p"), F.floor("f").cast("int").alias("whole"))
    done, level, wide = [], 0, -(-(most or 1) // bucket)
    while True:
        runs = rows.repartition("place", "bucket").sortWithinPartitions("place", "bucket", F.col("size").desc(), "doc_id")
        out = stash(runs.mapInArrow(_round(level), CARRIED), "rounded")
        fraction = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(out.where(~fraction))
        left = out.where(fraction)
        if wide <= 1:
            done.append(left.withColumn("p", F.round("p")))
            break
        rows, level, wide = left.withColumn("bucket", F.floor(F.col("bucket") / FAN)), level + 1, -(-wide // FAN)
    whole = done[0]
    for x in done[1:]:
        whole = whole.unionByName(x)
    whole = whole.join(F.broadcast(per) if n <= BROADCAST_ROWS else per, "place")
    copies = (F.col("whole") + F.col("p")).cast("int")
    return whole.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **parameters) -> DataFrame:
    """documents (doc_id, text, source) -> the mix, a row per document."""
    return mix(plain(docs, "doc_id", "source", "text").select("doc_id", "source", words(F.col("text")).alias("size")), **parameters)


def take(docs: DataFrame, **parameters) -> DataFrame:
    """documents -> their rows, each as often as the mix takes it. Rows that share id and source are taken alike."""
    own = masked(docs, "doc_id", "source", "text")
    sized = own.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"))
    units = sized.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    plan = stash(mix(units, **parameters).where("copies > 0").select(F.col("doc_id").alias("plan_id"), F.col("source").alias("plan_source"), "copies"), "copies")
    rows = own.join(checked(plan), F.col("doc_id").cast("long").eqNullSafe(F.col("plan_id")) & F.col("source").eqNullSafe(F.col("plan_source")))
    return rows.select(*own.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy").toDF(*docs.columns)
