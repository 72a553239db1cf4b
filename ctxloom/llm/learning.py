"""What the two text classifiers share: labels they may learn from, bounded samples, and their measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.llm.common import held_out


def labelled(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y): every labelled id that isn't held out, once."""
    y = F.col(label).cast("int")
    named = labels.select(F.col("doc_id").cast("long"), y.alias("y")).where("doc_id is not null and y in (0, 1)")
    return named.where(~held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))


def sample_ids(labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, y): at most per_class labelled ids of each class, by hash order, none of them held out."""
    named = labelled(labels, label)
    one = [named.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    return one[0].unionByName(one[1])


def collected(rows: DataFrame, most: int):
    """At most `most` rows, in a fixed order, as an Arrow table."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toArrow()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def best_thresholds(rows: DataFrame, default: float, parts: int = 4096) -> DataFrame:
    """rows (lang, score from 0 to 1, y) -> (lang, threshold): the midpoint of the gap between scores that gives the best F1, over all rows; default where a class is missing.

    Scores are counted in `parts` ranges, so that no language is one task."""
    each = rows.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("y").alias("hit")).withColumn("part", F.floor(F.col("score") * parts))
    by, own = W.partitionBy("lang").orderBy(F.desc("part")), W.partitionBy("lang", "part").orderBy(F.desc("score"))
    above = lambda c: F.coalesce(F.sum(c).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = lambda c: F.sum(c).over(W.partitionBy("lang"))
    ranges = each.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"), F.max("score").alias("top"))
    ranges = ranges.select("lang", "part", above("n").alias("n_above"), above("hit").alias("hit_above"), F.lead("top").over(by).alias("below"), total("n").alias("n_all"), total("hit").alias("hit_all"))
    upto = lambda c: F.sum(c).over(own.rowsBetween(W.unboundedPreceding, 0)) + F.col(f"{c}_above")
    cuts = each.join(ranges, ["lang", "part"]).select("lang", "score", "n_all", "hit_all", upto("n").alias("n"), upto("hit").alias("hit"), F.coalesce(F.lead("score").over(own), "below", "score").alias("next"))
    best = cuts.groupBy("lang", "n_all", "hit_all").agg(F.max(F.struct(2 * F.col("hit") / (F.col("n") + F.col("hit_all")), "score", "next")).alias("m"))
    both = (F.col("hit_all") > 0) & (F.col("hit_all") < F.col("n_all"))
    return best.select("lang", F.when(both, (F.col("m.score") + F.col("m.next")) / 2).otherwise(default).alias("threshold"))


class Adagrad:
    """Steps of its own for each parameter; rows gives the rows of a table that a gradient touches."""

    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate = params, rate
        self.seen = {k: np.full(v.shape, 1e-6, v.dtype) for k, v in params.items()}

    def step(self, name: str, grad: np.ndarray, rows=slice(None)) -> None:
        self.seen[name][rows] += grad * grad
        self.params[name][rows] -= self.rate * grad / np.sqrt(self.seen[name][rows])
