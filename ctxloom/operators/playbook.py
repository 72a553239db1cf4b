"""The playbook: short lessons (bullets) that are appended or counted in place, never rewritten, and what stands for a chunk that a session has seen.

A bullet is (id, content, helpful, harmful, v, refs). A delta has the same columns; its id is null for a new lesson.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxloom.operators import vectors
from ctxloom.operators.lexical import ranked
from ctxloom.operators.written import written

NEAR = 0.9


def counted(rows: DataFrame, id_: str = "id") -> DataFrame:
    """Rows of one id as one: counters are added, refs joined, the first content stays."""
    return rows.groupBy(F.col(id_).alias("id")).agg(F.sum("helpful").alias("helpful"), F.sum("harmful").alias("harmful"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("refs")))).alias("refs"),
                                                    F.min(F.struct("content", "v")).alias("b")).select("id", "b.content", "helpful", "harmful", "b.v", "refs")


def leaders(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (id), links (a, b) with a < b -> (id, leader): in the order of ids, a node follows the least leader it is linked with, or leads.

    The same as going through the ids one by one, but by rounds: whoever has no open link to a lesser id leads, and all that are linked
    with a leader are settled. Few rounds are needed, and each is a join."""
    open_, links, lead = written(nodes.select("id"), "open"), written(links.distinct(), "links"), nodes.select("id").limit(0)
    while not open_.isEmpty():
        live = links.join(open_.toDF("a"), "a").join(open_.toDF("b"), "b").select("a", "b")
        now = written(open_.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "leaders")
        settled = now.unionByName(live.join(now.toDF("a"), "a").select(F.col("b").alias("id"))).distinct()
        lead, open_ = lead.unionByName(now), written(open_.join(settled, "id", "left_anti"), "open")
    follow = links.join(lead.toDF("a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    return lead.select("id", F.col("id").alias("leader")).unionByName(follow)


def merged(bullets: DataFrame, deltas: DataFrame, near: float = NEAR) -> DataFrame:
    """bullets and deltas -> the playbook after the deltas, and change: kept, counted (a delta named it, repeated it, or is near it), appended.

    A delta that names a bullet counts for it. Any other is a lesson by the hash of its content: it counts for the nearest bullet at `near`
    or more; lessons that are near each other are one, the one of the least id."""
    text = F.sha2(F.col("content").cast("binary"), 256)
    named = deltas.join(bullets.select("id"), "id", "left_semi")
    rest = deltas.join(named.select("id").distinct(), "id", "left_anti").withColumn("id", text)
    fresh = written(counted(rest), "lessons")
    same = fresh.join(bullets.select("id"), "id", "left_semi")
    lessons = fresh.join(bullets.select("id"), "id", "left_anti")
    close = vectors.cosine(bullets.select("id", "v"), lessons.select(F.col("id").alias("qid"), "v"), keep=1, least=near)
    close = written(ranked(close, ["qid"], F.desc("score"), "id", k=1).select(F.col("qid").alias("lesson"), F.col("id").alias("bullet")), "close")
    left = written(lessons.join(close.select(F.col("lesson").alias("id")), "id", "left_anti"), "left")
    pairs = vectors.cosine(left.select("id", "v"), left.select(F.col("id").alias("qid"), "v"), least=near).where("id < qid")
    lead = leaders(pairs.select(F.col("id").alias("a"), F.col("qid").alias("b")), left)
    appended = counted(left.join(lead, "id").withColumn("first", F.col("id") == F.col("leader")), "leader").drop("content", "v")
    appended = appended.join(left.select("id", "content", "v"), "id").select("id", "content", "helpful", "harmful", "v", "refs", F.lit("appended").alias("change"))
    to_stored = named.unionByName(same.select(*named.columns)).unionByName(lessons.join(close, F.col("id") == F.col("lesson")).drop("id").withColumnRenamed("bullet", "id").select(*named.columns))
    more = counted(to_stored).select("id", F.col("helpful").alias("h"), F.col("harmful").alias("x"), F.col("refs").alias("r"))
    rows = bullets.join(more, "id", "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    rows = rows.select("id", "content", plus("helpful", "h"), plus("harmful", "x"), "v", F.array_sort(F.array_union("refs", F.coalesce("r", F.array().cast("array<string>")))).alias("refs"),
                       F.when(F.col("h").isNull(), "kept").otherwise("counted").alias("change"))
    return rows.unionByName(appended)


def retired(helpful: Column, harmful: Column, least: int = 3) -> Column:
    """A bullet that harms more often than it helps, seen `least` times or more, isn't shown any longer."""
    return (harmful >= least) & (harmful > helpful)


# --- sessions ------------------------------------------------------------------------------------------


def shown(hits: DataFrame, lessons: DataFrame) -> DataFrame:
    """hits (session, step, chunk) and lessons (chunk, content) -> (session, step, chunk, form, lesson): a chunk is shown in full the first time a session meets it;
    later the lesson about it stands for it, or where there is none a reference. Nothing is ever left out."""
    first = hits.groupBy("session", "chunk").agg(F.min("step").alias("first"))
    rows = hits.join(first, ["session", "chunk"]).join(lessons.groupBy("chunk").agg(F.min("content").alias("lesson")), "chunk", "left")
    again = F.col("step") > F.col("first")
    form = F.when(~again, "full").when(F.col("lesson").isNotNull(), "lesson").otherwise("reference")
    return rows.select("session", "step", "chunk", form.alias("form"), F.when(again, F.col("lesson")).alias("lesson"))


def shown_stream(hits: DataFrame, lessons: DataFrame, target: str, checkpoint: str) -> None:
    """The same over a stream whose steps arrive in order: what a session has seen is state, kept by session and chunk; appended to target, then it ends."""

    def mark(key: tuple, parts: Iterator, state) -> Iterator:
        import pandas as pd

        first = state.get[0] if state.exists else None
        for pdf in parts:
            least = int(pdf["step"].min())
            first = least if first is None else min(first, least)
            yield pd.DataFrame({"session": key[0], "step": pdf["step"], "chunk": key[1], "again": pdf["step"] > first})
        state.update((first,))

    kind = hits.schema["session"].dataType.simpleString()
    marked = hits.groupBy("session", "chunk").applyInPandasWithState(mark, f"session {kind}, step long, chunk string, again boolean", "first long", "append", "NoTimeout")
    known = lessons.groupBy("chunk").agg(F.min("content").alias("lesson"))

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.join(known, "chunk", "left")
        form = F.when(~F.col("again"), "full").when(F.col("lesson").isNotNull(), "lesson").otherwise("reference")
        rows.select("session", "step", "chunk", form.alias("form"), F.when(F.col("again"), F.col("lesson")).alias("lesson")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    marked.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
