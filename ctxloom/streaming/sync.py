"""Incremental indexing: what is new since the last run, by checkpoint or by a high-water mark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.operators import store


def append_new_chunks(stream: DataFrame, target: str, checkpoint: str) -> None:
    """A stream of chunks (chunk, ...) -> parquet in target, each chunk once over all runs; processes what there is and ends.

    The state of seen chunks lives in the checkpoint, so an interrupted run goes on where it stopped."""
    once = stream.dropDuplicates(["chunk"])
    once.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start().awaitTermination()


def above(rows: DataFrame, mark: int, key: str = "ord") -> DataFrame:
    """Rows over the high-water mark."""
    return rows.where(F.col(key) > mark)


def changed_refs(refs: DataFrame, indexed: DataFrame) -> DataFrame:
    """Branches whose commit isn't the indexed one."""
    return refs.join(indexed, ["branch", "commit"], "left_anti")


def embedding(embed: Callable[[list[str]], list[list[float]]]):
    """Batches of (chunk, text) -> (chunk, v); every text has to get a vector."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = embed(pdf["text"].tolist())
            if len(out) != len(pdf):
                raise ValueError(f"{len(out)} vectors for {len(pdf)} texts")
            yield pd.DataFrame({"chunk": pdf["chunk"], "v": [list(map(float, v)) for v in out]})

    return run


def embed_pending(chunks: DataFrame, held: store.Snapshots, embed: Callable[[list[str]], list[list[float]]], batch_bytes: int = 1 << 30) -> int:
    """Embeds the chunks (chunk, text) that have no vector yet, batch by batch, onto the snapshot's table `vectors`; returns how many.

    The batches are dealt once, by running bytes in the order of chunks, and that plan is part of the snapshot. A batch's vectors and
    the mark that it is done move with one pointer: a run that was killed goes on after the last batch that has
    landed, and none of its texts is embedded again. Chunks that came after the plan was made are the next plan's."""
    count, plan, done = 0, held.table("embed_plan"), held.meta("embed_done", None)
    while True:
        if plan is None or done is None:
            vectors = held.table("vectors")
            todo = chunks.select("chunk", "text").dropDuplicates(["chunk"])
            todo = todo if vectors is None else todo.join(vectors.select("chunk"), "chunk", "left_anti")
            sized = todo.withColumn("bytes", F.octet_length("text").cast("long")).withColumn("all", F.lit(0))
            sized = store.with_running(sized, "all", "chunk", "bytes", "before")
            held.commit({"embed_plan": sized.select("chunk", "text", F.floor(F.col("before") / batch_bytes).alias("batch"))}, {"embed_done": -1})
            plan, done = held.table("embed_plan"), -1
        last = plan.agg(F.max("batch")).first()[0]
        if last is None:
            held.commit({}, {"embed_done": None})
            return count
        for batch in range(done + 1, last + 1):
            rows = plan.where(F.col("batch") == batch)
            new = rows.select("chunk", "text").mapInPandas(embedding(embed), "chunk string, v array<float>")
            held.commit({"vectors": new}, {"embed_done": batch if batch < last else None}, append=True)
            count += rows.count()
        plan = done = None
