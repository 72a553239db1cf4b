"""Vector search: the exact scan, and an inverted-file index with a coverage check."""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.operators.lexical import ranked

BLOCK, QUERY_BLOCK = 8192, 2048
#: Scores that a task holds at once.
AT_ONCE = 2_000_000


class NotReady(RuntimeError):
    """A precondition of a search fails."""


def pending(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks without a vector."""
    return chunks.join(vectors, "chunk", "left_anti")


def require_all(chunks: DataFrame, vectors: DataFrame) -> None:
    """A ranking by vectors runs only when every chunk of the database has one."""
    if not pending(chunks, vectors).isEmpty():
        raise NotReady("some chunks have no vector yet")


def unit(rows) -> np.ndarray:
    """A column of vectors -> a matrix of doubles, each row of length 1 (or 0)."""
    v = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm > 0, norm, 1)[:, None]


def _scored(keep: int | None, places: int, sides: bool, least: float | None = None):
    """A block of vectors and a block of queries -> the `keep` best of each query (and side), with ties, so that ids decide later, and none under `least`."""

    def run(v, q):
        import pandas as pd

        # The empty beginnings keep the columns' types where nothing follows.
        out = {"qid": [q["qid"].to_numpy()[:0]], "id": [v["id"].to_numpy()[:0]], "score": [np.zeros(0)]} | ({"side": [np.zeros(0, dtype=object)]} if sides else {})
        if len(v) and len(q):
            for side, part in v.groupby("side") if sides else [(None, v)]:
                vectors = unit(part["v"]).T
                # A few queries at a time, however many meet this block.
                step = max(1, AT_ONCE // vectors.shape[1])
                for first in range(0, len(q), step):
                    some = q.iloc[first : first + step]
                    s = np.round(unit(some["v"]) @ vectors, places)
                    if keep is not None and s.shape[1] > keep:
                        cut = np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]
                        x, y = np.nonzero(s >= cut[:, None])
                    else:
                        x, y = (i.ravel() for i in np.indices(s.shape))
                    if least is not None:
                        high = s[x, y] >= least
                        x, y = x[high], y[high]
                    out["qid"].append(some["qid"].to_numpy()[x])
                    out["id"].append(part["id"].to_numpy()[y])
                    out["score"].append(s[x, y])
                    if sides:
                        out["side"].append(np.full(len(x), side, dtype=object))
        return pd.DataFrame({c: np.concatenate(a) for c, a in out.items()})

    return run


def _met(v: DataFrame, q: DataFrame, by: list[str], keep: int | None, places: int, least: float | None = None) -> DataFrame:
    v, q = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (v, q))  # both may come from one table
    sides = "side" in v.columns
    kind = f"qid {q.schema['qid'].dataType.simpleString()}, id {v.schema['id'].dataType.simpleString()}, score double" + (", side string" if sides else "")
    run = _scored(keep, places, sides, least)
    return v.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(lambda a, b: run(a, b), kind)


def cosine(vectors: DataFrame, queries: DataFrame, keep: int | None = None, places: int = 6, least: float | None = None) -> DataFrame:
    """vectors (id, v, perhaps side), queries (qid, v) -> (qid, id, score, perhaps side).

    Both are dealt in blocks, and a task scores a block of each; keep: the best of each query (and side) in a block alone; least: no lower scores."""
    blocks, asks = max(1, -(-vectors.count() // BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    sides = ["side"] if "side" in vectors.columns else []
    v = vectors.select("id", "v", *sides, dealt("id", blocks).alias("b"), every(asks).alias("a"))
    q = queries.select("qid", "v", every(blocks).alias("b"), dealt("qid", asks).alias("a"))
    return _met(v, q, ["b", "a"], keep, places, least)


def exact_top(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, id, score, rank): best first, ties to the smaller id; with a side, the k best of each."""
    by = ["qid", *(["side"] if "side" in vectors.columns else [])]
    return ranked(cosine(vectors, queries, keep=k), by, F.desc("score"), "id", k=k)


def visible(vectors: DataFrame, locations: DataFrame) -> DataFrame:
    """vectors (id, v) -> those that the locations show, once for each side they are on."""
    return vectors.join(locations.select(F.col("chunk").alias("id"), "side").distinct(), "id")


def nearest_visible(vectors: DataFrame, queries: DataFrame, locations: DataFrame, k: int) -> DataFrame:
    """The exact lane: (qid, side, chunk, score, rank), the k best of each side that the branch shows."""
    return exact_top(visible(vectors, locations), queries, k).select("qid", "side", F.col("id").alias("chunk"), "score", "rank")


def _near(centroids: np.ndarray, x: np.ndarray, probes: int) -> np.ndarray:
    """The `probes` nearest cells of each row."""
    half = (centroids * centroids).sum(axis=1) / 2
    if probes == 1:  # the first of the nearest, as the stable order gives it
        step = max(1, AT_ONCE // len(centroids))
        return np.concatenate([np.zeros((0, 1), dtype=np.int64), *[(x[i : i + step] @ centroids.T - half).argmax(axis=1)[:, None] for i in range(0, len(x), step)]])
    return np.argsort(-(x @ centroids.T - half), axis=1, kind="stable")[:, :probes]


def reach(x: np.ndarray, centroids: np.ndarray, k: int = 10, target: float = 0.95, asked: int = 256) -> int:
    """How many cells a search has to look into for the k nearest, by cosine, at the target recall; told by brute force inside a bounded sample."""
    u = unit(list(x))
    own = _near(centroids, x, 1)[:, 0]
    q = np.arange(0, len(x), max(1, len(x) // asked))
    true = np.argsort(-(u[q] @ u.T), axis=1)[:, :k]
    place = np.argsort(_near(centroids, x[q], len(centroids)), axis=1)  # of each cell: how near it is
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))) - 1)]) + 1


def stored(vectors: DataFrame, precision: str) -> DataFrame:
    """The vectors as the index keeps them: f32, or unit vectors in steps of 1/127 (i8), which search about as well at a quarter of the size."""
    if precision == "f32":
        return vectors
    if precision != "i8":
        raise ValueError(f"no such precision: {precision}")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.withColumn("v", F.transform("v", lambda x: F.when(norm > 0, F.round(x / norm * 127)).otherwise(0.0).cast("tinyint")))


@dataclass
class Index:
    """Cells of vectors around centroids. coverage: the count and the largest id it was built from; probes: how many cells reach the recall it was built for."""

    centroids: np.ndarray
    cells: DataFrame
    coverage: tuple[int, object]
    probes: int

    @staticmethod
    def build(vectors: DataFrame, cells: int | None = None, sample: int = 20_000, rounds: int = 10, recall: float = 0.95, precision: str = "f32") -> Index:
        """Centroids and the number of cells to look into come from a bounded sample; every vector is in a cell.

        cells: by default about the square root of the number of vectors, at most an eighth of the sample, so that a query's
        cells and the vectors in them grow alike."""
        n, top = vectors.agg(F.count("*"), F.max("id")).first()
        if not n:
            raise NotReady("no vector to index")
        cells = cells or max(1, min(round(n**0.5), sample // 8))
        x = np.array([r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()], dtype=np.float64)  # a bounded sample
        c = x[: min(cells, len(x))].copy()
        for _ in range(rounds):
            own = _near(c, x, 1)[:, 0]
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = x[own == j].mean(axis=0)

        def place(batches):
            import pyarrow as pa

            for batch in batches:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, c.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(_near(c, v, 1)[:, 0], pa.int32())], names=["id", "v", "cell"])

        kind = f"id {vectors.schema['id'].dataType.simpleString()}, v {vectors.schema['v'].dataType.simpleString()}, cell int"
        return Index(c, stored(vectors.select("id", "v").mapInArrow(place, kind), precision), (n, top), reach(x, c, target=recall))

    def save(self, path: str) -> None:
        """Cells first; what they cover is written after they have landed."""
        self.cells.write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
        spark = self.cells.sparkSession
        told = json.dumps({"centroids": self.centroids.tolist(), "count": self.coverage[0], "top": self.coverage[1], "probes": self.probes})
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/coverage")

    @staticmethod
    def open(spark, path: str, vectors: DataFrame) -> Index:
        """Refused when it was never built, or covers other vectors than there are now."""
        try:
            told = json.loads(spark.read.text(f"{path}/coverage").first()[0])
        except Exception as e:
            raise NotReady("the index was never built") from e
        now = tuple(vectors.agg(F.count("*"), F.max("id")).first())
        if (told["count"], told["top"]) != now:
            raise NotReady("the index is stale: it covers other vectors")
        return Index(np.array(told["centroids"]), spark.read.parquet(f"{path}/cells"), now, told["probes"])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, sides: DataFrame | None = None) -> DataFrame:
        """The k best by exact scores over the `probes` nearest cells of each query; by default as many as reach the recall the index was built for.

        sides (id, side): only vectors on a side, and the k best of each. A cell is dealt in parts of about BLOCK vectors, and a query goes to the parts of its cells alone."""
        c, probes = self.centroids, min(probes or self.probes, len(self.centroids))
        parts = max(1, -(-self.coverage[0] // (BLOCK * len(c))))

        def choose(batches):
            import pyarrow as pa

            for batch in batches:
                near = _near(c, np.array(batch.column("v").to_pylist(), dtype=np.float64).reshape(-1, c.shape[1]), probes)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), probes))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(rows), batch.column("v").take(rows), pa.array(near.ravel(), pa.int32())], names=["qid", "v", "cell"])

        kind = f"qid {queries.schema['qid'].dataType.simpleString()}, v {queries.schema['v'].dataType.simpleString()}, cell int"
        asked = queries.select("qid", "v").mapInArrow(choose, kind)
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cells = self.cells if sides is None else self.cells.join(sides, "id")
        cells = cells.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        return ranked(_met(cells, asked, ["cell", "part"], k, 6), ["qid", *([] if sides is None else ["side"])], F.desc("score"), "id", k=k)


def laddered(index: Index, queries: DataFrame, locations: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """The k best visible of each side in the cells that a query looks into.

    A ladder of 1000, 4000 and 16000 neighbours would hand on all of them to fill both sides; here the cells know the sides, so a block
    hands on k of each, and no side stays unfilled while the cells hold more for it."""
    sides = locations.select(F.col("chunk").alias("id"), "side").distinct()
    return index.search(queries, k, probes, sides).select("qid", "side", F.col("id").alias("chunk"), "score", "rank")
