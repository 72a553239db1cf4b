"""Exact top-k by inner product, over norm-sorted vectors with SVD-rotated partial sums.

Vectors are quantised to integers, so scores are exact. The second moments of all vectors (a matrix of dim x dim,
summed per task) give an SVD rotation that puts most of a product into the first coordinates. Candidates lie in
blocks by descending length, and queries in blocks too; for each pair of blocks, candidates that the norm bound
|q||v| puts under the query's current k-th score end the block, a partial sum over the first `lead` rotated
coordinates plus the Cauchy-Schwarz bound of the rest prunes what can't reach it, and the survivors get the exact
integer product. The best k of each block pair meet in a window.

A task holds one block of candidates and one of queries, whatever the tables' sizes.

Defined cases: vectors that are null, empty, of another length than most, or hold null or non-finite components take no part,
neither as query nor as candidate. Repeated rows are candidates of their own; a query leaves out all rows of its own id.
Query rows that share an id but not a vector are all asked, and the best k of them together are the id's.
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.llm.common import matrix, plain, runs, stash

QUANTUM = 1024


def usable(vectors: DataFrame, name: str = "embedding") -> DataFrame:
    """Rows whose vector has only finite components, as doubles, and the length that most vectors have."""
    v = F.transform(F.col(name), lambda x: x.cast("double"))
    rows = vectors.withColumn("v", v).where(F.size("v") > 0)
    rows = rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (dim[0] if dim else 0))


def _moments(batches):
    import pyarrow as pa

    total = None
    for batch in batches:
        if batch.num_rows:
            v = np.array(batch.column("v").to_pylist(), dtype=np.float64)
            total = v.T @ v if total is None else total + v.T @ v
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])


def rotation(vectors: DataFrame) -> np.ndarray:
    """Columns: directions by falling second moment. One matrix of each task comes to the driver, as sums of pairs."""
    sums = vectors.select("v").mapInArrow(_moments, "m array<double>")
    added = sums.select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").collect()  # dim * dim rows
    m = np.array([r[1] for r in added])
    dim = int(round(len(m) ** 0.5))
    return np.linalg.svd(m.reshape(dim, dim))[0] if dim else np.zeros((0, 0))


def best(ids: np.ndarray, v: np.ndarray, qids: np.ndarray, q: np.ndarray, turn: np.ndarray, k: int, lead: int, step: int = 512):
    """The k best (query row, id, score) of each query among one block; v sorted by falling length."""
    norm, qnorm = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    a, b = v @ turn, q @ turn
    rest = np.sqrt(np.maximum((a[:, lead:] ** 2).sum(axis=1), 0))
    qrest = np.sqrt(np.maximum((b[:, lead:] ** 2).sum(axis=1), 0))
    slack = 1e-9 * (1 + norm.max(initial=0) * qnorm.max(initial=0))
    top_s, top_i = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for at in range(0, len(v), step):
        part = slice(at, at + step)
        kth = top_s[:, -1]
        alive = np.flatnonzero(qnorm * norm[at] + slack >= kth)
        if not len(alive):
            break
        bound = b[alive, :lead] @ a[part, :lead].T + qrest[alive, None] * rest[None, part] + slack
        could = bound >= kth[alive, None]
        columns, rows = np.flatnonzero(could.any(axis=0)), np.flatnonzero(could.any(axis=1))
        if not len(columns):
            continue
        exact = q[alive[rows]] @ v[part][columns].T  # integers under 2**53: exact
        exact[qids[alive[rows], None] == ids[part][columns][None, :]] = -np.inf
        names = np.broadcast_to(ids[part][columns], exact.shape)
        s, i = np.concatenate([top_s[alive[rows]], exact], axis=1), np.concatenate([top_i[alive[rows]], names], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, :k]
        top_s[alive[rows]], top_i[alive[rows]] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
    x, y = np.nonzero(np.isfinite(top_s))
    return x, top_i[x, y], top_s[x, y]


def _search(turn: np.ndarray, k: int, lead: int):
    def run(batches):
        import pyarrow as pa

        for t in runs(batches, "c", "b"):
            side = t.column("q").to_numpy(zero_copy_only=False).astype(bool)
            ids, v = t.column("vec_id").to_numpy(), matrix(t.column("v"), len(turn), np.float64)
            if side.all() or not side.any():
                continue
            x, i, s = best(ids[~side], v[~side], ids[side], v[side], turn, k, lead)
            yield pa.RecordBatch.from_arrays([pa.array(ids[side][x]), pa.array(i), pa.array(s.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, lead: int = 16, block: int = 16384, queries: int = 8192) -> DataFrame:
    """embeddings (vec_id, embedding) -> query_id, rank, vec_id, score. Queries: every row whose id `every` divides."""
    rows = usable(plain(vectors, "vec_id", "embedding")).where("vec_id is not null")
    whole = F.transform("v", lambda x: F.floor(x * QUANTUM).cast("double"))
    rows = stash(rows.select(F.col("vec_id").cast("long"), whole.alias("v")), "quantised")
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    asked = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id", "v"])
    n, m = rows.count(), asked.count()
    cells, asks = max(1, -(-n // block)), max(1, -(-m // queries))
    # Blocks of candidates by falling length: the bounds between them come from quantiles of the length.
    cuts = rows.select(length.alias("n")).approxQuantile("n", [i / cells for i in range(1, cells)], 0.001) if cells > 1 else []
    rank = sum((F.when(length < c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    bands = len(set(cuts)) + 1
    share = -(-cells // bands)  # vectors of one length are dealt over as many blocks as they need
    spread = F.pmod(F.xxhash64("vec_id"), F.lit(share))
    c = (rank * share + spread).cast("int")
    # Of each side, a row goes to every block of the other.
    cand = rows.select(c.alias("c"), F.explode(F.sequence(F.lit(0), F.lit(asks - 1))).alias("b"), F.lit(0).alias("q"), "vec_id", "v", length.alias("n"))
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(bands * share - 1))).alias("c"), F.pmod(F.xxhash64("vec_id"), F.lit(asks)).cast("int").alias("b"), F.lit(1).alias("q"), "vec_id", "v", F.lit(0.0).alias("n"))
    turn = rotation(rows)
    met = cand.select("c", "b", "q", "vec_id", "v", "n").unionByName(ask).repartition("c", "b").sortWithinPartitions("c", "b", F.desc("n"), "vec_id")
    found = met.select("c", "b", "q", "vec_id", "v").mapInArrow(_search(turn, k, lead), "query_id long, vec_id long, score long")
    by = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
