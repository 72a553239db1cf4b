"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the two together are a grid of cells, and every row lies in the
cell of its nearest centroids. A row visits cells in the order of a multi-sequence traversal: the cells of each half
sorted by how far the row lies from their border, the product grid walked from the nearest pair outward, until the border
lies so far off that a partner across it would leave the target recall. A pair is met if one of the two visits
the other's cell, and verified by its cosine in double precision.

The border of a cell is the bisector between its centroid and the row's own. A partner at distance d (0.316 at cosine
0.95) moves across a bisector by d / sqrt(spread) times a normal deviate, so visiting cells within `reach` of those finds the target share
of partners at the threshold, and more of the closer ones.

Codebooks are fitted on a bounded sample: `sample` rows by hash order. Everything else covers all rows. Equal vectors are
one class that counts as often as it has rows. Large cells are dealt in blocks, so a task holds two blocks of rows; pairs
are counted inside and leave as counts and a spanning set of links.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components link
with nothing (n_links 0, kept). Rows that share a vec_id are rows of their own, with one component. Extra columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.llm.common import connected_components, matrix, plain, runs, stash
from ctxloom.llm.topk import usable


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; the first centroids are spread over x as it comes."""
    k = min(k, len(x))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = (x @ c.T - (c * c).sum(axis=1) / 2).argmax(axis=1)
        n = np.bincount(own, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def margins(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance from the border of every other cell."""
    d = ((c * c).sum(axis=1) - 2 * x @ c.T)
    own = d.argmin(axis=1)
    gap = np.sqrt(np.maximum(((c[:, None, :] - c[None, :, :]) ** 2).sum(axis=2), 1e-30))
    return own, np.maximum((d - d[np.arange(len(x)), own][:, None]) / (2 * gap[own]), 0)


def visited(m1: np.ndarray, m2: np.ndarray, reach: float) -> list[int]:
    """The cells that one row visits, nearest first: both halves in order of margin, the grid outward until the sum of squares is over reach squared."""
    o1, o2 = np.argsort(m1, kind="stable"), np.argsort(m2, kind="stable")
    s1, s2, out = m1[o1] ** 2, m2[o2] ** 2, []
    for i in range(int(np.searchsorted(s1, reach**2, side="right"))):
        n = int(np.searchsorted(s2, reach**2 - s1[i], side="right"))
        out += [(s1[i] + s2[j], int(o1[i]) * len(m2) + int(o2[j])) for j in range(n)]
    return [cell for _, cell in sorted(out)]


def _deal(c1: np.ndarray, c2: np.ndarray, reach: float):
    def run(batches):
        import pyarrow as pa

        half = c1.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"), half + c2.shape[1], np.float64)
            own1, m1 = margins(v[:, :half], c1)
            own2, m2 = margins(v[:, half:], c2)
            cells = [visited(m1[i], m2[i], reach) for i in range(len(v))]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), batch.column("n"), batch.column("v"),
                pa.array(own1 * len(c2) + own2, pa.int64()), pa.array(cells, pa.list_(pa.int64()))], names=["cls", "n", "v", "home", "cells"])

    return run


def local_parts(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least index that links reach, for each of n."""
    p = np.arange(n)
    while True:
        low = np.minimum(p[x], p[y])
        q = p.copy()
        np.minimum.at(q, x, low)
        np.minimum.at(q, y, low)
        q = q[q]
        if (q == p).all():
            return p
        p = q


def _verify(least: float, dim: int):
    """Runs of (cell, block of visitors, block of residents) -> per class the weight of its partners there, and a link into its local part."""

    def run(batches):
        import pyarrow as pa

        for t in runs(batches, "cell", "i", "j"):
            side = t.column("side").to_numpy(zero_copy_only=False).astype(bool)
            if side.all() or not side.any():
                continue
            cls, n = t.column("cls").to_numpy(), t.column("n").to_numpy()
            v = matrix(t.column("v"), dim, np.float64)
            both = t.column("mutual").to_pylist()
            home, cells = t.column("home").to_numpy(), [set(c) if c else () for c in both]
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            found = []
            for k in range(0, len(a), 512):
                rows = a[k : k + 512]
                x, y = np.nonzero(v[rows] @ v[b].T >= least)
                x, y = rows[x], b[y]
                keep = cls[x] != cls[y]
                x, y = x[keep], y[keep]
                # met from both ends: counted where the smaller class is the visitor
                again = np.fromiter((int(h) in cells[r] for h, r in zip(home[x], y)), bool, len(x)) & (cls[x] > cls[y])
                found.append((x[~again], y[~again]))
            x, y = (np.concatenate(z) for z in zip(*found))
            if not len(x):
                continue
            links = np.bincount(x, n[y], len(cls)) + np.bincount(y, n[x], len(cls))
            part = local_parts(len(cls), x, y)
            hit = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array(links[hit].astype(np.int64)), pa.array(cls[part[hit]])], names=["cls", "links", "into"])

    return run


def spread(x: np.ndarray) -> float:
    """In how many directions the vectors of a sample spread: all of them if each takes an equal share of the variance, 1 if they lie on a line.

    Two near vectors differ along these directions, so a difference of length d goes d / sqrt(spread) along one of them on average; no more than d ever."""
    share = np.linalg.eigvalsh(np.cov(x.T).reshape(x.shape[1], -1)) if len(x) > 1 else np.zeros(1)
    return float(max(1.0, share.sum() ** 2 / max((share**2).sum(), 1e-300)))


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, deviations: float = 3.0, sample: int = 20_000, per_cell: int = 256, block: int = 4096) -> DataFrame:
    """embeddings (vec_id, embedding) -> vec_id, n_links, component_id, kept."""
    vectors = plain(vectors, "vec_id", "embedding").select(F.col("vec_id").cast("long"), "embedding")
    good = usable(vectors.where("vec_id is not null"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    good = good.withColumn("norm", norm).where("norm > 0").select("vec_id", F.transform("v", lambda x: x / F.col("norm")).alias("v"))
    good = stash(good.withColumn("cls", F.xxhash64("v")), "unit")
    classes = stash(good.groupBy("cls").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    count = classes.count()
    if not count:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    x = np.array([r[0] for r in classes.orderBy(F.xxhash64("cls")).limit(sample).select("v").collect()])  # the bounded sample
    dim, half = x.shape[1], x.shape[1] // 2
    k = int(np.clip(round((count / per_cell) ** 0.5), 1, 1024))
    c1, c2 = codebook(x[:, :half], k), codebook(x[:, half:], k)
    reach = np.sqrt(2 - 2 * cosine) * min(1.0, deviations / np.sqrt(spread(x)))
    dealt = stash(classes.select("cls", "n", "v").mapInArrow(_deal(c1, c2, reach), "cls long, n long, v array<double>, home long, cells array<long>"), "dealt")
    visits = dealt.select(F.explode("cells").alias("cell"), "cls", "n", "v", "home", F.lit(1).alias("side"))
    homes = dealt.select(F.col("home").alias("cell"), "cls", "n", "v", "home", "cells", F.lit(0).alias("side"))
    sizes = homes.groupBy("cell").agg(F.count("*").alias("h")).join(visits.groupBy("cell").agg(F.count("*").alias("w")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("w") / block).cast("int").alias("bi"), F.ceil(F.col("h") / block).cast("int").alias("bj"))  # k * k rows
    sizes = stash(sizes, "cells")
    small = F.broadcast(sizes) if k * k <= 100_000 else sizes
    own = lambda c: F.pmod(F.xxhash64("cls"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    no = F.lit(None).cast("array<long>").alias("mutual")
    left = visits.join(small, "cell").select("cell", own("bi").alias("i"), every("bj").alias("j"), "side", "cls", "n", "v", "home", no)
    right = homes.join(small, "cell").select("cell", every("bi").alias("i"), own("bj").alias("j"), "side", "cls", "n", "v", "home", F.col("cells").alias("mutual"))
    met = left.unionByName(right).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    found = stash(met.mapInArrow(_verify(cosine, dim), "cls long, links long, into long"), "found")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("cls").alias("src"), F.col("into").alias("dst"))).toDF("cls", "root")
    named = classes.select("cls", "rep", "n").join(parts, "cls", "left").join(links, "cls", "left")
    named = named.select("cls", "rep", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("cls", "n_links", "component_id")
    out = good.select("vec_id", "cls").join(named, "cls").select("vec_id", "n_links", "component_id").dropDuplicates()
    seen = out.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = vectors.select("vec_id").join(seen, "vec_id", "left")
    rows = rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
