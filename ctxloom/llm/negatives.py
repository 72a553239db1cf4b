"""Mines hard negatives by distributed radix selection.

Every anchor has positives, its nearest rows of the same label, and every positive opens a window of scores in which rows
of other labels are hard negatives. The k-th best score of a window is located by digits: the rows inside the current
range of scores are counted in 64 buckets, the counts of all blocks are added up, the bucket that holds the k-th becomes
the range, and so on until few rows lie over its lower end, or until it is one score. Ties at that score are broken by
id, so they are selected by the digits of the id in the same way. Only then the rows over the threshold are gathered.

Rows lie in blocks and anchors in blocks; a task holds one of each and works in tiles. No block gives more than 64 counts
or k rows for a window, and later rounds ask only the anchors with an open window.

Defined cases: rows whose id, label or vector is null, whose vector is empty or holds a null or non-finite component take no part, nor do
those with a component of 2**18 or more in size (scores beyond 64 bits). Vectors of different lengths don't meet. Repeated rows, and rows that share an id, are
rows of their own, as anchors, positives and negatives; only an anchor's own row isn't its positive. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.llm.common import drop, matrix, plain, runs, stash

QUANTUM, LIMIT = 256, 1 << 26
BUCKETS = 64
#: A window with so many rows over its bucket's lower end, or fewer, is gathered.
FEW = 64
WINDOWS = "array<struct<p:int,lo:bigint,hi:bigint,tie:boolean,idlo:bigint,idhi:bigint,top:bigint>>"


def quantised(vectors: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> a stashed table (row, vec_id, label, d, v): rows that take part, relabelled where 7 divides the id."""
    rows = plain(vectors, "vec_id", "embedding", "label").where("vec_id is not null and label is not null and size(embedding) > 0")
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * QUANTUM)).alias("v"),
                       F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * QUANTUM) < LIMIT), F.lit(False))).alias("fit"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.where("fit").select("vec_id", label.alias("label"), F.size("v").alias("d"), F.col("v").cast("array<int>").alias("v"))
    return stash(rows.withColumn("row", F.monotonically_increasing_id()), "quantised")  # numbered once, as it is written


class Grid:
    """Blocks of rows against blocks of anchors."""

    def __init__(self, rows: DataFrame, every: int, block: int, asks: int):
        self.rows, self.anchors = rows, rows.where(F.col("vec_id") % every == 0)
        n, m = rows.count(), self.anchors.count()
        self.n = n
        # Blocks of their full size on large tables; on small ones as many as there are tasks at once.
        tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
        self.cells, self.asks = max(-(-n // block), min(-(-n // 2048), tasks), 1), max(-(-m // asks), 1)

    def met(self, asked: DataFrame) -> DataFrame:
        """asked (row, vec_id, label, d, v, wins) beside the rows, sorted by cell."""
        cell = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        names = ["d", "b", "c", "q", "row", "vec_id", "label", "v", "wins"]
        cand = self.rows.select("d", each(self.asks).alias("b"), cell(self.cells).alias("c"), F.lit(0).alias("q"), "row", "vec_id", "label", "v", F.lit(None).cast(WINDOWS).alias("wins"))
        ask = asked.select("d", cell(self.asks).alias("b"), each(self.cells).alias("c"), F.lit(1).alias("q"), "row", "vec_id", "label", "v", "wins")
        return cand.select(*names).unionByName(ask.select(*names)).repartition("d", "b", "c").sortWithinPartitions("d", "b", "c", "q")


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in floating point where that is exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * v.shape[1]
    if bound < 2**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _tiles(batches, tile: int = 128):
    """Cells -> (ids, rows, labels of the candidates; anchor's row and label, its windows, its scores) for each anchor."""
    for t in runs(batches, "d", "b", "c"):
        side = t.column("q").to_numpy(zero_copy_only=False).astype(bool)
        if side.all() or not side.any():
            continue
        d = t.column("d")[0].as_py()
        v = matrix(t.column("v"), d, np.int64)
        ids, rows, labels = (t.column(c).to_numpy() for c in ("vec_id", "row", "label"))
        wins = t.column("wins").take(np.flatnonzero(side)).to_pylist()
        asked = np.flatnonzero(side)
        own = ids[~side], rows[~side], labels[~side]
        for k in range(0, len(asked), tile):
            part = asked[k : k + tile]
            for x, s in zip(range(k, k + len(part)), products(v[part], v[~side])):
                yield own, rows[asked[x]], labels[asked[x]], wins[x], s


def _first(ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best: higher scores first, ties by smaller id."""
    if len(s) > k:
        kth = np.partition(s, len(s) - k)[len(s) - k]
        at = np.flatnonzero(s >= kth)
        return at[np.lexsort((ids[at], -s[at]))[:k]]
    return np.lexsort((ids, -s))


def _positives(k: int):
    def run(batches):
        for (ids, rows, labels), a, label, _, s in _tiles(batches):
            at = np.flatnonzero((labels == label) & (rows != a))
            at = at[_first(ids[at], s[at], k)]
            yield from _out(a, [0] * len(at), ids[at], s[at])

    return _gathered(run, "a", "p", "id", "score")


def _out(a, p, ids, s):
    for x, i, y in zip(p, ids.tolist(), s.tolist()):
        yield int(a), x, i, y


def _gathered(rows, *names: str):
    """Rows of longs, in batches."""

    def run(batches):
        held = []
        for r in rows(batches):
            held.append(r)
            if len(held) == 65536:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    def _batch(held):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.array(held, dtype=np.int64).T], names=list(names))

    return run


def _counts(batches):
    """How many rows of other labels lie in each bucket of each open window: buckets by falling score, those of ties by rising id."""
    for (ids, _, labels), a, label, wins, s in _tiles(batches):
        other = labels != label
        ids, s = ids[other], s[other]
        for w in wins:
            if w["tie"]:
                x = ids[(s == w["lo"]) & (ids >= w["idlo"]) & (ids <= w["idhi"])]
                x = (x.view(np.uint64) - np.uint64(w["idlo"] % (1 << 64))) // np.uint64(width(w["idlo"], w["idhi"]))
            else:
                x = s[(s >= w["lo"]) & (s <= w["hi"])]
                x = (w["hi"] - x) // width(w["lo"], w["hi"])
            n = np.bincount(x.astype(np.int64), minlength=BUCKETS)
            for b in np.flatnonzero(n).tolist():
                yield int(a), w["p"], b, int(n[b])


def width(lo: int, hi: int) -> int:
    return (hi - lo) // BUCKETS + 1


def _qualifying(k: int):
    """The rows over the thresholds of each window, k of a block at most: no more can be among the first k."""

    def run(batches):
        for (ids, _, labels), a, label, wins, s in _tiles(batches):
            other = labels != label
            ids, s = ids[other], s[other]
            for w in wins:
                over = (s > w["lo"]) & (s <= w["top"]) | (s == w["lo"]) & (ids <= w["idhi"])
                at = np.flatnonzero(over)
                at = at[_first(ids[at], s[at], k)]
                yield from _out(a, [w["p"]] * len(at), ids[at], s[at])

    return _gathered(run, "a", "p", "id", "score")


def refined(state: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """state (a, p, lo, hi, above, tie, idlo, idhi, open) and the buckets' counts (a, p, bucket, n) -> the state one digit further.

    above: the rows that come before the current range. The bucket of the k-th row becomes the range; where fewer than k rows are left, all of them qualify."""
    sums = counts.groupBy("a", "p", "bucket").agg(F.sum("n").alias("n"))
    by = W.partitionBy("a", "p").orderBy("bucket")  # 64 rows at most
    sums = sums.withColumn("to", F.sum("n").over(by)).join(state.where("open").select("a", "p", "above"), ["a", "p"])
    hit = sums.where("above + to >= %d and above + to - n < %d" % (k, k)).select("a", "p", "bucket", F.col("n").alias("inside"), (F.col("above") + F.col("to") - F.col("n")).alias("before"))
    s = state.join(hit, ["a", "p"], "left")
    found = F.col("open") & F.col("bucket").isNotNull()
    wide = lambda lo, hi: F.expr(f"({hi} - {lo}) div {BUCKETS} + 1")
    hi = F.col("hi") - F.col("bucket") * wide("lo", "hi")
    lo = F.greatest(F.col("lo"), hi - wide("lo", "hi") + 1)
    # Widths of ids are worked out by halves, so that the whole range of longs fits.
    wide_id = F.expr(f"(idhi div {BUCKETS} - idlo div {BUCKETS} + (idhi % {BUCKETS} - idlo % {BUCKETS} + 2 * {BUCKETS}) div {BUCKETS} - 1)")
    idlo = F.col("idlo") + F.col("bucket") * wide_id
    idhi = F.least(F.col("idhi"), F.try_add(idlo, wide_id - 1))
    score, by_id = found & ~F.col("tie"), found & F.col("tie")
    s = s.select("a", "p", "prow", "ps", "top", F.when(score, lo).otherwise(F.col("lo")).alias("lo"), F.when(score, hi).otherwise(F.col("hi")).alias("hi"),
                 F.when(found, F.col("before")).otherwise(F.col("above")).alias("above"), "tie", F.when(by_id, idlo).otherwise(F.col("idlo")).alias("idlo"),
                 F.when(by_id, idhi).otherwise(F.col("idhi")).alias("idhi"), "open", "inside", "bucket")
    few = F.col("bucket").isNull() | (F.col("above") + F.col("inside") <= FEW)
    one = F.when(F.col("tie"), F.col("idlo") == F.col("idhi")).otherwise(F.col("lo") == F.col("hi"))
    # One score with many rows goes on by id; one id with many rows is settled, since they are alike.
    s = s.withColumn("still", F.col("open") & ~few & ~(one & F.col("tie"))).withColumn("tie", F.col("tie") | (F.col("still") & one))
    return s.select("a", "p", "prow", "ps", "top", "lo", "hi", "above", "tie", "idlo", "idhi", F.col("still").alias("open"))


def mine(vectors: DataFrame, positives: int = 5, k: int = 3, every: int = 50, block: int = 32768, asks: int = 4096) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors: every row whose id `every` divides. positives, k: how many of an anchor, and how many negatives of a positive."""
    rows = quantised(vectors)
    grid = Grid(rows, every, block, asks)
    none = F.lit(None).cast(WINDOWS).alias("wins")
    near = grid.met(grid.anchors.select("d", "row", "vec_id", "label", "v", none)).mapInArrow(_positives(positives), "a long, p long, id long, score long")
    best = W.partitionBy("a").orderBy(F.desc("score"), "id")
    near = near.withColumn("p", F.row_number().over(best)).where(F.col("p") <= positives)
    ids = rows.agg(F.min("vec_id"), F.max("vec_id")).first()
    # 50 * ps <= 100 * score <= 95 * ps in whole numbers.
    lo, top = F.expr("score div 2 + if(score % 2 > 0, 1, 0)"), F.expr("19 * (score div 20) + 19 * (score % 20) div 20 - if(19 * (score % 20) % 20 < 0, 1, 0)")
    state = near.select("a", F.col("p").cast("int"), F.col("id").alias("prow"), F.col("score").alias("ps"), lo.alias("lo"), top.alias("top")).where("lo <= top")
    state = state.withColumn("hi", F.col("top")).withColumn("above", F.lit(0).cast("long")).withColumn("tie", F.lit(False))
    state = stash(state.withColumn("idlo", F.lit(ids[0]).cast("long")).withColumn("idhi", F.lit(ids[1]).cast("long")).withColumn("open", F.lit(True)), "windows")

    def asking(some: DataFrame) -> DataFrame:
        wins = some.groupBy("a").agg(F.collect_list(F.struct("p", "lo", "hi", "tie", "idlo", "idhi", "top")).alias("wins"))  # as many as an anchor has positives
        return grid.met(grid.anchors.join(wins, F.col("row") == F.col("a")).select("d", "row", "vec_id", "label", "v", "wins"))

    while not (live := state.where("open")).isEmpty():
        counts = asking(live).mapInArrow(_gathered(_counts, "a", "p", "bucket", "n"), "a long, p long, bucket long, n long")
        then = stash(refined(state, counts, k), "windows")
        drop(state)
        state = then
    found = asking(state).mapInArrow(_qualifying(k), "a long, p long, id long, score long")
    first = W.partitionBy("a", "p").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    named = state.select("a", "p", "prow", "ps").join(grid.anchors.select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id")), "a")
    return found.join(named, ["a", "p"]).select("anchor_id", F.col("prow").alias("positive_id"), F.col("rank").cast("int"), F.col("id").alias("negative_id"),
                                                 F.col("ps").alias("positive_score"), F.col("score").alias("negative_score"))
