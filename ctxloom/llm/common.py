"""What the training-data operators share: tables in the shared folder, connected components, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


_local: dict[str, str] = {}
#: Spark deletes the shuffle files of a plan when the plan is done, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. Only a session on one machine may do without: it gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _local.get(app := spark.sparkContext.applicationId) or _local.setdefault(app, tempfile.mkdtemp(prefix="ctxloom-"))
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: a plan that no lost executor can take back.

    The path is on the frame as `stash_path`, for drop()."""
    path = f"{shared_dir(df.sparkSession)}/ctxloom-{name}-{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Deletes stashed tables that nothing needs any more."""
    for df in frames:
        path = getattr(df, "stash_path", None)
        if path:
            jvm = df.sparkSession._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (src, dst) -> (node, root): root is the smallest node that links reach.

    Alternates large-star and small-star steps, each a min per node with partial aggregation and a join that
    AQE can split, so a node with very many links is no single task. Each round is a table in the shared folder.
    Nodes without links aren't returned; an empty input gives an empty table."""
    e = edges.where("src is not null and dst is not null and src <> dst")
    e = e.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = stash(e, "edges")
    for _ in range(rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # An edge to the least neighbour stays; the other neighbours move to it.
        small = large.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct()
        then = stash(small, "edges")
        drop(now)
        now = then
        forked = now.groupBy("u").count().where("count > 1").select("u")
        chained = now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if forked.unionByName(chained).isEmpty():  # every node points at a root
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merged_components(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, root), a stashed table, and more links (src, dst) -> (node, root) of both: only the roots that the links join are worked on again."""
    root = checked(parts)
    ends = links.join(root.toDF("src", "x"), "src", "left").join(root.toDF("dst", "y"), "dst", "left")
    over = stash(connected_components(ends.select(F.coalesce("x", "src").alias("src"), F.coalesce("y", "dst").alias("dst"))).toDF("root", "top"), "roots")
    moved = parts.join(checked(over), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    alone = over.toDF("node", "root").join(parts.select("node"), "node", "left_anti")
    out = stash(moved.unionByName(alone), "parts")
    drop(over)
    return out


# --- word hashes over whole Arrow batches -------------------------------------------------------

MULT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(MULT), -1, 1 << 64))
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Between words of letters, digits and bytes beyond ASCII.
MARKS = np.array([not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128) for b in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser over 64 bits: near inputs give unrelated outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; by sorting, which for whole numbers is quicker than np.unique's hash table."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def constants(n: int, salt: int) -> np.ndarray:
    """n odd 64-bit constants, the same on every machine."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(salt)) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT**i and its inverse, i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", MULT), ("down", _INVERSE)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """The words of some texts that lie one after another in a buffer of UTF-8 bytes.

    start, end: of each word, in bytes; doc: the text it is in; first: where each text's words begin (len texts + 1)."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE):
        self.buf, self.offsets = buf, offsets
        space = np.ones(len(buf) + 2, dtype=bool)
        space[1:-1] = between[buf]
        starts = ~space[1:-1] & space[:-2]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        starts[inner] = ~space[inner + 1]
        self.start = np.flatnonzero(starts)
        ends = ~space[1:-1] & space[2:]
        ends[inner - 1] = ~space[inner]
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    def sums(self, fold: np.ndarray) -> np.ndarray:
        up, _ = powers(len(self.buf) + 1)
        s = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum((fold[self.buf].astype(np.uint64) + np.uint64(1)) * up[: len(self.buf)], out=s[1:])
        return s

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        _, down = powers(len(self.buf) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def texts_in_chunks(column, limit: int = 1 << 20):
    """An Arrow string column -> (first row, buffer, offsets) of about `limit` bytes each, or one longer text. Nulls are empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, len(column))
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def runs(batches, *keys: str):
    """Arrow batches sorted by long or int keys -> one table for each run of equal keys, across batches."""
    import pyarrow as pa

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(k[:, a])
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def matrix(column, width: int, kind) -> np.ndarray:
    """An Arrow column of equally long lists -> rows x width."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; extra ones, whatever they are called, go."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def masked(df: DataFrame, *names: str) -> DataFrame:
    """df whose columns other than `names` are called extra_0, extra_1, ...: whatever they were called, no operator's own column meets them. toDF() gives them their names back."""
    return df.toDF(*[c if c in names else f"extra_{i}" for i, c in enumerate(df.columns)])


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels no classifier may learn from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


#: Rows of a few longs that may be broadcast; more are shuffled.
BROADCAST_ROWS = 250_000


def checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where it has `most` rows or fewer; otherwise Spark joins by shuffling. df should be a stashed table."""
    return F.broadcast(df) if df.count() <= most else df
