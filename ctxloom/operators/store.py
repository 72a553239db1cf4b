"""Content-addressed storage: ordinals, upserts, snapshots with an atomic pointer, and garbage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ctxloom.operators.written import written


class Incompatible(RuntimeError):
    """Stored vectors or schemas don't fit what is asked for."""


def with_ordinals(rows: DataFrame, order: list[str], start: int = 0, name: str = "ord") -> DataFrame:
    """Numbers rows from start in the given order without bringing them to one task: ranges, then an offset for each.

    The ranges are written with their numbers, so both reads of them see the same."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    local = written(dealt.withColumn("_m", F.monotonically_increasing_id()), "ranges")
    local = local.withColumn("_p", F.shiftright("_m", 33)).withColumn("_i", F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    offset = sizes.select("_p", (F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.lit(start)).alias("_o"))
    return local.join(F.broadcast(offset), "_p").withColumn(name, F.col("_i") + F.col("_o")).drop("_m", "_p", "_i", "_o")  # a row for each partition


def with_running(rows: DataFrame, group: str, order: str, value: str, name: str) -> DataFrame:
    """Adds what the rows of a group before a row sum up to, without bringing a group to one task: ranges, then an offset for each."""
    dealt = written(rows.repartitionByRange(group, order).withColumn("_p", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "_p").agg(F.sum(value).alias("_s"))
    past = lambda *by: W.partitionBy(*by).rowsBetween(W.unboundedPreceding, -1)
    offset = sums.select(F.col(group).alias("_g"), F.col("_p").alias("_q"), F.coalesce(F.sum("_s").over(past(group).orderBy("_p")), F.lit(0)).alias("_o"))
    local = dealt.withColumn("_i", F.coalesce(F.sum(value).over(past(group, "_p").orderBy(order)), F.lit(0)))
    out = local.join(offset, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q")))
    return out.withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_q", "_g", "_i", "_o")


def find_or_insert(stored: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows by key -> (key, ord, inserted): stored ordinals, and new ones behind the largest."""
    new = rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    top = stored.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    fresh = with_ordinals(new, order, top + 1).select(key, "ord", F.lit(True).alias("inserted"))
    return stored.join(rows.select(key).distinct(), key, "left_semi").select(key, "ord", F.lit(False).alias("inserted")).unionByName(fresh)


def first_placement(placed: DataFrame) -> DataFrame:
    """Placements by (blob, lang, chunk, start_line); of equal ones the first end_line stays."""
    return placed.groupBy("blob", "lang", "chunk", "start_line").agg(F.min("end_line").alias("end_line"))


def index_stats(files: DataFrame, placed: DataFrame, known: DataFrame) -> DataFrame:
    """One row of counts: files, new files, parsed documents, chunks, new chunks. known: (chunk)."""
    new = placed.select("chunk").distinct().join(known, "chunk", "left_anti")
    one = lambda df, *c: df.agg(*c)
    return one(files, F.count("*").alias("files"), F.count_distinct("blob").alias("blobs")).crossJoin(
        one(placed, F.count_distinct("blob", "lang").alias("parsed"), F.count_distinct("chunk").alias("chunks"))).crossJoin(one(new, F.count("*").alias("new_chunks")))


def garbage(branch_files: DataFrame, files: DataFrame, placed: DataFrame) -> DataFrame:
    """Chunks that no file of any branch holds."""
    live = files.join(branch_files.select("path").distinct(), "path", "left_semi").select("blob", "lang").distinct()
    alive = placed.join(live, ["blob", "lang"], "left_semi").select("chunk").distinct()
    return placed.select("chunk").distinct().join(alive, "chunk", "left_anti")


class Snapshots:
    """Tables under a folder, replaced all at once: versions are written beside each other, then a pointer is moved.

    The pointer is one small file, renamed into place, so a reader sees the tables before or after, never between."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _current(self) -> dict:
        at = self._path(f"{self.root}/CURRENT.json")
        if not self._fs.exists(at):
            return {"tables": {}, "meta": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/CURRENT.json").collect()))

    def commit(self, tables: dict[str, DataFrame], meta: dict | None = None, append: bool = False) -> None:
        """All tables are written before the pointer moves; when one fails nothing changes. append: the rows come to those that are there, which stay where they lie."""
        now, version = self._current(), uuid.uuid4().hex
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{version}/{name}")
            now["tables"][name] = [*(self._paths(now["tables"].get(name)) if append else []), f"{self.root}/{version}/{name}"]
        now["meta"] |= meta or {}
        out = self._fs.create(self._path(f"{self.root}/{version}._next"), True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        pointer = self._path(f"{self.root}/CURRENT.json")
        files, conf = self._jvm.org.apache.hadoop.fs.FileContext, self.spark._jsc.hadoopConfiguration()
        context = files.getFileContext(pointer.toUri(), conf) if pointer.toUri().getScheme() else files.getFileContext(conf)
        rename = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._path(f"{self.root}/{version}._next"), pointer, options)

    def table(self, name: str) -> DataFrame | None:
        at = self._paths(self._current()["tables"].get(name))
        return self.spark.read.parquet(*at) if at else None

    @staticmethod
    def _paths(at) -> list[str]:
        return [at] if isinstance(at, str) else at or []

    def meta(self, key: str, default=0):
        """A missing key reads as 0."""
        return self._current()["meta"].get(key, default)

    def pin(self, fingerprint: dict) -> None:
        """Fixes what stored vectors were made with; once there are vectors, any other value is refused by name."""
        held = self._current()["meta"].get("fingerprint")
        vectors = self.table("vectors")
        if held and vectors is not None and not vectors.isEmpty():
            for k, v in fingerprint.items():
                if held.get(k) != v:
                    raise Incompatible(f"stored vectors were made with {k} = {held.get(k)!r}, not {v!r}")
        else:
            self.commit({}, {"fingerprint": fingerprint})
