"""Git repositories as tables: branches, trees and blobs, read with the git program on the executors."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BLOB = 1 << 20


def git(repo: str, *args: str) -> bytes:
    done = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def branches(repo: str) -> list[tuple[str, str]]:
    """Local branches with their commits; what doesn't lead to a commit is passed over."""
    out = []
    for line in git(repo, "for-each-ref", "--format=%(refname:lstrip=2)%09%(objecttype)%09%(objectname)%09%(*objecttype)%09%(*objectname)", "refs/heads").decode().splitlines():
        name, kind, oid, inner_kind, inner = line.split("\t")
        if kind == "commit" or inner_kind == "commit":
            out.append((name, oid if kind == "commit" else inner))
    return out


def resolve(repo: str, rev: str) -> str:
    return git(repo, "rev-parse", "--verify", f"{rev}^{{commit}}").decode().strip()


class _Part(InputPartition):
    def __init__(self, name: str, commit: str):
        self.name, self.commit = name, commit


class _Reader(DataSourceReader):
    def __init__(self, repo: str, kind: str):
        self.repo, self.kind = repo, kind

    def partitions(self):
        found = branches(self.repo)
        return [_Part(n, c) for n, c in found] or [_Part("", "")]

    def read(self, part):
        if not part.commit:
            return
        if self.kind == "refs":
            yield part.name, part.commit
            return
        for entry in git(self.repo, "ls-tree", "-r", "-z", part.commit).decode(errors="surrogateescape").split("\0"):
            if entry:
                head, _, path = entry.partition("\t")
                mode, kind, oid = head.split()
                if kind == "blob" and mode != "120000":  # neither links nor submodules
                    yield part.name, path, oid


class GitRefs(DataSource):
    """spark.read.format("git_refs").load(repo) -> branch, commit."""

    @classmethod
    def name(cls):
        return "git_refs"

    def schema(self):
        return "branch string, commit string"

    def reader(self, schema):
        return _Reader(self.options["path"], "refs")


class GitTree(GitRefs):
    """spark.read.format("git_tree").load(repo) -> branch, path, blob: the files of every branch, a task each."""

    @classmethod
    def name(cls):
        return "git_tree"

    def schema(self):
        return "branch string, path string, blob string"

    def reader(self, schema):
        return _Reader(self.options["path"], "tree")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GitRefs)
    spark.dataSource.register(GitTree)


def read_blobs(repo: str, blobs: DataFrame) -> DataFrame:
    """(blob) -> (blob, size, text) of distinct blobs; over 1 MiB, or with a zero byte early on, the text is empty."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch-command", "--buffer"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
                ask = lambda what, oid: (p.stdin.write(f"{what} {oid}\nflush\n".encode()), p.stdin.flush(), p.stdout.readline().split())[2]
                for oid in pdf["blob"]:
                    head = ask("info", oid)  # the size before the bytes
                    if len(head) != 3:
                        raise RuntimeError(f"blob {oid} is missing")
                    data = b""
                    if int(head[2]) <= MAX_BLOB:
                        ask("contents", oid)
                        data = p.stdout.read(int(head[2]))
                        p.stdout.read(1)
                    rows.append((oid, int(head[2]), "" if b"\0" in data[:8000] else data.decode("utf-8", "replace")))
                p.stdin.close()
            yield pd.DataFrame(rows, columns=["blob", "size", "text"])

    return blobs.select("blob").distinct().mapInPandas(run, "blob string, size long, text string")


def read_work_tree(spark: SparkSession, root: str) -> DataFrame:
    """A folder of files -> path, size, text, under the same limits; sizes are filtered before bytes are read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).where(F.col("length") <= MAX_BLOB)
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    text = F.when(F.hex(F.substring("content", 1, 8000)).rlike("^(?:..)*?00"), "").otherwise(F.col("content").cast("string"))
    return rows.select(F.expr("substring(path, instr(path, '" + root.strip("/").replace("'", "''") + "') + " + str(len(root.strip("/")) + 1) + ")").alias("path"), F.col("length").alias("size"), text.alias("text")).withColumn("path", F.coalesce("path", path))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One object a line, its keys sorted."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)
