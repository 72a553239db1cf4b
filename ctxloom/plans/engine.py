"""The engine: index branches of a repository, answer batches of queries by a route, list symbols, serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxloom.functions.chunking import chunk_files
from ctxloom.functions.models import hashed_embedding
from ctxloom.functions.names import chunk_hash, embed_text
from ctxloom.functions.paths import indexable, is_test, lang_of
from ctxloom.operators import fusion, lexical, store, vectors
from ctxloom.operators.corpus import Corpus
from ctxloom.sources import git
from ctxloom.streaming import requests, sync

ROUTES = {"lexical": (("lexical", 1.0),), "vector": (("vector", 1.0),), "ann": (("ann", 1.0),), "hybrid": (("lexical", 0.5), ("ann", 1.0))}


class Engine:
    """State is a folder of snapshots; every commit replaces its tables together."""

    def __init__(self, spark: SparkSession, root: str, embed=hashed_embedding, max_bytes: int = 16384):
        self.spark, self.root, self.embed, self.max_bytes = spark, root.rstrip("/"), embed, max_bytes
        self.store = store.Snapshots(spark, self.root)

    def index(self, repo: str) -> dict:
        """Indexes every branch that moved; a blob is parsed once for all branches and runs. Returns counts."""
        git.register(self.spark)
        refs = self.spark.read.format("git_refs").load(repo)
        had = self.store.table("branches")
        if had is not None and refs.join(had, ["branch", "commit"], "left_anti").isEmpty() and had.join(refs, "branch", "left_anti").isEmpty():
            return {"changed": 0}
        tree = self.spark.read.format("git_tree").load(repo).where(indexable(F.col("path")))
        files = tree.select("path", "blob").distinct().withColumn("lang", lang_of(F.col("path"))).withColumn("side", F.when(is_test(F.col("path")), "tests").otherwise("code"))
        parsed, placed = self.store.table("parsed"), self.store.table("placed")
        todo = files.where("lang > 0").select("blob", "lang").distinct()
        todo = todo if parsed is None else todo.join(parsed, ["blob", "lang"], "left_anti")
        text = git.read_blobs(repo, todo).select("blob", "text")
        new = chunk_files(todo.join(text, "blob")).withColumn("chunk", chunk_hash(F.col("lang"), F.col("symbol"), F.col("content")))
        new = store.first_placement(new).join(new.dropDuplicates(["blob", "lang", "chunk"]).select("blob", "lang", "chunk", "kind", "symbol", "content"), ["blob", "lang", "chunk"])
        cols = ["blob", "lang", "chunk", "kind", "symbol", "content", "start_line", "end_line"]
        self.store.commit({
            "branches": refs, "files": files, "branch_files": tree.select("branch", "path", "blob"),
            "parsed": todo if parsed is None else parsed.unionByName(todo),
            "placed": new.select(*cols) if placed is None else placed.select(*cols).unionByName(new.select(*cols)),
        })
        return {"changed": refs.count(), "files": files.count(), "parsed": todo.count(), "chunks": self.corpus("").chunks.count()}

    def corpus(self, branch: str) -> Corpus:
        files, on = self.store.table("files"), self.store.table("branch_files")
        if files is None:
            raise vectors.NotReady("nothing is indexed")
        if branch and on.where(F.col("branch") == branch).isEmpty():
            raise KeyError(f"unknown branch {branch}")
        # A path may hold another blob on another branch: only the branch's own versions count.
        if branch:
            files = files.join(on.where(F.col("branch") == branch).select("path", "blob"), ["path", "blob"], "left_semi")
        return Corpus(files, on.select("branch", "path").distinct(), self.store.table("placed"))

    def build_vectors(self) -> int:
        """Embeds the chunks that have no vector; vectors of one fingerprint alone are kept together."""
        self.store.pin({"model": getattr(self.embed, "__name__", "custom"), "max_bytes": self.max_bytes})
        texts = self.corpus("").chunks.select("chunk", embed_text(F.col("symbol"), F.col("content"), self.max_bytes).alias("text"))
        embed = self.embed
        sync.embed_pending(texts, self.store, lambda batch: [embed(t) for t in batch])
        have = self.store.table("vectors")
        return 0 if have is None else have.count()

    def build_index(self, cells: int | None = None) -> None:
        v = self.store.table("vectors")
        if v is None:
            raise vectors.NotReady("no vector to index")
        vectors.Index.build(v.select(F.col("chunk").alias("id"), "v"), cells).save(f"{self.root}/ann")

    def search(self, queries: DataFrame, branch: str, route: str = "lexical", k: int = 200, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """queries (qid, query) -> (chunks, files), both by qid and side."""
        c = self.corpus(branch)
        every = self.corpus("")
        locs = c.locations(branch)
        lanes = []
        for kind, weight in ROUTES[route]:
            if kind == "lexical":
                top = fusion.visible_top(lexical.chunk_scores(every.chunks, queries, k, locs), locs, k)
                by_doc = fusion.files_by_document(lexical.file_scores(every.placed, queries, k, c.document_paths(branch)), c.document_paths(branch), k)
                lanes.append(fusion.Lane(top, [fusion.files_by_first_chunk(top, locs), by_doc], weight))
                continue
            v = self.store.table("vectors")
            if v is None:
                raise vectors.NotReady("no chunk has a vector yet")
            vectors.require_all(every.chunks, v)
            asked = self._asked(queries)
            v = v.select(F.col("chunk").alias("id"), "v")
            if kind == "vector":
                top = vectors.nearest_visible(v, asked, locs, k)
            else:
                top = vectors.laddered(vectors.Index.open(self.spark, f"{self.root}/ann", v), asked, locs, k, probes)
            lanes.append(fusion.Lane(top, [fusion.files_by_first_chunk(top, locs)], weight))
        files = fusion.fused_files(lanes)
        return fusion.fused_chunks(lanes, files, locs, k), files

    def _asked(self, queries: DataFrame) -> DataFrame:
        embed = self.embed

        def run(batches):
            import pandas as pd

            for pdf in batches:
                yield pd.DataFrame({"qid": pdf["qid"], "v": [embed(t) for t in pdf["query"]]})

        return queries.select(F.col("qid").cast("long"), "query").mapInPandas(run, "qid long, v array<float>")

    def symbols(self, branch: str) -> DataFrame:
        """Function names of a branch, path::name, one for each place."""
        c = self.corpus(branch)
        return c.locations(branch).join(self.store.table("placed").where("kind = 0 and symbol <> ''").select("chunk", "symbol").distinct(), "chunk").select(F.concat("path", F.lit("::"), "symbol").alias("symbol"))

    def chunk_text(self, chunk: str) -> str:
        row = self.corpus("").chunks.where(F.col("chunk") == chunk).select("content").first()
        if row is None:
            raise KeyError(f"unknown chunk {chunk}")
        return row[0]

    def answer(self, query: str, branch: str, route: str = "lexical", k: int = 200) -> str:
        """One query's nested answer as JSON: the text that serving returns."""
        q = self.spark.createDataFrame([(0, query)], "qid long, query string")
        chunks, files = self.search(q, branch, route, k)
        c = self.corpus(branch)
        row = fusion.results(chunks, files, c.locations(branch), c.chunks).first()
        return row["result"] if row else '{"code":null,"tests":null}'

    def answers(self, branch: str, route: str = "lexical", k: int = 200):
        """What requests.serve_stream asks: (qid, query) -> (qid, text), all queries of a micro-batch in one search."""

        def told(queries: DataFrame) -> DataFrame:
            chunks, files = self.search(queries, branch, route, k)
            c = self.corpus(branch)
            return fusion.results(chunks, files, c.locations(branch), c.chunks).select("qid", F.col("result").alias("text"))

        return told

    def serve(self, lines: DataFrame, branch: str, target: str, checkpoint: str, route: str = "lexical", k: int = 200) -> None:
        """Answers a stream of request lines (value) into target."""
        requests.serve_stream(lines, self.answers(branch, route, k), target, checkpoint)
