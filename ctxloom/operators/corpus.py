"""Text tables as the retrieval data model: files on branches, blobs, chunks, placements.

A prose document is one file version whose lines are its chunks; the path says side and language like any
repository path. Everything is content addressed: equal texts share a blob, equal lines of a language share a chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxloom.functions.names import chunk_hash
from ctxloom.functions.paths import is_test, lang_of
from ctxloom.operators.written import written

EXT = {"de": ".c", "en": ".py", "fr": ".go", "es": ".md"}


@dataclass
class Corpus:
    """files (path, blob, doc_id, lang, side, text), branch_files (branch, path), placed (blob, lang, chunk, symbol, content, start_line, end_line)."""

    files: DataFrame
    branch_files: DataFrame
    placed: DataFrame

    def written(self, texts: bool = True) -> Corpus:
        """The same tables, written once: what reads them several times doesn't cut and hash the texts again. texts: with those of whole files."""
        return Corpus(written(self.files if texts else self.files.drop("text"), "files"), written(self.branch_files, "branch-files"), written(self.placed, "placed"))

    @property
    def chunks(self) -> DataFrame:
        """(chunk, symbol, content), each once."""
        return self.placed.select("chunk", "symbol", "content").dropDuplicates(["chunk"])

    def chunks_of(self, some: DataFrame) -> DataFrame:
        """chunks, but only those of `some` (chunk): they are picked before their texts are shuffled."""
        return self.placed.select("chunk", "symbol", "content").join(some.select("chunk").distinct(), "chunk", "left_semi").dropDuplicates(["chunk"])

    def locations(self, branch: str) -> DataFrame:
        """(chunk, side, path, start_line, end_line) of what the branch shows; the language of the path must be the chunk's."""
        shown = self.files.join(self.branch_files.where(F.col("branch") == branch).select("path"), "path", "left_semi")
        return self.placed.select("blob", "lang", "chunk", "start_line", "end_line").join(shown.select("blob", "lang", "side", "path"), ["blob", "lang"])

    def document_paths(self, branch: str) -> DataFrame:
        """(blob, lang, side, path) of whole-file documents that the branch shows."""
        shown = self.files.join(self.branch_files.where(F.col("branch") == branch).select("path"), "path", "left_semi")
        return shown.select("blob", "lang", "side", "path").join(self.placed.select("blob", "lang").distinct(), ["blob", "lang"], "left_semi")


def files_of(documents: DataFrame) -> DataFrame:
    ext = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in EXT.items() for x in p]), F.col("lang")), F.lit(".txt"))
    folder = F.when(F.col("doc_id") % 7 == 0, "tests/").otherwise("src/")
    path = F.concat("source", F.lit("/"), folder, F.lit("doc_"), F.col("doc_id").cast("string"), ext)
    files = documents.select("doc_id", path.alias("path"), F.sha2(F.col("text").cast("binary"), 256).alias("blob"), "text")
    return files.withColumn("lang", lang_of(F.col("path"))).withColumn("side", F.when(is_test(F.col("path")), "tests").otherwise("code"))


def branches_of(files: DataFrame) -> DataFrame:
    on = [F.when(F.col("doc_id") % 5 != 4, "main"), F.when(F.col("doc_id") % 3 != 2, "dev")]
    return files.select(F.explode(F.array_compact(F.array(*on))).alias("branch"), "path")


def from_documents(documents: DataFrame) -> Corpus:
    files = files_of(documents)
    once = files.where("lang > 0").groupBy("blob", "lang").agg(F.first("text").alias("text"))  # each blob and language is parsed once
    lines = once.select("blob", "lang", F.posexplode(F.split("text", "\n", -1)).alias("n", "content")).where(F.trim("content") != "")
    symbol = F.regexp_extract("content", r"^[^ ]*", 0)
    placed = lines.select("blob", "lang", chunk_hash(F.col("lang"), symbol, F.col("content")).alias("chunk"), symbol.alias("symbol"), "content",
                          (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line"))
    return Corpus(files, branches_of(files), placed)


def code_of(documents: DataFrame) -> DataFrame:
    """documents -> files (path, blob, lang, side, doc_id, text) of source code: each line is the comment of a function of its own.

    In Python they are methods of a class of the document, in Go of its type, in C plain functions; other texts stay prose."""
    files = files_of(documents).where("lang > 0")
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.regexp_replace(x, r"[\x00-\x1F\x7F\x85\u2028\u2029]", " "))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    python = F.transform(lines, lambda x, i: say("\n    def f", i + 1, "(self):\n        # ", x, "\n        return ", i + 1))
    c = F.transform(lines, lambda x, i: say("int f", i + 1, "(int x) {\n    // ", x, "\n    return ", i + 1, ";\n}"))
    go = F.transform(lines, lambda x, i: say("\nfunc (t *Doc", F.col("doc_id"), ") F", i + 1, "() int {\n\t// ", x, "\n\treturn ", i + 1, "\n}"))
    text = (F.when(F.col("lang") == 7, F.concat(say("class Doc", F.col("doc_id"), ":"), F.array_join(python, ""))).when(F.col("lang") == 1, F.array_join(c, "\n"))
            .otherwise(F.concat(F.lit("package docs"), F.array_join(go, ""))))
    return files.select("path", F.sha2(text.cast("binary"), 256).alias("blob"), "lang", "side", "doc_id", text.alias("text"))
