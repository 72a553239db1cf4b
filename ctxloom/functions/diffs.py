"""Unified diffs as column expressions: the files of a diff, and the lines of the old side that it touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sections(diff: Column) -> Column:
    """The part of each file, without its first mark."""
    return F.slice(F.split(F.concat(F.lit("\n"), diff), r"\ndiff --git "), F.lit(2), F.lit(2147483647))


def status(section: Column) -> Column:
    """A for a new file, D for one that goes, M for all others."""
    return F.when(section.rlike(r"\nnew file mode "), "A").when(section.rlike(r"\ndeleted file mode "), "D").otherwise("M")


def path(section: Column) -> Column:
    """The path on the new side; that of the old side where the file goes."""
    new, old = F.regexp_extract(section, r"\n\+\+\+ b/([^\n]*)", 1), F.regexp_extract(section, r"\n--- a/([^\n]*)", 1)
    return F.when(new != "", new).otherwise(old)


def hunks(section: Column) -> Column:
    """(start, stop) of the old lines of each hunk; a hunk that only inserts has none."""
    heads = F.regexp_extract_all(section, F.lit(r"\n@@ -([0-9]+(?:,[0-9]+)?) \+[0-9]"), F.lit(1))

    def span(head):
        start, count = F.split(head, ",")[0].cast("int"), F.coalesce(F.try_element_at(F.split(head, ","), F.lit(2)), F.lit("1")).cast("int")
        return F.when(count > 0, F.struct(start.alias("start"), (start + count - 1).alias("stop")))

    return F.array_compact(F.transform(heads, span))


def files_of(diffs: DataFrame, key: str = "qid") -> DataFrame:
    """(key, diff) -> (key, status, path, hunks), a row for each file of a diff."""
    s = F.col("section")
    return diffs.select(key, F.explode(sections(F.col("diff"))).alias("section")).select(key, status(s).alias("status"), path(s).alias("path"), hunks(s).alias("hunks"))


def ranges_of(files: DataFrame, key: str = "qid") -> DataFrame:
    """files_of -> (key, path, start, stop) of the changed files: new and removed ones have no lines to ask."""
    return files.where("status = 'M'").select(key, "path", F.inline("hunks"))
