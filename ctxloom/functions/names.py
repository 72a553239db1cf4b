"""Symbol names, hashes, model inputs and scores as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RRF_K = 60


def normalise_symbol(name: str) -> str:
    """A definition's name without type arguments, parameters, pointers and return type, separated by ::."""
    depth = {"<": 0, "(": 0}
    closes = {">": "<", ")": "("}
    kept = []
    for c in name.split("->", 1)[0]:
        if c in depth:
            depth[c] += 1
        elif c in closes and depth[closes[c]]:
            depth[closes[c]] -= 1
        elif not any(depth.values()) and c not in "*& \t\r\n":
            kept.append("::" if c in ".#" else c)
    parts, text = [], "".join(kept)
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] == ":":
            end += 1
        parts.append("::" if end - at > 1 else text[at])
        at = max(end, at + 1)
    return "".join(parts).strip(":")


@F.pandas_udf(StringType())
def normalised(names: pd.Series) -> pd.Series:
    return names.map(normalise_symbol, na_action="ignore")


def eval_symbol(name: Column) -> Column:
    """The evaluation's own normal form: three rounds of innermost brackets, all by regular expressions."""
    # Fixed patterns: the marks that a signature's parts stand between.
    s = F.split(F.trim(name), "->", 2)[0]
    s = F.regexp_replace(s, r"^\(\s*\*?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\)\.", "$1.")
    for _ in range(3):
        s = F.regexp_replace(F.regexp_replace(s, "<[^<>]*>", ""), r"\([^()]*\)", "")
    s = F.regexp_replace(s, "[*&]", "")
    s = F.regexp_replace(F.replace(F.replace(s, F.lit("#"), F.lit("::")), F.lit("."), F.lit("::")), ":{3,}", "::")
    return F.regexp_replace(F.regexp_replace(s, r"\s+", ""), "^:+|:+$", "")


def joined(*parts: Column) -> Column:
    """Scope and name with ::, empty ones left out."""
    return F.concat_ws("::", *[F.when(p != "", p) for p in parts])


def chunk_hash(lang: Column, symbol: Column, content: Column) -> Column:
    """The identity of a chunk: equal language, symbol and text are one chunk wherever they stand."""
    return F.sha2(F.concat_ws("\x1f", lang.cast("string"), symbol, content).cast("binary"), 256)


def embed_text(symbol: Column, content: Column, max_bytes: int) -> Column:
    """Symbol, line break, content, cut to max_bytes bytes and back to a whole character."""
    raw = F.concat(symbol, F.lit("\n"), content).cast("binary")
    inner = lambda n: F.conv(F.hex(F.substring(raw, max_bytes - n + 1, 1)), 16, 10).cast("int").between(0x80, 0xBF)
    # Where the first byte after the cut continues a character, go back to that character's first byte.
    cut = F.when(~inner(0), max_bytes).when(~inner(1), max_bytes - 1).when(~inner(2), max_bytes - 2).otherwise(max_bytes - 3)
    return F.when(F.octet_length(raw) <= max_bytes, raw).otherwise(F.substring(raw, F.lit(1), cut)).cast("string")


def rrf(rank: Column) -> Column:
    """The share of a place, counted from 1."""
    return F.lit(1.0) / (F.lit(RRF_K) + rank)


def token_estimate(text: Column) -> Column:
    return F.octet_length(text) / F.lit(3.0)


def unit(v: Column) -> Column:
    """A vector of length 1 as floats; a zero vector is an error."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: (x / norm).cast("float"))).otherwise(F.raise_error(F.lit("zero vector")).cast("array<float>"))


def oid(raw: Column) -> Column:
    return F.lower(F.hex(raw))


# The signals of a good issue text.
TRACE = r"(Traceback|panicked at|SIGSEGV|Exception|\bat [\w.]+\(|#\d+ 0x[0-9a-f]+|thread '.*' panicked)"
REPRO = r"(?i)(steps? to reproduce|to reproduce|reproduc|minimal example|expected behaviou?r|actual behaviou?r|what happened|how to reproduce)"
FEATURE = r"(?i)(feature request|proposal|rfc\b|would be nice|it would be great|enhancement request)"


def issue_score(body: Column) -> Column:
    yes = lambda c, n: F.when(c, n).otherwise(0)
    return (yes(body.rlike(REPRO), 2) + yes(body.rlike(TRACE), 2) + yes(F.length(body).between(400, 6000), 1)
            - yes(F.substring(body, 1, 400).rlike(FEATURE), 2) + yes(F.regexp_count(body, F.lit("```")) >= 2, 1))


def leaks_path(query: Column, files: Column) -> Column:
    """Whether a query names one of the files, its base name, or its stem if that is a compound identifier."""
    def one(p):
        name = F.regexp_extract(p, r"[^/]*$", 0)
        stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
        compound = (F.length(stem) >= 6) & stem.rlike(r"[_-]|[a-z][A-Z]|[A-Z]{2,}[a-z]")
        return F.contains(query, p) | F.contains(query, name) | (compound & F.contains(query, stem))

    return F.coalesce(F.exists(files, one), F.lit(False))


def leaks_symbol(query: Column, functions: Column) -> Column:
    def one(q):
        last = F.element_at(F.split(q, "::"), -1)
        return (F.length(last) >= 4) & F.contains(query, last)

    return F.coalesce(F.exists(functions, one), F.lit(False))
