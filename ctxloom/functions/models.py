"""Model calls: reading responses strictly, and an embedder that needs no network."""

from __future__ import annotations

import json
import math
import re
import zlib


def embeddings_of(body: str, n: int, dim: int) -> list[list[float]]:
    """The unit vectors of a response, placed by index; every index once, every vector of dim numbers and not zero."""
    out: list = [None] * n
    data = json.loads(body)["data"]
    if len(data) != n:
        raise ValueError(f"{len(data)} embeddings for {n} texts")
    for item in data:
        i, v = item["index"], item["embedding"]
        if not 0 <= i < n or out[i] is not None:
            raise ValueError(f"index {i} is out of range or repeated")
        norm = math.sqrt(sum(x * x for x in v))
        if len(v) != dim or norm == 0:
            raise ValueError(f"embedding {i} has {len(v)} numbers or is zero")
        out[i] = [x / norm for x in v]
    return out


def relevance_of(body: str, n: int) -> list[tuple[int, float]]:
    """(index, score) of a reranking response, best first, ties by index; every document exactly once."""
    data = json.loads(body)
    rows = data.get("results", data.get("data"))
    if rows is None or sorted(r["index"] for r in rows) != list(range(n)):
        raise ValueError("a reranking response must name every document once")
    return sorted(((r["index"], float(r["relevance_score"])) for r in rows), key=lambda r: (-r[1], r[0]))


def hashed_embedding(text: str, dim: int = 64) -> list[float]:
    """A deterministic unit vector of a text's words: the offline embedder."""
    v = [0.0] * dim
    for w in re.findall(r"\w+", text.lower()) or [""]:
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
    norm = math.sqrt(sum(x * x for x in v))
    return [x / norm for x in v] if norm else [1.0, *[0.0] * (dim - 1)]
