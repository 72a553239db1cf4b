"""BM25 sums of many documents for many queries, block by block.

A document is one row with its words in arrays. Documents and queries are dealt in blocks, and a task adds up the scores of a block of each,
so that no row stands for a word of a document and a query that asks for it. Only what may be among the best of a block leaves it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block has about so many documents, words and queries.
DOCS, WORDS, QUERIES = 8192, 500_000, 256
#: Documents of a block whose scores are worked on at once, and of those that are only counted.
AT_ONCE, COUNTED = 32_768, 2048


def _hits(docs, terms, weights: dict[str, float]):
    """-> of each document and term of it: the document's row, the term's place, its weighted count; by document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    doc, term, f = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for c, w in weights.items():
        for at, part in zip(np.cumsum([0, *[len(x) for x in docs.column(c).chunks]]), docs.column(c).chunks):
            part = pc.split_pattern(part, " ") if pa.types.is_string(part.type) or pa.types.is_large_string(part.type) else part
            place = pc.index_in(part.flatten(), value_set=terms)
            known = np.asarray(place.is_valid())
            doc.append(np.asarray(pc.list_parent_indices(part)).astype(np.int64)[known] + at)
            term.append(np.asarray(place.drop_null()).astype(np.int64))
            f.append(np.full(len(doc[-1]), w))
    pair, own = np.unique(np.concatenate(doc) * max(len(terms), 1) + np.concatenate(term), return_inverse=True)
    return pair // max(len(terms), 1), pair % max(len(terms), 1), np.bincount(own.ravel(), weights=np.concatenate(f), minlength=len(pair))


def _asked(queries):
    """-> distinct terms, their idf, the places of each query's terms, the queries' ids and mean lengths."""
    import pyarrow.compute as pc

    terms, qids = pc.unique(queries.column("term")), pc.unique(queries.column("qid"))
    terms, qids = (x.combine_chunks() if hasattr(x, "combine_chunks") else x for x in (terms, qids))
    t, q = (np.asarray(pc.index_in(queries.column(c), value_set=v)).astype(np.int64) for c, v in (("term", terms), ("qid", qids)))
    idf, mean = np.zeros(len(terms)), np.ones(len(qids))
    idf[t] = queries.column("idf").to_numpy()
    mean[q] = queries.column("mean").to_numpy()
    own = np.unique(q * len(terms) + t)
    return terms, idf, np.split(own % len(terms), np.searchsorted(own, np.arange(1, len(qids)) * len(terms))), qids, mean


def _best(docs, asked, weights: dict[str, float], k1: float, b: float, keep: int | None, unit: float, sides, known):
    """-> rows of docs, places of queries, scores: every pair that shares a term; with `keep` those that can be among the best of a query and side.

    known: of each side and query the `keep` best scores so far, which it adds to."""
    terms, idf, own, _, mean = asked
    doc, term, f = _hits(docs, terms, weights)
    by = np.argsort(term, kind="stable")
    doc, term, f = doc[by].astype(np.int32), term[by], f[by]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    gain, d = idf[term] * f * (k1 + 1), docs.column("d").to_numpy().astype(np.float64)[doc]
    room, out = 1e-6 * unit, []
    rows_of = {s: np.flatnonzero(sides == s) for s in known} if len(known) > 1 else dict.fromkeys(known)
    for at, ts in enumerate(own):
        ts = ts[first[ts + 1] > first[ts]]
        if not len(ts):
            continue
        # A term's documents lie together: no other document is looked at.
        places = [slice(*x) for x in zip(first[ts].tolist(), first[ts + 1].tolist())]
        x, weight, length, of = (np.concatenate([c[p] for p in places]) for c in (f, gain, d, doc))
        total = np.bincount(of, weights=weight / (x + k1 * (1 - b + b * (length / mean[at]))), minlength=docs.num_rows)
        for side, best in known.items():
            rows = rows_of[side]
            part = total if rows is None else total[rows]
            if keep is None:
                i = np.flatnonzero(part > 0)
            else:
                low = best[at][0] if len(best[at]) == keep else 0.0
                # The `keep` best of some are no better than those of all.
                if not low and len(part) > 64 * keep:
                    low = np.partition(part[::16], -keep)[-keep]
                i = np.flatnonzero((part > 0) & (part >= low - room))
                best[at] = np.sort(np.concatenate([best[at], part[i]]))[-keep:]
                # What rounds to the same score is a tie, and ids decide between ties later.
                i = i[part[i] >= best[at][0] - room] if len(best[at]) == keep else i
            out.append((i if rows is None else rows[i], np.full(len(i), at), part[i]))
    none = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
    return tuple(np.concatenate([o[n] for o in [none, *out]]) for n in range(3))


def _counted(docs, asked, weights: dict[str, float], sums: tuple[str, ...]):
    """-> for each query, how many documents share a term with it, and what those have in the columns `sums`. A term is one bit for each document."""
    terms, _, own, _, _ = asked
    doc, term, _ = _hits(docs, terms, weights)
    each = np.stack([np.ones(docs.num_rows, dtype=np.int64), *[docs.column(c).to_numpy().astype(np.int64) for c in sums]], axis=1)
    out, wide = np.zeros((len(own), each.shape[1]), dtype=np.int64), -(-docs.num_rows // 8)
    if not len(doc):
        return out
    by = np.lexsort((doc, term))
    doc, (there, term) = doc[by], np.unique(term[by], return_inverse=True)
    byte = term.ravel() * wide + doc // 8
    starts = np.flatnonzero(np.diff(byte, prepend=-1))
    bits = np.zeros(len(there) * wide, dtype=np.uint8)
    bits[byte[starts]] = np.bitwise_or.reduceat((1 << (doc % 8)).astype(np.uint8), starts)
    bits, row = bits.reshape(len(there), wide), np.full(len(terms), -1)
    row[there] = np.arange(len(there))
    for at, ts in enumerate(own):
        r = row[ts]
        r = r[r >= 0]
        if len(r):
            any_ = np.unpackbits(np.bitwise_or.reduce(bits[r], axis=0), count=docs.num_rows, bitorder="little")
            out[at] = each[any_.view(bool)].sum(axis=0)
    return out


def dealt(docs: DataFrame, asked: DataFrame, key: list[str], words: int, count: int, queries: int = QUERIES, size: tuple[int, int] = (DOCS, WORDS)) -> tuple:
    """Both sides, grouped by block: `words` and `count` are those of all documents, `size` the documents and words of a block."""
    blocks, asks = max(1, -(-count // size[0]), -(-words // size[1])), max(1, -(-asked.select("qid").distinct().count() // queries))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    v = docs.where("d > 0").withColumn("_b", place(key, blocks)).withColumn("_a", every(asks))
    q = asked.withColumn("_b", every(blocks)).withColumn("_a", place(["qid"], asks))
    return v.groupBy("_b", "_a"), q.groupBy("_b", "_a")


def candidates(docs: DataFrame, asked: DataFrame, key: list[str], words: int, count: int, weights: dict[str, float], queries: int = QUERIES, sums: tuple[str, ...] = ("d",)) -> DataFrame:
    """(qid, n, sums): how many documents share a term with a query, and the sums of their columns `sums`."""
    names = ["n", *sums]
    kind = f"qid {asked.schema['qid'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names)

    def run(v, q):
        import pyarrow as pa

        qids, out = q.column("qid").slice(0, 0), np.zeros((0, len(names)), dtype=np.int64)
        if v.num_rows and q.num_rows:
            known = _asked(q)
            qids = known[3]
            out = sum(_counted(v.slice(at, COUNTED), known, weights, sums) for at in range(0, v.num_rows, COUNTED))
        return pa.table([qids, *[pa.array(out[:, i]) for i in range(len(names))]], names=["qid", *names])

    a, b = dealt(docs, asked.select("qid", "term", F.lit(0.0).alias("idf"), F.lit(1.0).alias("mean")), key, words, count, queries)
    return a.cogroup(b).applyInArrow(run, kind).where("n > 0").groupBy("qid").agg(*[F.sum(c).alias(c) for c in names])


def scored(docs: DataFrame, asked: DataFrame, key: list[str], words: int, count: int, weights: dict[str, float], k1: float, b: float, keep: int | None = None, unit: float = 1.0, queries: int = QUERIES, size: tuple[int, int] = (DOCS, WORDS)) -> DataFrame:
    """docs (key, d, the words that `weights` names, as arrays or with spaces between, perhaps side), asked (qid, term, idf, mean) -> (qid, key, perhaps side, score), rounded to 6 places.

    unit: what 1 is in idf; with whole numbers of a fine unit, and k1 of 0, sums are exact. Without `keep`, every pair that shares a term; with it only those that can be among the `keep` best of a query (and side). No idf is negative."""
    key = [*key, *(["side"] if "side" in docs.columns else [])]
    kind = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, cs in ((asked, ["qid"]), (docs, key)) for c in cs) + ", score double"

    def run(v, q):
        import pyarrow as pa

        x = y = np.zeros(0, dtype=np.int64)
        s, qids = np.zeros(0), q.column("qid")
        if v.num_rows and q.num_rows:
            asks = _asked(q)
            qids, found = asks[3], []
            sides = np.asarray(v.column("side").to_pylist(), dtype=object) if "side" in key else np.zeros(v.num_rows)
            known = {side: [np.zeros(0)] * len(qids) for side in set(sides)}
            for at in range(0, v.num_rows, AT_ONCE):
                i, j, part = _best(v.slice(at, AT_ONCE), asks, weights, k1, b, keep, unit, sides[at : at + AT_ONCE], known)
                found.append((i + at, j, part))
            x, y, s = (np.concatenate([f[n] for f in found]) for n in range(3))
            if keep is not None:
                cut = {side: np.array([p[0] if len(p) == keep else 0.0 for p in best]) - 1e-6 * unit for side, best in known.items()}
                low = np.zeros(len(x))
                for side in known:
                    own = sides[x] == side
                    low[own] = cut[side][y[own]]
                x, y, s = x[s >= low], y[s >= low], s[s >= low]
        return pa.table([qids.take(pa.array(y)), *[v.column(c).take(pa.array(x)) for c in key], pa.array(s)], names=["qid", *key, "score"])

    a, b_ = dealt(docs, asked.select("qid", "term", "idf", "mean"), [c for c in key if c != "side"], words, count, queries, size)
    return a.cogroup(b_).applyInArrow(run, kind).withColumn("score", F.round(F.col("score") / unit, 6))
