"""Sums over blocks of documents and queries against plain ones."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ctxloom.operators import blocks


def tables(docs=700, queries=40, terms=60, seed=7):
    """Documents of a few common and many rare terms, and queries that ask for both."""
    r = np.random.default_rng(seed)
    pick = lambda n: [f"t{int(x)}" for x in np.minimum(r.exponential(terms / 6, n), terms - 1)]
    words = [pick(r.integers(1, 15)) for _ in range(docs)]
    idf = {f"t{i}": 0.2 + i / 10 for i in range(terms)}
    asks = [(q, t, idf[t], 5.0 + q % 7) for q in range(queries) for t in dict.fromkeys(pick(12))]
    v = pa.table({"name": [f"f{i}" for i in range(docs)], "d": [len(w) + int(r.integers(0, 9)) for w in words], "t": [" ".join(w) for w in words], "side": [("code", "tests")[i % 3 == 0] for i in range(docs)]})
    return v, pa.table(dict(zip(("qid", "term", "idf", "mean"), map(list, zip(*asks)))))


def plain(v, q, k1, b):
    out = Counter()
    for qid, term, idf, mean in zip(*(q.column(c).to_pylist() for c in ("qid", "term", "idf", "mean"))):
        for i, (d, t) in enumerate(zip(v.column("d").to_pylist(), v.column("t").to_pylist())):
            if f := t.split(" ").count(term):
                out[qid, i] += idf * f * (k1 + 1) / (f + k1 * (1 - b + b * d / mean))
    return out


@pytest.mark.parametrize("sided", [False, True])
@pytest.mark.parametrize("at_once", [64, 100, 10_000])
def test_the_best_of_a_query_are_all_there(sided, at_once):
    v, q = tables()
    asks, whole = blocks._asked(q), plain(v, q, 0.9, 0.4)
    sides = np.asarray(v.column("side").to_pylist() if sided else ["code"] * v.num_rows, dtype=object)
    known = {s: [np.zeros(0)] * len(asks[3]) for s in set(sides)}
    got, qids = {}, asks[3].to_pylist()
    for at in range(0, v.num_rows, at_once):
        for i, j, s in zip(*blocks._best(v.slice(at, at_once), asks, {"t": 1.0}, 0.9, 0.4, 10, 1.0, sides[at : at + at_once], known)):
            got[qids[j], i + at] = s
    assert all(abs(s - whole[k]) < 1e-9 for k, s in got.items())
    for qid in qids:
        for side in known:
            own = sorted(((s, i) for (x, i), s in whole.items() if x == qid and sides[i] == side), reverse=True)
            assert {i for s, i in own if s >= own[min(10, len(own)) - 1][0]} <= {i for x, i in got if x == qid}


def test_counts_and_sums_of_the_files_that_share_a_term():
    v, q = tables(docs=90)
    asks = blocks._asked(q)
    out = sum(blocks._counted(v.slice(at, 37), asks, {"t": 1.0}, ("d",)) for at in range(0, 90, 37))
    d = v.column("d").to_pylist()
    for qid, (n, total) in zip(asks[3].to_pylist(), out):
        own = {i for x, i in plain(v, q, 0.9, 0.4) if x == qid}
        assert (n, total) == (len(own), sum(d[i] for i in own))


def test_no_place_for_each_document_and_query():
    """20,000 documents and 1,000 queries, of which two share a term each: less room than a byte for each two."""
    n, m = 20_000, 1_000
    v = pa.table({"d": [2] * n, "t": [f"a{i} b{i % 7}" for i in range(n)]})
    q = pa.table({"qid": list(range(m)), "term": [f"a{i}" for i in range(m)], "idf": [1.0] * m, "mean": [2.0 + i for i in range(m)]})
    tracemalloc.start()
    asks = blocks._asked(q)
    i, j, s = blocks._best(v, asks, {"t": 1.0}, 0.9, 0.4, 50, 1.0, np.zeros(n), {0.0: [np.zeros(0)] * m})
    counts = blocks._counted(v, asks, {"t": 1.0}, ("d",))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < n * m and i.tolist() == j.tolist() == list(range(m)) and counts.tolist() == [[1, 2]] * m
