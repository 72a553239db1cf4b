"""Vector search, vector near-duplicates and archives, against plain versions."""

import gzip
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import multi_index, topk, warc

KIND = "vec_id long, embedding array<float>, label int, v string, n string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 0, "v", "n") for i, e in rows], KIND)


def some(n, dim, seed):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, dim)).astype(np.float32) * r.uniform(0.2, 2, (n, 1)).astype(np.float32)


def test_topk_equals_brute_force(spark):
    x = some(600, 12, 1)
    x[50:60] = x[40:50]  # ties
    rows = [(i, v) for i, v in enumerate(x)] + [(3, x[3]), (900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [1.0, 2.0]), (None, x[0])]
    got = sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), k=5, lead=4, block=100, queries=3).collect())
    q = np.floor(1024 * np.vstack([x, x[3:4]]).astype(np.float64))
    ids = np.array([*range(600), 3])
    want = []
    for i in range(0, 600, 100):
        s = q @ q[i]
        order = sorted((-int(s[j]), int(ids[j])) for j in range(len(ids)) if ids[j] != i)[:5]
        want += [(i, n + 1, v, -m) for n, (m, v) in enumerate(order)]
    assert got == sorted(want)
    assert topk.top_k(vectors(spark, [])).count() == 0
    assert topk.top_k(vectors(spark, [(100, x[0]), (1, x[1])])).count() == 1


def test_topk_asks_every_vector_of_a_repeated_id(spark):
    x = np.eye(4, dtype=np.float32)
    rows = [(100, x[0]), (100, x[1]), (1, 3 * x[0]), (2, 2 * x[1]), (3, x[2])]
    got = [(r["query_id"], r["vec_id"], r["score"]) for r in topk.top_k(vectors(spark, rows), k=2, lead=2).orderBy("rank").collect()]
    assert got == [(100, 1, 3 * 1024 * 1024), (100, 2, 2 * 1024 * 1024)]


def test_multi_index_finds_all_links(spark):
    base = some(300, 16, 2)
    r = np.random.default_rng(5)
    near = base[:40].repeat(6, axis=0) + r.normal(size=(240, 16)) * 0.04 * np.linalg.norm(base[:40].repeat(6, axis=0), axis=1)[:, None]
    x = np.vstack([base, near, base[:5], base[:1]]).astype(np.float32)
    rows = [(i + 1, v) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0]), (None, x[0])]
    out = multi_index.near_duplicates(vectors(spark, rows), per_cell=32, block=50)
    got = {r["vec_id"]: r for r in out.collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    assert len(got) == len(rows)
    n = np.array([got[i + 1]["n_links"] for i in range(len(x))])
    assert (n <= hit.sum(axis=1)).all() and n.sum() >= 0.99 * hit.sum()
    part = np.arange(len(x))
    for _ in range(len(x)):
        new = np.minimum(part, np.where(hit, part[None, :], len(x)).min(axis=1))
        if (new == part).all():
            break
        part = new
    assert sum(got[i + 1]["component_id"] != part[i] + 1 for i in range(len(x))) <= 2
    for i in (2000, 2001, 2002, 2003):
        assert tuple(got[i])[1:] == (0, i, True)
    assert multi_index.near_duplicates(vectors(spark, [])).count() == 0


def test_multi_sequence_is_in_order():
    m1, m2 = np.array([0.0, 0.2, 0.5]), np.array([0.3, 0.0, 0.1])
    assert multi_index.visited(m1, m2, 0.31) == [1, 2, 4, 5, 0]


PAGES = [(1, "http://a/1", "x" * 999), (2, "http://a/2", "x" * 999), (3, "u\r\n3", "é" * 600), (4, None, "é" * 600), (9, "", "é" * 600), (5, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n" * 5000), (8, "u", "0\r\n\r\n"), (9, "u", "é" * 600), (None, "u", "z")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], "page_id long, url string, html string, digest string, n int")


def test_archives_round_trip(spark, tmp_path):
    at = warc.write(pages(spark), str(tmp_path / "w"), segment=700, chunk=300, per_file=4)
    got = warc.read(spark, at).collect()
    assert len(got) == len(PAGES) and {r["status"] for r in got} == {"ok"}
    for page, _, html in PAGES:
        mine = [r for r in got if r["page_id"] == page]
        body = (html or "").encode()
        again = html == "é" * 600 and page != 9
        for r in mine:
            assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
            assert r["record_type"] == ("revisit" if again else "response") and r["refers_to"] == (9 if again else None)
            assert r["payload"] == (None if again else body)
    assert warc.archive(pages(spark, [])).count() == 0


def test_damage_is_found(spark, tmp_path):
    at = warc.write(pages(spark, [(1, "u", "abc" * 1000), (2, "u", "def" * 1000)]), str(tmp_path / "w"), segment=700, chunk=300)
    kept, cut = [], False
    for f in (tmp_path / "w").glob("part-*"):
        for fields, block in warc.parse(gzip.decompress(f.read_bytes())):
            if fields["warc-type"] == "continuation" and not cut:
                cut = True
                continue
            kept.append(warc.record([(k, v) for k, v in fields.items() if k != "content-length"], block))
    (tmp_path / "d").mkdir()
    (tmp_path / "d/part-0.warc").write_bytes(b"".join(k + warc.END for k in kept))
    assert sorted(r["status"] for r in warc.read(spark, str(tmp_path / "d"), strict=False).collect()) == ["ok", "segments are missing"]
    with pytest.raises(Exception, match="segments are missing"):
        warc.read(spark, str(tmp_path / "d")).collect()


def test_chunked_framing():
    for n in (0, 1, 299, 300, 301):
        assert warc.unchunked(warc.chunked(b"\r\n0" * n, 300)) == b"\r\n0" * n
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n")
