"""The playbook's deltas, leaders of linked lessons, and sessions as a table and as a stream, against plain versions."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from ctxloom.operators import playbook, vectors

KIND = "id string, content string, helpful long, harmful long, v array<float>, refs array<string>"


def plain_merge(bullets, deltas, near):
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)
    stored = {b[0]: [b[2], b[3], set(b[5]), "kept"] for b in bullets}
    vs = {b[0]: np.float64(np.float32(b[4])) for b in bullets}
    lessons = {}
    for id_, content, up, down, v, refs in deltas:
        key = id_ if id_ in stored else hashlib.sha256(content.encode()).hexdigest()
        if key in stored:
            s = stored[key]
            s[0], s[1], s[3] = s[0] + up, s[1] + down, "counted"
            s[2].update(refs)
        else:
            x = lessons.setdefault(key, [0, 0, set(), np.float64(np.float32(v))])
            x[0], x[1] = x[0] + up, x[1] + down
            x[2].update(refs)
    added = {}
    for key, (up, down, refs, v) in sorted(lessons.items()):
        best = min(((-cos(v, w), i) for i, w in vs.items() if cos(v, w) >= near), default=None)
        if best:
            s = stored[best[1]]
            s[3] = "counted"
        else:
            lead = next((k for k in sorted(added) if cos(added[k][4], v) >= near), None)
            s = added.setdefault(lead or key, [0, 0, set(), "appended", v])
        s[0], s[1] = s[0] + up, s[1] + down
        s[2].update(refs)
    return sorted((i, s[0], s[1], ",".join(sorted(s[2])), s[3]) for i, s in {**stored, **added}.items())


def test_deltas_equal_a_plain_merge(spark):
    r = np.random.default_rng(6)
    v = r.normal(size=(90, 4))
    v[30:50] = v[:20] + r.normal(size=(20, 4)) * 0.15
    v[60:90] = v[50:60].repeat(3, axis=0) + r.normal(size=(30, 4)) * 0.2
    bullets = [(f"b{i}", f"text {i}", int(i % 3), 1, v[i].tolist(), [f"r{i}"]) for i in range(30)]
    deltas = [(None, f"lesson {i}", 1, int(i % 2), v[i].tolist(), [f"s{i % 5}"]) for i in range(30, 90)]
    deltas += [("b3", "", 2, 0, None, ["named"]), ("b3", "", 0, 1, None, []), ("gone", "lesson 88", 1, 0, v[88].tolist(), ["again"])]
    out = playbook.merged(spark.createDataFrame(bullets, KIND), spark.createDataFrame(deltas, KIND), 0.97)
    got = sorted((x["id"], x["helpful"], x["harmful"], ",".join(x["refs"]), x["change"]) for x in out.collect())
    want = plain_merge(bullets, deltas, 0.97)
    assert got == want and {c for *_, c in want} == {"kept", "counted", "appended"}


def test_leaders_equal_going_through_the_ids(spark):
    r = random.Random(2)
    links = {tuple(sorted(r.sample(range(80), 2))) for _ in range(120)} | {(i, i + 1) for i in range(80, 100)}
    want = {}
    for n in range(101):
        want[n] = min((a for a, b in links if b == n and want[a] == a), default=n)
    frame = lambda rows, kind: spark.createDataFrame(rows, kind)
    assert dict(playbook.leaders(frame(list(links), "a long, b long"), frame([(i,) for i in range(101)], "id long")).collect()) == want


def test_sessions_as_table_and_stream(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.randrange(4), n, f"c{r.randrange(6)}") for n in range(120)]
    lessons = spark.createDataFrame([("c1", "about one"), ("c1", "more about one"), ("c4", "about four")], "chunk string, content string")
    table = spark.createDataFrame(rows, "session long, step long, chunk string")
    seen, want = set(), []
    for s, n, c in rows:
        known = {"c1": "about one", "c4": "about four"}.get(c) if (s, c) in seen else None
        want.append((s, n, c, "full" if (s, c) not in seen else "lesson" if known else "reference", known))
        seen.add((s, c))
    assert sorted(map(tuple, playbook.shown(table, lessons).collect())) == sorted(want)
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:50], rows[50:80], rows[80:]):
        spark.createDataFrame(part, "session long, step long, chunk string").coalesce(1).write.mode("append").parquet(source)
        playbook.shown_stream(spark.readStream.schema("session long, step long, chunk string").parquet(source), lessons, target, str(tmp_path / "ck"))
    got = spark.read.parquet(target).select("session", "step", "chunk", "form", "lesson").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_what_harms_is_retired(spark):
    rows = spark.createDataFrame([(0, 2), (1, 3), (3, 3), (9, 4)], "u long, d long")
    assert [r[0] for r in rows.select(playbook.retired(F.col("u"), F.col("d"))).collect()] == [False, True, False, False]


def test_cells_of_clustered_vectors_are_found_by_scanning_few(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(60, 16))
    x = (centres[r.integers(0, 60, 3000)] + r.normal(size=(3000, 16)) * 0.25).tolist()
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id long, v array<float>")
    q = e.where("id % 50 = 0").select(F.col("id").alias("qid"), "v")
    index = vectors.Index.build(e)
    exact = {(a["qid"], a["id"]) for a in vectors.exact_top(e, q, 10).collect()}
    found = {(a["qid"], a["id"]) for a in index.search(q, 10).collect()}
    print("recall", len(exact & found) / len(exact), "scanned", index.probes, "of", len(index.centroids))
    assert len(exact & found) >= 0.9 * len(exact) and index.probes * 3 < len(index.centroids)
