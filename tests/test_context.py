"""Context assembly and function-level evaluation, against plain versions on random answers."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ctxloom.operators import curate, evaluate, store, truth


def answers(seed, queries=6, most=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(r.choices(vocabulary, k=r.randrange(0, 60))) for _ in range(10)]
    rows = []
    for q in range(queries):
        for rank in range(1, r.randrange(2, most)):
            words = r.choice(texts).split()
            for _ in range(r.randrange(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocabulary)
            start = r.randrange(1, 30)
            rows.append((q, f"i{rank}" if r.random() > 0.05 else "i1", rank, f"p{r.randrange(4)}", start, start + r.choice([0, 0, 3, 12]), " ".join(words)))
    return rows + [(99, "only", 1, "p", 1, 1, ""), (99, "empty too", 2, "p", 5, 5, " ")]


ITEMS = "qid long, item string, rank long, path string, start int, stop int, content string"


def plain_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def plain_merge(rows):
    out = []
    for q in {r[0] for r in rows}:
        best = {}
        for r in rows:
            if r[0] == q and (r[1] not in best or r[2:] < best[r[1]][2:]):
                best[r[1]] = r
        own = sorted(best.values(), key=lambda r: (r[3], r[4], -r[5], r[2]))
        outer, within = None, {}
        for r in own:
            if outer and outer[3] == r[3] and outer[5] >= r[5]:
                within[r[1]] = outer[1]
                out.append((q, r[1], r[2], False, "inside", outer[1]))
            else:
                outer = r
        left = [(min([r[2]] + [best[i][2] for i, o in within.items() if o == r[1]]), r[1], plain_set(r[6])) for r in own if r[1] not in within]
        kept = []
        for rank, item, s in sorted(left):
            into = next((i for _, i, t in kept if s and t and 100 * len(s & t) >= 75 * len(s | t)), None)
            kept += [] if into else [(rank, item, s)]
            out.append((q, item, rank, into is None, None if into is None else "copy", into))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merging_equals_a_plain_one(spark, seed):
    rows = answers(seed)
    got = [tuple(r) for r in curate.merged(spark.createDataFrame(rows, ITEMS)).select("qid", "item", "rank", "shown", "why", "into").collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_merge(rows)))
    assert {w for *_, w, _ in got} == {None, "inside", "copy"}


def test_all_near_pairs_are_found(spark):
    r = random.Random(3)
    base = [f"b{i}" for i in range(70)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(70)] = f"x{r.randrange(4)}"
        rows.append((i % 2, f"i{i}", " ".join(w[: r.randrange(50, 71)])))
    sets = curate.shingled(spark.createDataFrame(rows, "qid long, item string, content string"))
    got = {tuple(x) for x in curate.near_copies(sets.dropDuplicates(["qid", "set"])).collect()}
    own = {(x["qid"], x["item"]) for x in sets.dropDuplicates(["qid", "set"]).collect()}
    alike = lambda s, t: 100 * len(s & t) >= 75 * len(s | t)
    want = {(q, a, b) for q, a, x in rows for p, b, y in rows if p == q and a < b and (q, a) in own and (p, b) in own and alike(plain_set(x), plain_set(y))}
    assert got == want and len(want) > 50


@pytest.mark.parametrize("tokens", [0, 90, 400, 10**6])
def test_assembly_equals_a_plain_greedy(spark, tokens):
    r = random.Random(tokens)
    rows = [(q, f"i{n}", n, "x" * r.choice([0, 5, 40, 900, 4000]) + ("{" if r.random() < 0.5 else ""), f"src/a.py:{n}", r.choice([None, "short"])) for q in range(5) for n in range(1, r.randrange(2, 30))]
    costs = curate.priced(spark.createDataFrame(rows, "qid long, item string, rank long, content string, place string, summary string"))
    price = {(c["qid"], c["rank"]): c for c in costs.collect()}
    got = {(g["qid"], g["rank"]): g for g in curate.assembled(costs, tokens).collect()}
    assert len(got) == len(rows)
    for q in range(5):
        own = sorted(n for p, n in price if p == q)
        spent = 0
        for n in own:
            later = sum(price[q, m]["reference"] for m in own if m > n)
            level = next((x for x in curate.LEVELS if price[q, n][x] is not None and spent + price[q, n][x] + later <= tokens), "reference")
            spent += price[q, n][level]
            assert (got[q, n]["level"], got[q, n]["spent"]) == (level, spent)
        if sum(price[q, m]["reference"] for m in own) <= tokens:
            assert spent <= tokens


def test_signatures(spark):
    texts = {"/** doc */\nint haul(int a) {\n  return a;\n}": "/** doc */\nint haul(int a)", "def row(self,\n        n):\n    pass": "def row(self,\n        n)", "plain prose\nand more": "plain prose", "": "", "struct { int a; }": "struct"}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", curate.signature(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r["s"] for r in rows] == list(texts.values())


def test_metrics_without_lists_equal_the_definitions(spark):
    r = random.Random(4)
    found = [(q, f"x{i}", n + 1) for q in range(12) for n, i in enumerate(r.sample(range(40), r.randrange(0, 30)))]
    true = [(q, f"x{i}") for q in range(14) for i in r.sample(range(40), r.randrange(1, 14))] + [(0, "x1"), (0, "x1")]
    got = {x["qid"]: x for x in evaluate.per_query(spark.createDataFrame(found, "qid long, item string, rank int"), spark.createDataFrame(true, "qid long, item string"), (5, 10, 50)).collect()}
    for q in range(14):
        gt, order = {i for p, i in true if p == q}, [i for p, i, _ in sorted((f for f in found if f[0] == q), key=lambda f: f[2])]
        hits = [n for n, i in enumerate(order, 1) if i in gt]
        for k in (5, 10, 50):
            assert got[q][f"recall_{k}"] == pytest.approx(len(gt & set(order[:k])) / len(gt), abs=1e-6) and got[q][f"acc_{k}"] == float(gt <= set(order[:k]))
        assert got[q]["mrr"] == pytest.approx(1 / hits[0] if hits else 0, abs=1e-6)
        assert got[q]["ndcg_10"] == pytest.approx(sum(1 / math.log2(n + 1) for n in hits if n <= 10) / sum(1 / math.log2(n + 1) for n in range(1, min(len(gt), 10) + 1)), abs=1e-6)


def test_what_a_change_touches(spark):
    spans = spark.createDataFrame([("a.c", 2, 9, "a.c::outer", 1), ("a.c", 4, 6, "a.c::inner", 1), ("b.c", 1, 3, "b.c::f", 1)], "path string, start int, stop int, name string, tokens long")
    files = spark.createDataFrame([(1, "M", "a.c", [(5, 7), (20, 21)]), (1, "A", "new.c", [(1, 9)]), (1, "D", "b.c", [(1, 3)]), (1, "M", "readme.md", [(1, 1)]), (2, "M", "a.c", []), (2, "M", "vendor/x.c", [(1, 1)])],
                                  "qid long, status string, path string, hunks array<struct<start:int,stop:int>>")
    got = sorted(tuple(r) for r in truth.changed(files, spans).collect())
    assert got == [(1, "added", "new.c", 1), (1, "file", "a.c", 1), (1, "file", "b.c", 1), (1, "function", "a.c::inner", 2), (1, "function", "a.c::outer", 1), (1, "outside", "a.c", 1), (2, "file", "a.c", 1)]


def test_budget_curve(spark):
    found = spark.createDataFrame([(1, "a", 1, 100), (1, "b", 2, 50), (1, "c", 3, 1000), (2, "d", 1, 500), (2, "a", 11, 1)], "qid long, item string, rank int, tokens long")
    true = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d"), (2, "a"), (3, "z")], "qid long, item string")
    got = {r["budget"]: (r["recall"], r["least"]) for r in truth.budget_curve(found, true, budgets=(100, 150, 500, 2000)).collect()}
    whole = (1 + 0.5 + 0) / 3
    assert got == {100: (round(1 / 9, 6), False), 150: (round(2 / 9, 6), False), 500: (round((2 / 3 + 0.5) / 3, 6), False), 2000: (whole, True), -1: (whole, False)}


def test_numbers_hold_while_ranges_are_read_twice(spark):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("k"), (F.col("id") % 3).alias("g"), F.lit(2).alias("v")).repartition(7)
    got = store.with_ordinals(rows, ["k"], start=5).orderBy("k").collect()
    assert [r["ord"] for r in got] == list(range(5, 2005))
    sums = store.with_running(rows, "g", "k", "v", "before").collect()
    for g in range(3):
        assert [r["before"] for r in sorted((r for r in sums if r["g"] == g), key=lambda r: r["k"])] == [2 * i for i in range(sum(r["g"] == g for r in sums))]


def test_baseline_scores_by_function(spark):
    files = spark.createDataFrame([("a.py", "class A:\n def haul(self):\n  anchor chain\n def row(self):\n  oar anchor anchor\n"), ("b.py", "def reef():\n  sand\n")], "path string, text string")
    spans = spark.createDataFrame([("a.py", 2, 3, "a.py::A::haul", 9), ("a.py", 4, 5, "a.py::A::row", 9), ("b.py", 1, 2, "b.py::reef", 9)], "path string, start int, stop int, name string, tokens long")
    asked = spark.createDataFrame([(1, "anchor the chain"), (2, "nothing here")], "qid long, query string")
    got = {r["name"]: r["score"] for r in truth.bm25_functions(files, spans, asked).collect()}
    idf, mean = math.log(1 + (2 - 1 + 0.5) / 1.5), (5 + 6) / 2
    s = lambda tf, dl: idf * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * dl / mean))
    size = lambda t: len(re.findall("[A-Za-z_]+", t))
    assert size("def haul(self):\n  anchor chain") == 5 and got == {"a.py::A::haul": pytest.approx(2 * s(1, 5), abs=1e-4), "a.py::A::row": pytest.approx(s(2, 6), abs=1e-4)}
    assert {r["name"]: r["score"] for r in truth.grep_functions(files, spans, asked).collect()} == {"a.py::A::haul": pytest.approx(2 * idf, abs=1e-5), "a.py::A::row": pytest.approx(idf, abs=1e-5)}


def test_a_line_of_a_function_is_one_row(spark):
    files = spark.createDataFrame([("a.py", "def f():\n    # oak elm oak\n    return 1\nash")], "path string, text string")
    spans = spark.createDataFrame([("a.py", 1, 3, "a.py::f", 9)], "path string, start int, stop int, name string, tokens long")
    words = truth.owned_words(files, spans, spark.createDataFrame([("oak",), ("ash",)], "term string"))
    got = {r["name"]: (r["d"], [w for w in r["t"].split(" ") if w in ("oak", "ash")]) for r in words.collect()}
    assert got == {"a.py::f": (6, ["oak", "oak"]), None: (1, ["ash"])}
