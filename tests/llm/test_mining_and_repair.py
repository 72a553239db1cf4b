"""Hard negatives, repeated passages and conversation repair, against plain versions on small tables with awkward rows."""

import hashlib
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import conversations, negatives, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- hard negatives -----------------------------------------------------------------------------------


def vectors(spark, rows):
    kind = "vec_id long, embedding array<float>, label int, row string, score string, a string"
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], label, "r", "s", "a") for i, e, label in rows], kind)


def brute_negatives(rows, every=50, positives=5, k=3):
    ok = []
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and len(e) and all(x is not None and np.isfinite(x) and abs(float(np.float32(x))) * 256 < 1 << 26 for x in e):
            ok.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in e], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(ok):
        if i % every:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), j, m) for m, (j, w, _) in enumerate(ok) if m != n and len(w) == len(v)]
        near = sorted((x, j) for x, j, m in s if ok[m][2] == label)[:positives]
        for x, p in near:
            hard = sorted((y, j) for y, j, m in s if ok[m][2] != label and -50 * x <= -100 * y <= -95 * x)[:k]
            out += [(i, p, r + 1, j, -x, -y) for r, (y, j) in enumerate(hard)]
    return sorted(out)


def cones(n, dim, seed, labels=4):
    """Vectors around one direction, so that windows have many rows in them."""
    r = np.random.default_rng(seed)
    return [(i, r.normal(size=dim) * 0.5 + np.linspace(1, 2, dim) * r.uniform(0.3, 1.5), int(r.integers(0, labels))) for i in range(n)]


def mined(spark, rows, **parameters):
    return sorted(tuple(r) for r in negatives.mine(vectors(spark, rows), **parameters).collect())


def test_negatives_equal_brute_force(spark):
    rows = cones(700, 8, 1)
    rows += [(50, rows[50][1], rows[50][2]), (3, rows[3][1], rows[3][2]), (100, rows[7][1], 1), (None, rows[0][1], 1), (901, None, 1), (902, rows[0][1], None), (903, [None] * 8, 1),
             (904, [float("nan")] * 8, 1), (905, [float("inf")] * 8, 1), (906, [1e9] * 8, 1), (950, [1.0, 2.0], 1), (951, [2.0, 3.0], 1), (952, [1.0, 1.5], 2), (953, [], 1), (1000, [0.0] * 8, 2)]
    want = brute_negatives(rows)
    assert len(want) > 100
    assert mined(spark, rows, block=120, asks=3) == want
    assert mined(spark, []) == [] and mined(spark, rows[:1]) == [] and mined(spark, [(50, [1.0], 1), (51, [1.0], 1)]) == []


def test_negatives_break_ties_by_id(spark):
    """Hundreds of equal vectors tie at the threshold: the ids are selected by their digits."""
    e, f = [1.0, 0.0], [0.75, 0.0]
    ids = [int(x) for x in np.random.default_rng(2).integers(-(1 << 62), 1 << 62, 500)]
    rows = [(50, e, 1), (51, e, 1)] + [(i, f, 2) for i in ids if i % 7 and i % 50] + [(8, f, 2)] * 90 + [(1 << 62, [0.9, 0], 3)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_of_large_whole_numbers(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.integers(100000, 200000, 4) + 0.5, int(r.integers(0, 3))) for i in range(120)]
    assert mined(spark, rows) == brute_negatives(rows) != []


# --- repeated passages --------------------------------------------------------------------------------


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", "m") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, k1 int, tk string, marks string")


def brute_repeats(rows, window=35):
    words = [WORDS.findall(t or "") for _, t in rows]
    seen = {}
    for r, w in enumerate(words):
        for i in range(len(w) - window + 1):
            seen.setdefault(tuple(w[i : i + window]), []).append((r, i))
    gone = [np.zeros(len(w), bool) for w in words]
    for at in seen.values():
        if len(at) > 1:
            for r, i in at:
                gone[r][i : i + window] = True
    out = []
    for (doc, _), w, g in zip(rows, words, gone):
        kept = " ".join(x for x, y in zip(w, g) if not y)
        out.append((doc, len(w), int(g.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def passages(seed):
    r = np.random.default_rng(seed)
    fresh = lambda n: [f"w{x}" for x in r.integers(0, 4000, n)]
    base, common = fresh(300), fresh(60)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, " ".join(fresh(34))), (4, " ".join(base)), (5, "  ".join(base)), (6, " ".join(base[:150])), (7, " ".join(base[:34])), (8, " ".join(base[10:45]))]
    for i in range(30):  # a passage in many places, with edits in some
        c = list(common)
        for j in r.choice(60, i % 4, replace=False):
            c[j] = f"x{r.integers(0, 3)}"
        rows.append((100 + i, "\n".join([" ".join(fresh(int(r.integers(0, 90)))), " ".join(c), " ".join(fresh(int(r.integers(0, 90))))])))
    family = [list(base) for _ in range(25)]
    for f in family:
        for j in r.choice(300, 4, replace=False):
            f[j] = f"y{r.integers(0, 2)}"
    rows += [(200 + i, " ".join(f)) for i, f in enumerate(family)]
    rows += [(300, "so " * 500), (301, "so " * 36 + "it goes"), (302, "tick tock " * 60), (303, " ".join(fresh(40) * 2)), (304, " ".join(fresh(20000)) + " é " + " ".join(common)), (305, " ".join(base[:100]).upper())]
    alone = " ".join(fresh(200))
    rows += [(400, alone), (400, alone), (None, alone + " end"), (None, "one two"), (None, " ".join(fresh(100)) + " " + " ".join(common))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = passages(seed)
    got = [tuple(r) for r in substrings.digest(documents(spark, rows).repartition(5)).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(brute_repeats(rows), key=key)
    assert substrings.digest(documents(spark, [])).count() == 0
    assert {r["n_removed"] for r in substrings.digest(documents(spark, rows[:5])).collect()} == {0}


def test_factors_are_in_the_reference(spark):
    rows = passages(3)
    text = {d: WORDS.findall(t or "") for d, t in rows if d is not None and d != 400}
    found = 0
    for r in substrings.parsed(documents(spark, rows)).collect():
        if r["doc_id"] in text and r["doc_id"] != 4:
            for f in r["factors"]:
                if f["ref_doc"] in text:
                    found += 1
                    assert f["words"] >= 35 and text[r["doc_id"]][f["start"] : f["start"] + f["words"]] == text[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["words"]]
            assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]
    assert found > 40


def test_without_repeats_keeps_rows_and_columns(spark):
    rows = passages(4)
    df = documents(spark, rows)
    out = substrings.without_repeats(df)
    assert out.columns == df.columns and out.count() == len(rows)
    want = {d: h for d, _, n, h in brute_repeats(rows) if n}
    before = {d: t for d, t in rows}
    for r in out.where("doc_id is not null").collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]] if r["doc_id"] in want else r["text"] == before[r["doc_id"]]
        assert r["tk"] == "k" and r["marks"] == "m"


def test_least_of_neighbours():
    h = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 3, 24):
        assert substrings.least_of(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]


# --- conversations ------------------------------------------------------------------------------------


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "conv_id long, turn long, role string, text string, seg string, copies int")


def hurt(rows):
    out = []
    for c, t, role, text in rows:
        say = lambda x: " " if x is None else str(x)
        way = zlib.crc32(f"{say(c)}:{say(t)}".encode()) % 20
        role, text = "user" if way == 4 else say(role), "" if way == 1 else re.sub("[.!?]", "", say(text)) if way == 2 else say(text)
        out += [(c, t, role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def best(kinds):
    """The least (cost, audit) by dynamic programming from the end: kinds of (initial, fault)."""

    @lru_cache(None)
    def after(i, state, inserts):
        out = []
        if i == len(kinds) and state in "qa":
            out.append((0, ""))
        turn = "a" if state == "u" else "u"
        if inserts < 3:
            out.append((5, "I", after(i, turn, inserts + 1)))
        if i < len(kinds):
            initial, fault = kinds[i]
            more = 5 if fault == 3 else 0
            out.append((2, "D", after(i + 1, state, 0)))
            if fault in (0, 3):
                out.append((1 + more, "R", after(i + 1, turn, 0)))
                if initial == turn or initial == "s" and state == "q":
                    out.append((more, "K", after(i + 1, initial, 0)))
        out = [x if len(x) == 2 else (x[0] + x[2][0], x[1] + x[2][1]) for x in out if len(x) == 2 or x[2]]
        return min(out, default=None)

    return after(0, "q", 0)


def brute_repairs(rows):
    out, after = [], hurt(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for r in own:
            faults.append(1 if not WORDS.search(r[3]) else 2 if r[2:] in seen else 0 if WORDS.findall(r[3])[-1][-1] in ".!?" else 3)
            seen.add(r[2:])
        initials, turns = [r[2][:1] for r in own], [r[1] for r in own if r[1] is not None]
        cost, audit = best(tuple(zip(initials, faults)))
        at, state, text = 0, "q", []
        for x in audit:
            turn = "a" if state == "u" else "u"
            name = {"u": "user", "a": "assistant"}[turn]
            if x == "I":
                text.append(f"{name}:")
            elif x == "R":
                text.append(f"{name}:{own[at][3]}")
            elif x == "K":
                text.append(f"{own[at][2]}:{own[at][3]}")
                turn = initials[at]
            at += x != "I"
            state = state if x == "D" else turn
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in (1, 2, 3)],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return out


def talk(seed, n=400):
    r = np.random.default_rng(seed)
    texts = ["Yes.", "No", "Why?", " ", "", None, "wait!  ", "so\n", "…", "Ah. é", "end.", "well"]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "User"]
    rows = [(int(c), int(t) if r.random() > 0.1 else None, roles[r.integers(0, len(roles))], texts[r.integers(0, len(texts))]) for c, t in zip(r.integers(0, 60, n), r.integers(-2, 9, n))]
    rows += [(900, i, "user" if i % 2 else "assistant", f"turn {i}{'.' if i % 5 else ''}") for i in range(90)] + [(900, 5, "user", "turn 5")] * 3
    rows += [(901, 0, "user", "x" * 200000 + "."), (None, 1, "user", "a?"), (None, None, "assistant", "b."), (902, -(1 << 63), "user", "a."), (902, (1 << 63) - 1, "assistant", "b.")]
    return rows + [(c, t, "system", "You help.") for c in range(1000, 1040) for t in (0,)]


key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)


@pytest.mark.parametrize("chunk", [5, 256])
def test_repairs_equal_brute_force(spark, chunk):
    rows = talk(chunk)
    want = sorted(((c, min(g, (1 << 63) - 1), *rest) for c, g, *rest in brute_repairs(rows)), key=key)
    got = conversations.repair(conversations.damaged(chats(spark, rows).repartition(3)), chunk)
    assert sorted((tuple(r) for r in got.collect()), key=key) == want
    assert any(r[7] == "" for r in want) and conversations.repair(conversations.damaged(chats(spark, []))).count() == 0


def test_search_equals_dynamic_programming():
    r = np.random.default_rng(8)
    for _ in range(400):
        kinds = tuple(("suat"[r.integers(0, 4)], int(r.choice([0, 0, 0, 1, 2, 3]))) for _ in range(r.integers(0, 9)))
        assert conversations.search(list(kinds), 0, (0, 3))[:2] == best(kinds), kinds


def test_one_conversation_over_many_ranges(spark):
    rows = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line "), F.col("id") % 1000, F.lit(".")).alias("text"))
    got = conversations.repair(rows, 64).collect()
    plain = [(7, r["turn"], r["role"], r["text"]) for r in rows.collect()]
    seen, kinds = set(), []
    for _, _, role, text in plain:
        kinds.append((role[0], 2 if (role, text) in seen else 0))
        seen.add((role, text))
    assert len(got) == 1 and (got[0]["cost"], got[0]["audit"]) == conversations.search(kinds, 0, (0, 3))[:2] and got[0]["duplicate"] == sum(f == 2 for _, f in kinds)
