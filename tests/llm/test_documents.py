"""Operators over documents, against plain versions on small tables with awkward rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxloom.llm import common, lines, minhash, mixing, packing, pii

KIND = "doc_id long, text string, lang string, source string, n_chars long, class int, rep string, key string, kept int"


def table(spark, rows):
    """rows of (doc_id, text, source), with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "r", "k", 0) for i, t, s in rows], KIND)


def prose(seed, n):
    r = np.random.default_rng(seed)
    return [str(w) for w in r.choice(["ab", "cde", "Fg", "hij.", "klmno", "pq,", "rst", "é", "uvw"], n)] if n < 9 else [f"w{x}" for x in r.integers(0, 3000, n)]


def edited(words, seed, share):
    r, out = np.random.default_rng(seed), list(words)
    for i in np.flatnonzero(r.random(len(out)) < share):
        out[i] = f"x{r.integers(0, 9999)}"
    return out


def awkward():
    base = prose(1, 200)
    family = [" ".join(edited(base, s, 0.03)) for s in range(12)]
    rows = [(0, None, None), (1, "", "a"), (2, "   \n\t ", "a"), (3, "one two", "b"), (4, "ONE two", "b"), (5, "one two three", None)]
    rows += [(10 + i, t, "a") for i, t in enumerate([" ".join(base), *family, " ".join(base).upper()])]
    rows += [(40, " ".join(prose(2, 30000)), "c"), (41, " ".join(prose(3, 50)), "c"), (41, " ".join(prose(3, 50)), "c"), (None, " ".join(base), "d")]
    return rows


def brute_shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_minhash_equals_brute_force(spark):
    rows = awkward()
    sets = [brute_shingles(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    find = lambda i: i if part[i] == i else find(part[i])
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                part[find(i)] = find(j)
    want = []
    for i, (doc, _, _) in enumerate(rows):
        least = min(rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None) if doc is not None else None
        want.append((doc, len(sets[i]), least, doc is None or doc == least))
    got = [tuple(r) for r in minhash.near_duplicates(table(spark, rows)).collect()]
    key = lambda t: tuple((x is None, x or 0) for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(k for *_, k in want) < len(rows) - 8


def test_null_ids_bridge_two_documents(spark):
    base = prose(31, 200)
    x, y = list(base), list(base)
    x[20:24], y[120:124] = ["xa"] * 4, ["ya"] * 4
    x[60:64], y[160:164] = ["xb"] * 4, ["yb"] * 4
    a, b, c = (brute_shingles(" ".join(t)) for t in (x, base, y))
    assert len(a & c) / len(a | c) < 0.75 <= min(len(a & b) / len(a | b), len(b & c) / len(b | c))
    rows = [(1, " ".join(x), "a"), (None, " ".join(base), "a"), (3, " ".join(y), "a")]
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (1, True), None: (None, True), 3: (1, False)}


def test_keep_one_decides_by_row(spark):
    import corpus_pipeline

    base, clean = prose(41, 200), " ".join(prose(42, 200))
    near = " ".join(edited(base, 3, 0.02))
    alone = " ".join(prose(43, 200))
    rows = [(1, " ".join(base), "a"), (2, near, "a"), (2, clean, "b"), (5, alone, "a"), (5, alone, "a"), (None, near, "c"), (None, alone, "c"), (None, " ".join(prose(44, 90)), "c"), (7, "", "a"), (8, None, "a")]
    got = corpus_pipeline.dedup_documents(spark, table(spark, rows), "")
    assert got.columns == table(spark, rows).columns
    want = [(1, rows[0][1]), (2, clean), (5, alone), (None, rows[7][1]), (7, ""), (8, None)]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(str, want))


def test_minhash_estimate_follows_similarity():
    a, b = np.arange(4000, dtype=np.uint64), np.arange(800, 4800, dtype=np.uint64)
    x, y = (minhash.packed(minhash.minima(common.mix(s))).view(np.uint64) for s in (a, b))
    d = x ^ y
    wrong = np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(minhash.ODD_BITS)).sum()
    assert abs((1 - wrong / minhash.HASHES - 0.25) / 0.75 - 3200 / 4800) < 0.1


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (None, 3)]
    got = dict(common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(40)}}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_lines(rows, similarity=0.9, distance=None):
    """Groups lines by equal words; fuzzy links are left to the operator's own keys."""
    norm = lambda s: " ".join(re.findall(r"[^\x00-\x60\x7b-\x7f]+", s.lower()))
    seen, out = {}, []
    for doc, text, _ in sorted(((d, t, s) for d, t, s in rows if t is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate(text.split("\n")):
            k = norm(line)
            if k:
                seen.setdefault(k, (doc, n))
    for doc, text, _ in rows:
        out.append((doc, [n for n, line in enumerate((text or "").split("\n")) if norm(line) and seen[norm(line)] != (doc, n)] if text is not None else []))
    return out


def test_lines_exact_and_fuzzy(spark):
    long = " ".join(prose(5, 300)).replace("w", "v")
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    near = " ".join(words * 3)
    rows = [(3, "Hello, World!\nalpha beta\n\n12 34\nhello world 99", "a"), (2, "HELLO WORLD\nunique line here", "a"), (1, None, "a"), (4, "", "a"), (5, "hello world", "b"),
            (5, "hello world", "b"), (None, "alpha beta\nonly here", "b"), (6, long, "c"), (8, near + " end\nkeep me", "c"), (9, near + " and", "c")]
    got = lines.dedup_lines(table(spark, rows))
    assert set(table(spark, rows).columns) <= set(got.columns)
    by = sorted(((r["doc_id"], r["text"], list(r["dropped"])) for r in got.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    want = sorted(brute_lines(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for (doc, text, dropped), (_, exact) in zip(by, want):
        assert dropped == ([0] if doc == 9 else exact), doc
    assert dict((d, t) for d, t, _ in by)[3] == "alpha beta\n\n12 34" and dict((d, t) for d, t, _ in by)[5] == "" and by[0][1] is None
    kept = {r["doc_id"] for r in lines.keep_lines(table(spark, rows)).collect()}
    assert 5 not in kept and 9 not in kept and {1, 2, 3, 4, 8} <= kept
    assert lines.dedup_lines(table(spark, [])).count() == 0


def lines_with_edits():
    """(doc_id, line): lines of 3 to 50 words, each with a copy in which one word in ten is another, or a letter is."""
    r = np.random.default_rng(21)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    vocabulary = [word(r.integers(3, 9)) for _ in range(2000)]
    out = []
    for n in (3, 5, 10, 20, 30, 50):
        for _ in range(40):
            w = list(r.choice(vocabulary, n))
            v = list(w)
            if n < 10:
                v[0] = v[0][:-1] + "é"
            for i in r.choice(n, n // 10, replace=False):
                v[i] = word(len(v[i]))
            out += [" ".join(w), " ".join(v)]
    return list(enumerate(out))


def test_fuzzy_lines_of_ordinary_length_are_found(spark):
    rows = lines_with_edits()
    df = spark.createDataFrame(rows, "i long, a string")
    near = df.join(df.toDF("j", "b"), F.expr("i < j and abs(length(a) - length(b)) * 10 <= greatest(length(a), length(b))"))
    near = near.where(F.levenshtein("a", "b") * 10 <= F.greatest(F.length("a"), F.length("b"))).select("i", "j").collect()
    assert len(near) > 200
    gone = {r["doc_id"] for r in lines.dedup_lines(table(spark, [(i, t, "a") for i, t in rows])).collect() if list(r["dropped"])}
    want = {j for _, j in near}
    assert gone <= want
    long = {j for j in want if len(rows[j][1].split()) >= 10}
    assert len(gone & long) >= 0.95 * len(long) and len(gone) >= 0.9 * len(want), (len(gone & long), len(long), len(gone), len(want))
    print("fuzzy recall", len(gone & long), len(long), len(gone), len(want))


def scattered_edits():
    """(kind, line): pairs of long lines with a letter changed in one word of five, three or two, a word put in, two words joined, and lines after one pattern."""
    r = np.random.default_rng(23)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    typo = lambda w, i: w[:i] + chr(97 + r.integers(0, 26)) + w[i + 1 :]
    vocabulary = [word(r.integers(3, 9)) for _ in range(2000)]
    out = []
    for kind in ("fifth", "third", "half", "put in", "joined"):
        for _ in range(40):
            w = list(r.choice(vocabulary, r.integers(12, 41)))
            i = int(r.integers(0, len(w) - 1))
            share = {"fifth": 0.2, "third": 0.35, "half": 0.5}.get(kind)
            v = [typo(x, r.integers(0, len(x))) if r.random() < share else x for x in w] if share else w[:i] + [word(5)] + w[i:] if kind == "put in" else w[:i] + [w[i] + w[i + 1]] + w[i + 2 :]
            out += [(kind, " ".join(w)), (kind, " ".join(v))]
    base = [word(4) for _ in range(40)]
    for _ in range(60):
        own = word(14)
        out += [("pattern", " ".join([*base[:5], own, *base[5:20], word(14), *base[20:]])) for _ in range(2)]
    return out


def test_scattered_edits_and_patterns_are_found(spark):
    kinds, texts = zip(*scattered_edits())
    df = spark.createDataFrame(list(enumerate(texts)), "i long, a string")
    most = F.expr("cast(greatest(length(a), length(b)) div 10 as int)")
    near = df.join(df.toDF("j", "b"), F.expr("i < j and abs(length(a) - length(b)) * 10 <= greatest(length(a), length(b))")).where(F.levenshtein("a", "b") <= most).select("j").distinct().collect()
    want = {r["j"] for r in near}
    gone = {r["doc_id"] for r in lines.dedup_lines(table(spark, [(i, t, "a") for i, t in enumerate(texts)]), numbers=True).collect() if list(r["dropped"])}
    found = {k: (sum(kinds[j] == k for j in gone & want), sum(kinds[j] == k for j in want)) for k in set(kinds)}
    print("fuzzy recall by kind of edit", found)
    assert len(gone & want) >= 0.9 * len(want) and all(x >= 0.75 * n for x, n in found.values()), found


def test_registered_lines_that_differ_in_numbers_stay(spark, tmp_path):
    import __spark_entry__ as entry
    import corpus_pipeline

    rows = [(1, "invoice 17 total 40\nReouti anatha.\n2024-01-02 17:00", "a"), (2, "invoice 99 total 3\nReouti anatha. 19.37.233.111\n2024-01-02 17:00\n----", "a"), (3, "Invoice 17: total 40\n----\n\u201cReouti\u201d anatha", "a")]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["dropped"] for r in entry.queries()["op10_fuzzy_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "2", 3: "0,2"}
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, table(spark, rows), str(tmp_path)).collect()}
    assert kept[2].startswith("invoice 99 total 3\nReouti anatha. 19")


def test_verification_equals_plain_edit_distance(spark):
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = np.random.default_rng(3)
    texts = []
    for i in range(60):
        w = ["".join(r.choice(list("abcdé"), r.integers(1, 9))) for _ in range(r.integers(6, 40))]
        v = [x if r.random() > 0.08 else "".join(r.choice(list("abcdé"), r.integers(1, 9))) for x in w]
        texts += [" ".join(w), " ".join(v[r.integers(0, 2):])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = docs.select(F.col("doc_id").alias("k1"), F.struct(F.lit(False).alias("last"), "doc_id", F.lit(0).alias("line_no"), F.xxhash64("text").alias("th")).alias("first"))
    pairs = spark.createDataFrame([(i + 1, i) for i in range(0, 120, 2)], "k1 long, l1 long")
    want = {i for i in range(0, 120, 2) if plain(texts[i], texts[i + 1]) <= max(len(texts[i]), len(texts[i + 1])) // 10}
    got = {x["dst"] for x in lines.verified(docs, classes, pairs, 0.9, True).collect()}
    assert got == want and 10 < len(want) < 50


def test_clashing_names_stay(spark):
    names = ["_id", "_h", "dropped", "_size", "_gone", "a.b", "row", "th", "k1", "key"]
    rows = [(1, "one line that repeats here\nand one of its own", "a", 2, *names), (2, "one line that repeats here\nanother of its own", "b", 2, *names), (2, "one line that repeats here\nanother of its own", "b", 2, *names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    kept = lines.keep_lines(df)
    assert kept.columns == df.columns and {tuple(r)[4:] for r in kept.collect()} == {tuple(names)}
    assert sorted(r["text"] for r in kept.collect()) == ["another of its own", "another of its own", "one line that repeats here\nand one of its own"]
    for stage in (minhash.keep_one, mixing.take):
        out = stage(df)
        assert out.columns == df.columns and {tuple(r)[4:] for r in out.collect()} <= {tuple(names)}


def brute_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii_equals_brute_force(spark):
    texts = [None, "", "a@b.c_d@e.f x@y@z.w .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 1", "é+49 (30) 123-4567é +1 2 3 +123456789012345678",
             "1" * 30000, "+1" * 3000, "a" * 30000, "a@b.c" * 500, "5500005555555559 0 1 2 3", "\U0001F600 ann@b.org", "IBAN DE89 3704 0044 0532 0130 00, DE88 3704 0044 0532 0130 00", "social security 123-45-6789" + " " * 60 + "order 123-45-6789"]
    rows = pii.digest(table(spark, [(i, t, "a") for i, t in enumerate(texts)] + [(0, None, "a")])).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        base = brute_spans(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), texts[r["doc_id"]][:60]
        assert r["n_email"] == base.count("email") and r["n_card"] == base.count("card")
    spans = {r["doc_id"]: r["spans"] for r in rows}
    assert spans[12] == "iban:5:32" and spans[13] == "ssn:16:27" and spans[11] == "email:2:11"
    out = pii.masked(table(spark, [(1, "to ann@b.org or +49 30 1234567.", "a")])).first()["text"]
    assert out == "to [email] or [phone]."
    assert pii.digest(table(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    r = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(r.integers(0, 60))), s) for i, s in enumerate([*["a"] * 400, *["b"] * 30, *["é"] * 20, *[None] * 10])] + [(7, None, "b"), (8, "x y", "b")]
    one = mixing.mix_documents(table(spark, rows), bucket=64).collect()
    two = mixing.mix_documents(table(spark, rows).repartition(7), bucket=64).collect()
    assert len(one) == len(rows) and sorted(map(str, one)) == sorted(map(str, two))
    size = {}
    for r in one:
        size.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and (r["copies"] >= 0)
    weight = dict(zip(["a", "b", "é", None], [5, 2, 1, 5]))
    total = {s: sum(x["size"] for x in v) for s, v in size.items()}
    want, full, left = {}, set(), 1.5 * sum(total.values())
    while True:
        open_ = [s for s in total if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2 * total[s]
            left -= want[s]
            full.add(s)
    for s, v in size.items():
        assert v[0]["target"] == pytest.approx(want[s]) and v[0]["source_size"] == total[s]
        assert abs(sum(x["taken"] for x in v) - want[s]) <= max(x["size"] for x in v)
    assert mixing.mix_documents(table(spark, [])).count() == 0
    took = mixing.take(table(spark, [(1, "a b", "s"), (2, "c d", "s")]))
    assert took.columns == table(spark, []).columns and took.count() == 3


def test_pair_keeps_the_sum():
    r = np.random.default_rng(4)
    for _ in range(500):
        p, q, s, t = *r.uniform(0.01, 0.99, 2), *r.integers(1, 1000, 2)
        a, b = mixing.pair(p, s, q, t, r.random())
        assert a * s + b * t == pytest.approx(p * s + q * t) and min(abs(a - round(a)), abs(b - round(b))) < 1e-12 and -1e-9 <= min(a, b) and max(a, b) <= 1 + 1e-9
    mean = np.mean([mixing.pair(0.3, 5, 0.6, 9, u)[0] for u in r.random(4000)])
    assert abs(mean - 0.3) < 0.03


def test_boundaries_are_optimal():
    from itertools import combinations

    r = np.random.default_rng(2)
    for _ in range(20):
        n = np.sort(r.choice(40, 7, replace=False)) + 1
        c = r.integers(1, 9, 7)
        cost = lambda ends: sum(k * min(e for e in ends if e >= x) for x, k in zip(n, c))
        best = min(cost([*x, n[-1]]) for x in combinations(n[:-1], 2))
        assert cost(packing.boundaries(n.astype(np.int64), c.astype(np.int64), 3)) == best
    assert packing.boundaries(np.zeros(0, np.int64), np.zeros(0, np.int64), 3) == []


def test_packing_fills_batches(spark):
    rows = [(i, " ".join(["w"] * (i % 50)), "a") for i in range(300)] + [(1000, " ".join(["w"] * 205), "a"), (1, "w w", "a"), (None, "w w", "a"), (5000, None, "a")]
    got = packing.pack(table(spark, rows), window=64, buckets=4, budget=256).collect()
    assert sum(r["n_tokens"] for r in got) == sum(len((t or "").split()) for _, t, _ in rows)
    assert [r["n_tokens"] for r in sorted((r for r in got if r["doc_id"] == 1000), key=lambda r: r["piece"])] == [64, 64, 64, 13]
    slots = {}
    for r in got:
        assert r["n_tokens"] <= r["boundary"]
        slots.setdefault((r["boundary"], r["batch"]), []).append(r["slot"])
    for (b, n), s in slots.items():
        assert sorted(s) == list(range(len(s))) and len(s) <= 256 // b
        assert len(s) == 256 // b or n == max(x for y, x in slots if y == b)
    assert packing.pack(table(spark, [])).count() == 0


def test_components_merge_by_roots(spark):
    r = np.random.default_rng(13)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (220, 2))]
    frame = lambda e: spark.createDataFrame(e, "src long, dst long")
    for cut in (0, 150, 220):
        parts = common.stash(common.connected_components(frame(edges[:cut])), "t")
        assert sorted(common.merged_components(parts, frame(edges[cut:])).collect()) == sorted(common.connected_components(frame(edges)).collect())


def test_members_of_a_large_key_meet_all_that_share_enough(spark):
    r = np.random.default_rng(3)
    sketches = {i: (sorted(r.choice(40, 16, replace=False).tolist()), sorted(r.choice(30, int(r.integers(2, 15)), replace=False).tolist())) for i in range(120)}
    part = {i: i if i % 3 else 0 for i in sketches}
    facts = spark.createDataFrame([(i, (200, a, b)) for i, (a, b) in sketches.items()], "k1 long, facts struct<len: int, long: array<int>, short: array<int>>")
    members = spark.createDataFrame([(1, 120, i, p) for i, p in part.items()], "key long, c long, k1 long, part long")
    got = {(x["l1"], x["k1"]) for x in lines.across(lines.finer(members, facts), facts, 0.9).collect()}
    enough = lambda a, b, k, w: 0 < len(set(a) & set(b)) >= int(max(len(a), len(b)) * k / w)
    like = lambda a, b: enough(a[0], b[0], lines.SHARED, lines.WIDTH) or enough(a[1], b[1], lines.LETTERS_SHARED, lines.LETTERS_WIDTH)
    want = {(i, j) for i in sketches for j in sketches if i < j and part[i] != part[j] and like(sketches[i], sketches[j])}
    assert got == want and len(want) > 500


def test_members_meet_in_slices_that_lose_nothing(spark, monkeypatch):
    from pathlib import Path

    r = np.random.default_rng(29)
    facts = spark.createDataFrame([(i, (200, sorted(r.choice(40, 16, replace=False).tolist()), [])) for i in range(60)], "k1 long, facts struct<len: int, long: array<int>, short: array<int>>")
    members = spark.createDataFrame([(int(k), 60, i, i) for i in range(60) for k in r.choice(20, 5, replace=False)], "key long, c long, k1 long, part long")
    near = lambda df: {(x["l1"], x["k1"], x["shared"]) for x in df.collect()}
    kept = lambda: set(Path(common.shared_dir(spark)).glob("ctxloom-*"))
    whole = near(lines.across(members, facts, 0.9))
    pairs = common.stash(spark.createDataFrame([(j, i) for i in range(60) for j in range(i + 1, 60)], "k1 long, l1 long"), "test")
    every = near(lines.likely(pairs, facts, 0.9))
    monkeypatch.setattr(lines, "SLICE_ROWS", 100)
    written, stash = [], lines.stash
    monkeypatch.setattr(lines, "stash", lambda df, name: written.append(name) or stash(df, name))
    before = kept()
    sliced = lines.across(members, facts, 0.9)
    assert near(sliced) == whole and len(whole) > 100 and written.count("pairs") == 4  # 300 rows in three slices, and their union
    assert {p.name for p in kept() - before} == {sliced.stash_path.rsplit("/", 1)[1]}
    monkeypatch.setattr(lines, "SLICE_ROWS", 1000)
    assert near(lines.likely(pairs, facts, 0.9)) == every >= whole


def test_lines_too_unlike_in_length_share_no_key_and_alike_ones_all(spark):
    from itertools import pairwise

    rows = [(n, n, list(range(16)), []) for n in range(10, 1000)]
    classes = spark.createDataFrame(rows, "k1 long, len int, long array<int>, short array<int>")
    keys = {}
    for r in lines.keyed(classes, 0.9).collect():
        keys.setdefault(r["k1"], set()).add(r["key"])
    for n in range(10, 1000):
        most = max(m for m in range(n, 1000) if m - n <= m // 10)
        assert all(len(keys[n] & keys[m]) >= lines.KEYED - 1 for m in (n, (n + most) // 2, most)), n
    assert not any(keys[n] & keys[m] for n, m in pairwise((10, 30, 90, 270, 810)))
    assert sum(len(x) for x in keys.values()) < 1.3 * len(rows) * (lines.KEYED - 1)


def test_outlines_leave_all_pairs_that_fit_and_few_others(spark):
    r = np.random.default_rng(31)
    draw = lambda n, of: sorted(r.choice(of, n, replace=False).tolist())
    rows = [(i, (200 + i % 30, draw(16, 60) if i % 3 else [], draw(int(r.integers(1, 15)), 40) if i % 3 != 1 else [])) for i in range(150)]
    rows += [(150 + i, (200, draw(16, 1_000_000), [])) for i in range(150)]
    facts = spark.createDataFrame(rows, "k1 long, facts struct<len: int, long: array<int>, short: array<int>>")
    both = facts.join(facts.toDF("l1", "b"), F.expr("l1 < k1")).withColumnRenamed("facts", "a").select("k1", "l1", "a", "b")
    fits = {(x["k1"], x["l1"]) for x in lines.fitting(both, 0.9).collect()}
    seen = lines.outlines(facts)
    left = {(x["k1"], x["l1"]) for x in seen.toDF("k1", "a").join(seen.toDF("l1", "b"), F.expr("l1 < k1")).where(lines.possible(0.9)).select("k1", "l1").collect()}
    assert fits <= left and len(fits) > 300
    assert len([x for x in left if min(x) >= 150]) < 0.02 * 150 * 149 / 2


def test_many_lines_alike_are_not_compared_all_with_all(spark, monkeypatch):
    r = np.random.default_rng(37)
    word = lambda n: "".join(chr(97 + c) for c in r.integers(0, 26, n))
    docs = table(spark, [(i, word(9), "a") for i in range(60)])
    classes = spark.createDataFrame([(i, 200, list(range(i, i + 16)), []) for i in range(60)], "k1 long, len int, long array<int>, short array<int>")
    # No key connects them at first; then all are like all.
    pairs = common.stash(spark.createDataFrame([(j, i, i, j, 16) for i in range(60) for j in range(i + 1, 60)], "k1 long, l1 long, p long, q long, shared int"), "test")
    compared = []

    def verified(_docs, _classes, asked, *_):
        compared.append(asked.count())
        return common.stash(asked.select(F.col("k1").alias("src"), F.col("l1").alias("dst")), "links")

    monkeypatch.setattr(lines, "verified", verified)
    monkeypatch.setattr(lines, "likely", lambda *_: common.stash(pairs.where("false").select("k1", "l1", "shared"), "test"))
    monkeypatch.setattr(lines, "met", lambda members, facts, similarity: [], raising=False)
    monkeypatch.setattr(lines, "finer", lambda members, *_: members, raising=False)
    monkeypatch.setattr(lines, "confirmed", lambda *_: common.stash(pairs, "test"), raising=False)
    monkeypatch.setattr(lines, "across", lambda *_: common.stash(pairs, "test"))
    out = {x["node"]: x["root"] for x in lines.similar(docs, classes, 0.9, False).toDF("node", "root").collect()}
    assert out == {i: 0 for i in range(60)} and sum(compared) <= 60


def test_a_written_table_leaves_no_shuffle_files(spark):
    from pathlib import Path

    from ctxloom.llm.common import stash
    from ctxloom.operators.written import written

    at = [Path(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    files = lambda: {f for d in at for f in d.rglob("shuffle_*")}
    for write in (stash, written):
        before = files()
        assert write(spark.range(1000).groupBy(F.col("id") % 7).count(), "test").count() == 7
        left = files() - before
        assert len({f.name.split("_")[1] for f in left}) <= 1  # the count's own
