"""Text, paths, names and the chunker: random inputs against plain restatements of the rules, and grids over their tables."""

import json
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ctxloom.functions import chunking, diffs, models, names, paths, text
from ctxloom.functions.chunking import C, CPP, GO, JAVA, PYTHON, RUST, TS, chunk


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.select(f(F.col("v")).alias("x"), "i").orderBy("i").collect()]


# --- words --------------------------------------------------------------------------------------------


def plain_words(s):
    """Runs of ASCII letters, digits, underscores and all beyond ASCII, of 2 to 64 bytes."""
    out, run = [], ""
    for c in s + " ":
        if c == "_" or c.isascii() and c.isalnum() or ord(c) >= 128:
            run += c
        else:
            out += [run] if 2 <= len(run.encode()) <= 64 else []
            run = ""
    return out


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def plain_parts(w):
    """Pieces between underscores and humps; only two or more of two bytes count."""
    kind = lambda c: "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or "0" <= c <= "9" else "_" if c == "_" else "?"
    kinds, pieces = [kind(c) for c in w], [""]
    for i, c in enumerate(w):
        if c == "_":
            pieces.append("")
            continue
        hump = i > 0 and kinds[i] == "A" and (kinds[i - 1] == "a" or kinds[i - 1] == "A" and i + 1 < len(w) and kinds[i + 1] == "a")
        if hump:
            pieces.append("")
        pieces[-1] += c
    pieces = [low(p) for p in pieces if len(p.encode()) >= 2]
    return pieces if len(pieces) >= 2 else []


def scraps(seed, n=250):
    r = random.Random(seed)
    bits = ["Sail", "MAST", "knot", "Q", "x9", "_", "__", "ß", "ñandú", "7", ".", " ", "::", "-", "\t", "\n", "keel" * 20, "Z" * 64, "oar", "The", "with", "RIGging", "return"]
    return ["".join(r.choices(bits, k=r.randrange(0, 9))) for _ in range(n)]


def test_document_tokens_follow_the_rules(spark):
    given_ = scraps(1)
    want = [[t for w in plain_words(s) for t in [low(w), *plain_parts(w)]] for s in given_]
    assert column(spark, given_, text.document_tokens) == want
    assert column(spark, given_, text.query_tokens) == [[low(w) for w in plain_words(s)] for s in given_]
    assert sum(len(plain_parts(w)) > 0 for s in given_ for w in plain_words(s)) > 50


def test_query_terms_are_tokens_without_function_words(spark):
    given_ = [f"{a} {b} {a}" for a, b in zip(scraps(2), scraps(3))]
    tokens = column(spark, given_, text.document_tokens)
    assert column(spark, given_, text.query_terms) == [list(dict.fromkeys(t for t in ts if t not in text.STOPWORDS)) for ts in tokens]
    assert column(spark, [" ".join(text.STOPWORDS)], text.query_terms) == [[]]


def test_identifiers_of_the_baselines(spark):
    given_ = scraps(4)
    found = [re.findall("[A-Za-z_][A-Za-z0-9_]*", s) for s in given_]
    want = [list(dict.fromkeys(w for w in f if len(w) >= 4 and w.lower() not in text.BASELINE_STOPWORDS)) for f in found]
    assert column(spark, given_, text.grep_terms) == want
    terms = column(spark, given_, text.baseline_terms)
    for f, t in zip(found, terms):
        assert set(t) <= {x for w in f for x in [w.lower(), *(w.lower()[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1))]}
        assert {w.lower() for w in f if len(w) >= 2} - set(text.BASELINE_STOPWORDS) <= set(t)


# --- paths ---------------------------------------------------------------------------------------------


def test_every_test_folder_counts_anywhere_in_any_case(spark):
    for d in paths.TEST_DIRS:
        good = [f"{d}/anchor.rs", f"bay/{d}/anchor.rs", f"bay/{d.upper()}/deep/anchor.rs", f"bay/{d.title()}/anchor.rs"]
        bad = [f"{d}", f"bay/{d}", f"bay/x{d}x/anchor.rs", f"bay/{d}{d}q/anchor.rs"]
        assert column(spark, good + bad, paths.is_test) == [True] * 4 + [False] * 4, d


def test_names_that_end_or_begin_like_tests(spark):
    for stem in ["test_buoy", "gtest_buoy", "conftest", "buoy_test", "buoy_tests", "buoy_unittest", "buoy.test", "buoy.spec", "BuoyTest", "BuoyTests", "BuoyIT", "BuoyTestCase", "b0Test"]:
        assert column(spark, [f"bay/{stem}.kt", f"bay/{stem}", f"bay/{stem}x.kt", f"bay/{stem}/reef.kt"][:3], paths.is_test) == [True, False, stem.startswith(("test_", "gtest_"))], stem
    assert column(spark, ["bay/TEST.kt", "bay/ATTEST.kt", "bay/DIGIT.kt", "bay/submit.kt", "moorTests/x.kt", "testMoor/x.kt", "testmoor/x.kt", "bay/.test"], paths.is_test) == [False, False, False, False, True, True, False, False]


def test_what_is_not_indexed(spark):
    folders = ["third_party", "vendor", "external", "node_modules", "secrets"]
    assert column(spark, [p for f in folders for p in (f"{f}/tide.go", f"sea/{f}/a/tide.go", f"sea/{f}", f"sea/my{f}/tide.go")], paths.indexable) == [False, False, True, True] * 5
    names_ = {"tide.pb.go": False, "tide.pb.cc": False, "moc_tide.cpp": False, "tide_generated.ts": False, ".env": False, ".env.prod": False, "tide.pem": False, "tide.key": False, "credentials": False,
              "tide.pb.h": True, "xmoc_tide.cpp": True, ".envrc": True, "tide.keys": True, "credentials.py": True, "tide.min.jsx": True}
    assert dict(zip(names_, column(spark, [f"sea/{n}" for n in names_], paths.indexable))) == names_


def test_languages_follow_the_table(spark):
    every = list(paths.EXTENSIONS.items())
    assert column(spark, [f"a.b/tide{e.upper()}" for e, _ in every], paths.lang_of) == [n for _, n in every]
    assert column(spark, ["tide", "a.py/tide", "tide.", "tide.pyx", ".java"], paths.lang_of) == [0, 0, 0, 0, 8]


def test_zero_bytes_count_in_the_first_8000_alone(spark):
    at = lambda n: bytearray(b"w" * n + b"\0" + b"w" * 9)
    assert column(spark, [at(0), at(7999), at(8000), bytearray(b"\x10\x01" * 40)], paths.is_text, "binary") == [False, False, True, True]


# --- names ---------------------------------------------------------------------------------------------

SIMPLE = st.from_regex(r"[a-z][a-z0-9_]{0,6}", fullmatch=True)


@given(st.lists(SIMPLE, min_size=1, max_size=4), st.sampled_from(["::", ".", "#"]), st.sampled_from(["", "<W>", "<W, X<Y>>", "(tide t)", "<W>(tide (*)(int))"]), st.sampled_from(["", " -> Reef<Z>", "->int"]), st.sampled_from(["", "*", "& ", "**"]))
def test_symbols_lose_arguments_and_results(parts, separator, arguments, result, pointer):
    assert names.normalise_symbol(pointer + separator.join(parts) + arguments + result) == "::".join(parts)


def test_symbols_of_the_evaluation(spark):
    given_ = {"(t *Tide).Rise": "t *Tide::Rise", "(*Tide).Rise": "Tide::Rise", "( Tide ).Rise": "Tide::Rise", "Tide<A<B<C>>>::rise(int(x))": "Tide::rise", " a . b ": "a::b", "::a#b::": "a::b"}
    got = column(spark, list(given_), names.eval_symbol)
    assert got[1:] == list(given_.values())[1:]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("aé€😀\n", max_size=12), min_size=1, max_size=8), st.integers(4, 30))
def test_inputs_are_cut_at_whole_characters(spark, texts, most):
    rows = spark.createDataFrame([(i, "sy", t) for i, t in enumerate(texts)], "i int, s string, c string")
    for t, got in zip(texts, [r[0] for r in rows.select(names.embed_text(F.col("s"), F.col("c"), most)).collect()]):
        whole = "sy\n" + t
        assert whole.startswith(got) and len(got.encode()) <= most
        assert got == whole or len(got.encode()) + len(whole[len(got)].encode()) > most


def test_unit_vectors(spark):
    v = np.random.default_rng(1).normal(size=(20, 5))
    got = np.array(column(spark, v.tolist(), names.unit, "array<double>"))
    assert np.allclose(got, v / np.linalg.norm(v, axis=1)[:, None], atol=1e-6)


# --- chunker: random programs in each language -----------------------------------------------------------


def program(lang, seed):
    """A random program of nested containers and functions -> source, {name: its text}, names of containers."""
    r, count = random.Random(seed), iter(range(1000))
    want, boxes = {}, set()
    note = {PYTHON: "# '}' \"{"}.get(lang, "// '}' \"{")
    nests = {PYTHON, JAVA, RUST, TS, CPP}

    def function(scope, pad):
        n = f"do{next(count)}"
        head = {PYTHON: f"def {n}(a, b=1):", JAVA: f"int {n}(int a)" + " {", RUST: f"fn {n}(a: i32) -> i32" + " {", TS: f"{'export ' if scope else ''}function {n}(a: number): number" + " {",
                CPP: f"int {n}(int a)" + " {", C: f"static int {n}(int a, char *b)" + " {", GO: f"func {n}(a int) int" + " {"}[lang]
        body = {PYTHON: ["x = '}{'", "return a"], C: ['const char *s = "}{";', "if (a) { a--; }", "return a;"]}.get(lang, ["if (a > 0) { a = 1 }" if lang == GO else "if (a > 0) { a = 1; }", "return a" + ("" if lang == GO else ";")])
        lines = [pad + head, *[pad + "    " + b for b in r.sample(body, 1) + body[-1:]]] + ([] if lang == PYTHON else [pad + "}"])
        above = [pad + note] if r.random() < 0.4 else []
        want["::".join([*scope, n])] = "\n".join(above + lines)
        return above + lines

    def box(scope, pad, deep):
        n = f"Box{next(count)}"
        boxes.add("::".join([*scope, n]))
        head = {PYTHON: f"class {n}:", JAVA: f"class {n}" + " {", RUST: f"mod {n}" + " {", TS: f"{'export ' if scope else ''}namespace {n}" + " {", CPP: f"namespace {n}" + " {"}[lang]
        return [pad + head, *block([*scope, n], pad + "    ", deep + 1), *([] if lang == PYTHON else [pad + "}"])]

    def block(scope, pad, deep):
        out = []
        for _ in range(r.randrange(1, 4)):
            out += box(scope, pad, deep) if lang in nests and deep < 3 and r.random() < 0.4 else function(scope, pad)
            if r.random() < 0.5:
                out.append("")
        return out

    lines = box([], "", 1) if lang == JAVA else block(["tide"] if lang == GO else [], "", 0)
    return "\n".join((["package tide", ""] if lang == GO else []) + lines) + "\n", want, boxes


@pytest.mark.parametrize("lang", [C, CPP, GO, RUST, TS, PYTHON, JAVA])
def test_chunks_of_random_programs(lang):
    for seed in range(40):
        src, want, boxes = program(lang, seed)
        chunks = list(chunk(lang, src))
        got = {c[3]: c for c in chunks if c[2] == chunking.FUNCTION}
        assert set(got) == set(want), (seed, src)
        lines = src.split("\n")
        for name, body in want.items():
            start, stop, _, _, content = got[name]
            assert "\n".join(lines[start - 1 : stop]) == body and content.strip() == body.strip(), (seed, name)
        assert {c[3] for c in chunks if c[2] == chunking.CONTAINER} <= boxes | {"", "tide"}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["struct Hull { int keel; };", "long sum(long a)", "{", "} // shut", "'{'", '"', "/* {", "*/", "fn haul() {}", "class Crew:", "    def row(self): pass", "\t;", "=> {", "ß"]), max_size=14), st.integers(1, 8))
def test_no_character_is_lost_or_doubled(parts, lang):
    src = "\n".join(parts)
    letters = lambda s: sorted(s.replace(" ", "").replace("\t", "").replace("\n", ""))
    if src.strip():
        assert letters("".join(c[4] for c in chunk(lang, src))) == letters(src)


def test_texts_without_a_grammar_or_without_letters_have_no_chunks():
    assert [list(chunk(n, s)) for n, s in ((0, "keel: oak\n"), (GO, ""), (RUST, "\n\n \n"))] == [[], [], []]


@given(st.text("{}\n x", max_size=60), st.integers(1, 5))
def test_closing_lines_by_counting(src, line):
    tail, depth, want = "\n".join(src.split("\n")[line - 1 :]), 0, None
    for i in range(max(tail.find("{"), 0), len(tail)):
        depth += (tail[i] == "{") - (tail[i] == "}")
        if tail[i] == "}" and depth == 0 and "{" in tail[:i]:
            want = line + tail[:i].count("\n")
            break
    assert chunking.closing_line(src, line) == (want if "{" in tail else None)


# --- diffs and models ---------------------------------------------------------------------------------


def test_diffs(spark):
    diff = "\n".join(["diff --git a/old name.c b/new name.c", "index 1..2", "--- a/old name.c", "+++ b/new name.c", "@@ -3,2 +3 @@ int keel(", "-a", "-b", "+c", "@@ -9 +8,0 @@", "--- a/trap.c", "@@ -20,0 +19,4 @@", "++++ b/trap.c",
                      "diff --git a/gone.c b/gone.c", "deleted file mode 100644", "--- a/gone.c", "+++ /dev/null", "@@ -1,7 +0,0 @@", "-x", "diff --git a/bin b/bin", "Binary files differ",
                      "diff --git a/fresh.c b/fresh.c", "new file mode 100755", "--- /dev/null", "+++ b/fresh.c", "@@ -0,0 +1 @@", "+y"])
    rows = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "qid long, diff string")
    files = diffs.files_of(rows)
    assert sorted((r["status"], r["path"]) for r in files.collect()) == [("A", "fresh.c"), ("D", "gone.c"), ("M", ""), ("M", "new name.c")]
    assert sorted(tuple(r) for r in diffs.ranges_of(files).collect()) == [(1, "new name.c", 3, 4), (1, "new name.c", 9, 9)]


def test_embedding_responses():
    r = np.random.default_rng(3)
    v = r.normal(size=(7, 3))
    order = r.permutation(7)
    body = lambda rows: json.dumps({"data": [{"index": int(i), "embedding": v[j].tolist()} for i, j in rows]})
    assert np.allclose(models.embeddings_of(body((i, i) for i in order), 7, 3), v / np.linalg.norm(v, axis=1)[:, None])
    for bad, n, dim in ((body([(0, 0), (0, 1)]), 2, 3), (body([(0, 0)]), 2, 3), (body([(1, 0)]), 1, 3), (body([(0, 0)]), 1, 4), (json.dumps({"data": [{"index": 0, "embedding": [0, 0, 0]}]}), 1, 3)):
        with pytest.raises(ValueError):
            models.embeddings_of(bad, n, dim)


def test_reranking_responses():
    scores = [0.25, 0.75, 0.25, 0.5]
    body = json.dumps({"data": [{"index": i, "relevance_score": s} for i, s in reversed(list(enumerate(scores)))]})
    assert models.relevance_of(body, 4) == [(1, 0.75), (3, 0.5), (0, 0.25), (2, 0.25)]
    for n in (3, 5):
        with pytest.raises(ValueError):
            models.relevance_of(body, n)
