"""What a path says: whether it is indexed, whether it is a test, and its language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, numbered none 0, C 1, C++ 2, Go 3, Rust 4, TypeScript 5, TSX and JavaScript 6, Python 7, Java 8.
LANG_NAMES = ["none", "c", "cpp", "go", "rust", "typescript", "tsx", "python", "java"]
EXTENSIONS = {
    ".c": 1, ".h": 2, ".cc": 2, ".cpp": 2, ".cxx": 2, ".hpp": 2, ".hh": 2, ".hxx": 2, ".ipp": 2, ".inl": 2, ".go": 3, ".rs": 4,
    ".ts": 5, ".mts": 5, ".cts": 5, ".tsx": 6, ".js": 6, ".jsx": 6, ".mjs": 6, ".cjs": 6, ".py": 7, ".java": 8,
}
# Folders and names that aren't indexed.
SKIPPED_DIR = r"(^|/)(third_party|vendor|external|node_modules|secrets)/"
SKIPPED_NAME = r"\.min\.js$|\.pb\.cc$|\.pb\.go$|^moc_.*\.cpp$|_generated\.|^\.env$|^\.env\.|\.pem$|\.key$|^id_rsa$|^credentials$"
# Folders and names of tests.
TEST_DIRS = ["test", "tests", "testing", "__tests__", "testdata", "spec", "specs", "fixtures", "e2e", "benchmark", "benchmarks"]
TEST_DIR = r"(^|/)(?:(?i:" + "|".join(TEST_DIRS) + r")|test[A-Z_-][^/]*|[^/]*[a-z0-9]Tests?)/"
TEST_STEM = r"^test_|^gtest_|^conftest$|_test$|_tests$|_unittest$|\.test$|\.spec$|[a-z0-9](Test|Tests|IT|TestCase)$"
# The evaluation's own rules, kept apart from the engine's on purpose.
EVAL_VENDOR = r"(^|/)(vendor|third_party|thirdparty|node_modules|deps|external|generated|gen|dist|build|target|\.git)(/|$)|^contrib(/|$)"
EVAL_GENERATED = r"(\.pb\.go|_pb2\.py|\.generated\.[a-z]+|\.min\.js|\.g\.dart|_generated\.[a-z]+)$|(^|/)zz_generated[^/]*$"
EVAL_TEST = (
    r"(^|/)(tests?|testing|testsuite|spec|specs|__tests__|testdata|fixtures|e2e|benchmarks?|asv_bench)(/|$)|(^|/)tests?[._-][^/]+$"
    r"|_test\.[a-z]+$|\.test\.[a-z]+$|\.spec\.[a-z]+$|(^|/)Test[A-Z][^/]*\.java$|[A-Za-z0-9]Tests?\.java$|[A-Za-z0-9]IT\.java$"
)
EVAL_DOC = r"\.(md|rst|txt|adoc|png|jpg|svg|gif|pdf)$|(^|/)docs?/"


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def indexable(path: Column) -> Column:
    return ~path.rlike(SKIPPED_DIR) & ~name_of(path).rlike(SKIPPED_NAME)


def is_test(path: Column) -> Column:
    stem = F.regexp_extract(name_of(path), r"^(.+)\.[^.]*$", 1)
    return path.rlike(TEST_DIR) | ((stem != "") & stem.rlike(TEST_STEM))


def lang_of(path: Column) -> Column:
    """A number as in LANG_NAMES."""
    ext = F.lower(F.regexp_extract(name_of(path), r"(\.[^.]*)$", 1))
    table = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(table, ext), F.lit(0))


def is_text(content: Column) -> Column:
    """No zero byte among the first 8000 of a binary column."""
    return ~F.hex(F.substring(content, 1, 8000)).rlike("^(?:..)*?00")


def eval_is_code(path: Column) -> Column:
    """A first-party source file by the evaluation's rules."""
    return ~path.rlike(EVAL_VENDOR) & ~path.rlike(EVAL_GENERATED) & (lang_of(path) > 0)


def eval_is_test(path: Column) -> Column:
    return path.rlike(EVAL_TEST)


def eval_is_doc(path: Column) -> Column:
    return path.rlike(EVAL_DOC)
