"""Source code to chunks: functions are leaves, containers keep what their definitions leave.

Every character of a file but the line breaks belongs to exactly one chunk. Python is read with its own parser; the other languages by a
scanner that knows strings, comments and braces. What the scanner can't tell stays in its container: a chunk is
never guessed.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ctxloom.functions.names import normalise_symbol

FUNCTION, CONTAINER = 0, 1
C, CPP, GO, RUST, TS, TSX, PYTHON, JAVA = 1, 2, 3, 4, 5, 6, 7, 8
MAX_DEPTH = 64
#: Characters of text whose chunks are held before they are handed on.
AT_ONCE = 1 << 20
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "sizeof", "else", "do", "try", "new", "synchronized", "static_assert", "await", "function"}


@dataclass
class Definition:
    kind: int
    name: str
    start: int
    stop: int
    inner: list[Definition] = field(default_factory=list)


def masked(lang: int, src: str) -> str:
    """The text with comments and strings as spaces, of the same length."""
    strings = [r'"(?:\\.|[^"\\\n])*"']
    if lang in (TS, TSX, GO):
        strings.append(r"`(?:\\.|[^`\\])*`" if lang != GO else r"`[^`]*`")
    strings.append(r"'(?:\\.|[^'\\\n])'" if lang in (RUST, GO) else r"'(?:\\.|[^'\\\n])*'")
    if lang in (C, CPP):
        strings.insert(0, r'R"(?P<tag>[^()\\ ]{0,16})\((?:.|\n)*?\)(?P=tag)"')
    if lang == RUST:
        strings.insert(0, r'r(?P<tag>#*)"(?:.|\n)*?"(?P=tag)')
    if lang == JAVA:
        strings.insert(0, r'"""(?:.|\n)*?"""')
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    return re.sub("|".join([r"//[^\n]*", r"/\*(?:.|\n)*?\*/", *strings]), blank, src)


def _closing(text: str, at: int, stop: int) -> int | None:
    """The place of the brace that closes the one at `at`."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at, stop):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.start()
    return None


def _called(head: str) -> str | None:
    """The name before a header's first parenthesis."""
    m = re.search(r"((?:[\w~]+(?:<[^()<>]*(?:<[^()<>]*>[^()<>]*)*>)?\s*::\s*)*(?:operator\s*[^\s\w(]+|[~\w]+))\s*(?:<[^()]*>)?\s*\(", head)
    return m[1] if m and m[1] not in _NOT_NAMES and "=" not in head[: m.start()] else None


_ARROW = re.compile(r"(?:^|\n)[ \t]*(?:export\s+)?(?:(?:const|let|var)\s+|(?:(?:public|private|protected|readonly|static)\s+)*)(\w+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:\([^()]*\)|\w+)\s*(?::\s*[^={}]+)?=>\s*$")
_ARROW_LINE = re.compile(r"[ \t]*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*(?::[^=;{}\n]+)?=\s*(?:async\s*)?(?:\([^()\n]*\)|\w+)\s*(?::\s*[^={}\n]+)?=>[^{}\n;]*;?[ \t]*(?=\n|$)")


def _definition(lang: int, head: str, owner: str) -> tuple[int, str, int] | None:
    """kind, name, and where in the header it begins."""
    first = len(head) - len(head.lstrip())
    if lang == GO:
        m = re.search(r"\bfunc\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^()]*\)\s*)?(\w+)\s*[\[(]", head)
        return (FUNCTION, f"{m[1]}::{m[2]}" if m[1] else m[2], m.start()) if m else None
    if lang == RUST:
        if m := re.search(r"\bfn\s+(\w+)", head):
            return FUNCTION, m[1], first
        if m := re.search(r"\bimpl\b(.*)$", head, re.S):
            body = re.sub(r"\bwhere\b.*$", "", m[1], flags=re.S)
            while (cut := re.sub(r"<[^<>]*>", "", body)) != body:
                body = cut
            return CONTAINER, body.split(" for ")[-1].strip(" &*\n\t").split("::")[-1], first
        m = re.search(r"\b(?:mod|trait)\s+(\w+)", head)
        return (CONTAINER, m[1], first) if m else None
    if lang in (TS, TSX):
        if m := re.search(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\bdeclare\s+)?(?:\babstract\s+)?\b(?:class|namespace|module)\s+([\w.]+)[^()=]*$", head):
            return CONTAINER, m[1], m.start()
        if m := re.search(r"(?:\bexport\s+)?(?:\bdefault\s+)?(?:\basync\s+)?\bfunction\s*\*?\s*(\w+)", head):
            return FUNCTION, m[1], m.start()
        if m := _ARROW.search(head):
            return FUNCTION, m[1], m.start(1) if not m[0].strip() else m.start() + len(m[0]) - len(m[0].lstrip())
        m = re.search(r"(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*([#\w]+)\s*(?:<[^()]*>)?\s*\([^{}]*\)[^(){}=;]*$", head) if owner else None
        return (FUNCTION, m[1], m.start()) if m and m[1] not in _NOT_NAMES else None
    if lang == JAVA:
        if m := re.search(r"(?:\b(?:class|interface|enum|record)|@interface)\s+(\w+)", head):
            return CONTAINER, m[1], first
        if head.strip().split()[-1:] == [owner] and owner:
            return FUNCTION, owner, first
        name = _called(head)
        return (FUNCTION, name, first) if name else None
    if lang == CPP and (m := re.search(r"\b(?:namespace|(?<!enum )class|(?<!enum )struct|union)\s+(?:\[\[[^\]]*\]\]\s*)?([\w:]+)\s*(?:final\s*)?(?::[^:(]*(?:::[^(]*)*)?$", head)) and "(" not in head[: m.start()]:
        return CONTAINER, m[1], first
    if lang == CPP and re.search(r"\bnamespace\s*$|\bextern\s*$", head):
        return CONTAINER, "", first
    name = _called(head)
    return (FUNCTION, name, first) if name else None


def _upward(src: str, text: str, start: int, floor: int) -> int:
    """Where the comments and annotations directly above a definition begin."""
    line = src.rfind("\n", floor, start) + 1 or floor
    if text[line:start].strip():
        return start
    line = max(line, floor)
    while line > floor:
        above = max(src.rfind("\n", floor, line - 1) + 1, floor)
        own = src[above : line - 1].strip()
        if not own or (text[above : line - 1].strip() and not own.startswith(("@", "#["))):
            break
        line = above
    return line


def _scan(lang: int, src: str, text: str, start: int, stop: int, owner: str, depth: int) -> list[Definition]:
    out, head, at, paren = [], start, start, 0
    while at < stop and depth <= MAX_DEPTH:
        c = text[at]
        if lang in (C, CPP) and c == "#" and not text[text.rfind("\n", 0, at) + 1 : at].strip():
            while at < stop and not (text[at] == "\n" and src[at - 1] != "\\"):
                at += 1
            head = at = at + 1
            continue
        if lang in (TS, TSX) and (at == start or text[at - 1] == "\n") and not paren and (m := _ARROW_LINE.match(text, at, stop)):
            begin = _upward(src, text, at + len(m[0]) - len(m[0].lstrip()), head)
            out.append(Definition(FUNCTION, m[1], begin, m.end()))
            head = at = m.end()
            continue
        if c in "([":
            paren += 1
        elif c in ")]":
            paren = max(0, paren - 1)
        elif c == ";" and not paren:
            head = at + 1
        elif c == "{" and not paren:
            end = _closing(text, at, stop)
            if end is None:
                return out
            found = _definition(lang, text[head:at], owner)
            if found:
                kind, name, begin = found
                begin = _upward(src, text, head + begin, head)
                after = end + 1
                if kind == CONTAINER or lang in (TS, TSX):
                    after += len(re.match(r"[ \t]*;?", text[after:stop])[0])
                d = Definition(kind, name, begin, after)
                if kind == CONTAINER:
                    d.inner = _scan(lang, src, text, at + 1, end, name, depth + 1)
                out.append(d)
                end = after - 1
            head = at = end + 1
            continue
        elif c == "}":
            head = at + 1
        at += 1
    return out


def _python(src: str) -> list[Definition] | None:
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError, RecursionError):
        return None
    starts = [0]
    for line in src.splitlines(keepends=True) if "\f" not in src and "\x0b" not in src else re.findall(r"[^\n]*\n|[^\n]+", src):
        starts.append(starts[-1] + len(line))
    lines = src.split("\n")

    def read(body, depth) -> list[Definition]:
        out = []
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([n.lineno, *[d.lineno for d in n.decorator_list]])
                while first > 1 and lines[first - 2].lstrip().startswith("#"):
                    first -= 1
                leaf = not isinstance(n, ast.ClassDef)
                out.append(Definition(FUNCTION if leaf else CONTAINER, n.name, starts[first - 1], min(starts[n.end_lineno], len(src)), [] if leaf else read(n.body, depth + 1)))
            elif depth < MAX_DEPTH:
                for part in ("body", "orelse", "finalbody"):
                    out += read(getattr(n, part, None) or [], depth + 1) if isinstance(getattr(n, part, None), list) else []
        return out

    return read(tree.body, 0)


def chunk(lang: int, src: str) -> Iterator[tuple[int, int, int, str, str]]:
    """start_line, end_line, kind, symbol and content of each chunk. Blank texts and texts without a language have none."""
    if not lang or not src or not src.strip():
        return
    if lang == PYTHON:
        tree, scope = _python(src) or [], ""
    else:
        text = masked(lang, src)
        m = re.search(r"^\s*package\s+(\w+)", text, re.M) if lang == GO else None
        tree, scope = _scan(lang, src, text, 0, len(src), "", 0), m[1] if m else ""
    line = lambda at: src.count("\n", 0, at) + 1

    def emit(inner: list[Definition], scope: str, start: int, stop: int):
        rest, at = [], start
        for d in inner:
            if d.start < at:
                continue
            rest.append(src[at : d.start])
            at = d.stop
            name = normalise_symbol(d.name)
            symbol = "::".join(x for x in (scope, name) if x)
            if d.kind == FUNCTION:
                yield line(d.start), line(max(d.start, d.stop - 1)), FUNCTION, symbol, src[d.start : d.stop]
            else:
                yield from emit(d.inner, symbol, d.start, d.stop)
        rest.append(src[at:stop])
        left = "\n".join(rest)
        if left.strip():
            yield line(start), line(max(start, stop - 1)), CONTAINER, scope, left

    yield from emit(tree, scope, 0, len(src))


ROW = StructType([StructField(n, IntegerType()) for n in ("start_line", "end_line", "kind")] + [StructField(n, StringType()) for n in ("symbol", "content")])


@udtf(returnType=ROW)
class ChunkSource:
    """A table function: SELECT * FROM files, LATERAL chunk_source(lang, text)."""

    def eval(self, lang: int, text: str):
        yield from chunk(lang or 0, text or "")


def chunk_files(files):
    """(blob, lang, text) -> (blob, lang, start_line, end_line, kind, symbol, content); each blob and language once."""
    once = files.select("blob", "lang", "text").where("lang > 0").dropDuplicates(["blob", "lang"])

    def run(batches):
        import pandas as pd

        columns = ["blob", "lang", "start_line", "end_line", "kind", "symbol", "content"]
        for pdf in batches:
            rows, size = [], 0
            for b, g, t in pdf[["blob", "lang", "text"]].itertuples(index=False):
                rows += [(b, g, *c) for c in chunk(int(g), t or "")]
                size += len(t or "")
                if size >= AT_ONCE:  # no more chunks are held than those of so much text
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns)

    return once.mapInPandas(run, "blob string, lang int, start_line int, end_line int, kind int, symbol string, content string")


def closing_line(text: str, line: int, most: int = 4000) -> int | None:
    """The line (from 1) of the brace that closes the first one at or after a line; None rather than a guess."""
    cut = masked(CPP, text)
    if re.search(r'R"|`', text):
        return None
    start = 0
    for _ in range(line - 1):
        start = cut.find("\n", start) + 1
        if not start:
            return None
    brace = cut.find("{", start)
    end = _closing(cut, brace, len(cut)) if brace >= 0 else None
    found = cut.count("\n", 0, end) + 1 if end is not None else None
    return found if found is not None and found - line <= most else None
