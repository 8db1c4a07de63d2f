"""Where statements and their blocks lie in source texts.

A text is scanned once: strings and comments are masked, brackets are matched with a stack over what
remains, and blocks are followed by indentation (Python) or braces (JavaScript, TypeScript). What a
statement is (function, class, method) is told elsewhere, from its parts. The scan keeps a stack
and its own place in the text, which column expressions have no linear way to do, so it runs over
Arrow batches of texts.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# The scan travels to workers by value; they need Arrow, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATEMENT = ("owner:string,start_line:bigint,end_line:bigint,head:string,parameters:string,"
             "tail:string,doc:string,decorators:array<string>,code:string")
OUTPUT_CHARS = 1 << 20      # of texts whose statements leave together

_STRING = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|' r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
_LONG = (r'"""[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+(?:"""|\Z)|'
         r"'''[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+(?:'''|\Z)")
_PY_LITERAL = re.compile(rf"(?P<comment>#[^\n]*)|(?P<long>{_LONG})|(?P<string>{_STRING})", re.S)
# A regular expression is told from a division by what stands before it.
_JS_LITERAL = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<template>`)|(?P<close>\})|(?P<open>\{)"
    rf"|(?P<string>{_STRING})"
    r"|(?P<regex>(?:(?<=[=(,:\[!&|?;+\n])|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof))[ \t]*/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/)", re.S)
_JS_TEMPLATE = re.compile(r"[^`\\$]*+(?:(?:\\.|\$(?!\{))[^`\\$]*+)*+(`|\$\{|\Z)", re.S)
_CLOSER = {"(": ")", "[": "]", "{": "}"}


def _masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, fill in spans:
        out += [text[at:start], fill * (end - start)]
        at = end
    return "".join(out) + text[at:]


def _pairs(masked: str) -> dict[int, int]:
    """Closing place by opening place; a closer without its opener counts for nothing, an opener
    without its closer goes to the end."""
    out, stack = {}, []
    for m in re.finditer(r"[()\[\]{}]", masked):
        c = m.group()
        if c in _CLOSER:
            stack.append((m.start(), _CLOSER[c]))
        elif any(want == c for _, want in stack[-8:]):
            while True:
                start, want = stack.pop()
                out[start] = m.start()
                if want == c:
                    break
    return out | dict.fromkeys((s for s, _ in stack), len(masked))


class _Text:
    """A text with its masks: ``bare`` has no comments and no strings, ``shown`` no comments."""

    def __init__(self, text: str, spans: list[tuple[int, int, str]]) -> None:
        self.text = text
        self.bare = _masked(text, spans)
        self.comments = [(s, e) for s, e, fill in spans if fill == " "]
        self.shown = _masked(text, [(s, e, " ") for s, e in self.comments])
        self.breaks = [m.start() for m in re.finditer("\n", text)]

    def line(self, place: int) -> int:
        return bisect_right(self.breaks, place - 1) + 1

    def last(self, start: int, end: int) -> int:
        """The place after the last character of a stretch that is neither blank nor comment."""
        return start + len(self.bare[start:end].rstrip())


# --- Python ------------------------------------------------------------------

_PY_HEAD = re.compile(r"\s*(@|(?:async\s+)?def\b|class\b|import\b|from\b)")
_PY_BREAK = re.compile(r"\\\n|[()\[\]{}]|\n(?=[ \t\f]*(?:(?:async\s+)?def|class)\b)|\n")


def _logical_lines(bare: str) -> Iterator[tuple[int, int]]:
    """Stretches of lines that brackets or backslashes join. No definition starts inside brackets,
    so one ends whatever is open."""
    start = depth = 0
    for m in _PY_BREAK.finditer(bare):
        c = m.group()
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth = max(0, depth - 1)
        elif c == "\n" and (not depth or re.match(r"[ \t\f]*(?:async\s+def|def|class)\s+\w+\s*[(\[:]",
                                                  bare[m.end():m.end() + 200])):
            yield start, m.start()
            start, depth = m.end(), 0
    yield start, len(bare)


def python_statements(text: str) -> list[dict]:
    """Definitions and imports at the top level and in class bodies, classes nested to any depth."""
    spans, longs = [], {}
    for m in _PY_LITERAL.finditer(text):
        spans.append((m.start(), m.end(), " " if m.lastgroup == "comment" else '"'))
        if m.lastgroup == "long":
            longs[m.start()] = m.end()
    t, rows, stack, marks = _Text(text, spans), [], [], []
    pairs, last_line, waiting = _pairs(t.bare), 0, None
    doc = lambda at: text[at + 3:longs[at] - 3] if at in longs else None
    for start, end in _logical_lines(t.bare):
        line = t.bare[start:end]
        first = start + len(line) - len(line.lstrip())
        end = t.last(start, end)
        if first >= end:
            continue
        if waiting is not None:
            waiting["doc"] = doc(first)
            waiting = None
        indent = first - start
        while stack and indent <= stack[-1][0]:
            row = stack.pop()[2]
            if row:
                row["end_line"] = last_line
        head, row = _PY_HEAD.match(t.bare, first), None
        opens = t.bare[end - 1] == ":"
        last_line = t.line(end - 1)
        if head and head.group(1) == "@":
            marks.append((first, text[first + 1:end].strip()))
            continue
        if head and all(is_class for _, is_class, _ in stack):
            row = {"owner": next((r["head"] for _, _, r in reversed(stack)), None),
                   "start_line": t.line(marks[0][0] if marks else first), "end_line": last_line,
                   "decorators": [m for _, m in marks]}
            rows.append(row)
            if head.group(1) in ("import", "from"):
                row["code"] = text[first:end]
            else:
                place, group = head.end(), None
                while place < end and t.bare[place] != ":":
                    if t.bare[place] == "(" and group is None:
                        group = place
                    place = pairs.get(place, place) + 1
                after = min(pairs[group] + 1, end) if group is not None else place
                row["head"] = t.shown[first:place if group is None else group]
                row["parameters"] = None if group is None else text[group:after]
                row["tail"] = t.shown[after:place + 1]
                body = place + 1
                while body < end and t.bare[body].isspace():
                    body += 1
                if body < end:
                    row["doc"] = doc(body)
                else:
                    waiting = row
        marks = []
        if opens:
            stack.append((indent, bool(row) and head.group(1) == "class", row))
    for _, _, row in stack:
        if row:
            row["end_line"] = last_line
    return rows


# --- JavaScript and TypeScript -----------------------------------------------

_JS_SKIP = re.compile(r"[\s;]*")
_JS_KIND = re.compile(r"(?P<function>(?:export\s+(?:default\s+)?)?(?:async\s+)?function\b)"
                      r"|(?P<class>(?:export\s+(?:default\s+)?)?class\b)"
                      r"|(?P<bound>(?:const|let|var)\b)|(?P<import>import\b(?!\s*[(.]))")
_JS_MARK = re.compile(r"@[\w.$]+\s*")
_JS_NEXT = re.compile(r"[()\[\]{};\n]|=>")
_JS_BOUND = re.compile(r"\s*(?:async\b\s*)?(?:<[^()]*>)?\s*\(")
_NO_END_AFTER = set("=,(:?&|+-*<.![{")
_NO_END_BEFORE = set("{=.,)?:&|+*/<>]([")
_HOLD_AFTER = re.compile(r"\b(?:export|default|async|function|class|extends|implements|const|let|var|"
                         r"import|from|abstract|static|public|private|protected|readonly|override|"
                         r"get|set|as|type)\Z")
_HOLD_BEFORE = re.compile(r"(?:extends|implements|from|of|in|instanceof|as|satisfies)\b")


def _js_spans(text: str) -> list[tuple[int, int, str]]:
    """Comments and strings; a template literal is one with all that it holds. Braces of what stands
    inside a template are told apart from its end by a stack."""
    spans, stack, at, began = [], [], 0, 0
    while m := _JS_LITERAL.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "open":
            stack.append("{")
        elif kind == "template" or kind == "close" and stack and stack[-1] == "`":
            if kind == "template":
                began = began if "`" in stack else m.start()
            else:
                stack.pop()
            inner = _JS_TEMPLATE.match(text, at)
            at = inner.end()
            if inner.group(1) == "${":
                stack.append("`")
            elif "`" not in stack:
                spans.append((began, at, '"'))
        elif kind == "close":
            stack = stack[:-1]
        elif "`" not in stack:
            spans.append((m.start(), m.end(), " " if kind == "comment" else '"'))
        if at >= len(text):
            break
    if "`" in stack:
        spans.append((began, len(text), '"'))
    return spans


def _js_ends_at(bare: str, start: int, place: int, end: int) -> bool:
    """Whether a statement ends at a line break."""
    before = bare[start:place].rstrip()
    after = _JS_SKIP.match(bare, place).end()
    if after >= end or not before:
        return True
    return not (before[-1] in _NO_END_AFTER or before.endswith("=>") or bare[after] in _NO_END_BEFORE
                or _HOLD_AFTER.search(before[-12:]) or _HOLD_BEFORE.match(bare, after))


def script_statements(text: str) -> list[dict]:
    """Functions, classes, bindings and imports at the top level, and the members of its classes."""
    t = _Text(text, _js_spans(text))
    bare, pairs, rows, imports = t.bare, _pairs(t.bare), [], 0
    ends = [e for _, e in t.comments]

    def comment_before(place: int) -> str | None:
        k = bisect_right(ends, place) - 1
        if k >= 0 and not text[ends[k]:place].strip() and text.startswith("/**", t.comments[k][0]):
            return text[t.comments[k][0]:ends[k]]
        return None

    def is_body(place: int, start: int) -> bool:
        before = bare[start:place].rstrip()
        return bool(before) and (before[-1] not in "=:|&<,(?[" or before.endswith("=>"))

    def region(at: int, stop: int, owner: str | None) -> None:
        nonlocal imports
        while (start := _JS_SKIP.match(bare, at).end()) < stop:
            doc = comment_before(start)
            while mark := _JS_MARK.match(bare, start):
                start = mark.end()
                if bare[start:start + 1] == "(":
                    start = _JS_SKIP.match(bare, min(pairs[start] + 1, stop)).end()
            found = _JS_KIND.match(bare, start) if owner is None else None
            kind = found.lastgroup if found else "member" if owner is not None else None
            place, end, group, body, arrow, equals = start, stop, None, None, None, None
            while (m := _JS_NEXT.search(bare, place, stop)):
                c, place = m.group(), m.end()
                if c == "{":
                    close = min(pairs[m.start()], stop)
                    if body is None and kind != "import" and (
                            kind != "bound" or arrow is not None) and is_body(m.start(), start):
                        body = m.start()
                        if kind != "bound":
                            end = min(close + 1, stop)
                            break
                    place = min(close + 1, stop)
                elif c in "([":
                    if c == "(" and group is None:
                        if kind == "bound":
                            if equals is None:
                                eq = re.compile(r"(?<![=!<>])=(?![=>])").search(bare, start, m.start())
                                equals = eq and eq.end()
                            if equals and arrow is None and _JS_BOUND.fullmatch(
                                    bare, equals, m.end()):
                                group = m.start()
                        else:
                            group = m.start()
                    place = min(pairs[m.start()] + 1, stop)
                elif c == ";" or c == "\n" and _js_ends_at(bare, start, m.start(), stop):
                    end = m.end() if c == ";" else m.start()
                    break
                elif c == "=>" and arrow is None and (
                        kind != "bound" or group is not None or equals is None):
                    arrow = m.end()
            last = max(t.last(start, end), start + 1)
            if kind == "import":
                if "from" in bare[start:last] or '"' in bare[start:last]:
                    rows.append({"code": text[start:last], "start_line": imports})
                    imports += 1
            elif kind and (body is not None or arrow is not None):
                split = group is not None and (body is None or group < body)
                head_end = group if split else arrow if kind == "bound" else body
                after = min(pairs[group] + 1, last) if split else head_end
                tail_end = arrow if kind == "bound" else body + 1 if body is not None else last
                row = {"owner": owner, "start_line": t.line(start), "end_line": t.line(last - 1),
                       "head": t.shown[start:head_end], "doc": doc,
                       "parameters": text[group:after] if split else None,
                       "tail": t.shown[after:max(after, tail_end or after)]}
                rows.append(row)
                if kind == "class" and body is not None:
                    region(body + 1, min(pairs[body], stop), row["head"])
            at = max(end, start + 1)

    region(0, len(text), None)
    return rows


_PARTS = {f.split(":")[0]: {"bigint": pa.int64(), "string": pa.string()}.get(f.split(":")[1], pa.list_(pa.string()))
          for f in STATEMENT.split(",")}


def scanned(batches: Iterator[pa.RecordBatch], most: int = OUTPUT_CHARS) -> Iterator[pa.RecordBatch]:
    """Rows (language, text, ...) as one row per statement, without ``text``. Texts are taken one by
    one and statements leave after about ``most`` characters of text, so memory depends on neither the
    batch nor what it gives."""
    def given(batch, at, rows):
        kept = batch.drop_columns(["text"]).take(pa.array(at, pa.int64()))
        parts = [pa.array([row.get(name) for row in rows], kind) for name, kind in _PARTS.items()]
        return pa.RecordBatch.from_arrays([*kept.columns, *parts], [*kept.schema.names, *_PARTS])

    for batch in batches:
        texts, languages, at, rows, taken = batch.column("text"), batch.column("language"), [], [], 0
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text:
                continue
            python = languages[i].as_py() == "python"
            found = python_statements(text) if python else script_statements(text)
            at += [i] * len(found)
            rows += found
            taken += len(text)
            if taken >= most and rows:
                yield given(batch, at, rows)
                at, rows, taken = [], [], 0
        if rows:
            yield given(batch, at, rows)


def statements(files: DataFrame) -> DataFrame:
    """A row per statement (STATEMENT's fields) of the column ``text``, whose line breaks are all
    newlines, in ``language``; the other columns stay. A filter on them belongs before this."""
    kept = [f for f in files.schema.fields if f.name != "text"]
    return files.mapInArrow(scanned, StructType(kept + StructType.fromDDL(STATEMENT).fields))
