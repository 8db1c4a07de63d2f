import pyarrow as pa

from patchloom.functions import lexical
from patchloom.operators import symbols as S

PY = '''from __future__ import annotations
import os
from pathlib import (
    Path,
)

@cache(maxsize=1)
@other
async def greet(name: str, x=(1, (2, 3))) -> Dict[str, int]:
    """Greet. """
    def inner():
        pass
    return 1


class Calc(Base, pkg.Mixin, Generic[T], metaclass=M):
    # note
    import re

    @property
    def add(self) -> float:
        "no triple quotes"
        return a

    class Inner:
        def deep(self): pass
if x:
    def hidden():
        pass
def multi(
    a,
):
    return 1
'''
JS = '''import { readFile } from 'fs/promises';
/**
 * Greets.
 *   Twice.
 */
function greet(name) {
    return `Hello, ${name}!`;
}
const one = x => x + 1;
/** Hidden. */
export async function gen(url) {
    if (x) { y(); }
}
export const nope = () => { return 1; };
class Dog extends Animal {
    constructor(p) {
    }
    async speak(x = f(1)) {
        if (x) {
            return 'Woof}';
        }
    }
}
'''
TS = '''const multiply = (a: number, b: number): number => {
    return a * b;
};
export class K extends B {
  private static run<T>(x: T): Promise<{a: T}> {
    return x;
  }
}
'''


def test_outline(spark):
    files = spark.createDataFrame([(1, "a.py", PY), (1, "b.js", JS), (1, "c.ts", TS), (1, "d.go", JS)],
                                  "change_id bigint, path string, content string")
    rows = S.outline(files).collect()
    fns = {(r.path, r.name): r for r in rows if r.kind == "function"}
    assert {(p, n, r.start_line, r.end_line, r.class_name) for (p, n), r in fns.items()} == {
        ("a.py", "greet", 7, 13, None), ("a.py", "add", 20, 23, "Calc"), ("a.py", "deep", 26, 26, "Inner"),
        ("a.py", "multi", 30, 33, None), ("b.js", "greet", 6, 8, None), ("b.js", "one", 9, 9, None),
        ("b.js", "gen", 11, 13, None), ("b.js", "constructor", 16, 17, "Dog"),
        ("b.js", "speak", 18, 22, "Dog"), ("c.ts", "multiply", 1, 3, None), ("c.ts", "run", 5, 7, "K")}
    greet = fns["a.py", "greet"]
    assert greet.decorators == ["cache(maxsize=1)", "other"] and greet.is_async
    assert greet.return_type == "Dict[str, int]" and greet.docstring == "Greet."
    assert fns["a.py", "add"].docstring is None and fns["a.py", "add"].decorators == ["property"]
    assert fns["b.js", "greet"].docstring == "Greets. Twice." and fns["b.js", "gen"].docstring is None
    assert fns["b.js", "one"].parameters == "(x)" and fns["b.js", "gen"].is_async
    assert fns["c.ts", "run"].return_type == "Promise<{a: T}>"
    bases = {r.name: r.base_classes for r in rows if r.kind == "class"}
    assert bases == {"Calc": ["Base", "pkg.Mixin"], "Inner": [], "Dog": ["Animal"], "K": []}
    assert sorted(r.import_text for r in rows if r.kind == "import") == [
        "from pathlib import (\n    Path,\n)", "import os", "import re",
        "import { readFile } from 'fs/promises';"]


def test_any_depth_of_classes_and_brackets(spark):
    code = "".join("    " * k + f"class L{k}:\n" + "    " * (k + 1) + f"def m{k}(self):\n"
                   + "    " * (k + 2) + "pass\n" for k in range(6))
    code += "def deep(a=((((((1,)))))), b: int = 2) -> int:\n    return a\n"
    files = spark.createDataFrame([(1, "a.py", code)], "change_id bigint, path string, content string")
    out = S.py_outline(S.py_statements(files))
    assert sorted(r.name for r in S.classes_of(out).collect()) == [f"L{k}" for k in range(6)]
    found = {r.name: (r.class_name, r.parameters) for r in S.functions_of(out).collect()}
    assert found == {**{f"m{k}": (f"L{k}", "(self)") for k in range(6)},
                     "deep": (None, "(a=((((((1,)))))), b: int = 2)")}


MANY_LINES = """function one(
  a,
  b = ((((((1)))))), // {
) {
  return `x ${a + `y ${"}"} {`} z {`;
}
class K<T>
  extends Base
{
  static x = 1
  handler = (a) => { return 1 }
  /** Runs. */
  @Get("/{id}")
  async run(
    x: { a: number },
  ): Promise<{ b: number }>
  {
    if (x) { y() }
  }
  get z() { return /[{"]/.test(a) }
}
const f = async (
  a: string,
): Promise<void> =>
{
  go()
}
const g = <T,>(a: T): T => a
const {p, q} = require("x")
const h = x =>
  x + 1
const o = { a: 1, run() { return 2 } }
/* import { no } from "no" */
import {
  z,
} from "z"
import 'side';
export default function () {}
function two(a: string): string;
function two(a: any): { b: number } { return a }
"""
FILES = "change_id bigint, path string, content string"


def test_headers_over_lines(spark):
    rows = S.outline(spark.createDataFrame([(1, "a.js", MANY_LINES)], FILES)).collect()
    assert {(r.name, r.start_line, r.end_line, r.class_name, r.is_async, r.return_type)
            for r in rows if r.kind == "function"} == {
        ("one", 1, 6, None, False, None), ("run", 14, 19, "K", True, "Promise<{ b: number }>"),
        ("z", 20, 20, "K", False, None), ("f", 22, 27, None, True, "Promise<void>"),
        ("g", 28, 28, None, False, "T"), ("h", 30, 31, None, False, None),
        ("two", 40, 40, None, False, "{ b: number }")}
    found = {r.name: r for r in rows}
    assert found["one"].parameters == "(\n  a,\n  b = ((((((1)))))), // {\n)"
    assert found["run"].docstring == "Runs."
    assert [(r.name, r.start_line, r.end_line, r.base_classes) for r in rows if r.kind == "class"] == [
        ("K", 7, 21, ["Base"])]
    assert sorted(r.import_text for r in rows if r.kind == "import") == [
        "import 'side';", 'import {\n  z,\n} from "z"']


ODD = '''"""
def no(): pass
"""
X = {
    "a": [1,
def after(x="#", y=(")")):
    r"""class No: pass"""
    def inner(): pass
class A(  # base
    B,
):

    \'\'\'Doc.

    def no(): pass
    \'\'\'
    if True:
        def hidden(self): pass
    x = """
def no2(): pass"""
    def m(self, *, a: "dict[str, int]" = {}, **k) -> "A": return 1
    # end

import os  # why
'''


def test_code_in_strings_and_open_brackets(spark):
    cut = "class B:\n    def open(self, x='never closed"
    deep = "class C {\n  m(a) {\n    `${"
    rows = S.outline(spark.createDataFrame([
        (1, "a.py", ODD), (2, "b.py", cut), (3, "c.js", deep), (4, "d.py", ""), (5, "e.js", None),
        (6, "f.py", "\n\n"), (7, "g.ts", "})] class"), (8, "h.py", ")]}\ndef ok(): pass")], FILES)).collect()
    assert {(r.change_id, r.kind, r.name or r.import_text, r.start_line, r.end_line) for r in rows} == {
        (1, "function", "after", 6, 8), (1, "class", "A", 9, 21), (1, "function", "m", 21, 21),
        (1, "import", "import os", 24, 24), (2, "class", "B", 1, 2), (3, "class", "C", 1, 3),
        (3, "function", "m", 2, 3), (8, "function", "ok", 2, 2)}
    m = next(r for r in rows if r.name == "m" and r.change_id == 1)
    assert m.return_type == '"A"' and m.parameters == '(self, *, a: "dict[str, int]" = {}, **k)'
    assert next(r for r in rows if r.name == "A").docstring == "Doc.\n\n    def no(): pass"


def test_statements_leave_in_small_batches(spark):
    texts = [None if k % 10 == 9 else "" if k % 10 == 8 else "".join(
        f"def f{k}_{i}(a):\n    pass\n" for i in range(20)) for k in range(300)]
    whole = pa.record_batch([pa.array(range(300)), pa.array(["python"] * 300), pa.array(texts)],
                            ["n", "language", "text"])
    one, most = sum(map(len, texts[10:11])), 2000
    out = list(lexical.scanned([whole], most))
    assert sum(b.num_rows for b in out) == 240 * 20
    assert max(b.num_rows for b in out) <= 20 * (most // one + 1)
    assert [b.column("n")[0].as_py() for b in out] == sorted({b.column("n")[0].as_py() for b in out})
    files = spark.createDataFrame([(k, "a.py", t) for k, t in enumerate(texts)],
                                  "change_id bigint, path string, content string").coalesce(1)
    got = sorted((r.change_id, r.start_line, r.name) for r in S.outline(files).collect())
    assert got == [(k, 2 * i + 1, f"f{k}_{i}") for k in range(300) if k % 10 < 8 for i in range(20)]


def test_methods_meet_their_class_in_one_scan(spark):
    code = ("class A:\n    def x(self):\n        pass\nclass A:\n    class In:\n        def y(self):\n"
            "            pass\n    def x(self):\n        pass\ndef free():\n    pass\n")
    files = spark.createDataFrame([(1, "a.py", code), (1, "b.py", code), (None, "c.py", code),
                                   (2, "d.js", JS)], "change_id bigint, path string, content string")
    met = S.class_methods(S.outline(files))
    got = sorted((r.path, r.class_name, r.name, r.start_line, r.class_line) for r in met.collect())
    assert got == [(p, *row) for p in ("a.py", "b.py") for row in (
        ("A", "x", 2, 1), ("A", "x", 8, 1), ("In", "y", 6, 5))] + [
        ("d.js", "Dog", "constructor", 16, 15), ("d.js", "Dog", "speak", 18, 15)]
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 2  # one per family of languages
