"""Functions, classes and imports of source files.

No grammar is parsed. One scan per file masks strings and comments, matches brackets and follows
blocks by indentation or braces (``functions/lexical.py``); what a statement is and what its parts
say is told here by column expressions over its header. The plan is the same for any files, and
nothing is shuffled. Limits: several Python statements on one line count as one; a script statement
ends at a line break unless what stands around the break says that it goes on. The tables may also
come from outside, since later operators read only their columns.

files: change_id, path, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchloom.functions import lexical
from patchloom.functions import paths as P
from patchloom.functions import text as T

FILE = ["change_id", "path"]
OUTLINE = ["kind", "name", "start_line", "end_line", "parameters", "return_type", "docstring",
           "is_method", "is_async", "class_name", "decorators", "base_classes", "import_text"]
FUNCTION_COLUMNS = [*FILE, "name", "start_line", "end_line", "parameters", "return_type",
                    "docstring", "is_method", "is_async", "class_name", "decorators"]
LANGUAGES = ("python", "javascript", "typescript")

# What stands before the parameters and between them and the block, and the block's opening.
_DEF, _DEF_TAIL = (r"^(async\s+)?def\s+(\w+)\s*(?:\[(?s:.*)\])?\s*\z",
                   r"^\s*(?:->\s*((?s:.+?))\s*)?:\z")
_CLASS = r"^class\s+(\w+)\s*(?:\[(?s:.*)\])?\s*\z"
_TYPE_ARGS = r"(?:<[^(]*>)?"
_JS_TAIL = r"^\s*(?::\s*((?s:.+?)))?\s*"
_JS_FUNCTION = r"^(export\s+(?:default\s+)?)?(async\s+)?function\s*\*?\s*(\w+)\s*" + _TYPE_ARGS + r"\s*\z"
_JS_ARROW = (r"^(?:const|let|var)\s+(\w+)\s*(?::(?s:.+?))?=\s*(async\b\s*)?" + _TYPE_ARGS
             + r"\s*(?:(\w+)\s*=>)?\z")
_JS_CLASS = (r"^(export\s+(?:default\s+)?)?class\s+(\w+)(?:\s*<(?s:[^{]*?)>)?"
             r"(?:\s+extends\s+(\w+))?")
_JS_METHOD = (r"^(?:(?:public|private|protected|static|readonly|override|get|set)\s+)*"
              r"(async\s+)?\*?\s*(#?\w+)\s*" + _TYPE_ARGS + r"\s*\z")
_JS_NOT_METHODS = ("if", "for", "while", "switch", "catch", "function", "return", "with")


def statements(files: DataFrame, *languages: str) -> DataFrame:
    """FILE, language and the statements of files in these languages (``lexical.STATEMENT``)."""
    told = files.select(*FILE, P.language(F.col("path")).alias("language"), F.col("content")).filter(
        F.col("language").isin(*languages))
    return lexical.statements(told.select(
        *FILE, "language", T.unify_breaks(F.col("content")).alias("text")))


def _found(pattern: str, group: int, text: str = "head") -> Column:
    return F.regexp_extract(text, pattern, group)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# --- Python ------------------------------------------------------------------


def py_statements(files: DataFrame) -> DataFrame:
    """Definitions and imports at the top level and in class bodies, with classes nested to any
    depth; what is inside functions, ``if`` or ``try`` is not listed."""
    return statements(files, "python")


def py_outline(rows: DataFrame) -> DataFrame:
    """Functions, classes and imports of ``py_statements`` (OUTLINE columns). Bases are plain or
    dotted names; ``from __future__`` lines are left out."""
    head, tail, code = F.col("head"), F.col("tail"), F.col("code")
    kinds = rows.withColumn("kind", (
        F.when(head.rlike(_DEF) & F.col("parameters").isNotNull() & tail.rlike(_DEF_TAIL), "function")
        .when(head.rlike(_CLASS) & tail.rlike(r"^\s*:\z"), "class")
        .when(code.isNotNull() & ~code.rlike(r"^from\s+__future__\b"), "import")))
    is_function, is_class = F.col("kind") == "function", F.col("kind") == "class"
    inside = F.regexp_extract("parameters", r"(?s)^\((.*)\)$", 1)
    # Nested brackets hold commas of their own; take them out before splitting.
    flat = F.regexp_replace(inside, r"\([^()]*\)|\[[^\[\]]*\]", "()")
    bases = F.filter(F.transform(F.split(flat, ","), lambda b: T.strip(b)),
                     lambda b: b.rlike(r"^[A-Za-z_]\w*(?:\.\w+)*$"))
    owner = _some(_found(_CLASS, 1, "owner"))
    return kinds.filter(F.col("kind").isNotNull()).select(
        *FILE, "kind",
        F.when(is_function, _found(_DEF, 2)).when(is_class, _found(_CLASS, 1)).alias("name"),
        "start_line", "end_line", F.when(is_function, F.col("parameters")).alias("parameters"),
        F.when(is_function, _some(_found(_DEF_TAIL, 1, "tail"))).alias("return_type"),
        T.strip(F.col("doc")).alias("docstring"),
        (is_function & F.col("owner").isNotNull()).alias("is_method"),
        (is_function & (_found(_DEF, 1) != "")).alias("is_async"), owner.alias("class_name"),
        "decorators", F.when(is_class, F.coalesce(bases, F.array().cast("array<string>")))
        .alias("base_classes"),
        F.when(F.col("kind") == "import", T.strip(code)).alias("import_text"))


def functions_of(outline: DataFrame) -> DataFrame:
    """Function rows; the start line, unique in a file, is their number."""
    return outline.filter(F.col("kind") == "function").select(
        *FUNCTION_COLUMNS, F.col("start_line").alias("fn_no"))


def classes_of(outline: DataFrame) -> DataFrame:
    return outline.filter(F.col("kind") == "class").select(
        *FILE, "name", "start_line", "end_line", "base_classes", "docstring")


def imports_of(outline: DataFrame) -> DataFrame:
    return outline.filter(F.col("kind") == "import").select(
        *FILE, F.col("start_line").alias("seq"), "import_text")


# --- JavaScript and TypeScript -----------------------------------------------


def js_statements(files: DataFrame) -> DataFrame:
    """Functions, classes, bound arrow functions and imports at the top level, and the members of
    its classes, whatever lines and brackets their headers take."""
    return statements(files, "javascript", "typescript")


def _js_doc(comment: Column) -> Column:
    """The text of a JSDoc comment as one line."""
    lines = F.transform(F.split(F.regexp_replace(comment, r"^/\*\*|\*/\z", ""), "\n"),
                        lambda x: T.strip(F.regexp_replace(T.strip(x), r"^[* ]+", "")))
    return _some(F.array_join(F.filter(lines, lambda x: x != ""), " "))


def js_outline(rows: DataFrame) -> DataFrame:
    """Functions, classes and imports of ``js_statements`` (OUTLINE columns). An import's place
    among the file's imports stands in for its line.

    An export wrapper or a variable binding hides a comment in front, so only plain declarations and
    methods have a docstring. In TypeScript the ``extends`` name lies one level deeper in the syntax
    and is not listed."""
    head, tail, top = F.col("head"), F.col("tail"), F.col("owner").isNull()
    block, arrow = tail.rlike(_JS_TAIL + r"\{\z"), tail.rlike(_JS_TAIL + r"=>\z")
    kinds = rows.withColumn("form", (
        F.when(F.col("code").isNotNull(), "import")
        .when(top & head.rlike(_JS_CLASS) & (tail == "{"), "class")
        .when(top & head.rlike(_JS_FUNCTION) & block, "function")
        .when(top & head.rlike(_JS_ARROW) & (arrow | ((_found(_JS_ARROW, 3) != "") & (tail == ""))),
              "arrow")
        .when(~top & head.rlike(_JS_METHOD) & block & ~_found(_JS_METHOD, 2).isin(*_JS_NOT_METHODS),
              "method")))
    form = F.col("form")
    is_import, is_class, method = form == "import", form == "class", form == "method"
    function = form.isin("function", "arrow", "method")
    exported = (F.when(form == "function", _found(_JS_FUNCTION, 1))
                .when(is_class, _found(_JS_CLASS, 1)).otherwise("") != "")
    returns = F.when(form == "arrow", _found(_JS_TAIL + r"=>\z", 1, "tail")).otherwise(
        _found(_JS_TAIL + r"\{\z", 1, "tail"))
    base = F.when(F.col("language") == "javascript", _found(_JS_CLASS, 3)).otherwise("")
    return kinds.filter(form.isNotNull()).select(
        *FILE, F.when(is_import, "import").when(is_class, "class").otherwise("function").alias("kind"),
        F.when(form == "function", _found(_JS_FUNCTION, 3)).when(form == "arrow", _found(_JS_ARROW, 1))
        .when(method, _found(_JS_METHOD, 2)).when(is_class, _found(_JS_CLASS, 2)).alias("name"),
        "start_line", "end_line",
        F.when(function, F.coalesce("parameters", F.concat(F.lit("("), _found(_JS_ARROW, 3),
                                                           F.lit(")")))).alias("parameters"),
        F.when(function, _some(T.strip(returns))).alias("return_type"),
        F.when((form != "arrow") & ~exported, _js_doc(F.col("doc"))).alias("docstring"),
        method.alias("is_method"),
        (F.when(form == "function", _found(_JS_FUNCTION, 2)).when(form == "arrow", _found(_JS_ARROW, 2))
         .when(method, _found(_JS_METHOD, 1)).otherwise("") != "").alias("is_async"),
        F.when(method, _found(_JS_CLASS, 2, "owner")).alias("class_name"),
        F.when(~is_import, F.array().cast("array<string>")).alias("decorators"),
        F.when(is_class, F.filter(F.array(base), lambda b: b != "")).alias("base_classes"),
        F.when(is_import, F.col("code")).alias("import_text"))


# --- all languages -----------------------------------------------------------


def outline(files: DataFrame) -> DataFrame:
    """Functions, classes and imports of all supported files; others give
    nothing."""
    return py_outline(py_statements(files)).unionByName(js_outline(js_statements(files)))


def symbols(outline_rows: DataFrame) -> DataFrame:
    """(FILE, kind, name, start_line, end_line); an import's name is its text."""
    is_import = F.col("kind") == "import"
    return outline_rows.select(
        *FILE, "kind", F.coalesce("name", "import_text").alias("name"),
        F.when(~is_import, F.col("start_line")).alias("start_line"),
        F.when(~is_import, F.col("end_line")).alias("end_line"))


def class_methods(outline_rows: DataFrame) -> DataFrame:
    """Methods attached to the first class of their class name in the file (``class_line``). Classes
    and methods meet under file and class name, so the outline is made once."""
    is_class, is_function = F.col("kind") == "class", F.col("kind") == "function"
    by_class = Window.partitionBy(*FILE, "_class")
    met = outline_rows.filter(is_class | is_function).withColumn(
        "_class", F.when(is_class, F.col("name")).otherwise(F.col("class_name"))).dropna(
        subset=[*FILE, "_class"]).withColumn(
        "class_line", F.min(F.when(is_class, F.col("start_line"))).over(by_class))
    return met.filter(is_function & F.col("class_line").isNotNull()).select(
        *FUNCTION_COLUMNS, F.col("start_line").alias("fn_no"), "class_line")


def symbol_report(files: DataFrame, outline_rows: DataFrame) -> DataFrame:
    """Counts per supported file."""
    kind = F.col("kind")
    counts = outline_rows.groupBy(*FILE).agg(
        F.count_if(kind == "function").alias("functions"), F.count_if("is_method").alias("methods"),
        F.count_if("is_async").alias("async_functions"),
        F.count_if(kind == "class").alias("classes"), F.count_if(kind == "import").alias("imports"))
    columns = ("functions", "methods", "async_functions", "classes", "imports")
    return files.select(*FILE, P.language(F.col("path")).alias("language")).filter(
        F.col("language").isin(*LANGUAGES)
    ).join(counts, FILE, "left").select(
        *FILE, "language", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in columns])
