"""Functions touched by a change, and the texts put in front of a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import paths as P
from patchloom.functions import ranking as R
from patchloom.functions import text as T
from patchloom.operators import diff as D

SPAN_BUCKET = 64  # lines per bucket of the interval joins
PROMPT_PART_CHARS = 16_384
PROMPT_BUCKET = 64  # files per bucket when prompts are laid out
FUNCTION_KEY = ["change_id", "path", "fn_no"]


def function_signature() -> Column:
    """Decorators, async, class prefix, name, parameters and return type."""
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    return F.concat(
        F.array_join(F.transform("decorators", lambda d: F.concat(F.lit("@"), d, F.lit("\n"))), ""),
        F.when(F.col("is_async"), "async ").otherwise(""), F.lit("def "),
        F.when(some("class_name"), F.concat("class_name", F.lit("."))).otherwise(""),
        "name", "parameters",
        F.when(some("return_type"), F.concat(F.lit(" -> "), "return_type")).otherwise(""))


def function_skeleton() -> Column:
    """Signature with the docstring, or with an ellipsis."""
    doc = F.col("docstring")
    return F.concat(function_signature(), F.when(
        F.coalesce(doc, F.lit("")) != "", F.concat(F.lit(':\n    """'), doc, F.lit('"""'))
    ).otherwise(": ..."))


def _buckets(start: Column, end: Column) -> Column:
    return F.sequence(F.floor(start / SPAN_BUCKET).cast("bigint"),
                      F.floor(F.greatest(end, start) / SPAN_BUCKET).cast("bigint"))


def functions_in_range(functions: DataFrame, ranges: DataFrame) -> DataFrame:
    """Interval join: functions that overlap (first_line, last_line) of a range.

    Both sides are spread over buckets of lines, so the join key is not just the
    file and a huge file is split. A pair that shares several buckets is kept in
    the first of them only."""
    f = functions.withColumn("_b", F.explode(_buckets(F.col("start_line"), F.col("end_line"))))
    r = ranges.withColumn("_b", F.explode(_buckets(F.col("first_line"), F.col("last_line"))))
    first_shared = F.greatest(F.floor(F.col("start_line") / SPAN_BUCKET),
                              F.floor(F.col("first_line") / SPAN_BUCKET))
    return f.join(r, ["change_id", "path", "_b"]).filter(
        (F.col("_b") == first_shared)
        & (F.col("end_line") >= F.col("first_line")) & (F.col("start_line") <= F.col("last_line"))
    ).drop("_b")


def changed_in_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """(FUNCTION_KEY, line): changed lines inside each function's span."""
    spans = functions.select(
        *FUNCTION_KEY, "start_line", "end_line",
        F.explode(_buckets(F.col("start_line"), F.col("end_line"))).alias("_b"))
    points = lines.select("change_id", "path", "line").distinct().withColumn(
        "_b", F.floor(F.col("line") / SPAN_BUCKET).cast("bigint"))
    return points.join(spans, ["change_id", "path", "_b"]).filter(
        F.col("line").between(F.col("start_line"), F.col("end_line"))
    ).select(*FUNCTION_KEY, "line")


def modified_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """Functions holding any changed line, with ``changed_lines`` sorted. The
    list is at most as long as the function's own text."""
    touched = changed_in_functions(functions, lines).groupBy(*FUNCTION_KEY).agg(
        F.sort_array(F.collect_set("line")).alias("changed_lines"))
    return functions.join(touched, FUNCTION_KEY)


def unmodified_functions(functions: DataFrame, lines: DataFrame) -> DataFrame:
    return functions.join(changed_in_functions(functions, lines), FUNCTION_KEY, "left_anti")


def numbered(lines: Column, start: Column) -> Column:
    """Lines behind right-aligned numbers (width 4, wider if needed), joined."""
    return T.join_lines(F.transform(lines, lambda x, i: F.format_string(
        "%4d | %s", start.cast("bigint") + i, x)))


def numbered_lines(text: Column, start: Column) -> Column:
    return numbered(T.lines_of(text), start)


def _source_of(lines: Column, start: Column, end: Column) -> Column:
    """Numbered slice of a file. One empty last line is not shown."""
    part = T.py_slice(lines, start - 1, end)
    n = F.size(part)
    shown = F.when((n > 0) & (F.element_at(part, F.greatest(n, F.lit(1))) == ""),
                   F.slice(part, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(part)
    return numbered(shown, start)


def _function_block(f: Column, lines: Column) -> Column:
    return F.concat(
        F.lit("\n#### `"), f["name"], F.lit("` (lines "), f.start_line.cast("string"), F.lit("-"),
        f.end_line.cast("string"), F.lit(", changed: ["),
        F.array_join(f.changed_lines.cast("array<string>"), ", "), F.lit("])\n```\n"),
        _source_of(lines, f.start_line, f.end_line), F.lit("\n```"))


def _functions_of_file(functions: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file with its functions in order. The functions of a file come
    from its text, which is one value already, so the list is no larger."""
    touched = changed_in_functions(functions, lines).groupBy(*FUNCTION_KEY).agg(
        F.sort_array(F.collect_set("line")).alias("changed_lines"))
    return functions.join(touched, FUNCTION_KEY, "left").groupBy("change_id", "path").agg(
        F.array_sort(F.collect_list(F.struct(
            "fn_no", "name", "start_line", "end_line", "changed_lines",
            function_signature().alias("signature"), function_skeleton().alias("skeleton"))))
        .alias("functions"))


def _modified(fs: str) -> Column:
    return F.filter(fs, lambda f: f.changed_lines.isNotNull())


def function_context(functions: DataFrame, lines: DataFrame, heads: DataFrame) -> DataFrame:
    """Per modified function: signature and rendered block. Head texts are joined
    once per file, not once per function."""
    joined = _functions_of_file(functions, lines).join(
        heads.filter(F.col("content") != "").select(
            "change_id", "path", T.lines_of(F.col("content")).alias("lines")),
        ["change_id", "path"])
    return joined.select("change_id", "path", F.inline(F.transform(
        _modified("functions"), lambda f: F.struct(
            f.fn_no.alias("fn_no"), f.signature.alias("signature"),
            _function_block(f, F.col("lines")).alias("block")))))


def skeleton_context(functions: DataFrame, lines: DataFrame) -> DataFrame:
    return unmodified_functions(functions, lines).select(
        *FUNCTION_KEY, function_skeleton().alias("skeleton"))


def file_context(files: DataFrame, heads: DataFrame, functions: DataFrame,
                 imports: DataFrame, lines: DataFrame) -> DataFrame:
    """(change_id, file_no, path, context_text) of files in an analyzed language.

    files: ``diff_files(..., with_hunks=True)``; imports: change_id, path, seq,
    import_text; lines: changed lines. Every side is one row per file before the
    joins; sections are laid out inside the row, empty ones are left out."""
    language = P.language(F.col("path"))
    shown = files.withColumn("language", language).filter(
        F.col("language").isin(*C.ANALYZED_LANGUAGES))
    import_lists = imports.groupBy("change_id", "path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "import_text"))).alias("imports"))
    rows = shown.join(
        heads.filter(F.col("content") != "").select(
            "change_id", "path", T.lines_of(F.col("content")).alias("lines")),
        ["change_id", "path"]
    ).join(_functions_of_file(functions, lines), ["change_id", "path"], "left").join(
        import_lists, ["change_id", "path"], "left")
    fs = F.coalesce("functions", F.filter("functions", lambda f: F.lit(False)))
    modified = F.filter("functions", lambda f: f.changed_lines.isNotNull())
    skeletons = F.filter("functions", lambda f: f.changed_lines.isNull())

    def section(heading, items):
        return F.when(F.size(items) > 0, F.concat(F.lit(heading + "\n"), T.join_lines(items)))

    text = F.concat_ws(
        "\n",
        F.concat(F.lit("## File: "), "path", F.lit(" ("), "language", F.lit(")")),
        section(C.CONTEXT_IMPORTS, F.transform("imports", lambda i: i.import_text)),
        section(C.CONTEXT_MODIFIED, F.transform(
            modified, lambda f: _function_block(f, F.col("lines")))),
        section(C.CONTEXT_SKELETONS, F.transform(skeletons, lambda f: f.skeleton)),
        section(C.CONTEXT_HUNKS, F.transform("hunk_texts", lambda h: F.concat(
            F.lit("```diff\n"), D.rendered_hunk(h), F.lit("\n```")))))
    return rows.select("change_id", "file_no", "path", text.alias("context_text"))


def review_prompt(contexts: DataFrame, changes: DataFrame,
                  part_chars: int = PROMPT_PART_CHARS) -> DataFrame:
    """The user prompt of each change in parts: (change_id, part_no, parts, prompt).

    contexts: change_id, file_no, context_text; changes: change_id, title, body. The prompt is the
    texts of a change's parts in order of ``part_no``, which counts from 0; every part but the last
    of ``parts`` has ``part_chars`` characters. Each file knows where in the prompt its text begins,
    is cut there, and only what falls into one part is gathered, so a change may be of any size."""
    body = F.when(F.length("body") > C.BODY_CHARS,
                  F.concat(F.substring("body", 1, C.BODY_CHARS), F.lit("..."))
                  ).otherwise(F.col("body"))
    some = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    frame = changes.select("change_id", F.concat_ws(
        "\n",
        F.when(some("title"), F.concat(F.lit(C.REVIEW_TITLE_PREFIX), "title")),
        F.when(some("body"), F.concat(F.lit("\n"), body, F.lit("\n"))),
        F.lit(C.REVIEW_CODE_HEADING + "\n")).alias("top"))
    ends = contexts.groupBy("change_id").agg(
        F.min("file_no").alias("first_no"), F.max("file_no").alias("last_no"))
    texts = contexts.join(frame.join(ends, "change_id"), "change_id").select(
        "change_id", "file_no", F.concat(
            F.when(F.col("file_no") == F.col("first_no"), F.col("top")).otherwise(
                C.REVIEW_SEPARATOR), "context_text",
            F.when(F.col("file_no") == F.col("last_no"), "\n" + C.REVIEW_INSTRUCTIONS).otherwise(""))
        .alias("text"))
    placed = R.bucketed_running_sum(
        texts.withColumn("chars", F.length("text").cast("bigint")), ["change_id"], "file_no", "chars",
        "start", "total", width=PROMPT_BUCKET)
    room = F.lit(part_chars) - F.col("start") % part_chars  # characters left in the first part
    pieces = F.concat(
        F.array(F.substr("text", F.lit(1), room)),
        F.regexp_extract_all(F.substr("text", room + 1), F.lit(f"(?s).{{1,{part_chars}}}"), F.lit(0)))
    cut = placed.select("change_id", "file_no", "total", F.floor(F.col("start") / part_chars)
                        .cast("bigint").alias("first_part"), F.posexplode(pieces).alias("k", "piece"))
    return cut.groupBy("change_id", (F.col("first_part") + F.col("k")).alias("part_no")).agg(
        F.ceil(F.first("total") / part_chars).cast("bigint").alias("parts"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "piece"))),
                                 lambda x: x.piece), "").alias("prompt"))


def json_text(value: Column) -> Column:
    """A JSON string literal in ASCII: other characters as \\uXXXX (in pairs
    beyond the basic plane)."""
    quoted = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)

    def unit(n):
        return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n.cast("bigint")), 4, "0")))

    def escaped(c):
        n = F.ascii(c)
        return (F.when(n < 128, c).when(n < 65536, unit(n)).otherwise(F.concat(
            unit(F.floor((n - 65536) / 1024) + 55296), unit((n - 65536) % 1024 + 56320))))
    ascii_only = F.array_join(F.transform(F.split(quoted, ""), escaped), "")
    return F.when(quoted.rlike(r"[^\x00-\x7F]"), ascii_only).otherwise(quoted)


def chat_messages(prompts: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """(change_id, seq, role, content): a system row and user rows per change. With guidance, the
    system text grows and a JSON array of excerpts follows the prompt. A prompt in parts (``part_no``
    of ``parts``) has a user row for each, numbered in their order, the excerpts after the last.
    matches: change_id, seq, changed_path, source_id, excerpt; at most k per file of at most eight
    files, so the list per change is short."""
    system = F.lit(C.SYSTEM_PROMPT + "\n\n" + C.REVIEW_EXAMPLE)
    seq, last = F.lit(1).cast("bigint"), F.lit(True)
    if "part_no" in prompts.columns:
        seq = F.col("part_no") + 1
        last = seq == F.col("parts")
    if matches is None:
        rows = prompts.withColumn("data", F.lit(None).cast("string"))
    else:
        entry = F.concat(F.lit('{"changed_path": '), json_text(F.col("changed_path")),
                         F.lit(', "id": '), json_text(F.col("source_id")),
                         F.lit(', "excerpt": '), json_text(F.col("excerpt")), F.lit("}"))
        data = matches.groupBy("change_id").agg(F.concat(F.lit("["), F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("seq", entry.alias("entry")))),
            lambda e: e.entry), ", "), F.lit("]")).alias("data"))
        rows = prompts.join(data, "change_id", "left")
    guided = F.col("data").isNotNull()
    first = F.struct(
        F.lit(0).cast("bigint").alias("seq"), F.lit("system").alias("role"),
        F.when(guided, F.concat(system, F.lit(C.GUIDANCE_INSTRUCTIONS)))
        .otherwise(system).alias("content"))
    user = F.struct(
        seq.alias("seq"), F.lit("user").alias("role"),
        F.when(guided & last, F.concat("prompt", F.lit(C.GUIDANCE_DATA_HEADING), "data"))
        .otherwise(F.col("prompt")).alias("content"))
    messages = F.when(seq == 1, F.array(first, user)).otherwise(F.array(user))
    return rows.select("change_id", F.inline(messages))


def repair_prompt(original: Column, suggested: Column, error: Column, path: Column) -> Column:
    a, b, c, d, e = (F.lit(p) for p in C.REPAIR_PIECES)
    return F.concat(a, path, b, original, c, suggested, d,
                    F.substring(error, 1, C.REPAIR_ERROR_CHARS), e)


def strip_code_fence(answer: Column) -> Column:
    """Trimmed answer without its code fence lines; null for an empty answer."""
    bare = T.strip(answer)
    lines = T.lines_of(bare)
    inside = F.when(F.size(lines) > 2, T.join_lines(
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))))).otherwise(bare)
    return F.when(answer != "", F.when(bare.startswith("```"), inside).otherwise(bare))


def model_string(provider: Column, model: Column) -> Column:
    """Provider-prefixed model name; one provider needs no prefix."""
    low = F.lower(provider)
    return F.when(low == "openai", model).otherwise(F.concat(low, F.lit("/"), model))
