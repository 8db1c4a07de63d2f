"""Unified diffs to tables of files, hunks and changed lines.

A diff text is cut at its file boundaries, each file block at its hunk headers,
each hunk into lines. Every step is an array expression on one row followed by
an explode, so the whole decomposition runs without a shuffle and spreads one
huge diff over rows as soon as it is cut. Line numbers need running counts
inside a hunk; they are read off as positions in filtered arrays (the k-th line
that is not a deletion has new number ``new_start + k``), which is linear and
needs no window.

All tables carry ``change_id`` and ``file_no`` (0-based order of the file in its
diff); hunks add ``hunk_no``, lines add ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import text as T

_BOUNDARY_SPLIT = rf"\n(?={C.FILE_BOUNDARY})"
_HUNK_SPLIT = r"\n(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"


def scan_diffs(diffs: DataFrame) -> DataFrame:
    """Diffs with any text in them: (change_id, diff_text)."""
    return diffs.filter(F.col("diff_text").isNotNull() & ~T.is_blank(F.col("diff_text")))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Numbered raw lines: (change_id, pos, raw), pos from 1."""
    return scan_diffs(diffs).select(
        "change_id", F.posexplode(T.lines_of(F.col("diff_text"))).alias("pos0", "raw")
    ).select("change_id", (F.col("pos0") + 1).cast("bigint").alias("pos"), "raw")


def file_blocks(diffs: DataFrame) -> DataFrame:
    """One row per file: (change_id, file_no, head_lines, hunk_texts).

    A block starts at a boundary line; a block whose first line is not a full
    file header is dropped."""
    opens_file = lambda b: F.substring_index(b, "\n", 1).rlike(C.FILE_HEADER)
    blocks = scan_diffs(diffs).select(
        "change_id",
        F.posexplode(F.filter(
            F.split(T.unify_breaks(F.col("diff_text")), _BOUNDARY_SPLIT), opens_file)
        ).alias("file_no", "block"))
    pieces = blocks.select(
        "change_id", F.col("file_no").cast("bigint").alias("file_no"),
        F.split("block", _HUNK_SPLIT).alias("pieces"))
    return pieces.select(
        "change_id", "file_no",
        F.split(F.get("pieces", F.lit(0)), "\n").alias("head_lines"),
        F.slice("pieces", 2, F.size("pieces")).alias("hunk_texts"))


def _last_path(lines: Column, pattern: str) -> Column:
    found = F.filter(lines, lambda x: x.rlike(pattern))
    return F.when(F.size(found) > 0, F.regexp_extract(F.element_at(found, -1), pattern, 1))


def diff_files(diffs: DataFrame, with_hunks: bool = False) -> DataFrame:
    """One row per file: paths, flags and ``path`` (new path, else old, else '').

    Only header lines before the first ``--- ``, ``@@ `` or binary marker count;
    ``+++`` counts only directly after ``--- ``."""
    stops = lambda x: (x.startswith("--- ") | x.startswith("@@ ") | x.rlike(C.BINARY_MARKER))
    head = file_blocks(diffs).select(
        "change_id", "file_no", "hunk_texts", "head_lines",
        F.get("head_lines", F.lit(0)).alias("header"),
        F.filter(
            F.transform("head_lines", lambda x, i: F.when((i > 0) & stops(x), i)),
            lambda i: i.isNotNull()).alias("stop_at"))
    head = head.select(
        "*", F.coalesce(F.get("stop_at", F.lit(0)), F.size("head_lines")).alias("stop")
    ).select(
        "*",
        F.expr("slice(head_lines, 2, stop - 1)").alias("ext"),
        F.coalesce(F.get("head_lines", F.col("stop")), F.lit("")).alias("stop_line"),
        F.coalesce(F.get("head_lines", F.col("stop") + 1), F.lit("")).alias("after_stop"))
    old_line = F.col("stop_line")
    new_line = F.when(old_line.startswith("--- "), F.col("after_stop")).otherwise("")
    old_null = F.regexp_extract(old_line, C.OLD_FILE, 2) != ""
    new_null = F.regexp_extract(new_line, C.NEW_FILE, 2) != ""
    any_starts = lambda prefix: F.exists("ext", lambda x: x.startswith(prefix))
    nonempty = lambda c: F.nullif(c, F.lit(""))
    is_binary = old_line.rlike(C.BINARY_MARKER)
    parsed = F.struct(
        F.when(~old_null, F.coalesce(
            nonempty(F.regexp_extract(old_line, C.OLD_FILE, 1)),
            _last_path(F.col("ext"), C.RENAME_FROM),
            F.regexp_extract("header", C.FILE_HEADER, 1))).alias("old_path"),
        F.when(~new_null, F.coalesce(
            nonempty(F.regexp_extract(new_line, C.NEW_FILE, 1)),
            _last_path(F.col("ext"), C.RENAME_TO),
            F.regexp_extract("header", C.FILE_HEADER, 2))).alias("new_path"),
        (any_starts("new file") | old_null).alias("is_new_file"),
        (any_starts("deleted file") | new_null).alias("is_deleted_file"),
        any_starts("rename from").alias("is_renamed"),
        is_binary.alias("is_binary"),
        # A binary marker ends the file: whatever follows it is not a hunk.
        F.when(is_binary, F.array().cast("array<string>")).otherwise(F.col("hunk_texts"))
        .alias("hunk_texts"))
    # Columns that come out of a generator stop later filters (on path, flags,
    # hunk count) from being pushed below and parsing the header a second time.
    files = head.select("change_id", "file_no", F.inline(F.array(parsed)))
    columns = ["change_id", "file_no", "old_path", "new_path", "is_new_file",
               "is_deleted_file", "is_renamed", "is_binary"]
    return files.select(*columns, file_path(), *(["hunk_texts"] if with_hunks else []))


def file_path() -> Column:
    """New path, else old path, else empty."""
    return F.coalesce(F.nullif(F.col("new_path"), F.lit("")), F.col("old_path"),
                      F.lit("")).alias("path")


def _start(header: Column, group: int) -> Column:
    return F.regexp_extract(header, C.HUNK_HEADER, group).cast("bigint")


def _count(header: Column, group: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(header, C.HUNK_HEADER, group), F.lit("")),
                      F.lit("1")).cast("bigint")


def _body(hunk_text: Column) -> Column:
    """The hunk's lines after its header, without '\\' notes."""
    lines = F.split(hunk_text, "\n")
    return F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.startswith("\\"))


def _content(line: Column) -> Column:
    """A line without its prefix; a context line may lack the leading space."""
    return F.when(line.rlike(r"^[-+ ]"), F.substr(line, F.lit(2))).otherwise(line)


def _is_add(line: Column) -> Column:
    return line.startswith("+")


def _is_delete(line: Column) -> Column:
    return line.startswith("-")


def hunk_rows(files: DataFrame) -> DataFrame:
    """Explode ``hunk_texts`` of ``diff_files(..., with_hunks=True)``."""
    return files.select(
        "change_id", "file_no", "path", F.posexplode("hunk_texts").alias("hunk_no", "hunk_text"))


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Hunk headers: starts, counts (1 if missing) and the header line."""
    header = F.substring_index("hunk_text", "\n", 1)
    return hunk_rows(diff_files(diffs, with_hunks=True)).select(
        "change_id", "file_no", "path", F.col("hunk_no").cast("bigint").alias("hunk_no"),
        _start(header, 1).alias("old_start"), _count(header, 2).alias("old_count"),
        _start(header, 3).alias("new_start"), _count(header, 4).alias("new_count"),
        header.alias("header"))


def changes_of_hunks(hunks: DataFrame) -> DataFrame:
    """Line rows of ``hunk_rows``: op, content and both line numbers.

    A delete row carries the current new number and does not advance it. The
    header's counts never bound the hunk."""
    base = hunks.select(
        "change_id", "file_no", "path", F.col("hunk_no").cast("bigint").alias("hunk_no"),
        _start(F.col("hunk_text"), 1).alias("old_start"),
        _start(F.col("hunk_text"), 3).alias("new_start"),
        F.transform(_body(F.col("hunk_text")),
                    lambda x, i: F.struct(i.alias("i"), x.alias("x"))).alias("body"))
    ranked = base.select(
        "*",
        F.transform(F.filter("body", lambda e: ~_is_delete(e.x)),
                    lambda e, k: F.struct(e.i.alias("i"), e.x.alias("x"), k.alias("k"))
                    ).alias("in_new"),
        F.transform(F.filter("body", lambda e: ~_is_add(e.x)),
                    lambda e, k: F.struct(e.i.alias("i"), e.x.alias("x"), k.alias("k"))
                    ).alias("in_old"))
    old_context = ranked.select(
        "*", F.filter("in_old", lambda e: ~_is_delete(e.x)).alias("old_context"))
    new, old = F.col("new_start"), F.col("old_start")

    def row(i, op, content, line, old_line):
        return F.struct(i.cast("bigint").alias("seq"), F.lit(op).alias("op"),
                        content.alias("content"), line.cast("bigint").alias("line_number"),
                        old_line.cast("bigint").alias("old_line_number"))

    adds = F.transform(
        F.filter("in_new", lambda e: _is_add(e.x)),
        lambda e: row(e.i, "add", F.substr(e.x, F.lit(2)), new + e.k, F.lit(None)))
    context = F.transform(
        F.filter("in_new", lambda e: ~_is_add(e.x)),
        lambda e, c: row(e.i, "context", _content(e.x), new + e.k,
                         old + F.get(F.col("old_context"), c).k))
    deletes = F.transform(
        F.filter("in_old", lambda e: _is_delete(e.x)),
        lambda e, d: row(e.i, "delete", F.substr(e.x, F.lit(2)), new + e.i - d, old + e.k))
    return old_context.select(
        "change_id", "file_no", "path", "hunk_no",
        F.inline(F.concat(adds, context, deletes)))


def diff_changes(diffs: DataFrame) -> DataFrame:
    """(change_id, file_no, path, hunk_no, seq, op, content, line_number,
    old_line_number)."""
    return changes_of_hunks(hunk_rows(diff_files(diffs, with_hunks=True)))


def changed_lines(changes: DataFrame) -> DataFrame:
    """Set of added new-file lines per file."""
    return changes.filter(F.col("op") == "add").select(
        "change_id", "file_no", "path", F.col("line_number").alias("line")).distinct()


def commentable_lines(changes: DataFrame) -> DataFrame:
    """Set of added and context lines per file: where a comment may go."""
    return changes.filter(F.col("op").isin("add", "context")).select(
        "change_id", "file_no", "path", F.col("line_number").alias("line")).distinct()


def hunk_line_range(diffs: DataFrame) -> DataFrame:
    """First and last new-file line of each hunk; (start, start) if it only
    deletes. Non-delete lines are numbered without gaps, so a count is enough."""
    start = _start(F.col("hunk_text"), 3)
    kept = F.size(F.filter(_body(F.col("hunk_text")), lambda x: ~_is_delete(x)))
    return hunk_rows(diff_files(diffs, with_hunks=True)).select(
        "change_id", "file_no", "path", F.col("hunk_no").cast("bigint").alias("hunk_no"),
        start.alias("first_line"),
        (start + F.greatest(kept - 1, F.lit(0))).cast("bigint").alias("last_line"))


def changed_file_paths(files: DataFrame) -> DataFrame:
    """Non-empty paths; ``file_no`` is their order in the change."""
    return files.filter(F.col("path") != "").select("change_id", "file_no", "path")


def rendered_hunk(hunk_text: Column) -> Column:
    """Hunk lines with '+', '-' or space in front, without the header."""
    return T.join_lines(F.transform(
        _body(hunk_text),
        lambda x: F.when(x.rlike(r"^[-+ ]"), x).otherwise(F.concat(F.lit(" "), x))))


def rendered_hunks(diffs: DataFrame) -> DataFrame:
    return hunk_rows(diff_files(diffs, with_hunks=True)).select(
        "change_id", "file_no", "path", F.col("hunk_no").cast("bigint").alias("hunk_no"),
        rendered_hunk(F.col("hunk_text")).alias("hunk_body"))


def with_parsed_hunks(files: DataFrame) -> DataFrame:
    """Adds ``hunks``: array of (new_start, body lines), one per hunk text."""
    return files.withColumn("hunks", F.transform("hunk_texts", lambda h: F.struct(
        _start(h, 3).alias("new_start"), _body(h).alias("body"))))


def _added_of_file() -> Column:
    """All added lines of a file's hunks, in order."""
    return F.flatten(F.transform("hunk_texts", lambda h: F.transform(
        F.filter(_body(h), _is_add), lambda x: F.substr(x, F.lit(2)))))


def added_lines_of_file() -> Column:
    """Array of (line, text) of a file's added lines, from ``hunks``."""
    def of_hunk(h):
        numbered = F.transform(
            F.filter(h.body, lambda x: ~_is_delete(x)),
            lambda x, k: F.when(_is_add(x), F.struct(
                (h.new_start + k).cast("bigint").alias("line"),
                F.substr(x, F.lit(2)).alias("text"))))
        return F.filter(numbered, lambda e: e.isNotNull())
    return F.flatten(F.transform("hunks", of_hunk))


def added_text(files: DataFrame, max_chars: int = C.ADDED_TEXT_CHARS) -> DataFrame:
    """Per file with hunks: its added lines as one text, blank ones dropped. The
    cut to ``max_chars`` is the query text's defined length."""
    joined = files.select("change_id", "file_no", "path",
                          T.join_lines(_added_of_file()).alias("added"))
    return joined.filter(~T.is_blank(F.col("added"))).select(
        "change_id", "file_no", "path", F.substring("added", 1, max_chars).alias("added_text"))


def diff_report(diffs: DataFrame, shown: int = 20) -> DataFrame:
    """Per file: path, status label, hunk count and its first changed lines."""
    files = with_parsed_hunks(diff_files(diffs, with_hunks=True)).select(
        "*", F.array_sort(F.array_distinct(F.transform(
            added_lines_of_file(), lambda e: e.line))).alias("numbers"))
    status = (F.when(F.col("is_new_file"), "NEW").when(F.col("is_deleted_file"), "DELETED")
              .when(F.col("is_binary"), "BINARY").otherwise(""))
    return files.select(
        "change_id", "file_no", "path", status.alias("status"),
        F.size("hunk_texts").cast("bigint").alias("hunks"),
        F.concat(
            F.lit("["),
            F.array_join(F.slice("numbers", 1, shown).cast("array<string>"), ", "),
            F.lit("]"),
            F.when(F.size("numbers") > shown, "...").otherwise("")).alias("first_changed"))
