"""The prompt job: from diffs and head files to the messages put in front of a model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.operators import context as K
from patchloom.operators import diff as D
from patchloom.operators import filters as L
from patchloom.operators import symbols as S


def context_run(diffs: DataFrame, heads: DataFrame, extra_ignore=()) -> DataFrame:
    """Context text of every reviewable file in an analysed language: (change_id, file_no, path,
    context_text), with functions and imports from the outlines of the head files.

    heads: change_id, path, content; files without text at the head have no context."""
    files = L.reviewable_files(D.diff_files(diffs, with_hunks=True), extra_ignore)
    texts = heads.filter(F.col("content") != "").join(
        files.select("change_id", "path").distinct(), ["change_id", "path"], "left_semi")
    outline = S.outline(texts)
    lines = D.changed_lines(D.changes_of_hunks(D.hunk_rows(files)))
    return K.file_context(files, texts, S.functions_of(outline), S.imports_of(outline), lines)


def prompt_run(diffs: DataFrame, heads: DataFrame, changes: DataFrame,
               matches: DataFrame | None = None, extra_ignore=(),
               part_chars: int = K.PROMPT_PART_CHARS) -> DataFrame:
    """(change_id, seq, role, content): the messages of every change that has a file to show.

    changes: change_id, title, body; matches: change_id, seq, changed_path, source_id, excerpt of
    retrieved guidance, if there is any."""
    contexts = context_run(diffs, heads, extra_ignore).select("change_id", "file_no", "context_text")
    return K.chat_messages(K.review_prompt(contexts, changes, part_chars), matches)
