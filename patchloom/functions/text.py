"""Text helpers. All are plain column expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What ends a line, and what counts as white space, in the source data's
# convention (wider than Java's defaults).
LINE_BREAK = r"(?:\r\n|[\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}])"
_OTHER_BREAK = r"\r\n|[\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"
_NOT_BREAK = r"[^\n\r\x0B\f\x1C-\x1E\x85\x{2028}\x{2029}]"
SPACE = r"[\t-\r\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NON_SPACE = SPACE.replace("[", "[^", 1)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda over a one-element
    array is the only binding a column expression has."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unify_breaks(text: Column) -> Column:
    """Every line break as '\n', and no final one, so that splitting gives no
    empty piece for a line that does not exist.

    One cached-pattern pass; later splits are then on a single character, which
    Java does without compiling a pattern per row."""
    return F.regexp_replace(F.regexp_replace(text, _OTHER_BREAK, "\n"), r"\n\z", "")


def lines_of(text: Column) -> Column:
    """Array of lines; no empty last line after a final break, none for ''."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(unify_breaks(text), "\n"))


def lines_with_breaks(text: Column) -> Column:
    """Array of lines that keep their own line break."""
    pattern = f"{_NOT_BREAK}*{LINE_BREAK}|{_NOT_BREAK}+"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NON_SPACE)


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"\A{SPACE}+", ""), rf"{SPACE}++\z", "")


def last_index(text: Column, needle: str) -> Column:
    """0-based position of the last occurrence, -1 if there is none."""
    from_end = F.locate(needle[::-1], F.reverse(text))
    return let(from_end, lambda p: F.when(p == 0, F.lit(-1)).otherwise(
        F.length(text) - p - len(needle) + 1))


def contains_any(text: Column, words) -> Column:
    """True if the text holds any of the literal words."""
    escaped = [w.replace(".", r"\.") for w in words]
    return text.rlike("|".join(escaped))


def py_slice(items: Column, start: Column, end: Column) -> Column:
    """Items ``start`` (0-based) up to, not including, ``end``. A negative index
    counts from the end of the array, as callers with a 0 line number rely on."""
    n = F.size(items)
    lo = F.least(F.when(start < 0, F.greatest(n + start, F.lit(0))).otherwise(start), n)
    hi = F.least(F.when(end < 0, F.greatest(n + end, F.lit(0))).otherwise(end), n)
    return F.slice(items, (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int"))


def join_lines(items: Column) -> Column:
    return F.array_join(items, "\n")


def estimate_tokens(text: Column) -> Column:
    """Tokens of a whole prompt: 3.5 characters each, rounded down, plus 10."""
    return context_tokens(text) + 10


def context_tokens(text: Column) -> Column:
    return F.floor(F.length(text).cast("bigint") * 2 / 7).cast("bigint")


def html_escape(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def percent_encode_path(path: Column) -> Column:
    """Percent-encoding that leaves '/', '_', '.', '-' and '~' as they are."""
    out = F.url_encode(path)
    for code, char in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


def capitalize(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
