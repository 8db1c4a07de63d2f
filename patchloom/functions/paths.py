"""Predicates and properties of file paths."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions.text import contains_any


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored Java regex; '*' also crosses '/'."""
    translated = fnmatch.translate(pattern)
    for end in (r"\Z", r"\z"):
        translated = translated.removesuffix(end)
    return rf"\A{translated}\z"


def base_name(path: Column) -> Column:
    """Last path part, after trailing '/' and '/.' are taken off."""
    name = F.regexp_extract(path, r"([^/]+)(?:/\.?)*$", 1)
    return F.when(name == ".", "").otherwise(name)


def glob_matches(path: Column, pattern: str) -> Column:
    """True if one pattern covers the path."""
    return ignored(path, (pattern,))


def ignored(path: Column, patterns=C.IGNORE_PATTERNS) -> Column:
    """True if any pattern covers the whole path or its base name. A pattern
    with '**' also covers everything below its prefix at the path root.

    The pattern list is folded into one literal regex per target, so the cost
    per row does not grow with a join."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    folded = "|".join(f"(?:{glob_regex(p)})" for p in patterns)
    if not folded:
        return F.lit(False)
    hit = path.rlike(folded) | base_name(path).rlike(folded)
    for prefix in (p.replace("/**", "") for p in patterns if "**" in p):
        hit = hit | path.startswith(prefix + "/") | (path == prefix)
    return hit


def extension(path: Column) -> Column:
    """From the last '.' of the whole path, lower-cased; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(?s)\.[^.]*\z", 0))


def language(path: Column) -> Column:
    """Language by the suffix of the base name, null if unknown. A leading or
    final dot makes no suffix."""
    suffix = F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)\z", 1))
    known = F.create_map(*[F.lit(x) for pair in C.LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix)


def is_valid_path(path: Column) -> Column:
    """Repository-relative, without control characters or backslashes."""
    bad_part = F.exists(F.split(path, "/", -1), lambda p: p.isin("", ".", ".."))
    return ~bad_part & ~path.rlike(r"[\x00-\x1f\x7f\\]")


def security_sensitive(path: Column) -> Column:
    return contains_any(F.lower(path), C.ROUTING_SECURITY_WORDS)


def is_test_file(path: Column) -> Column:
    return contains_any(F.lower(path), C.ROUTING_TEST_MARKERS)


def packing_priority(path: Column, start: Column | None = None) -> Column:
    """Review priority: security +10, not a test +5, infrastructure -3."""
    low = F.lower(path)
    return (
        (F.lit(0) if start is None else start)
        + F.when(contains_any(low, C.PRIORITY_SECURITY_WORDS), 10).otherwise(0)
        + F.when(contains_any(low, C.PRIORITY_TEST_MARKERS), 0).otherwise(5)
        - F.when(contains_any(low, C.PRIORITY_INFRA_WORDS), 3).otherwise(0)
    ).cast("bigint")


def in_scope(path: Column, scopes: Column) -> Column:
    """No scopes means everywhere; otherwise the path is a scope or below one."""
    return (F.size(scopes) == 0) | F.exists(
        scopes, lambda s: (path == s) | F.startswith(path, F.concat(s, F.lit("/"))))
