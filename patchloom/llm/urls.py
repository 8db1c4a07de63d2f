"""URL rules and a list of canonical URLs behind a blocked Bloom filter (native).

The filter is a table of one 64-bit word per block with a fixed most number of blocks, so it may be
broadcast. What passes it, true hits and a few false ones, goes to an exact join with the list.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C

MAX_BLOCKS = 1 << 18        # 64-bit words: at most 2 MB of bits, 6 MB as broadcast rows
KEYS_PER_BLOCK = 4          # 16 bits per key
BITS_PER_KEY = 4


@dataclass(frozen=True)
class UrlRule:
    """Pages of ``host`` and its subdomains whose path starts with ``path``."""
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"),
         UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))
AUTHORITY = r"(?s)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, AUTHORITY, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, AUTHORITY, 2), F.lit(""))


def canonical(url: Column, host: Column, path: Column) -> Column:
    """Host without 'www.' or 'm.', path without a final '/' or '.html', and the query's
    parameters without tracking ones, sorted. Scheme and fragment do not count. Null without a
    host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat_ws(
        "?", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""),
                      F.regexp_replace(path, r"(\.html|/)$", "")),
        F.when(F.size(kept) > 0, F.array_join(kept, "&"))))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def located(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, rule_verdict, canonical of each page."""
    rows = pages.select("page_id", "url").withColumn("host", host_of(F.col("url"))).withColumn(
        "path", path_of(F.col("url")))
    hit = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", hit.getField("rule").alias("rule"),
                       hit.getField("verdict").alias("rule_verdict"),
                       canonical(F.col("url"), F.col("host"), F.col("path")).alias("canonical"))


def repeated_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """The list for a crawl: (canonical, first_page) of all URLs that several pages share.

    ``first_page`` stands for the others: the smallest page_id that a rule allows, as that page stays
    in any case, else the smallest that no rule decides. A page that a rule blocks stands for the others
    only where rules block them all."""
    verdict, page = F.col("rule_verdict"), F.col("page_id")
    blocked = F.coalesce(verdict == "block", F.lit(False))
    first = F.when(F.count_if(~blocked) > 0, F.coalesce(
        F.min(F.when(verdict == "allow", page)), F.min(F.when(verdict.isNull(), page)))).otherwise(
        F.min(page))
    return located(pages, rules).filter(F.col("canonical").isNotNull()).groupBy("canonical").agg(
        first.alias("first_page"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")


def _place(key: Column, n_blocks: int) -> tuple[Column, Column]:
    """(block, mask of BITS_PER_KEY bits) of a key."""
    bits = F.xxhash64(key, F.lit("bits"))
    mask = None
    for i in range(BITS_PER_KEY):
        one = F.expr("CAST(1 AS BIGINT)")
        bit = F.call_function("shiftleft", one, F.call_function(
            "shiftrightunsigned", bits, F.lit(6 * i)).bitwiseAND(F.lit(63).cast("bigint")).cast(
            "int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return F.pmod(F.xxhash64(key), F.lit(n_blocks).cast("bigint")), mask


def bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, word): at most n_blocks rows, whatever the list's length."""
    block, mask = _place(F.col("canonical"), n_blocks)
    return listed.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(
        F.bit_or("mask").alias("word"))


def blocks_for(n_keys: int) -> int:
    wanted = max(1, math.ceil(n_keys / KEYS_PER_BLOCK))
    return min(MAX_BLOCKS, 1 << (wanted - 1).bit_length())


def filter_urls(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed per page.

    A rule decides its pages. Of the others, a page is blocked when its canonical URL is in
    ``listed`` (canonical, first_page) and it is not ``first_page`` itself; without a list, that of
    repeated URLs is taken, so that each URL stays once: at pages that a rule allows, else at the
    smallest page_id that no rule decides. A null page_id on a listed URL is blocked. A list longer than MAX_BLOCKS * KEYS_PER_BLOCK only lets more false
    hits through to the exact join. Null URLs, and those without '://', have empty host and path,
    fit no rule and are allowed. Repeated rows are judged one by one."""
    listed = C.written((repeated_urls(pages, rules) if listed is None else listed).select(
        "canonical", "first_page").groupBy("canonical").agg(
        F.min("first_page").alias("first_page")))
    n_blocks = blocks_for(listed.count())
    rows = located(pages, rules)
    block, mask = _place(F.col("canonical"), n_blocks)
    probed = rows.withColumn("_block", block).withColumn("_mask", mask).join(
        F.broadcast(bloom(listed, n_blocks)), F.col("_block") == F.col("block"), "left")
    maybe = F.coalesce(F.col("word").bitwiseAND(F.col("_mask")) == F.col("_mask"), F.lit(False)) \
        & F.col("canonical").isNotNull()
    probed = probed.withColumn("_maybe", maybe).drop("_block", "_mask", "block", "word")
    hits = probed.filter("_maybe").join(listed, "canonical", "left").select(
        "page_id", "host", "path", "rule", "rule_verdict",
        F.col("first_page").isNotNull().alias("listed"),
        (F.col("first_page").isNotNull()
         & ~F.col("page_id").eqNullSafe(F.col("first_page"))).alias("_later"))
    misses = probed.filter("NOT _maybe").select(
        "page_id", "host", "path", "rule", "rule_verdict", F.lit(False).alias("listed"),
        F.lit(False).alias("_later"))
    return misses.unionByName(hits).select(
        "page_id", "host", "path", "rule", F.coalesce(
            "rule_verdict", F.when(F.col("_later"), "block").otherwise("allow")).alias("verdict"),
        "listed")
