"""Secrets in texts: keyword prefilter, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton over all keywords reads each text once; a pattern is tried only at the
places of its own keywords. Tokens that embed a checksum count only if it holds. One pass over the
documents without a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: keywords and patterns ---
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign",
    "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "-----begin ": "private_key",
}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
PRIVATE_KEY = re.compile(r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----(?:\s*[A-Za-z0-9-]+:[^\n]*\n)*+"
                         r"[A-Za-z0-9+/=\s]+-----END \1PRIVATE KEY-----", re.ASCII)
JWT_PART = re.compile(r"[A-Za-z0-9_-]+")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key")
BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32
# --- end of fixed values ---

_HEX_MAP = bytes(0x68 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))


def crc_holds(body: str) -> bool:
    """36 characters whose last six are the base-62 CRC-32 of the 30 before."""
    want, value = "", zlib.crc32(body[:30].encode())
    for _ in range(6):
        value, digit = divmod(value, 62)
        want = BASE62[digit] + want
    return body[30:] == want


def jwt_holds(header: str) -> bool:
    """The first part decodes to a JSON object that names its algorithm."""
    try:
        found = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except ValueError:
        return False
    return isinstance(found, dict) and "alg" in found


# kind -> (pattern, does a match count)
CHECKS = {
    "assign": (ASSIGN, lambda m: len(m.group(2)) >= MIN_VALUE),
    "access": (ACCESS, lambda m: len(m.group()) >= MIN_ACCESS),
    "github": (GITHUB, lambda m: crc_holds(m.group(1))),
    "npm": (NPM, lambda m: crc_holds(m.group(1))),
    "jwt": (JWT, lambda m: jwt_holds(m.group(1))),
    "private_key": (PRIVATE_KEY, lambda m: True),
}


def lowered(text: str) -> str:
    """Lower case of the same length, so that places stay: U+0130 alone would grow."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower()


def automaton():
    import ahocorasick
    trie = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        trie.add_word(word, (kind, len(word)))
    trie.make_automaton()
    return trie


def hex_spans(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 0-9a-f of at least MIN_HEX characters. Bytes are mapped first, which tells
    at once whether there is such a run at all."""
    if b"h" * MIN_HEX not in text.encode("utf-8", "surrogatepass").translate(_HEX_MAP):
        return []
    return [m.span() for m in re.finditer(rf"[0-9a-f]{{{MIN_HEX},}}", text)]


def find_secrets(text: str, trie) -> list[tuple[int, str, int]]:
    """(start, kind, end) in order of start, then KINDS. Per kind, matches are leftmost and do not
    overlap; a match that fails its check still uses up its characters, as when scanning from the
    left."""
    hits = [(end - n + 1, kind) for end, (kind, n) in trie.iter(lowered(text))]
    found, after = [], dict.fromkeys(CHECKS, 0)
    for start, kind in sorted(hits):
        if start < after[kind]:
            continue
        pattern, counts = CHECKS[kind]
        m = pattern.match(text, start)
        if m is None:
            if kind == "jwt":  # a later start in the same run of characters ends at the same place
                after[kind] = JWT_PART.match(text, start).end() if text[start:start + 3] == "eyJ" else 0
            continue
        after[kind] = m.end()
        if counts(m):
            found.append((start, kind, m.end()))
    found += [(a, "hex", b) for a, b in hex_spans(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans per document.

    Null texts count as empty: no spans, the digest of the empty string. Repeated rows are scanned
    one by one; columns besides doc_id and text are not read."""
    schema = ("doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
              "spans string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = automaton()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                spans = find_secrets(text, trie) if text else []
                base = [s for s in spans if s[1] in BASE_KINDS]
                rows.append([sum(s[1] == k for s in base) for k in BASE_KINDS] + [
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)])
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256",
                                              "spans"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def redact(docs: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by a mark and ``n_chars``, where there is
    one, set to the new length. Overlapping spans become one mark, of the first. All documents
    stay; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        trie = automaton()

        def one(text):
            if not text:
                return text
            out, at = [], 0
            for start, kind, end in find_secrets(text, trie):
                if start >= at:
                    out += [text[at:start], mark.format(kind=kind)]
                at = max(at, end)
            return "".join(out) + text[at:] if out else text
        return texts.map(one, na_action="ignore")

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
