import base64
import hashlib
import random
import re
import zlib

from patchloom.llm import secrets as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)


def base(text):
    found = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(text)
             if len(m[2]) >= 8]
    found += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text)
              if len(m[0]) >= 16]
    found += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text)
              if len(m[0]) >= 32]
    return ",".join(x for *_, x in sorted(found))


def signed(prefix, body):
    value, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        tail = S.BASE62[digit] + tail
    return prefix + body + tail


def test_base_spans_equal_plain_scans():
    rng = random.Random(6)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'",
             "abcdefgh", "x1", "AKIA", "AKIAABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "İ", "ſ",
             "K", "é", "\n", "🎈", ".", "/", "-"]
    trie = S.automaton()
    for _ in range(6000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 16)))
        got = S.joined([s for s in S.find_secrets(text, trie) if s[1] in S.BASE_KINDS])
        assert got == base(text), text


def test_checksums_decide():
    trie = S.automaton()
    good = signed("ghp_", "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5")
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    no = base64.urlsafe_b64encode(b'{"aXg":"HS256"}').decode().rstrip("=")
    text = f"{good} {bad} {signed('npm_', 'x' * 30)} {head}.eyJh.sig {no}.eyJh.sig"
    assert [k for _, k, _ in S.find_secrets(text, trie)] == ["github", "npm", "jwt"]
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabc=\n-----END RSA PRIVATE KEY-----"
    assert S.find_secrets("x" + key, trie) == [(1, "private_key", 1 + len(key))]


def test_rows(spark, make_docs, odd_rows):
    docs = make_docs(odd_rows).selectExpr("*", "1 AS spans")
    got = S.scan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    assert len(got) == len(odd_rows) and S.scan(make_docs([])).count() == 0
    for r in got:
        if r.doc_id is not None:
            want = base(texts[r.doc_id] or "")
            assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and r.spans == want
            assert r.n_assign == want.count("assign")


def test_redaction(spark, make_docs):
    rows = [(1, "a password = 'hunter2hunter2' b"), (2, None), (3, "clean"), (4, "f" * 40),
            (5, "token=" + "f" * 40 + "!")]
    out = S.redact(make_docs(rows))
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got[1][0] == "a [assign]' b" and got[2] == (None, None) and got[3] == ("clean", 5)
    assert got[4] == ("[hex]", 5) and got[5][0] == "[assign]!"
    assert out.columns == make_docs(rows).columns


def test_runs_of_headers_take_linear_time():
    import time
    trie = S.automaton()
    for run in ("eyJ", "eyJa.", "eyJ.eyJ", "-----BEGIN PRIVATE KEY-----\n", "a: b\n", "token ", "password"):
        start = time.perf_counter()
        S.find_secrets(run * 100_000, trie)
        assert time.perf_counter() - start < 5, run


def test_private_keys_with_header_lines():
    key = ("-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00\n\n"
           "QUJD\nREVG\n-----END RSA PRIVATE KEY-----")
    assert (3, "private_key", 3 + len(key)) in S.find_secrets("x: " + key + " y", S.automaton())
