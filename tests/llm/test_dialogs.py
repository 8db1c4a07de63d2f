import hashlib
import itertools
import random
import zlib

import pytest

from patchloom.llm import dialogs as D

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(kinds):
    """(cost, edits) by dynamic programming forwards over (cost, edits) pairs."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    inserted = lambda at: {q: min([x for x in [at.get(q)] + [
        (c + 3, e + "I") for p, (c, e) in at.items() if follow.get((p, "a" if q == 3 else "u")) == q
        and q > 1] if x]) for q in set(at) | {2, 3} if q in at or q > 1 and any(
        (p, "a" if q == 3 else "u") in follow for p in at)}
    at = {0: (0, "")}
    for kind in kinds:
        at = inserted(inserted(at))
        new = {}
        put = lambda q, x: new.__setitem__(q, min(new.get(q, x), x))
        for q, (c, e) in at.items():
            put(q, (c + 4, e + "D"))
            if kind != "x":
                more = 3 * kind.isupper()
                if (q, kind.lower()) in follow:
                    put(follow[q, kind.lower()], (c + more, e + "K"))
                for r in "ua":
                    if (q, r) in follow:
                        put(follow[q, r], (c + 3 + more, e + "R"))
        at = new
    at = inserted(inserted(at))
    return min(x for q, x in at.items() if q in (0, 3))


def brute(rows, damage=True):
    talks = {}
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20 if damage else 9
        mine = talks.setdefault(conv, [])
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        row = (turn, "user" if kind == 4 else role, text)
        mine += [row] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, mine in talks.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, kinds, counts = set(), "", [0, 0, 0]
        for _, role, text in mine:
            bare = text.strip(SPACE)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            kind = "x" if fault < 2 else role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += kind.upper() if fault == 2 else kind
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, edits = cheapest(kinds)
        state, k, lines = None, 0, []
        for e in edits:
            role = "assistant" if state == "u" else "user"
            if e == "K":
                role = mine[k][1]
            if e != "D":
                lines.append(f"{role}:{'' if e == 'I' else mine[k][2]}")
                state = role[:1]
            k += e != "I"
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, edits, sha))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                    r.repaired_sha256) for r in df.collect()), key=repr)


def test_auction_equals_dynamic_programming():
    rng = random.Random(2)
    short = ["".join(p) for n in range(4) for p in itertools.product("suaoSUAx", repeat=n)]
    long = ["".join(rng.choices("suaoSUAOx", [1, 6, 6, 1, 1, 2, 2, 1, 3], k=rng.randint(4, 90)))
            for _ in range(300)]
    for kinds in short + long:
        assert D.whole(kinds) == cheapest(kinds), kinds


def test_prices_are_exact_at_origins():
    rng = random.Random(4)
    kinds = "".join(rng.choices("suaoUAx", k=40))
    arcs, price = D.converged(kinds, D.END)
    assert all(price[k] <= c + price[to] for k, out in enumerate(arcs) for _, c, to in out)
    exact = [0] * (len(arcs) + 1)
    for k in range(len(arcs) - 1, -1, -1):
        exact[k] = D.FAR
    for _ in range(3 * len(arcs)):
        for k in range(len(arcs) - 1, -1, -1):
            exact[k] = min((c + exact[to] for _, c, to in arcs[k]), default=D.FAR)
    assert all(price[k] <= exact[k] for k in range(len(arcs)))
    assert price[:4] == exact[:4]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    rows = []
    for conv in [*range(60), None, -5]:
        n = 150 if conv in (7, None) else rng.choice([1, 2, 3, 5, 8, 13])
        for turn in range(n):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "usher", "",
                               None]) if rng.random() < .3 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No! ", "so it\n", "", " \t", None, f"t{turn}?", f"x{turn}", "é"])
            at = None if rng.random() < .1 else turn + rng.choice([0, 0, 0, 0, 1, 3])
            rows.append((conv, at, role, text))
            if rng.random() < .1:
                rows += [rows[-1]] * rng.choice([1, 2])
    rows += [(500, None, None, None), (501, 3, "user", "x" * 70_000), (501, 4, "assistant", "Ok.")]
    # a conversation whose every row is dropped
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "Hi.")]


@pytest.mark.parametrize("most_rows, parts", [(256, 3), (4, 11), (1, 5)])
def test_equals_brute_force(spark, talks, most_rows, parts):
    table = spark.createDataFrame(talks, SCHEMA).selectExpr(
        "*", "1 AS seg", "2 AS cost", "3 AS audit", "4 AS kinds", "5 AS entry").repartition(parts)
    got = D.digests(D.repair(D.damaged(table), most_rows))
    assert result(got) == brute(talks)


def test_repeats_joined_by_shuffle(spark, talks, monkeypatch):
    monkeypatch.setattr(D, "FEW_REPEATS", -1)
    table = spark.createDataFrame(talks, SCHEMA)
    assert result(D.digests(D.repair(table))) == brute(talks, damage=False)


def test_repaired_turns(spark):
    table = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B?"), (1, 2, "tool", "C."),
                                   (2, 0, "system", "S.")], SCHEMA)
    got = {r.conv_id: (r.audit, r.roles, r.texts) for r in D.repair(table).collect()}
    assert got == {1: ("KIKR", ["user", "assistant"] * 2, ["A.", "", "B?", "C."]),
                   2: ("D", [], [])}
    assert D.digests(D.repair(spark.createDataFrame([], SCHEMA))).count() == 0
