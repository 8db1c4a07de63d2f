"""Conversation structure repair by an auction over the lattice of edits.

A conversation's rows are columns of a lattice; in each column stand four nodes, by what the
repaired conversation has so far: nothing, a system turn, a user turn last, an assistant turn last.
Keeping, changing the role of, or deleting a row leads to the next column, inserting a turn stays in
its own; costs are whole numbers. Shortest paths to the end are found by auction: nodes carry prices,
a path from an origin is extended to the node that makes its end's price tight, or, where no arc is
tight, that price is raised and the path contracted. Prices never exceed true distances and are
equal to them on every cheapest path once the origin's path arrives, so all cheapest edits are paths
of tight arcs, and the first of them in the alphabet is traced along these. Origins are taken from
the end of the lattice backwards in steps of some columns; prices are kept, so each only has to raise
those of its own columns.

Conversations of any length are cut into segments. Rows are sorted into ranges of conversation and
turn, so one conversation may lie in many tasks. A segment gives the costs between its entry and exit
nodes and their order in the alphabet; one small row per segment is chained by conversation, after
which each segment traces its own part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patchloom.llm import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_ROWS = 256
SEGMENT_CHARS = 4_000_000
ORIGIN_STEP = 8            # columns between origins of the auction
REMEMBERED = 24            # shapes of at most so many rows are remembered in a task
FEW_REPEATS = 50_000       # repeated messages of at most so many rows are broadcast
PREFIX = 64                # characters of a text that take part in dealing out rows
FAR = 1 << 40
AFTER_INSERT = (2, 2, 3, 2)     # an inserted or rerolled turn is user, but assistant after user
END = (0, 2 * INSERT, INSERT, 0)  # what is still to insert after the last row, by node
LEGAL = {"su", "ua", "au"}


def _arcs(symbol: str) -> list[list[tuple[str, int, int, int]]]:
    """Arcs (letter, cost, columns on, node) from each node of a column before a row of this kind,
    letters in the order of the alphabet. Kinds: s, u, a by role, o for any other; capitals are
    truncated; x must go."""
    out = []
    for node in range(4):
        arcs = [("D", DELETE, 1, node), ("I", INSERT, 0, AFTER_INSERT[node])]
        if symbol != "x":
            more = TRUNCATED if symbol.isupper() else 0
            follows = {"s": node == 0 and 1, "u": node != 2 and 2, "a": node == 2 and 3}
            kept = follows.get(symbol.lower(), 0)
            if kept:
                arcs.append(("K", KEEP + more, 1, kept))
            arcs.append(("R", REROLE + more, 1, AFTER_INSERT[node]))
        out.append(arcs)
    return out


ARCS = {symbol: _arcs(symbol) for symbol in "suaoSUAOx"}


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int,
            target: int) -> None:
    """Raise ``price`` until a path of tight arcs leads from ``origin`` to ``target``, or the origin
    is known to lead nowhere. arcs: (letter, cost, node) by node. Prices must not exceed any arc's
    cost plus the price behind it, and stay so."""
    path = [origin]
    while path[-1] != target:
        node = path[-1]
        best, onward = FAR, -1
        for _, cost, to in arcs[node]:
            value = cost + price[to]
            if value < best:
                best, onward = value, to
        if price[node] < best:
            price[node] = best
            if node != origin:
                path.pop()
        elif onward < 0:
            return
        else:
            path.append(onward)


def converged(rows: str, end: tuple[int, ...]) -> tuple[list, list[int]]:
    """(arcs, prices) of the lattice of rows of these kinds, prices exact for every origin taken;
    ``end`` has the cost of leaving at each node of the last column, FAR for no exit there."""
    n = len(rows)
    arcs = [[(letter, cost, 4 * (i + on) + to) for letter, cost, on, to in ARCS[symbol][node]]
            for i, symbol in enumerate(rows) for node in range(4)]
    arcs += [[("", end[node], 4 * n + 4)] if end[node] < FAR else [] for node in range(4)]
    # Nodes after a user or assistant turn never get back to the first two.
    dead = [q for q in range(4) if min(end[min(q, 2):] if q else end) >= FAR]
    price = [FAR if k % 4 in dead else 0 for k in range(4 * n + 4)] + [0]
    for column in [*range(n, 0, -ORIGIN_STEP), 0]:
        for node in range(4):
            auction(arcs, price, 4 * column + node, 4 * n + 4)
    return arcs, price


def traced(rows: str, arcs: list, price: list[int]) -> list[tuple[int, str, int] | None]:
    """For each entry node: (cost, edits, exit node) of the cheapest edits that come first in the
    alphabet; None if no exit can be reached. Only tight arcs from which tight arcs lead to the end
    are followed."""
    n, target = len(rows), len(arcs)
    leads = [False] * target + [True]
    for i in range(n, -1, -1):
        for _ in range(1 if i == n else 3):  # inserts stay in the column, two in a row at most
            for k in range(4 * i, 4 * i + 4):
                leads[k] = leads[k] or any(leads[to] and price[k] == cost + price[to]
                                           for _, cost, to in arcs[k])
    out = []
    for entry in range(4):
        k, edits = entry, []
        while leads[k] and k < 4 * n:
            letter, k = next((letter, to) for letter, cost, to in arcs[k]
                             if leads[to] and price[k] == cost + price[to])
            edits.append(letter)
        out.append((price[entry], "".join(edits), k - 4 * n) if leads[k] else None)
    return out


def whole(rows: str) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    cost, edits, node = traced(rows, *converged(rows, END))[0]
    return cost, edits + "I" * (END[node] // INSERT)


def between(rows: str) -> tuple[list[int], list[int]]:
    """Costs from each entry to each exit node of a segment, and the place of each exit's edits in
    the alphabet among those of its entry; both by entry, then exit."""
    found = []
    for out in range(4):
        end = tuple(0 if q == out else FAR for q in range(4))
        found.append(traced(rows, *converged(rows, end)))
    costs = [found[out][entry][0] if found[out][entry] else FAR
             for entry in range(4) for out in range(4)]
    places = []
    for entry in range(4):
        known = sorted(found[out][entry][1] for out in range(4) if found[out][entry])
        places += [known.index(found[out][entry][1]) if found[out][entry] else 4
                   for out in range(4)]
    return costs, places


def part(rows: str, entry: int, out: int) -> str:
    """The edits of a segment between two nodes."""
    end = tuple(0 if q == out else FAR for q in range(4))
    return traced(rows, *converged(rows, end))[entry][1]


def applied(edits: str, entry: int, roles: list[str], texts: list[str]
            ) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from the entry node on."""
    node, row, out_roles, out_texts = entry, 0, [], []
    for edit in edits:
        if edit in "KR":
            kept = roles[row]
            node = {"s": 1, "u": 2, "a": 3}[kept[0]] if edit == "K" else AFTER_INSERT[node]
            out_roles.append(kept if edit == "K" else ("user", "assistant")[node - 2])
            out_texts.append(texts[row])
        elif edit == "I":
            node = AFTER_INSERT[node]
            out_roles.append(("user", "assistant")[node - 2])
            out_texts.append("")
        row += edit != "I"
    return out_roles, out_texts


# --- rows in order ------------------------------------------------------------


def marked(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text with n, the number of equal ones, and what is wrong with them:
    blank, repeated (the same role and text stand at an earlier turn), cut (truncated).

    Equal rows are counted before anything is shuffled. Messages that stand at several turns are
    found by a digest, counted map-side too; they are few as a rule and then joined as a broadcast
    of checked size, else by shuffle."""
    n = F.col("n") if "n" in rows.columns else F.lit(1)
    read = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    counted = rows.select("conv_id", "turn", read("role"), read("text"), n.cast("bigint").alias("n")
                          ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    message = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")),
                                 F.hex("role"), F.col("text")), 256)
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = counted.withColumn("message", F.when(F.col("n") > 0, message)).withColumn("at", at)
    repeated = C.written(keyed.filter("message IS NOT NULL").groupBy("message").agg(
        F.count("*").alias("places"), F.min("at").alias("first")).filter("places > 1").drop("places"))
    if repeated.count() <= FEW_REPEATS:
        repeated = F.broadcast(repeated)
    word = rf"[^{C.SPACE}]"
    return keyed.join(repeated, "message", "left").select(
        "conv_id", "turn", "role", "text", "n",
        (~F.col("text").rlike(word)).alias("blank"),
        F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("repeated"),
        F.col("text").rlike(rf"[^.!?{C.SPACE}][{C.SPACE}]*\z").alias("cut"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows by conversation, turn (nulls first), role and text, dealt out in ranges of these."""
    ranged = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, PREFIX))
    return ranged.sortWithinPartitions("conv_id", "turn", "role", "text")


class _Segment:
    """What is gathered of one conversation in one task until it is cut or ends."""

    def __init__(self) -> None:
        self.rows, self.roles, self.texts, self.chars = [], [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.initials = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeated: bool,
            cut: bool) -> None:
        initial = role[:1]
        if self.initials is None:
            self.initials = (initial, initial)
        else:
            self.illegal += self.initials[1] + initial not in LEGAL
            self.initials = (self.initials[0], initial)
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        symbol = "x" if blank or repeated else initial if initial and initial in "sua" else "o"
        self.blank += blank
        self.duplicate += repeated and not blank
        if cut and symbol != "x":
            self.truncated += 1
            symbol = symbol.upper()
        self.rows.append(symbol)
        self.roles.append("" if symbol == "x" else role)
        self.texts.append("" if symbol == "x" else text)
        self.chars += len(self.texts[-1])


SEGMENT_SCHEMA = (
    "conv_id bigint, seg bigint, closed boolean, kinds string, blank bigint, duplicate bigint, "
    "truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, head string, "
    "tail string, cost bigint, audit string, costs array<bigint>, places array<int>, "
    "roles array<string>, texts array<string>")


def segments(ordered: DataFrame, most_rows: int) -> DataFrame:
    """Whole conversations, repaired, where one task has all of one in a segment (``closed``); else
    segments with their costs, roles and texts as they are. seg rises in the order of rows."""
    columns = [c.split()[0] for c in SEGMENT_SCHEMA.split(", ")]
    known = ordered.select(
        F.col("conv_id").isNotNull().alias("has_id"), F.coalesce("conv_id", F.lit(0)).alias("id"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", "text", "n", "blank", "repeated", "cut")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        solved = functools.lru_cache(1 << 15)(whole)
        number, base = 0, TaskContext.get().partitionId() << 32
        out, chars = [], 0

        def done(key, s: _Segment, closed: bool) -> None:
            nonlocal number, chars
            kinds = "".join(s.rows)
            row = [key[1] if key[0] else None, base + number, closed, kinds, s.blank, s.duplicate,
                   s.truncated, s.illegal, s.turns, s.low, s.high, *(s.initials or (None, None))]
            if closed:
                cost, edits = (solved if len(kinds) <= REMEMBERED else whole)(kinds)
                out.append([*row, cost, edits, None, None, *applied(edits, 0, s.roles, s.texts)])
            else:
                out.append([*row, None, None, *between(kinds), s.roles, s.texts])
            number += 1
            chars += s.chars

        def flush() -> pd.DataFrame:
            nonlocal out, chars
            frame = pd.DataFrame(out, columns=columns)
            for c in ("conv_id", "low", "high", "cost"):
                frame[c] = frame[c].astype("Int64")
            out, chars = [], 0
            return frame

        now, held, whole_here = None, _Segment(), False
        for batch in batches:
            for has_id, conv, has_turn, turn, role, text, n, blank, repeated, cut in zip(
                    *(batch[c].tolist() for c in batch.columns)):
                key = (has_id, conv)
                if key != now:
                    if now is not None:
                        done(now, held, whole_here)
                        whole_here = True
                    now, held = key, _Segment()
                for copy in range(n):
                    if len(held.rows) >= most_rows or held.chars + len(text) > SEGMENT_CHARS:
                        if held.rows:
                            done(now, held, False)
                            held, whole_here = _Segment(), False
                    held.add(turn if has_turn else None, role, text, blank, repeated or copy > 0,
                             cut)
                    if chars > SEGMENT_CHARS or len(out) > 2_000:
                        yield flush()
                if chars > SEGMENT_CHARS or len(out) > 2_000:
                    yield flush()
        if now is not None:
            done(now, held, False)
        yield flush()

    return known.mapInPandas(run, SEGMENT_SCHEMA)


def chained(open_segments: DataFrame) -> DataFrame:
    """seg, entry, out, first, last and the conversation's figures, for each open segment.

    A conversation comes here as one row of some 300 bytes for each segment, which is less than the
    edits that its result holds as one value."""
    schema = ("seg bigint, entry int, out int, first boolean, last boolean, gaps bigint, "
              "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seg")
        costs, places = frame["costs"].tolist(), frame["places"].tolist()
        after = [list(END)]
        for c in reversed(costs):
            after.append([min(min(c[4 * q + e] + after[-1][e] for e in range(4)), FAR)
                          for q in range(4)])
        after.reverse()
        entries, node = [], 0
        for k, (c, p) in enumerate(zip(costs, places)):
            entries.append(node)
            node = min((p[4 * node + e], e) for e in range(4)
                       if c[4 * node + e] + after[k + 1][e] == after[k][node])[1]
        filled = frame[frame["head"].notna()]
        heads, tails = filled["head"].tolist(), filled["tail"].tolist()
        illegal = frame["illegal"].sum() + sum(
            a + b not in LEGAL for a, b in zip(tails, heads[1:]))
        timed = frame[frame["has_turn"]]
        low, high = timed["low"].tolist(), timed["high"].tolist()
        turns = timed["turns"].sum() - sum(a == b for a, b in zip(high, low[1:]))
        return pd.DataFrame({
            "seg": frame["seg"].to_numpy(), "entry": entries, "out": entries[1:] + [node],
            "first": [True] + [False] * (len(frame) - 1), "last": [False] * (len(frame) - 1) + [True],
            "gaps": high[-1] - low[0] + 1 - turns if low else 0,
            **{c: frame[c].sum() for c in ("blank", "duplicate", "truncated")},
            "illegal": illegal, "cost": after[0][0]})

    light = open_segments.select(
        "conv_id", "seg", "blank", "duplicate", "truncated", "illegal", "turns",
        F.col("low").isNotNull().alias("has_turn"), F.coalesce("low", F.lit(0)).alias("low"),
        F.coalesce("high", F.lit(0)).alias("high"), "head", "tail", "costs", "places")
    return light.groupBy("conv_id").applyInPandas(lambda f: run(f), schema)


BLOCK = ["conv_id", "seg", "first", "last", "gaps", "blank", "duplicate", "truncated", "illegal",
         "cost", "audit", "roles", "texts"]


def repair(rows: DataFrame, most_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Repaired conversations as blocks of turns in order (BLOCK columns); almost all have one block,
    which is ``first`` and ``last``. The figures are the conversation's, audit, roles and texts the
    block's.

    rows: conv_id, turn, role, text and maybe n, the number of equal rows; 0 only names the
    conversation. Nulls in role and text count as one space; rows without a conv_id are one
    conversation; rows with equal turns are ordered by role and text; a role that begins with none
    of s, u, a can't be kept. Extra columns are ignored. No rows give no blocks."""
    found = C.written(segments(in_order(marked(rows)), most_rows))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    closed = found.filter("closed").withColumns(
        {"first": F.lit(True), "last": F.lit(True), "gaps": gaps}).select(*BLOCK)
    still_open = found.filter("NOT closed")
    told = C.written(chained(still_open))
    schema = "audit string, roles array<string>, texts array<string>"
    figures = [c for c in BLOCK if c not in ("audit", "roles", "texts")]
    joined = still_open.select("conv_id", "seg", "kinds", "roles", "texts").join(told, "seg").select(
        *figures, "kinds", "entry", "out", "roles", "texts")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.select(*figures).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = batch[figures].copy()
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            new = []
            for kinds, entry, out, last, roles, texts in zip(
                    *(batch[c] for c in ("kinds", "entry", "out", "last", "roles", "texts"))):
                edits = part(kinds, entry, out) + "I" * (END[out] // INSERT if last else 0)
                new.append((edits, *applied(edits, entry, list(roles), list(texts))))
            for k, c in enumerate(("audit", "roles", "texts")):
                frame[c] = [x[k] for x in new]
            yield frame

    return closed.unionByName(joined.mapInPandas(run, f"{kept}, {schema}"))


def digests(blocks: DataFrame) -> DataFrame:
    """One row per conversation: its figures, the whole audit and the SHA-256 of its turns as
    ``role:text`` lines. Conversations of several blocks are hashed block after block in a stream;
    a hash can't be had in parts, but only one block is held at a time."""
    figures = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    one = F.col("first") & F.col("last")
    short = blocks.filter(one).select(*figures, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    several = blocks.filter(~one).select(
        *figures, "seg", "last", "audit", lines.alias("lines"),
        (F.size("roles") > 0).alias("filled")).repartition("conv_id").sortWithinPartitions(
        "conv_id", "seg")
    schema = ", ".join(f"{c} bigint" for c in figures) + ", audit string, repaired_sha256 string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha, begun, audit = hashlib.sha256(), False, []
        for batch in batches:
            rows = []
            for k, (last, edits, text, filled) in enumerate(zip(
                    *(batch[c] for c in ("last", "audit", "lines", "filled")))):
                audit.append(edits)
                if filled:
                    sha.update((b"\n" if begun else b"") + text.encode("utf-8", "surrogatepass"))
                    begun = True
                if last:
                    rows.append((k, "".join(audit), sha.hexdigest()))
                    sha, begun, audit = hashlib.sha256(), False, []
            frame = batch[figures].iloc[[k for k, _, _ in rows]].copy()
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            frame["audit"], frame["repaired_sha256"] = [r[1] for r in rows], [r[2] for r in rows]
            yield frame

    return short.unionByName(several.mapInPandas(run, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """The conversations with faults put in by a checksum of ``conv_id:turn``, nulls as one space:
    of 20 values 0 drops a row (n = 0), 1 empties its text, 2 removes its sentence ends, 3 repeats
    it (n = 2), 4 makes it the user's."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat_ws(":", read("conv_id"), read("turn")), "UTF-8")) % 20
    text = (F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(read("text"), "[.!?]", ""))
            .otherwise(read("text")))
    role = F.when(kind == 0, "").when(kind == 4, "user").otherwise(read("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("n"))
