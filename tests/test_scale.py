"""Operators with a special way for very large groups, against plain loops."""

import random
import statistics

from pyspark.sql import functions as F

from patchloom.functions.ranking import bucketed_lead, bucketed_row_number, grouped_median
from patchloom.operators import budget as B
from patchloom.operators import context as K
from patchloom.streaming import lifecycle_stream as S


def test_bucketed_ranks(spark):
    rnd = random.Random(1)
    rows = [(k, s) for k in range(3) for s in rnd.sample(range(-500, 5000), 300 if k else 900)]
    df = spark.createDataFrame(rows, "k bigint, seq bigint")
    got = bucketed_lead(bucketed_row_number(df, ["k"], "seq", "n", width=37), ["k"], "seq", "nxt",
                        width=37).collect()
    for k in range(3):
        order = sorted(s for kk, s in rows if kk == k)
        assert {(r.seq, r.n, r.nxt) for r in got if r.k == k} == {
            (s, i + 1, order[i + 1] if i + 1 < len(order) else None) for i, s in enumerate(order)}


def test_grouped_median(spark):
    rnd = random.Random(2)
    rows = [(k, round(rnd.random() * 9, 2)) for k in range(4) for _ in range(50 + k)]
    got = grouped_median(spark.createDataFrame(rows, "k bigint, v double"), ["k"], "v", "m").collect()
    assert {r.k: round(r.m, 9) for r in got} == {
        k: round(statistics.median(v for kk, v in rows if kk == k), 9) for k in range(4)}


def next_fit(files, limit):
    out, chunk, used, empty = {}, 0, 0, True
    for _, seq, tokens in sorted((-p, s, t) for s, t, p in files):
        if used + tokens <= limit:
            used += tokens
        else:
            chunk, used = chunk + (0 if empty else 1), tokens
        out[seq], empty = chunk, False
    return out


def test_packing_equals_next_fit_whatever_the_segments(spark):
    rnd = random.Random(3)
    for limit in (10, 100, 1000):
        changes = {c: [(s, rnd.choice((0, 1, 5, 9, 40, 120)), rnd.choice((0, 5, 10)))
                       for s in rnd.sample(range(400), 120)] for c in range(4)}
        changes[9] = [(0, limit + 1, 0), (1, 0, 0), (2, limit, 0)]
        df = spark.createDataFrame([(c, *f) for c, fs in changes.items() for f in fs],
                                   "change_id bigint, seq bigint, tokens bigint, priority bigint")
        for segment in (16, 4096):
            got = {}
            for r in B.chunk_numbers(df, limit, segment=segment, buckets=7).collect():
                got.setdefault(r.change_id, {})[r.seq] = r.chunk_no
            assert got == {c: next_fit(fs, limit) for c, fs in changes.items()}, (limit, segment)


def cut(text, limit):
    if len(text) <= limit:
        return text
    kept = text[:limit]
    whole_lines, newline, _ = kept.rpartition("\n")
    kept = whole_lines if newline and len(whole_lines) > limit * 0.8 else kept
    ends = [before + m for m in B.C.TRUNCATION_MARKERS
            for before, found, _ in [kept.rpartition(m)] if found and len(before) > limit * 0.6]
    return (ends or [kept])[0] + B.C.TRUNCATION_NOTICE


def test_truncate_context(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice(["word ", "\n", "\n## ", "\n### ", "\n```\n", "\n---\n", "x" * 9])
                     for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame([(t, rnd.randint(20, 200)) for t in texts], "t string, n bigint")
    for r in df.select("t", "n", B.truncate_context(F.col("t"), F.col("n")).alias("c")).collect():
        assert r.c == cut(r.t, r.n)


def test_interval_joins_over_buckets(spark):
    rnd = random.Random(5)
    fns = [(1, "a", i, s, s + rnd.randint(0, 300)) for i, s in enumerate(rnd.sample(range(1, 999), 40))]
    spans = [(1, "a", h, s, s + rnd.randint(0, 90)) for h, s in enumerate(rnd.sample(range(1, 999), 30))]
    f = spark.createDataFrame(fns, "change_id bigint, path string, fn_no int, start_line bigint, end_line bigint")
    r = spark.createDataFrame(spans, "change_id bigint, path string, h int, first_line bigint, last_line bigint")
    got = sorted((x.fn_no, x.h) for x in K.functions_in_range(f, r).collect())
    assert got == sorted((a[2], b[2]) for a in fns for b in spans if a[4] >= b[3] and a[3] <= b[4])
    lines = spark.createDataFrame([(1, "a", n) for n in range(1, 1300, 17)],
                                  "change_id bigint, path string, line bigint")
    got = {x.fn_no: x.changed_lines for x in K.modified_functions(f, lines).collect()}
    want = {a[2]: [n for n in range(1, 1300, 17) if a[3] <= n <= a[4]] for a in fns}
    assert got == {k: v for k, v in want.items() if v}
    assert K.unmodified_functions(f, lines).count() == sum(not v for v in want.values())


def lifecycle(runs):
    """(change, id) -> (posted, resolved), one run after the other."""
    state = {}
    for change, revision, found in sorted(runs):
        for i in found:
            state.setdefault((change, i), [revision, None])
        for (c, i), v in state.items():
            if c == change and i not in found and v[1] is None:
                v[1] = revision
    return {k: tuple(v) for k, v in state.items()}


def test_lifecycle_stream_with_late_and_repeated_runs(spark, tmp_path):
    rnd = random.Random(6)
    runs = [(c, r, sorted(rnd.sample("abcdef", rnd.randint(0, 4)))) for c in range(5)
            for r in sorted(rnd.sample(range(1, 40), 9))]
    as_df = lambda rows: spark.createDataFrame(
        [(c, r, i) for c, r, found in rows for i in (None, *found)], S.RUN_SCHEMA)
    twin = {(r.change_id, r.comment_id): (r.posted_revision, r.resolved_revision)
            for r in S.history(as_df(runs)).collect()}
    assert twin == lifecycle(runs)
    batches = [[r for r in runs if lo <= r[1] < lo + 10] for lo in (0, 10, 20, 30)]
    batches[2] = batches[2] + batches[2][:2] + [(0, 1, ["zz"])] + batches[1][:1]  # repeats, late
    for i, rows in enumerate(batches):
        as_df(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "runs"))
    table = S.StateTable(spark, str(tmp_path / "state"), compact_every=3)
    stream = spark.readStream.schema(S.RUN_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "runs"))
    S.start(stream, table, str(tmp_path / "checkpoint")).awaitTermination()
    result = lambda: {(r.change_id, r.comment_id): (r.posted_revision, r.resolved_revision)
                      for r in table.ids().collect()}
    assert result() == twin
    late = {(r.change_id, r.revision) for r in table.late().collect()}
    assert len(late) == (2 if batches[1] else 1)
    table.apply(as_df(batches[3]), 3)  # a replayed batch changes nothing
    assert result() == twin


def test_lifecycle_state_is_read_by_bucket_and_cleaned(spark, tmp_path):
    as_df = lambda rows: spark.createDataFrame(
        [(c, r, i) for c, r, found in rows for i in (None, *found)], S.RUN_SCHEMA)
    table = S.StateTable(spark, str(tmp_path), compact_every=2, buckets=4)
    rnd, runs = random.Random(8), []
    shown = lambda: {(r.change_id, r.comment_id): (r.posted_revision, r.resolved_revision)
                     for r in table.ids().collect()}
    for batch in range(7):
        mine = [(c, 10 * batch + 1, sorted(rnd.sample("abc", rnd.randint(0, 3))))
                for c in rnd.sample(range(20), 6)]
        runs += mine
        if batch == 4:  # a crash before the commit leaves the state as it was
            before, write = shown(), table._write
            def crash(df, kind, *rest):
                if kind == "manifest":
                    raise RuntimeError("lost")
                return write(df, kind, *rest)
            table._write = crash
            try:
                table.apply(as_df(mine[:3] + [(99, 1, ["z"])]), batch)
                raise AssertionError("no crash")
            except RuntimeError:
                table._write = write
            assert shown() == before
        table.apply(as_df(mine), batch)
        table.apply(as_df(mine), batch)  # repeated
        assert shown() == lifecycle(runs)
    held = table.manifest()
    assert all(len(deltas) <= 2 for _, deltas in held.values())
    assert len(table._batches("manifest")) == 2 and len(table._batches("input")) == 1
    some = table._state(held, {next(iter(held))})
    assert len({f.split("bucket=")[1].split("/")[0] for f in some.inputFiles()}) == 1
    assert {r.change_id: r.last_revision for r in table.last().collect()} == {
        c: max(r for x, r, _ in runs if x == c) for c, _, _ in runs}


def test_lifecycle_base_is_rewritten_only_when_deltas_have_grown(spark, tmp_path):
    as_df = lambda rows: spark.createDataFrame(
        [(c, r, i) for c, r, found in rows for i in (None, *found)], S.RUN_SCHEMA)
    table, runs, bases = S.StateTable(spark, str(tmp_path), compact_every=1, buckets=1), [], []
    for batch in range(6):
        n = 3000 if batch == 1 else 1
        mine = [(int(n > 1), 10 * batch + 1, [f"id{batch}-{i}" for i in range(n)])]
        runs += mine
        if batch == 2:
            mine += [(0, 1, ["late"])]
        table.apply(as_df(mine + mine), batch)
        (base, deltas), = table.manifest().values()
        bases.append(base)
        assert len(deltas) <= 1
    # The large batch made the base; the small ones after it are merged among themselves.
    assert bases == [None, 1, 1, 1, 1, 1]
    assert {(r.change_id, r.comment_id): (r.posted_revision, r.resolved_revision)
            for r in table.ids().collect()} == lifecycle(runs)
    assert [r.comment_id for r in table.late().collect() if r.comment_id] == ["late"]
    assert len(table._batches("staged")) == 1 and len(table._batches("state")) <= 4
