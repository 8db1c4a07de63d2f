"""Fixture tables derived from the driver's test tables.

The test tables hold no diffs, sources or findings, so these build them, row by
row and over the whole tables. The same tables are restated in DuckDB SQL in
``oracles.py``; the diff texts exist only here, so what the diff operators parse
is checked against a generator that never parses.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patchloom import constants as C
from patchloom.functions import ids


SPLIT_BYTES = 32 << 20


def memo(build):
    """Build a fixture's lazy DataFrame once per session and folder. Only the
    plan is kept, no data."""
    made: dict[tuple[str, str], DataFrame] = {}

    @functools.wraps(build)
    def get(spark, sf_dir):
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in made:
            made[key] = build(spark, sf_dir)
        return made[key]
    return get


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A small table lies in one file with one row group, hence in one task; hash
    it over the cores. A large one comes in many splits and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * SPLIT_BYTES else df


@memo
def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"), "doc_id")


@memo
def files(spark, sf_dir) -> DataFrame:
    """One file per document, 20 files per change."""
    d = F.col("doc_id")
    folder = (F.when(d % 10 == 0, "node_modules/").when(d % 10 == 1, "tests/test_")
              .when(d % 10 == 2, "src/auth/").when(d % 10 == 3, "deploy/").otherwise("src/"))
    suffix = (F.when(d % 7 == 1, ".js").when(d % 7 == 2, ".ts").when(d % 7 == 3, ".go")
              .when(d % 7 == 4, ".min.js").when(d % 7 == 5, ".md").otherwise(".py"))
    kind = (F.when(d % 40 == 7, "binary").when(d % 40 == 9, "deleted")
            .when(d % 40 == 11, "rename").when(d % 40 == 13, "new").otherwise("edit"))
    return documents(spark, sf_dir).select(
        d.alias("file_id"), F.floor(d / 20).cast("bigint").alias("change_id"),
        F.concat(folder, "source", F.lit("_"), d.cast("string"), suffix).alias("path"),
        kind.alias("kind"), F.col("text").alias("content"))


def _op(kind: Column, n: Column) -> Column:
    return (F.when(kind == "new", "add").when(kind == "deleted", "delete")
            .when(n % 5 == 0, "delete").when(n % 3 == 0, "context").otherwise("add"))


def _planted(file_id: Column, n: Column, raw: Column) -> Column:
    """Lines that fire each rule once in a while; documents hold none."""
    k = (file_id + n) % 23
    lines = (
        F.concat(F.lit('API_KEY = "'), F.md5(raw), F.lit('"')),
        'password = "hunter2hunter2"', "    result = eval(x)", "exec(code)",
        'cursor.execute(f"SELECT {x}")', "db.query(`SELECT ${x}`)", "except:",
        "} catch (e) { }", "console.log(x)", "    # TODO: later",
        'API_KEY = "test_placeholder_key_12345678"', "def f(a, b):", "import os",
    )
    out = None
    for i, line in enumerate(lines):
        line = line if isinstance(line, Column) else F.lit(line)
        out = F.when(k == i, line) if out is None else out.when(k == i, line)
    return out.otherwise(raw)


def _not_deleted_upto(kind, n):
    """Non-delete lines among the first n; ops repeat, so a closed form."""
    return (F.when(kind == "new", n).when(kind == "deleted", 0)
            .otherwise(n - F.floor(n / 5)))


def _not_added_upto(kind, n):
    return (F.when(kind == "new", 0).when(kind == "deleted", n)
            .otherwise(F.floor(n / 5) + F.floor(n / 3) - F.floor(n / 15)))


@memo
def changes(spark, sf_dir) -> DataFrame:
    """The expected line changes, straight from the generator."""
    raw = files(spark, sf_dir).filter(~F.col("kind").isin("binary", "rename")).select(
        "file_id", "change_id", "path", "kind",
        F.posexplode(F.split("content", "\n")).alias("p", "raw"))
    n, kind = F.col("n"), F.col("kind")
    lines = raw.select(
        "file_id", "change_id", "path", "kind", (F.col("p") + 1).cast("bigint").alias("n"), "raw"
    ).select(
        "file_id", "change_id", "path", "kind", "n", _op(kind, n).alias("op"),
        F.when(kind.isin("new", "deleted"), 0).otherwise(F.floor((n - 1) / 12))
        .cast("bigint").alias("hunk_no"),
        _planted(F.col("file_id"), n, F.col("raw")).alias("line"))
    return lines.select(
        "*",
        (1 + 3 * F.col("hunk_no") + _not_deleted_upto(kind, n - 1)).cast("bigint")
        .alias("new_line"),
        F.when(F.col("op") != "add", 3 * F.col("hunk_no") + _not_added_upto(kind, n))
        .cast("bigint").alias("old_line"))


@memo
def change_rows(spark, sf_dir) -> DataFrame:
    """``changes`` in the column layout of ``diff_changes``."""
    return changes(spark, sf_dir).select(
        "change_id", (F.col("file_id") % 20).alias("file_no"), "path", "hunk_no",
        F.col("n").alias("seq"), "op", F.col("line").alias("content"),
        F.col("new_line").alias("line_number"), F.col("old_line").alias("old_line_number"))


def _line_structs() -> Column:
    kind = F.col("kind")

    def one(raw, i):
        n = (i + 1).cast("bigint")
        return F.struct(n.alias("n"), _op(kind, n).alias("op"),
                        _planted(F.col("file_id"), n, raw).alias("line"))
    return F.transform(F.split("content", "\n"), one)


@memo
def diffs(spark, sf_dir) -> DataFrame:
    """(change_id, diff_text): one unified diff per change."""
    kind, path = F.col("kind"), F.col("path")
    base = files(spark, sf_dir).select(
        "file_id", "change_id", "path", "kind", _line_structs().alias("ls"))
    whole = kind.isin("new", "deleted")
    hunk_numbers = F.when(whole, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), F.floor((F.size("ls") - 1) / 12).cast("bigint")))

    def hunk(h):
        rows = F.when(whole, F.col("ls")).otherwise(
            F.slice(F.col("ls"), (h * 12 + 1).cast("int"), F.lit(12)))
        before = h * 12
        old_start = 1 + 3 * h + _not_added_upto(kind, before)
        new_start = 1 + 3 * h + _not_deleted_upto(kind, before)
        count = lambda op: F.size(F.filter(rows, lambda r: r.op != op)).cast("string")
        header = F.concat(
            F.lit("@@ -"), old_start.cast("string"), F.lit(","), count("add"),
            F.lit(" +"), new_start.cast("string"), F.lit(","), count("delete"), F.lit(" @@"))
        body = F.array_join(F.transform(rows, lambda r: F.concat(
            F.when(r.op == "add", "+").when(r.op == "delete", "-").otherwise(" "), r.line)), "\n")
        return F.concat(header, F.lit("\n"), body)

    head = F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path)
    extra = (
        F.when(kind == "new", F.concat(
            F.lit("\nnew file mode 100644\n--- /dev/null\n+++ b/"), path))
        .when(kind == "deleted", F.concat(
            F.lit("\ndeleted file mode 100644\n--- a/"), path, F.lit("\n+++ /dev/null")))
        .when(kind == "rename", F.concat(
            F.lit("\nrename from "), path, F.lit("\nrename to "), path, F.lit(".moved")))
        .when(kind == "binary", F.concat(
            F.lit("\nBinary files a/"), path, F.lit(" and b/"), path, F.lit(" differ")))
        .otherwise(F.concat(F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path)))
    hunks = F.when(kind.isin("rename", "binary"), F.lit("")).otherwise(F.concat(
        F.lit("\n"), F.array_join(F.transform(hunk_numbers, hunk), "\n")))
    blocks = base.select("change_id", "file_id", F.concat(head, extra, hunks).alias("block"))
    # 20 files per change by construction, so the list is short.
    return blocks.groupBy("change_id").agg(
        F.array_join(F.transform(
            F.array_sort(F.collect_list(F.struct("file_id", "block"))),
            lambda s: s.block), "\n").alias("diff_text"))


@memo
def head_texts(spark, sf_dir) -> DataFrame:
    """(change_id, path, content): file text after the change, with the three
    line gap between hunks filled by empty lines; deleted files are absent."""
    kept = files(spark, sf_dir).filter(
        ~F.col("kind").isin("binary", "rename", "deleted")
    ).select("change_id", "file_id", "path", "kind",
             F.filter(_line_structs(), lambda s: s.op != "delete").alias("ls"))

    def one(s):
        p = s.n - 1
        first = (F.col("kind") == "edit") & (s.n > 12) & (
            (p % 12 == 0) | ((p % 12 == 1) & (p % 5 == 0)))
        return F.concat(F.when(first, "\n\n\n").otherwise(""), s.line)
    return kept.select("change_id", "file_id", "path",
                       F.array_join(F.transform("ls", one), "\n").alias("content"))


@memo
def functions(spark, sf_dir) -> DataFrame:
    """Synthetic spans over the raw lines of each file."""
    base = files(spark, sf_dir).select(
        "change_id", "file_id", "path",
        F.explode(F.sequence(
            F.lit(0).cast("bigint"),
            (F.ceil(F.size(F.split("content", "\n")) / 10) - 1).cast("bigint"))).alias("i"))
    i = F.col("i")
    return base.select(
        "change_id", "path", i.alias("fn_no"),
        F.concat(F.lit("f"), i.cast("string")).alias("name"),
        (10 * i + 1).alias("start_line"), (10 * i + 6).alias("end_line"),
        F.lit("(a, b)").alias("parameters"),
        F.when(i % 3 == 0, "int").alias("return_type"),
        F.when(i % 4 == 0, F.concat(F.lit("Doc "), i.cast("string"))).alias("docstring"),
        (i % 2 == 1).alias("is_method"), (i % 5 == 0).alias("is_async"),
        F.when(i % 2 == 1, "K").alias("class_name"),
        F.when(i % 6 == 0, F.array(F.lit("cached"), F.lit("retry(2)")))
        .otherwise(F.array().cast("array<string>")).alias("decorators"))


@memo
def model_findings(spark, sf_dir) -> DataFrame:
    """One model finding per file, some outside the diff."""
    f = F.col("file_id")
    top = changes(spark, sf_dir).groupBy("change_id", "file_id", "path").agg(
        F.max("new_line").alias("top"))
    end = F.col("top") + f % 9
    return top.select(
        "change_id", f.alias("seq"), "path",
        F.greatest(end - f % 3, F.lit(1)).cast("bigint").alias("start_line"),
        end.cast("bigint").alias("end_line"),
        F.element_at(F.array(*map(F.lit, C.SEVERITIES)), (f % 4 + 1).cast("int"))
        .alias("severity"),
        F.element_at(F.array(*map(F.lit, C.CATEGORIES)), (f % 6 + 1).cast("int"))
        .alias("category"),
        F.lit("Because.").alias("reasoning"),
        F.concat(F.lit("See [docs] & <b>"), F.col("path"), F.lit("</b>: https://x.test/a_b) *now*"))
        .alias("explanation"),
        (f % 5 != 0).alias("can_generate_patch"),
        F.when(f % 5 != 0, F.concat(F.lit("fixed_"), f.cast("string"))).alias("replacement_code"))


@memo
def responses(spark, sf_dir) -> DataFrame:
    """Model answers as JSON text: some malformed, with a wrong enum value, without a required field,
    with a quoted line number or with a number for a text."""
    d = F.col("doc_id")
    issue = F.concat(
        F.lit('{"file_path":"src/f'), (d % 20).cast("string"), F.lit('.py","start_line":'),
        F.when(d % 7 == 1, F.concat(F.lit('" '), (d % 50 + 1).cast("string"), F.lit('"'))).otherwise(
            (d % 50 + 1).cast("string")), F.lit(',"end_line":'), (d % 50 + 3).cast("string"),
        F.when(d % 7 == 2, ".0").otherwise(""), F.lit(',"severity":"'), F.when(d % 11 == 1, "urgent").otherwise("major"),
        F.lit('","category":"bug","reasoning":"r","explanation":"e'), d.cast("string"),
        F.lit('","can_generate_patch":'), F.when(d % 2 == 0, "true").otherwise("false"),
        F.when(d % 3 == 0, F.concat(F.lit(',"replacement_code":"c'), d.cast("string"), F.lit('"')))
        .otherwise(""), F.lit("}"))
    count = (d % 4).cast("int")
    issues = F.array_join(F.array_repeat(issue, count), ",")
    good = F.concat(
        F.lit('{"summary":'), F.when(d % 13 == 3, d.cast("string")).otherwise(F.concat(
            F.lit('"'), F.substring(F.md5("text"), 1, 8), F.lit('"'))),
        F.when(d % 11 == 2, "").otherwise(',"risk_level":"medium"'),
        F.when(d % 4 == 0, "").otherwise(F.concat(F.lit(',"issues":['), issues, F.lit("]"))),
        F.lit("}"))
    return documents(spark, sf_dir).select(
        d.alias("change_id"),
        F.when(d % 11 == 0, F.col("text")).otherwise(good).alias("json"))


@memo
def contexts(spark, sf_dir) -> DataFrame:
    """(change_id, seq, path, context_text)."""
    return files(spark, sf_dir).select(
        "change_id", F.col("file_id").alias("seq"), "path", F.col("content").alias("context_text"))


@memo
def comments(spark, sf_dir) -> DataFrame:
    """Comments of many review runs: change = user, run = day."""
    base = spread(table(spark, sf_dir, "events"), "event_id").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("change_id"),
        F.dayofmonth("ts").cast("bigint").alias("revision"),
        F.concat(F.lit("f"), (F.col("event_id") % 20).cast("string"), F.lit(".py")).alias("path"),
        F.floor("value").cast("bigint").alias("line"), F.col("event_type").alias("category"))
    out = base.withColumn(
        "comment_id", ids.comment_id(F.col("path"), F.col("line"), F.col("line"),
                                     F.col("category")))
    body = (
        F.when(F.col("seq") % 13 == 0, F.lit("A remark by a person."))
        .when(F.col("seq") % 7 == 0, F.concat(
            F.lit(C.RESOLVED_BADGE), ids.marker(F.col("comment_id"), C.BOT_NAME), F.lit("\nText")))
        .otherwise(F.concat(ids.marker(F.col("comment_id"), C.BOT_NAME), F.lit("\nText"))))
    return out.withColumn("body", body)


@memo
def patches(spark, sf_dir) -> DataFrame:
    """One patch per file with all sorts of ranges; some files are missing."""
    f = F.col("file_id")
    return files(spark, sf_dir).select(
        "change_id", f.alias("seq"),
        F.when(f % 19 == 0, F.concat(F.col("path"), F.lit(".gone"))).otherwise(F.col("path"))
        .alias("path"),
        (f % 12).alias("start_line"), (f % 12 + f % 4 - 1).alias("end_line"),
        F.when(f % 5 != 0, F.concat(
            F.lit("new_"), f.cast("string"), F.when(f % 2 == 0, "\nmore").otherwise("\n")))
        .alias("replacement_code"))


@memo
def attempts(spark, sf_dir) -> DataFrame:
    """Results of trying each patch."""
    f = F.col("seq")
    return patches(spark, sf_dir).select(
        "change_id", "seq", (f % 7 != 0).alias("can_generate_patch"), "replacement_code",
        (f % 17 != 0).alias("sandbox_on"), (f % 3 == 0).alias("first_ok"),
        F.when(f % 8 == 0, "").otherwise(F.concat(F.lit("out "), f.cast("string")))
        .alias("first_stdout"),
        F.when(f % 4 == 0, "").otherwise(F.concat(F.lit("err "), F.col("path")))
        .alias("first_stderr"),
        F.when(f % 10 != 9, F.concat(F.lit("again_"), f.cast("string"))).alias("repair_code"),
        (f % 3 == 1).alias("repair_ok"))


@memo
def sources(spark, sf_dir) -> DataFrame:
    """Guidance Markdown: five documents per repository snapshot; one in sixteen snapshots has a
    branch for a commit, and one source in eighty a path outside the repository."""
    d = F.col("doc_id")

    def line(raw, i):
        n = i + 1
        return (F.when(n % 31 == 5, "```").when(n % 31 == 9, "```")
                .when(n % 31 == 7, "# not a heading")
                .when(n % 9 == 1, F.concat(F.lit("## "), raw)).otherwise(raw))
    scope = (F.when(d % 4 == 1, F.array(F.lit("src"))).when(d % 4 == 2, F.array(F.lit("src/auth")))
             .when(d % 4 == 3, F.array(F.lit("tests"), F.lit("deploy")))
             .otherwise(F.array().cast("array<string>")))
    return documents(spark, sf_dir).select(
        "doc_id", _repo(d).alias("repo_id"), F.when(F.floor(d / 5) % 16 == 9, "main").otherwise(
            F.sha1(_repo(d))).alias("revision"),
        F.concat(F.when(d % 80 == 41, "../g").otherwise("docs/g"), F.when(d % 50 == 3, d - 1).otherwise(d).cast("string"),
                 F.lit(".md")).alias("path"),
        F.array_join(F.transform(F.split("text", "\n"), line), "\n").alias("content"),
        scope.alias("applies_to"))


def _repo(d: Column) -> Column:
    return F.concat(F.lit("org/r"), F.floor(d / 5).cast("string"))


@memo
def decisions(spark, sf_dir) -> DataFrame:
    """Decision sources: a JSON array of five items each; one in eight arrays
    repeats an id."""
    i = F.col("item_id")
    group = F.floor(i / 5)
    item = F.struct(
        F.concat(F.lit("d"), F.when((group % 8 == 3) & (i % 5 == 4), i - 1).otherwise(i)
                 .cast("string")).alias("id"),
        F.substring("text", 1, 40).alias("title"), F.col("text").alias("decision"),
        F.when(i % 2 == 0, F.array(F.lit("src"), F.lit("api"), F.lit("src")))
        .otherwise(F.array().cast("array<string>")).alias("applies_to"))
    grouped = table(spark, sf_dir, "benchmark").select(
        group.alias("g"), F.struct(i.alias("o"), item.alias("item")).alias("s")
    ).groupBy("g").agg(F.array_sort(F.collect_list("s")).alias("items"))
    repo = F.concat(F.lit("org/r"), F.col("g").cast("string"))
    return grouped.select(
        repo.alias("repo_id"), F.sha1(repo).alias("revision"),
        F.concat(F.lit("docs/decisions"), F.col("g").cast("string"), F.lit(".json")).alias("path"),
        F.to_json(F.transform("items", lambda s: s.item)).alias("content"),
        F.array(F.lit("src"), F.lit("lib")).alias("applies_to"))


@memo
def guidance(spark, sf_dir) -> DataFrame:
    """Stored guidance vectors: 50 per repository, so within the item limit."""
    v = F.col("vec_id")
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        F.concat(F.lit("org/r"), F.floor(v / 50).cast("string")).alias("repo_id"),
        F.concat(F.lit("s"), F.lpad(v.cast("string"), 9, "0")).alias("source_id"),
        F.when(v % 5 == 4, "other-embedder").otherwise(C.EMBEDDER_NAME).alias("embedder"),
        F.when(F.col("label") % 3 == 1, F.array(F.lit("src")))
        .when(F.col("label") % 3 == 2, F.array(F.lit("src/auth"), F.lit("tests")))
        .otherwise(F.array().cast("array<string>")).alias("scopes"),
        F.col("embedding").alias("embedding"))


@memo
def guidance_vector_queries(spark, sf_dir) -> DataFrame:
    """Every vector also asks, one repository further on."""
    v = F.col("vec_id")
    return spread(table(spark, sf_dir, "embeddings"), "vec_id").select(
        v.alias("query_id"),
        F.concat(F.lit("org/r"), F.floor(v / 50 + 1).cast("string")).alias("repo_id"),
        F.when(v % 3 == 0, F.concat(F.lit("src/auth/q"), v.cast("string")))
        .when(v % 3 == 1, F.concat(F.lit("src/q"), v.cast("string")))
        .otherwise(F.concat(F.lit("srcx/q"), v.cast("string"))).alias("path"),
        F.lit(C.EMBEDDER_NAME).alias("embedder"), F.col("embedding").alias("embedding"))


@memo
def eval_cases(spark, sf_dir) -> DataFrame:
    """Labelled cases: ``quality`` = has an expected reference, ``toxic`` = is a
    violation."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "labels").select(
        d.alias("case_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("L"), (d % 7).cast("string")))
        .alias("expected_locator"),
        (F.col("toxic") == 1).alias("violation"))


@memo
def code(spark, sf_dir) -> DataFrame:
    """Source files of 33-line blocks, one block per ten lines of a document, all ten as comments:
    the even documents in Python, the others in JavaScript or TypeScript. Headers over several lines,
    brackets six deep, a brace on the next line and code in strings are part of every block."""
    d = F.col("doc_id")
    lines = F.split("text", "\n")

    def block(i):
        n = i.cast("string")

        def raws(mark):
            return F.concat_ws("\n", *[F.concat(F.lit(mark), F.coalesce(
                F.get("lines", (i * 10 + k).cast("int")), F.lit(""))) for k in range(10)])
        python = F.concat(
            F.lit("import mod"), n, F.lit("\n\n@cached\n@retry(2)\nasync def f"), n,
            F.lit("(a, b=(1, 2)) -> int:\n    \"\"\"Doc "), n, F.lit(".\"\"\"\n"), raws("    # "),
            F.lit("\n    return a\n\nclass C"), n, F.lit("(Base, pkg.Mixin):\n    '''Class "), n,
            F.lit("'''\n    def m"), n, F.lit("(self):\n        return 1\n    class Inner"), n,
            F.lit(":\n        def deep(self): pass\ndef w"), n,
            F.lit("(\n    a=((((((1)))))),\n) -> int:\n    text = \"\"\"\ndef not_me():\n    pass\n"
                  "\"\"\"\n    return a\n"))
        script = F.concat(
            F.lit("import { a"), n, F.lit(" } from 'm"), n, F.lit("';\n/**\n * Adds "), n,
            F.lit(".\n */\nfunction g"), n, F.lit("(a, b) {\n  if (a) { return b; }\n  return a;\n}"
                                                "\nconst h"), n,
            F.lit(" = async x => x + 1;\nexport class K"), n,
            F.lit(" extends Base {\n  /** Runs. */\n  run(x) {\n    return x;\n  }\n}\n"), raws("// "),
            F.lit("\nfunction t"), n, F.lit("(\n  a = ((((((1)))))),\n) {\n  return `function no() {`;"
                                           "\n}\nclass Z"), n, F.lit("\n{\n  go() { return 1; } }"))
        return F.when(d % 2 == 0, python).otherwise(script)
    blocks = F.transform(F.sequence(
        F.lit(0).cast("bigint"), (F.ceil(F.size("lines") / 10) - 1).cast("bigint")), block)
    return documents(spark, sf_dir).withColumn("lines", lines).select(
        F.floor(d / 20).cast("bigint").alias("change_id"),
        F.concat(F.lit("src/c"), d.cast("string"), F.when(d % 2 == 0, ".py").when(
            d % 4 == 1, ".js").otherwise(".ts")).alias("path"),
        F.array_join(blocks, "\n").alias("content"))
