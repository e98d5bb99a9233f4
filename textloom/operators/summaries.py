"""Summaries of tool outputs by line state machines: a row (doc_id, summary) for each output.

Lines are classed by built-in expressions, walked by machines.walk(), and what a summary shows is cut by rank within its
block before it is gathered, so a row holds at most the lines that are shown. An output without lines has no row.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators.machines import CHUNK, Machine, walk

#: How many entries a summary shows, and the rule under its head line.
ERRORS, WARNINGS, LIST, RULER = 20, 10, 20, "═" * 39

_text = lambda c: c.cast("string")


def _ranked(rows: DataFrame, by: list[str], order: list, most: int, name: str = "k") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= most)


def _gather(rows: DataFrame, by: list[str], key: str, value: str, name: str) -> DataFrame:
    """by and the array name of value in the order of key."""
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]).alias(name))


def _with(base: DataFrame, *parts: DataFrame) -> DataFrame:
    for part in parts:
        base = base.join(part.withColumnRenamed("doc_id", "_doc"), F.col("doc_id").eqNullSafe(F.col("_doc")), "left").drop("_doc")
    return base


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def blocks(walked: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, block, lines, n): the first most lines of each block, and how many it has."""
    rows = walked.filter(F.col("tag").isin("open", "in"))
    counts = rows.groupBy("doc_id", "block").agg(F.count(F.lit(1)).alias("n"))
    shown = _ranked(rows, ["doc_id", "block"], ["line_no"], most) if most else rows
    lines = _gather(shown, ["doc_id", "block"], "line_no", "line", "lines").select(F.col("doc_id").alias("_doc"), F.col("block").alias("_block"), "lines")
    return counts.join(lines, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("block") == F.col("_block"))).select("doc_id", "block", "lines", "n")


def _starts(c: Column, *prefixes: str) -> Column:
    out = c.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | c.startswith(p)
    return out


# pytest: a state is the section (header, progress, failures, summary), whether a failure is open, and whether totals were seen


def _pytest_move(state: str, kind: str) -> tuple[str, str]:
    mode, opened, seen = state
    if kind in ("session", "failures"):
        return f"{'H' if kind == 'session' else 'F'}{opened}{seen}", ""
    if kind == "summary":
        return f"S0{seen}", ""
    if kind == "totals" or kind.startswith("quiet") and seen == "0":
        return f"{mode}{opened}1", "total"
    kind = kind.removeprefix("quiet ")
    if mode == "H" and kind == "collected":
        return f"P{opened}{seen}", ""
    if mode == "F" and kind != "blank":
        return f"F1{seen}", "open" if kind == "rule" or opened == "0" else "in"
    if mode == "S" and kind == "failed":
        return state, "open"
    return state, "xfail" if mode == "S" and kind == "xfail" else ""


_PLAIN = ("collected", "rule", "failed", "xfail", "blank", "text")
PYTEST = Machine.of(tuple(map("".join, product("HPFS", "01", "01"))), ("session", "failures", "summary", "totals", *(f"quiet {k}" for k in _PLAIN), *_PLAIN), _pytest_move)


def pytest_kind(line: Column) -> Column:
    t = X.trim(line)
    ruled = t.startswith("===")
    total = t.contains(" passed") | t.contains(" failed") | t.contains(" skipped")
    plain = F.when(t.startswith("collected"), "collected").when(t.startswith("___"), "rule").when(_starts(t, "FAILED", "ERROR"), "failed").when(_starts(t, "XFAIL", "XPASS"), "xfail").when((t == "") | ruled, "blank").otherwise("text")
    head = F.when(ruled & t.contains("test session starts"), "session").when(ruled & t.contains("FAILURES"), "failures").when(ruled & t.contains("short test summary"), "summary")
    head = head.when(ruled & (t.contains("passed") | t.contains("failed") | t.contains("skipped")), "totals")
    return head.when(~ruled & ~_starts(t, "FAILED", "ERROR") & total & t.contains(" in "), F.concat(F.lit("quiet "), plain)).otherwise(plain)


def _pytest_count(totals: Column, name: str) -> Column:
    """The last number before a word that holds name and, for passed and failed, no x before it."""
    word = rf"(?<![^\s,])(\d+)\s+[^\s,]*{'(?<!x)' if name in ('passed', 'failed') else ''}{name}"
    return F.coalesce(F.try_element_at(F.regexp_extract_all(totals, F.lit(word), 1), F.lit(-1)).cast("long"), F.lit(0))


def pytest_summary(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Counts, expected failures and the first failures with up to three lines of each."""
    walked = walk(lines.withColumn("line", X.trim(F.col("line"))), PYTEST, pytest_kind(F.col("line")), chunk)
    totals = walked.groupBy("doc_id").agg(F.coalesce(F.max_by("line", F.when(F.col("tag") == "total", F.col("line_no"))), F.lit("")).alias("totals"), F.max("block").alias("n"), F.count(F.when(F.col("tag") == "xfail", 1)).alias("n_xfail"))
    xfails = _ranked(walked.filter("tag = 'xfail'"), ["doc_id"], ["line_no"], WARNINGS).withColumn("line", X.truncate(F.col("line"), 120))
    xfails = _gather(xfails, ["doc_id"], "line_no", "line", "xfails")
    member = walked.filter(F.col("tag").isin("open", "in") & (F.col("block") <= WARNINGS))
    low = F.lower("line")
    told = _starts(F.col("line"), ">", "E") | low.contains("assert") | low.contains("error") | F.col("line").contains(".py:")
    detail = _ranked(member.filter((F.col("tag") == "in") & told), ["doc_id", "block"], ["line_no"], 3).withColumn("line", X.truncate(F.col("line"), 100))
    shown = member.filter("tag = 'open'").select("doc_id", "line_no", "line", "block").unionByName(detail.select("doc_id", "line_no", "line", "block"))
    shown = _gather(shown, ["doc_id", "block"], "line_no", "line", "shown")
    head, rest, number = F.get("shown", F.lit(0)), F.slice("shown", 2, 3), _text(F.col("block"))
    named = F.concat(number, F.lit(". [FAIL] "), X.trim(F.regexp_replace(head, "^_+|_+$", "")), F.lit("\n"))
    parts = F.split(head, " - ")
    failed = F.concat(number, F.lit(". [FAIL] "), F.regexp_replace(parts[0], "^(FAILED )+", ""), F.lit("\n"), F.when(F.size(parts) > 1, F.concat(F.lit("     "), X.truncate(F.get(parts, F.lit(1)), 100), F.lit("\n"))).otherwise(""))
    detail = F.array_join(F.transform(rest, lambda x: F.concat(F.lit("     "), x, F.lit("\n"))), "")
    entry = F.when(head.startswith("FAILED"), F.struct(failed.alias("text"), F.lit("").alias("gap"))).otherwise(F.struct(F.concat(F.when(head.startswith("___"), named).otherwise(""), detail).alias("text"), F.lit("\n").alias("gap")))
    entries = shown.withColumn("entry", entry).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "entry"))).alias("entries"))
    found = _with(totals, xfails, entries)
    count = {k: _pytest_count(F.col("totals"), k) for k in ("passed", "failed", "skipped", "xfailed", "xpassed")}
    none = (count["passed"] + count["failed"] + count["skipped"] + count["xfailed"] + count["xpassed"]) == 0
    extras = (count["skipped"] + count["xfailed"] + count["xpassed"] + F.col("n_xfail")) > 0
    more = [F.when(count[k] > 0, F.concat(F.lit(", "), _text(count[k]), F.lit(f" {k}"))).otherwise("") for k in ("skipped", "xfailed", "xpassed")]
    first = F.concat(F.lit("Pytest: "), _text(count["passed"]), F.lit(" passed, "), _text(count["failed"]), F.lit(" failed"), *more, F.lit(f"\n{RULER}\n"))
    over = F.col("n_xfail") - WARNINGS
    expected = F.concat(F.lit("\nExpected-failure outcomes:\n"), F.array_join(F.transform(_or_empty("xfails"), lambda x: F.concat(F.lit("  "), x, F.lit("\n"))), ""), F.when(over > 0, F.concat(F.lit("  … +"), _text(over), F.lit(" more\n"))).otherwise(""))
    listed = F.array_join(F.transform("entries", lambda x: F.concat(x["entry"]["text"], F.when(x["block"] < F.col("n"), x["entry"]["gap"]).otherwise(""))), "")
    over = F.col("n") - WARNINGS
    failures = F.concat(F.lit("\nFailures:\n"), listed, F.when(over > 0, F.concat(F.lit("\n… +"), _text(over), F.lit(" more failures\n"))).otherwise(""))
    whole = F.concat(first, F.when(F.col("n_xfail") > 0, expected).otherwise(""), F.when(F.col("n") > 0, failures).otherwise(""))
    passed = F.concat(F.lit("Pytest: "), _text(count["passed"]), F.lit(" passed"))
    return found.select("doc_id", F.when(none, "Pytest: No tests collected").when((count["failed"] == 0) & (count["passed"] > 0) & ~extras, passed).otherwise(X.trim(whole)).alias("summary"))


# cargo test: outside or inside the failures, with or without an open failure


def _cargo_test_move(state: str, kind: str) -> tuple[str, str]:
    inside, opened = state
    if kind == "failures":
        return f"1{opened}", ""
    if kind == "result":
        return f"0{opened}", "twice" if inside == "1" else "once"
    if inside == "1" and kind in ("indent", "text"):
        return "11", "in" if opened == "1" else "open"
    if inside == "1" and kind == "blank":
        return "10", ""
    return state, ""


CARGO_TEST = Machine.of(("00", "01", "10", "11"), ("skip", "failures", "result", "indent", "blank", "text"), _cargo_test_move)
_RESULT = r"test result: (\w+)\.\s+(\d+) passed;\s+(\d+) failed;\s+(\d+) ignored;\s+(\d+) measured;\s+(\d+) filtered out(?:;\s+finished in ([\d.]+)s)?"


def cargo_test_kind(line: Column) -> Column:
    t = F.regexp_replace(line, r"^\s+", "")
    skip = _starts(t, "Compiling", "Downloading", "Downloaded", "Finished") | line.startswith("running ") | (line.startswith("test ") & line.endswith("... ok"))
    return F.when(skip, "skip").when(line == "failures:", "failures").when(line.startswith("test result:"), "result").when(_starts(line, "    ", "---- "), "indent").when(X.trim(line) == "", "blank").otherwise("text")


def cargo_test_summary(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Suites added up where all passed, else failures and result lines, else build errors or the last lines."""
    walked = walk(lines, CARGO_TEST, cargo_test_kind(F.col("line")), chunk)
    got = lambda i: F.regexp_extract("line", _RESULT, i)
    result = F.col("tag").isin("once", "twice")
    ok = got(1) == "ok"
    number = lambda i: F.sum(F.when(result & ok, got(i).try_cast("long"))).alias(("passed", "ignored", "filtered")[(2, 4, 6).index(i)])
    totals = walked.groupBy("doc_id").agg(
        F.max("block").alias("n"), F.count(F.when(result, 1)).alias("results"), F.count(F.when(result & ok, 1)).alias("suites"), number(2), number(4), number(6),
        F.count(F.when(result & ok & (got(7) != ""), 1)).alias("timed"), F.sum(F.when(result & ok, F.coalesce(got(7).try_cast("decimal(18,4)"), F.lit(0)))).alias("seconds"),
        F.max(F.when(_starts(F.regexp_replace("line", r"^\s+", ""), "error[", "error:"), 1).otherwise(0)).alias("broken"))
    said = walked.filter(result).withColumn("line", F.when(F.col("tag") == "twice", F.concat("line", F.lit("\n"), "line", F.lit("\n"))).otherwise(F.concat("line", F.lit("\n"))))
    said = _gather(said, ["doc_id"], "line_no", "line", "said")
    shown = blocks(walked.filter(F.col("block") <= WARNINGS), 202)
    shown = shown.withColumn("entry", F.concat(_text(F.col("block")), F.lit(". "), X.truncate(F.array_join("lines", "\n"), 200), F.lit("\n")))
    shown = _gather(shown, ["doc_id"], "block", "entry", "failures")
    useful = lines.filter((X.trim(F.col("line")) != "") & ~F.regexp_replace("line", r"^\s+", "").startswith("Compiling"))
    last = _gather(_ranked(useful, ["doc_id"], [F.desc("line_no")], 5), ["doc_id"], "line_no", "line", "last")
    build = cargo_build_summary(lines, chunk).withColumnRenamed("summary", "build")
    found = _with(totals, said, shown, last, build)
    suite = F.when(F.col("suites") == 1, "1 suite").otherwise(F.concat(_text(F.col("suites")), F.lit(" suites")))
    extra = lambda name, label: F.when(F.col(name) > 0, F.concat(F.lit(", "), _text(F.col(name)), F.lit(f" {label}"))).otherwise("")
    timed = F.when(F.col("timed") == F.col("suites"), F.concat(F.lit(", "), _text(F.col("seconds").cast("decimal(18,2)")), F.lit("s"))).otherwise("")
    compact = F.concat(F.lit("cargo test: "), _text(F.col("passed")), F.lit(" passed"), extra("ignored", "ignored"), extra("filtered", "filtered out"), F.lit(" ("), suite, timed, F.lit(")"))
    over = F.col("n") - WARNINGS
    failures = F.concat(F.lit("FAILURES ("), _text(F.col("n")), F.lit(f"):\n{RULER}\n"), F.array_join(_or_empty("failures"), ""), F.when(over > 0, F.concat(F.lit("\n… +"), _text(over), F.lit(" more failures\n"))).otherwise(""), F.lit("\n"))
    whole = X.trim(F.concat(F.when(F.col("n") > 0, failures).otherwise(""), F.array_join(_or_empty("said"), "")))
    rest = F.when((F.col("broken") == 1) & F.col("build").startswith("cargo build:"), F.concat(F.lit("cargo test:"), F.substr("build", F.lit(13)))).otherwise(X.trim(F.array_join(_or_empty("last"), "\n")))
    return found.select("doc_id", F.when((F.col("n") == 0) & (F.col("results") > 0) & (F.col("results") == F.col("suites")), compact).when(whole != "", whole).otherwise(rest).alias("summary"))


# cargo build: outside a block, or in one of 1, 2, 3 or more lines; a blank line ends a block of more than three


def _cargo_build_move(state: str, kind: str) -> tuple[str, str]:
    if kind in ("error", "warning"):
        return "1", "open"
    if state == "0" or kind in ("compiled", "finished", "skip"):
        return state, kind if kind in ("compiled", "finished") else ""
    if kind == "blank" and state == "4":
        return "0", ""
    return str(min(int(state) + 1, 4)), "in"


CARGO_BUILD = Machine.of(("0", "1", "2", "3", "4"), ("compiled", "finished", "skip", "error", "warning", "blank", "text"), _cargo_build_move)


def cargo_build_kind(line: Column) -> Column:
    t = F.regexp_replace(line, r"^\s+", "")
    error = _starts(line, "error:", "error[")
    kind = F.when(_starts(t, "Compiling", "Checking"), "compiled").when(_starts(t, "Downloading", "Downloaded"), "skip").when(t.startswith("Finished"), "finished")
    kind = kind.when(line.startswith("warning:") & line.contains("generated"), "skip").when(error & (line.contains("aborting due to") | line.contains("could not compile")), "skip")
    return kind.when(error, "error").when(_starts(line, "warning:", "warning["), "warning").when(X.trim(line) == "", "blank").otherwise("text")


def cargo_build_summary(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Errors and warnings with their lines, the first ones whole, or what was compiled."""
    walked = walk(lines, CARGO_BUILD, cargo_build_kind(F.col("line")), chunk)
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    totals = walked.groupBy("doc_id").agg(count("error").alias("errors"), count("warning").alias("warnings"), count("compiled").alias("compiled"), F.max_by("line", F.when(F.col("kind") == "finished", F.col("line_no"))).alias("finished"), F.max("block").alias("n"))
    shown = blocks(walked.filter(F.col("block") <= ERRORS)).withColumn("entry", F.concat(F.array_join("lines", "\n"), F.lit("\n")))
    found = _with(totals, shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "entry"))).alias("entries")))
    listed = F.array_join(F.transform("entries", lambda x: F.concat(x["entry"], F.when(x["block"] < F.col("n"), "\n").otherwise(""))), "")
    over = F.col("n") - ERRORS
    head = F.concat(F.lit("cargo build: "), _text(F.col("errors")), F.lit(" errors, "), _text(F.col("warnings")), F.lit(" warnings ("), _text(F.col("compiled")), F.lit(f" crates)\n{RULER}\n"))
    whole = X.trim(F.concat(head, listed, F.when(over > 0, F.concat(F.lit("\n… +"), _text(over), F.lit(" more issues\n"))).otherwise("")))
    clean = F.concat(F.lit("cargo build ("), _text(F.col("compiled")), F.lit(" crates compiled)"), F.coalesce(F.concat(F.lit("\n"), F.regexp_replace("finished", r"^\s+", "")), F.lit("")))
    return found.select("doc_id", F.when(F.col("errors") + F.col("warnings") == 0, clean).otherwise(whole).alias("summary"))


# tsc: outside an error, or in one whose context goes on as long as lines are indented


def _tsc_move(state: str, kind: str) -> tuple[str, str]:
    if kind == "error":
        return "in", "open"
    return ("in", "in") if state == "in" and kind == "indent" else ("out", "")


TSC = Machine.of(("out", "in"), ("error", "indent", "text"), _tsc_move)
_TSC = r"^(.+?)\((\d+),(\d+)\):\s+(error|warning)\s+(TS\d+):\s+(.+)$"


def tsc_kind(line: Column) -> Column:
    return F.when(line.rlike(_TSC), "error").when(_starts(line, "  ", "\t"), "indent").otherwise("text")


def tsc_summary(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """All errors by file, files with most errors first (ties by name), the commonest codes on top (ties by code)."""
    walked = walk(lines, TSC, tsc_kind(F.col("line")), chunk)
    got = lambda i: F.regexp_extract("line", _TSC, i)
    base = walked.groupBy("doc_id").agg(F.max("block").alias("errors"), F.max(F.col("line").contains("Found 0 errors").cast("int")).alias("none"))
    errors = walked.filter("tag = 'open'").select("doc_id", "block", got(1).alias("file"), got(5).alias("code"), F.concat(F.lit("  L"), _text(F.coalesce(got(2).try_cast("long"), F.lit(0))), F.lit(": "), got(5), F.lit(" "), X.truncate(got(6), 120), F.lit("\n")).alias("entry"))
    context = walked.filter("tag = 'in'").withColumn("line", F.concat(F.lit("    "), X.truncate(X.trim(F.col("line")), 120), F.lit("\n")))
    context = _gather(context, ["doc_id", "block"], "line_no", "line", "context").withColumnRenamed("doc_id", "_doc").withColumnRenamed("block", "_block")
    full = errors.join(context, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("block") == F.col("_block")), "left").withColumn("entry", F.concat("entry", F.array_join(_or_empty("context"), "")))
    files = full.groupBy("doc_id", "file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "entry"))), lambda x: x["entry"]), "").alias("entries"))
    files = files.withColumn("text", F.concat("file", F.lit(" ("), _text(F.col("n")), F.lit(" errors)\n"), "entries", F.lit("\n"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "file", "text"))), lambda x: x["text"]), "").alias("listed"))
    codes = errors.groupBy("doc_id", "code").agg(F.count(F.lit(1)).alias("n"))
    codes = codes.withColumn("all", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    codes = _ranked(codes, ["doc_id"], [F.desc("n"), "code"], 5).withColumn("text", F.concat("code", F.lit(" ("), _text(F.col("n")), F.lit("x)")))
    codes = codes.groupBy("doc_id").agg(F.max("all").alias("codes"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), ", ").alias("top"))
    found = _with(base, files, codes)
    top = F.when(F.col("codes") > 1, F.concat(F.lit("Top codes: "), "top", F.lit("\n\n"))).otherwise("")
    whole = F.concat(F.lit("TypeScript: "), _text(F.col("errors")), F.lit(" errors in "), _text(F.col("files")), F.lit(f" files\n{RULER}\n"), top, "listed")
    return found.select("doc_id", F.when(F.col("errors") > 0, X.trim(whole)).when(F.col("none") == 1, "TypeScript: No errors found").otherwise("TypeScript compilation completed").alias("summary"))


# git log: commits end at a marker, their first line that is not blank is the header, further ones the body


def _log_move(state: str, kind: str) -> tuple[str, str]:
    if kind == "end":
        return "between", "end"
    if kind == "blank":
        return state, ""
    if state == "between":
        return "body", "open"
    return state, "in" if kind == "text" else ""


GIT_LOG = Machine.of(("between", "body"), ("end", "blank", "trailer", "text"), _log_move)


def git_log_kind(line: Column) -> Column:
    t = X.trim(line)
    return F.when(t == "---END---", "end").when(t == "", "blank").when(_starts(t, "Signed-off-by:", "Co-authored-by:"), "trailer").otherwise("text")


def git_log_summary(lines: DataFrame, limit: int = 10, width: int = 80, chunk: int = CHUNK) -> DataFrame:
    """The first commits, each with its header and three lines of its body; every commit ends with a line ---END---."""
    walked = walk(lines.withColumn("line", X.trim(F.col("line"))), GIT_LOG, git_log_kind(F.col("line")), chunk)
    before = F.count(F.when(F.col("tag") == "end", 1)).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    ends = walked.filter("tag = 'end'").select("doc_id", "line_no", before.alias("ends")).filter(F.col("ends") == limit).select(F.col("doc_id").alias("_doc"), F.col("line_no").alias("_last"))
    seen = walked.join(ends, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").filter(F.col("_last").isNull() | (F.col("line_no") < F.col("_last")))
    shown = blocks(seen, 4)
    cut = F.transform("lines", lambda x: X.truncate(x, width))
    more = F.col("n") - 4
    entry = F.concat(F.array_join(cut, "\n  "), F.when(more > 0, F.concat(F.lit("\n  [+"), _text(more), F.lit(" lines omitted]"))).otherwise(""))
    listed = _gather(shown.withColumn("entry", entry), ["doc_id"], "block", "entry", "entries")
    return _with(lines.select("doc_id").distinct(), listed).select("doc_id", X.trim(F.array_join(_or_empty("entries"), "\n")).alias("summary"))


# git diff: before a file, in its head, in a hunk without or with a changed line


def _diff_move(state: str, kind: str) -> tuple[str, str]:
    if kind == "file":
        return "head", "file"
    if kind == "hunk":
        return "hunk", "open"
    if state in ("none", "head") or kind == "note":
        return state, ""
    if kind in ("added", "removed"):
        return "changed", kind
    return state, "context" if state == "changed" else ""


GIT_DIFF = Machine.of(("none", "head", "hunk", "changed"), ("file", "hunk", "added", "removed", "note", "context"), _diff_move)


def git_diff_kind(line: Column) -> Column:
    kind = F.when(line.startswith("diff --git"), "file").when(line.startswith("@@"), "hunk").when(line.startswith("+") & ~line.startswith("+++"), "added")
    return kind.when(line.startswith("-") & ~line.startswith("---"), "removed").when(line.startswith("\\"), "note").otherwise("context")


def git_diff_summary(lines: DataFrame, most: int = 500, hunk: int = 100, chunk: int = CHUNK) -> DataFrame:
    """File names, hunks and their changed lines with the context after the first of them; counts by file; at most most entries."""
    walked = walk(lines, GIT_DIFF, git_diff_kind(F.col("line")), chunk)
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    by_hunk, by_file = Window.partitionBy("doc_id", "file", "block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("doc_id", "file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    changed = F.col("tag").isin("added", "removed")
    rows = walked.withColumn("file", F.count(F.when(F.col("tag") == "file", 1)).over(upto))
    rows = rows.withColumn("at", F.count(F.when(changed | (F.col("tag") == "context"), 1)).over(by_hunk))
    rows = rows.withColumns({"added": F.count(F.when(F.col("tag") == "added", 1)).over(by_file), "removed": F.count(F.when(F.col("tag") == "removed", 1)).over(by_file), "skipped": F.count(F.when(changed & (F.col("at") > hunk), 1)).over(by_hunk)})
    last = lambda name: F.coalesce(F.lag(name).over(order), F.lit(0))
    rows = rows.withColumns({"was_skipped": last("skipped"), "was_added": last("added"), "was_removed": last("removed")})
    none = F.array().cast("array<string>")
    cut = lambda n: F.when(n > 0, F.array(F.concat(F.lit("  ... ("), _text(n), F.lit(" lines truncated)")))).otherwise(none)
    sums = lambda a, r: F.when(a + r > 0, F.array(F.concat(F.lit("  +"), _text(a), F.lit(" -"), _text(r)))).otherwise(none)
    in_file = lambda at: F.col("file") > at
    name = F.coalesce(F.get(F.split("line", " b/"), F.lit(1)), F.lit("unknown"))
    own = F.array(F.concat(F.lit("  "), "line"))
    out = F.when(F.col("tag") == "file", F.concat(cut(F.col("was_skipped")), F.when(in_file(1), sums(F.col("was_added"), F.col("was_removed"))).otherwise(none), F.array(F.concat(F.lit("\n"), name))))
    out = out.when(F.col("tag") == "open", F.concat(cut(F.col("was_skipped")), own)).when((changed | (F.col("tag") == "context")) & (F.col("at") <= hunk), own).otherwise(none)
    rows = rows.withColumn("out", out).withColumn("shown", F.sum(F.size("out")).over(upto))
    stop = rows.filter(F.col("shown") >= most).groupBy("doc_id").agg(F.min("line_no").alias("stop"))
    rows = _with(rows, stop).filter(F.col("stop").isNull() | (F.col("line_no") <= F.col("stop")))
    ends = rows.groupBy("doc_id").agg(F.max_by(F.struct("skipped", "file", "added", "removed", "stop"), "line_no").alias("end"), F.max(F.when(F.col("tag").isin("file", "open"), F.col("was_skipped")).otherwise(0)).alias("cut"))
    listed = rows.filter(F.size("out") > 0).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "out"))), lambda x: x["out"])).alias("entries"))
    found = _with(ends, listed)
    stopped = F.col("end.stop").isNotNull()
    tail = F.concat(F.when(stopped, F.array(F.lit("\n... (more changes truncated)"))).otherwise(none), cut(F.col("end.skipped")), F.when(F.col("end.file") > 0, sums(F.col("end.added"), F.col("end.removed"))).otherwise(none))
    tail = F.concat(tail, F.when(stopped | (F.col("end.skipped") > 0) | (F.col("cut") > 0), F.array(F.lit("[full diff: git diff]"))).otherwise(none))
    return found.select("doc_id", F.array_join(F.concat(_or_empty("entries"), tail), "\n").alias("summary"))
