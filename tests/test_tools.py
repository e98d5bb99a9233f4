"""Every tool specification on a line or two of its form."""

import pytest
from pyspark.sql import functions as F

from textloom.operators import dsl, tools
from textloom.sources.tables import to_lines

SAMPLES = {
    "tsc": ("src/a.ts:3:5 - error TS2322: bad type", ("src/a.ts", 3, "error", "TS2322", "bad type")),
    "mypy": ("a.py:3: error: bad type  [arg-type]", ("a.py", 3, "error", "arg-type", "bad type")),
    "ruff": ("a.py:3:1: F401 [*] unused import", ("a.py", 3, "", "F401", "unused import")),
    "pylint": ("a.py:3:0: C0114: no docstring (missing-module-docstring)", ("a.py", 3, "c", "missing-module-docstring", "no docstring")),
    "eslint": ("a.js:3:1: no var. [Error/no-var]", ("a.js", 3, "error", "no-var", "no var.")),
    "rubocop": ("a.rb:3:1: C: [Correctable] Style/Quotes: use single", ("a.rb", 3, "c", "Style/Quotes", "use single")),
    "golangci": ("a.go:3:1: not checked (errcheck)", ("a.go", 3, "", "errcheck", "not checked")),
    "go": ("./a.go:3:1: undefined: x", ("./a.go", 3, "", "", "undefined: x")),
    "gcc": ("a.c:3:1: warning: unused [-Wunused]", ("a.c", 3, "warning", "-Wunused", "unused")),
    "dotnet": ("a.cs(3,1): error CS1002: ; expected [p.csproj]", ("a.cs", 3, "error", "CS1002", "; expected")),
    "phpstan": ("a.php:3:Undefined variable", ("a.php", 3, "", "", "Undefined variable")),
    "maven": ("[ERROR] /s/A.java:[3,1] cannot find symbol", ("/s/A.java", 3, "error", "", "cannot find symbol")),
    "sbt": ("[error] /s/A.scala:3:1: not found", ("/s/A.scala", 3, "error", "", "not found")),
    "kotlin": ("e: file:///s/A.kt:3:1 unresolved", ("/s/A.kt", 3, "e", "", "unresolved")),
    "shellcheck": ("a.sh:3:1: warning: quote this [SC2086]", ("a.sh", 3, "warning", "SC2086", "quote this")),
    "yamllint": ("a.yml:3:1: [error] too many spaces (colons)", ("a.yml", 3, "error", "colons", "too many spaces")),
    "hadolint": ("Dockerfile:3 DL3008 warning: pin versions", ("Dockerfile", 3, "warning", "DL3008", "pin versions")),
    "markdownlint": ("a.md:3:1 MD013/line-length Line length", ("a.md", 3, "", "MD013", "Line length")),
    "php_lint": ("PHP Parse error: unexpected x in a.php on line 3", ("a.php", 3, "parse error", "", "unexpected x")),
    "basedpyright": ("  a.py:3:1 - error: no attribute (reportX)", ("a.py", 3, "error", "reportX", "no attribute")),
    "xcodebuild": ("A.swift:3:1: error: no member", ("A.swift", 3, "error", "", "no member")),
    "grep": ("a.txt:3:found", ("a.txt", 3, "", "", "found")),
}


def as_lines(spark, text):
    return to_lines(spark.createDataFrame([(0, text)], "doc_id long, text string"))


@pytest.mark.parametrize("tool", sorted(tools.DIAGNOSTICS))
def test_diagnostics(spark, tool):
    line, want = SAMPLES[tool]
    got = tools.diagnostics(as_lines(spark, "noise\n" + line), tool).collect()
    assert [(r.file, r.number, r.severity, r.code, r.message) for r in got] == [want]


COUNTED = {
    "cargo_test": ("test result: FAILED. 3 passed; 1 failed; 2 ignored;", (3, 1, 2)),
    "pytest": ("== 3 passed, 1 failed, 1 error in 1s ==", (3, 1, 0, 0, 0, 1)),
    "rspec": ("5 examples, 1 failure, 2 pending", (5, 1, 2)),
    "phpunit": ("OK (7 tests, 9 assertions)", (7, 0, 0, 0, 0)),
    "maven": ("Tests run: 4, Failures: 1, Errors: 0, Skipped: 2", (4, 1, 0, 2)),
    "git_diff": (" 2 files changed, 5 insertions(+), 1 deletion(-)", (2, 5, 1)),
    "rsync": ("sent 1,234 bytes  received 56 bytes", (1234, 56)),
}


@pytest.mark.parametrize("tool", sorted(tools.COUNTERS))
def test_counters(spark, tool):
    line, want = COUNTED.get(tool, ("nothing here", (0,) * len(tools.COUNTERS[tool])))
    row = tools.counters(as_lines(spark, line), tool).first()
    assert tuple(row[c] for c in tools.COUNTERS[tool]) == want


def test_all_filters_compile(spark):
    rows = spark.createDataFrame([("\x1b[1mtext\x1b[0m\n\nmore",), ("",), (None,)], "text string")
    for name, spec in tools.FILTERS.items():
        got = [r[0] for r in rows.select(dsl.apply(spec, F.col("text"))).collect()]
        assert got[0] == "text\nmore" and got[1] == got[2] == (spec.on_empty or ""), name


def test_records_and_columns(spark):
    docs = spark.createDataFrame([(1, '{"items": [{"metadata": {"namespace": "n", "name": "a"}, "status": {"phase": "Running"}}]}'), (2, "no json"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.shown) for r in tools.records(docs, "pods").collect()] == [(1, "n a Running")]
    assert [r.shown for r in tools.columns(as_lines(spark, "NAME   READY   STATUS   X\na   1/1   Up   3"), "kubectl").collect()] == ["a 1/1 Up 3"]


def test_sections(spark):
    got = tools.sections(as_lines(spark, "x\nerror[E1]: bad\n  --> a.rs\nwarning: w\n   more\nend"), "rust_errors").orderBy("first_line").collect()
    assert [r.block for r in got] == ["error[E1]: bad\n  --> a.rs", "warning: w\n   more"]
    tracebacks = tools.sections(as_lines(spark, "a\nTraceback (most recent call last):\n  File x\nValueError: y\nb"), "python_tracebacks").collect()
    assert [r.block for r in tracebacks] == ["Traceback (most recent call last):\n  File x\nValueError: y"]
