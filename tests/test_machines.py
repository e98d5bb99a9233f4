"""Line state machines against a plain walk, summaries on outputs in the tools' own forms, and block handlers on a stream."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import handlers, summaries
from textloom.operators.machines import Machine, walk
from textloom.sources.tables import to_lines
from textloom.streaming.blocks import block_stream

LINES = "doc_id long, line_no long, line string"


def plain_walk(machine, rows):
    state, out = {}, {}
    for doc, number, kind in rows:
        now, block = state.get(doc, (machine.states[0], 0))
        now, tag = machine.moves[kind][now]
        block += tag == "open"
        state[doc] = now, block
        out[doc, number] = now, tag, block
    return out


@pytest.mark.parametrize("chunk", [3, 128])
def test_walk(spark, chunk):
    rng = random.Random(chunk)
    states, kinds = tuple("abcd"), tuple("wxyz")
    table = {(s, k): (rng.choice(states), rng.choice(["open", "in", "", "note"])) for s in states for k in kinds}
    machine = Machine.of(states, kinds, lambda s, k: table[s, k])
    rows = [(d, i, rng.choice(kinds)) for d, n in ((1, 1), (2, 70), (3, 129), (None, 40)) for i in range(n)]
    got = walk(spark.createDataFrame(rows, LINES).repartition(3), machine, F.col("line"), chunk)
    assert {(r.doc_id, r.line_no): (r.state, r.tag, r.block) for r in got.collect()} == plain_walk(machine, rows)
    assert walk(spark.createDataFrame([], LINES), machine, F.col("line"), chunk).count() == 0


PYTEST = """=== test session starts ===
platform linux
collected 3 items

tests/test_a.py .F. [100%]

=== FAILURES ===
___ test_b ___

    def test_b():
>       assert 1 == 2
E       assert 1 == 2

tests/test_a.py:4: AssertionError
=== short test summary info ===
FAILED tests/test_a.py::test_b - assert 1 == 2
=== 1 failed, 2 passed in 0.05s ==="""

RULE = "═" * 39
SAMPLES = {
    "pytest": (summaries.pytest_summary, PYTEST, f"Pytest: 2 passed, 1 failed\n{RULE}\n\nFailures:\n1. [FAIL] test_b\n     >       assert 1 == 2\n     E       assert 1 == 2\n     tests/test_a.py:4: AssertionError\n\n2. [FAIL] tests/test_a.py::test_b\n     assert 1 == 2"),
    "pytest, quiet": (summaries.pytest_summary, "....\n4 passed in 0.2s", "Pytest: 4 passed"),
    "pytest, nothing": (summaries.pytest_summary, "=== no tests ran in 0.01s ===", "Pytest: No tests collected"),
    "cargo test": (summaries.cargo_test_summary, "running 2 tests\ntest a ... ok\n\ntest result: ok. 2 passed; 0 failed; 1 ignored; 0 measured; 0 filtered out; finished in 0.01s", "cargo test: 2 passed, 1 ignored (1 suite, 0.01s)"),
    "cargo test, failed": (summaries.cargo_test_summary, "failures:\n\n---- a stdout ----\nboom\n\ntest result: FAILED. 0 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out", f"FAILURES (1):\n{RULE}\n1. ---- a stdout ----\nboom\n\ntest result: FAILED. 0 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out\ntest result: FAILED. 0 passed; 1 failed; 0 ignored; 0 measured; 0 filtered out"),
    "cargo build": (summaries.cargo_build_summary, "   Compiling a v1\nerror[E1]: bad\n --> a.rs:1\n\nend\n\nother\nerror: could not compile", f"cargo build: 1 errors, 0 warnings (1 crates)\n{RULE}\nerror[E1]: bad\n --> a.rs:1\n\nend"),
    "cargo build, clean": (summaries.cargo_build_summary, "   Compiling a v1\n    Finished dev", "cargo build (1 crates compiled)\nFinished dev"),
    "tsc": (summaries.tsc_summary, "a.ts(1,2): error TS2: bad\n  because\nb.ts(3,4): error TS1: no\na.ts(5,6): error TS1: no", f"TypeScript: 3 errors in 2 files\n{RULE}\nTop codes: TS1 (2x), TS2 (1x)\n\na.ts (2 errors)\n  L1: TS2 bad\n    because\n  L5: TS1 no\n\nb.ts (1 errors)\n  L3: TS1 no"),
    "tsc, clean": (summaries.tsc_summary, "Found 0 errors. Watching", "TypeScript: No errors found"),
    "git log": (summaries.git_log_summary, "abc subject\nbody\nSigned-off-by: me\nb2\nb3\nb4\n---END---\n\ndef next\n---END---", "abc subject\n  body\n  b2\n  b3\n  [+1 lines omitted]\ndef next"),
    "git diff": (summaries.git_diff_summary, "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1 +1 @@ f\n before\n-a\n+b\n after", "\nx\n  @@ -1 +1 @@ f\n  -a\n  +b\n   after\n  +1 -1"),
}


@pytest.mark.parametrize("make", sorted({m for m, *_ in SAMPLES.values()}, key=lambda m: m.__name__))
def test_summary(spark, make):
    mine = [(text, want) for f, text, want in SAMPLES.values() if f is make]
    lines = to_lines(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(mine)], "doc_id long, text string"))
    assert [r.summary for r in make(lines).orderBy("doc_id").collect()] == [want for _, want in mine]


def test_summary_of_nothing(spark):
    assert summaries.tsc_summary(spark.createDataFrame([], LINES)).count() == 0


def test_push(spark):
    lines = to_lines(spark.createDataFrame([(0, "Total 3\n\nTo host\n   a..b  main -> main"), (1, "Everything up-to-date"), (2, "Total 1"), (3, "x -> ")], "doc_id long, text string"))
    assert {r.doc_id: r.summary for r in handlers.push_summary(lines).collect()} == {0: "ok main", 1: "ok (up-to-date)", 2: "ok", 3: "ok"}


def test_block_stream_equals_table_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(7)
    texts = ["error[E1]: bad", "warning: odd", "", "  --> a.rs", "plain", "   Compiling a"]
    rows = [(d, i, rng.choice(texts)) for d in range(4) for i in range(40)]
    lines = spark.createDataFrame(rows, LINES)
    for low, high in ((0, 17), (17, 40)):  # a query a part: each one starts again from the checkpoint
        lines.filter(f"line_no >= {low} AND line_no < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(LINES).parquet(str(tmp_path / "in"))
        query = block_stream(stream, "cargo build", idle_ms=500).writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(processingTime="200 milliseconds").start()
        until, seen = time.time() + 60, 0.0
        while time.time() < until and query.isActive:
            if not seen and any(p.numInputRows for p in query.recentProgress):
                seen = time.time()
            if seen and (high < 40 or time.time() - seen > 5):  # the last open blocks are sent by their timers
                break
            time.sleep(0.2)
        query.stop()
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("first_line").collect():
        got.setdefault((r.doc_id, r.block), []).append(r.text)
    want = {(r.doc_id, r.block): r.text for r in handlers.output_blocks(lines, "cargo build").collect()}
    assert {k: "\n".join(v) for k, v in got.items()} == want and len(want) > 8
