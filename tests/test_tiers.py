"""Every tier of the parsers on outputs in the tools' own forms."""

import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import tiers

REPORT = {"numTotalTests": 3, "numPassedTests": 1, "numFailedTests": 1, "numPendingTests": 1, "testResults": [{"name": "a.test.ts", "assertionResults": [{"fullName": "adds", "status": "failed", "failureMessages": ["expected 1", "got 2"]}, {"fullName": "ok", "status": "passed", "failureMessages": []}]}]}
SPEC = lambda title, ok, *tests: {"title": title, "ok": ok, "tests": list(tests)}
PLAYS = {"stats": {"expected": 1, "unexpected": 2, "skipped": 0, "duration": 1234.7}, "suites": [{"title": "top", "file": "a.spec.ts", "specs": [SPEC("one", True)], "suites": [{"title": "inner", "specs": [SPEC("two", False, {"status": "expected", "results": []}, {"status": "unexpected", "results": [{"status": "passed", "errors": []}, {"status": "timedOut", "errors": [{"message": "slow\nvery"}]}]}), SPEC("three", False)]}]}]}
LIST = [{"name": "app", "version": "1.0", "dependencies": {"z": {"version": "3"}, "b": {"version": "2", "dependencies": {"c": {"version": "4"}}}}, "devDependencies": {"d": {"version": "5", "dependencies": {"e": {"version": "6"}}}}}]
OLD = {"x": {"current": "1", "latest": "2", "wanted": "1.5", "dependencyType": "devDependencies"}, "a": {"current": "3", "latest": "3"}}

CASES = [
    (tiers.vitest, json.dumps(REPORT), "full", "PASS (1) FAIL (1) skipped (1)\n\n1. adds\n   expected 1\n   got 2"),
    (tiers.vitest, "Scope: all\n" + json.dumps(REPORT) + "\ndone", "full", "PASS (1) FAIL (1) skipped (1)\n\n1. adds\n   expected 1\n   got 2"),
    (tiers.vitest, "\x1b[31m FAIL\x1b[0m a.test.ts\n  expected 1\n  FAIL too\nnext\n Tests  1 failed | 4 passed (5)\n Duration  1.52s", "degraded", "PASS (4) FAIL (1)\n\n1.  FAIL a.test.ts\n   expected 1\n   FAIL too\n\nTime: 1520ms"),
    (tiers.vitest, " Tests  4 passed (4)", "degraded", "PASS (4) FAIL (0)"),
    (tiers.vitest, '{"numTotalTests": 3}', "raw", '{"numTotalTests": 3}'),
    (tiers.vitest, "é" * 3000, "raw", "é" * 2000 + "..."),
    (tiers.vitest, None, "raw", ""),
    (tiers.playwright, json.dumps(PLAYS), "full", "PASS (1) FAIL (2)\n\n1. two\n   slow\n   very\n2. three\n   Test failed\n\nTime: 1234ms"),
    (tiers.playwright, "  ✗ [chromium] › login.spec.ts:3\n  1 failed\n  2 skipped\n  7 passed (1.5m)", "degraded", "PASS (7) FAIL (1) skipped (2)\n\n1. ✗ [chromium] › login.spec.ts\n\nTime: 90000ms"),
    (tiers.playwright, "nothing", "raw", "nothing"),
    (tiers.pnpm_list, json.dumps(LIST), "full", "6 packages\n  app 1.0\n  b 2\n  c 4\n  z 3\n  d 5 (dev)\n  e 6 (dev)"),
    (tiers.pnpm_list, "Legend: x\ndependencies:\nreact@18.2.0 extra\n@scope/p@1.0\n├ no@1\ndevDependencies:\nvite@5\nplain", "degraded", "3 packages\n  react 18.2.0\n  @scope/p 1.0\n  vite 5 (dev)"),
    (tiers.pnpm_list, "nothing", "raw", "nothing"),
    (tiers.pnpm_list, "[]", "full", "All packages up-to-date"),
    (tiers.pnpm_outdated, json.dumps(OLD), "full", "1 outdated packages (of 2)\nx: 1 → 2"),
    (tiers.pnpm_outdated, "{}", "full", "All packages up-to-date"),
    (tiers.pnpm_outdated, "Package Current Wanted Latest\n──\nreact 17.0 17.1 18.2\nvite 5 5 5\nshort 1 2", "degraded", "1 outdated packages (of 2)\nreact: 17.0 → 18.2"),
    (tiers.pnpm_outdated, '{"x": {"current": "1"}}', "raw", '{"x": {"current": "1"}}'),
]


@pytest.mark.parametrize("parser", [tiers.vitest, tiers.playwright, tiers.pnpm_list, tiers.pnpm_outdated])
def test_tiers(spark, parser):
    mine = [c for c in CASES if c[0] is parser]
    shown = tiers.format_tests if parser in (tiers.vitest, tiers.playwright) else tiers.format_packages
    rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(mine)], "i int, text string").withColumn("p", parser(F.col("text")))
    got = {r.i: (r.tier, r.shown, r.warnings) for r in rows.select("i", "p.tier", "p.warnings", shown(F.col("p")).alias("shown")).collect()}
    assert [got[i][:2] for i in range(len(mine))] == [c[2:] for c in mine]
    assert all(bool(w) == (tier == "degraded") for tier, _, w in got.values())
