"""Queries over summaries of tool outputs; the outputs are made from the events table, a line an event, in several forms each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import handlers, summaries
from textloom.sources.tables import table

#: The line of each event in SQL that both engines read: u is the user, e the event, rn its number within the user's.
LINES = {
    "pytest": """CASE u % 3
      WHEN 0 THEN CASE WHEN rn % 30 = 0 THEN '=== test session starts ===' WHEN rn % 30 = 1 THEN 'collected 9 items' WHEN rn % 30 = 2 THEN 'tests/test_a.py ..F [ 40%]'
        WHEN rn % 30 = 5 THEN 'before the failures' WHEN rn % 30 = 6 THEN '=== FAILURES ===' WHEN rn % 30 IN (8, 12, 16, 20) THEN '____ test_' || e || ' ____'
        WHEN rn % 30 = 24 THEN '=== short test summary info ===' WHEN rn % 30 IN (25, 26) THEN 'FAILED tests/t.py::t' || e || CASE WHEN e % 2 = 0 THEN ' - AssertionError: bad - worse' ELSE '' END
        WHEN rn % 30 = 27 THEN 'XFAIL tests/t.py::x' || e || ' ' || repeat('why ', e % 60) WHEN rn % 30 = 28 THEN 'ERROR tests/y.py'
        WHEN rn % 30 = 29 THEN '=== ' || e % 4 || ' failed, ' || e % 9 || ' passed, ' || e % 2 || ' xfailed in 0.1s ==='
        ELSE CASE e % 5 WHEN 0 THEN '>   assert x' WHEN 1 THEN 'E   AssertionError: ' || repeat('long ', 30) WHEN 2 THEN '' WHEN 3 THEN 'plain ' || e ELSE '  tests/test_a.py:' || e || ' ' END END
      WHEN 1 THEN CASE WHEN rn % 12 = 5 THEN 'FAILED tests/t.py::q' || e WHEN rn % 12 = 9 THEN e % 4 || ' failed, ' || e % 9 || ' passed, 2 skipped, 1 xpassed in 0.5s' ELSE '..F. [' || e % 100 || '%]' END
      ELSE CASE WHEN rn % 9 = 0 THEN '=== test session starts ===' WHEN rn % 9 = 8 THEN '== x ==' WHEN rn % 9 = 7 THEN '=== ' || (e % 9 + 1) || ' passed in 1s ===' ELSE 'tests/b.py ...' END END""",
    "cargo": """CASE u % 4
      WHEN 0 THEN CASE WHEN rn % 25 = 0 THEN '   Compiling a v0.1' WHEN rn % 25 = 1 THEN 'running 9 tests' WHEN rn % 25 = 2 THEN 'test a::b ... ok' WHEN rn % 25 = 3 THEN 'test a::c ... FAILED'
        WHEN rn % 25 IN (4, 20) THEN 'failures:' WHEN rn % 25 IN (6, 10, 14) THEN '---- a::t' || e || ' stdout ----' WHEN rn % 25 = 22 THEN 'test result: FAILED. 3 passed; ' || e % 7 || ' failed; 0 ignored; 0 measured; 0 filtered out'
        ELSE CASE e % 4 WHEN 0 THEN '' WHEN 1 THEN '    a::t' || e WHEN 2 THEN 'thread panicked at ' || repeat('src/lib.rs ', e % 30) ELSE 'note: ' || e END END
      WHEN 1 THEN CASE WHEN rn % 5 = 4 THEN 'test result: ok. ' || e % 50 || ' passed; 0 failed; ' || e % 2 || ' ignored; 0 measured; ' || e % 3 || ' filtered out; finished in ' || e % 10 || '.25s' ELSE 'test x ... ok' END
      WHEN 2 THEN CASE WHEN rn % 9 = 0 THEN '   Compiling c v' || e WHEN rn % 9 = 1 THEN 'error[E0' || e % 500 || ']: bad' WHEN rn % 9 = 5 THEN 'warning: unused ' || e WHEN rn % 9 = 8 THEN 'error: could not compile' ELSE CASE e % 3 WHEN 0 THEN '' WHEN 1 THEN '  --> src/a.rs:' || e ELSE '   |' END END
      ELSE CASE WHEN rn % 6 = 0 THEN '   Compiling d v' || e WHEN rn % 6 = 5 THEN '    Finished in ' || e || 's' ELSE 'plain ' || e END END""",
    "tsc": """CASE WHEN u % 5 = 0 THEN CASE WHEN e % 2 = 0 THEN 'Found 0 errors.' ELSE 'watching' END WHEN u % 5 = 1 THEN 'nothing ' || e
      ELSE CASE e % 4 WHEN 0 THEN 'src/f' || e % 3 || '.ts(' || e || ',' || rn || '): error TS' || (2000 + e % 7) || ': Type ' || repeat('long ', e % 40) || 'x' WHEN 1 THEN '  ' || repeat('context ', e % 30) || 'y'
        WHEN 2 THEN 'other' ELSE chr(9) || 'tab ' || e || ' ' END END""",
    "log": """CASE WHEN rn % 9 = 8 THEN '---END---' WHEN rn % 9 = 0 THEN 'abc' || e || ' ' || repeat('subject ', e % 20) || '(2 days ago) <me>' WHEN rn % 9 = 4 THEN 'Signed-off-by: me' WHEN e % 5 < u % 4 THEN '' ELSE ' body ' || e || ' ' END""",
    "push": """CASE WHEN rn % 11 = 0 THEN 'Enumerating objects: ' || e WHEN rn % 11 = 3 THEN '  Total ' || e WHEN rn % 11 = 5 THEN '' WHEN u % 3 = 0 AND e % 7 = 0 THEN '   abc..def  main -> main' || e || ' (x)'
      WHEN u % 3 = 1 AND rn = 20 THEN 'Everything up-to-date' WHEN u % 3 = 2 AND e % 5 = 0 THEN 'odd -> ' ELSE 'remote: ' || e END""",
    "diff": """CASE WHEN rn % 40 = 0 THEN 'diff --git a/f' || e || ' b/f' || e WHEN rn % 40 = 1 THEN '--- a/f' WHEN rn % 40 = 2 THEN '+++ b/f' WHEN rn % 40 IN (3, 17) THEN '@@ -1,9 +1,9 @@ fn f' || e || '()'
      ELSE CASE e % 6 WHEN 0 THEN '+added ' || e WHEN 1 THEN '-removed ' || e WHEN 2 THEN '\\ No newline' WHEN 3 THEN '+++ odd' ELSE ' context ' || e END END""",
}


def lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """doc_id (a user), line_no, line."""
    numbered = table(spark, sf_dir, "events").selectExpr("user_id AS u", "event_id AS e", "CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS rn")
    return numbered.select(F.col("u").alias("doc_id"), F.col("rn").alias("line_no"), F.expr(LINES[kind].replace("\\", "\\\\")).alias("line"))


QUERIES = {
    "pytest_summaries": lambda s, d: summaries.pytest_summary(lines(s, d, "pytest"), 32),
    "cargo_test_summaries": lambda s, d: summaries.cargo_test_summary(lines(s, d, "cargo"), 32),
    "cargo_build_summaries": lambda s, d: summaries.cargo_build_summary(lines(s, d, "cargo"), 32),
    "tsc_summaries": lambda s, d: summaries.tsc_summary(lines(s, d, "tsc"), 32),
    "git_log_summaries": lambda s, d: summaries.git_log_summary(lines(s, d, "log"), 5, chunk=32),
    "git_diff_summaries": lambda s, d: summaries.git_diff_summary(lines(s, d, "diff"), 50, 6, 32),
    "cargo_build_blocks": lambda s, d: handlers.output_blocks(lines(s, d, "cargo"), "cargo build", 32).select("doc_id", "block", "text"),
    "cargo_test_blocks": lambda s, d: handlers.output_blocks(lines(s, d, "cargo"), "cargo test", 32).select("doc_id", "block", "text"),
    "tsc_blocks": lambda s, d: handlers.output_blocks(lines(s, d, "tsc"), "tsc", 32),
    "git_push_lines": lambda s, d: handlers.push_lines(lines(s, d, "push")),
    "git_push_summaries": lambda s, d: handlers.push_summary(lines(s, d, "push")),
}


def _lines_sql(kind: str) -> str:
    return f"""numbered AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events),
      lines AS (SELECT u AS doc_id, rn AS line_no, {LINES[kind]} AS line FROM numbered)"""


# Each oracle walks its lines one by one with a fold over the list of a user's lines.
_RULE = "repeat('═', 39)"
_BUILD = """
  kinds AS (SELECT *, CASE WHEN regexp_matches(line, '^\\s*(Compiling|Checking)') THEN 'c' WHEN regexp_matches(line, '^\\s*Download(ing|ed)') THEN 's' WHEN regexp_matches(line, '^\\s*Finished') THEN 'f'
      WHEN line LIKE 'warning:%generated%' THEN 's' WHEN regexp_matches(line, '^error[:\\[].*(aborting due to|could not compile)') THEN 's' WHEN regexp_matches(line, '^error[:\\[]') THEN 'e'
      WHEN regexp_matches(line, '^warning[:\\[]') THEN 'w' WHEN trim(line) = '' THEN 'b' ELSE 't' END AS k FROM lines),
  built AS (
    SELECT doc_id, count(*) FILTER (k = 'e') AS errors, count(*) FILTER (k = 'w') AS warnings, count(*) FILTER (k = 'c') AS compiled, max_by(ltrim(line), line_no) FILTER (k = 'f') AS finished,
      list_reduce(list({'k': k, 'l': line} ORDER BY line_no), lambda a, x: CASE
        WHEN x.k IN ('e', 'w') THEN {'b': list_append(a.b, x.l), 'n': 1, 'in': true}
        WHEN NOT a.in OR x.k IN ('c', 's', 'f') THEN a
        WHEN x.k = 'b' AND a.n > 3 THEN {'b': a.b, 'n': 0, 'in': false}
        ELSE {'b': list_append(a.b[1:len(a.b) - 1], a.b[len(a.b)] || chr(10) || x.l), 'n': a.n + 1, 'in': true} END, {'b': []::VARCHAR[], 'n': 0, 'in': false}).b AS b
    FROM kinds GROUP BY doc_id),
  build AS (
    SELECT doc_id, CASE WHEN errors + warnings = 0 THEN 'cargo build (' || compiled || ' crates compiled)' || coalesce(chr(10) || finished, '')
      ELSE trim('cargo build: ' || errors || ' errors, ' || warnings || ' warnings (' || compiled || ' crates)' || chr(10) || RULE || chr(10)
        || array_to_string(list_transform(b[1:20], lambda x, i: x || chr(10) || CASE WHEN i < len(b) THEN chr(10) ELSE '' END), '') || CASE WHEN len(b) > 20 THEN chr(10) || '… +' || (len(b) - 20) || ' more issues' || chr(10) ELSE '' END, ' ' || chr(10)) END AS summary
    FROM built)""".replace("RULE", _RULE)

ORACLES = {
    "pytest_summaries": f"""WITH {_lines_sql("pytest")},
  t AS (SELECT doc_id, line_no, trim(line) AS t FROM lines),
  k AS (SELECT *, starts_with(t, '===') AS r, CASE WHEN NOT starts_with(t, '===') THEN '' WHEN contains(t, 'test session starts') THEN 'H' WHEN contains(t, 'FAILURES') THEN 'F' WHEN contains(t, 'short test summary') THEN 'S'
      WHEN regexp_matches(t, 'passed|failed|skipped') THEN 'T' ELSE '' END AS k, NOT regexp_matches(t, '^(===|FAILED|ERROR)') AND regexp_matches(t, ' (passed|failed|skipped)') AND contains(t, ' in ') AS q FROM t),
  folded AS (
    SELECT doc_id, list_reduce(list({{'k': k, 't': t, 'r': r, 'q': q}} ORDER BY line_no), lambda a, x:
      CASE WHEN x.k IN ('H', 'F') THEN {{'m': x.k, 'c': a.c, 'f': a.f, 'x': a.x, 's': a.s}}
        WHEN x.k = 'S' THEN {{'m': 'S', 'c': []::VARCHAR[], 'f': CASE WHEN len(a.c) > 0 THEN list_append(a.f, array_to_string(a.c, chr(10))) ELSE a.f END, 'x': a.x, 's': a.s}}
        WHEN x.k = 'T' OR x.q AND a.s = '' THEN {{'m': a.m, 'c': a.c, 'f': a.f, 'x': a.x, 's': x.t}}
        WHEN a.m = 'H' AND starts_with(x.t, 'collected') THEN {{'m': 'P', 'c': a.c, 'f': a.f, 'x': a.x, 's': a.s}}
        WHEN a.m = 'F' AND starts_with(x.t, '___') THEN {{'m': 'F', 'c': [x.t], 'f': CASE WHEN len(a.c) > 0 THEN list_append(a.f, array_to_string(a.c, chr(10))) ELSE a.f END, 'x': a.x, 's': a.s}}
        WHEN a.m = 'F' AND x.t <> '' AND NOT x.r THEN {{'m': 'F', 'c': list_append(a.c, x.t), 'f': a.f, 'x': a.x, 's': a.s}}
        WHEN a.m = 'S' AND regexp_matches(x.t, '^(FAILED|ERROR)') THEN {{'m': 'S', 'c': a.c, 'f': list_append(a.f, x.t), 'x': a.x, 's': a.s}}
        WHEN a.m = 'S' AND regexp_matches(x.t, '^(XFAIL|XPASS)') THEN {{'m': 'S', 'c': a.c, 'f': a.f, 'x': list_append(a.x, x.t), 's': a.s}}
        ELSE a END, {{'m': 'H', 'c': []::VARCHAR[], 'f': []::VARCHAR[], 'x': []::VARCHAR[], 's': ''}}) AS z
    FROM k GROUP BY doc_id),
  done AS (SELECT doc_id, z.x AS x, z.s AS s, CASE WHEN len(z.c) > 0 THEN list_append(z.f, array_to_string(z.c, chr(10))) ELSE z.f END AS f FROM folded),
  words AS (SELECT doc_id, p, string_split_regex(trim(part), '\\s+') AS w FROM (SELECT doc_id, unnest(string_split(s, ',')) AS part, generate_subscripts(string_split(s, ','), 1) AS p FROM done)),
  pairs AS (SELECT doc_id, p * 100 + i AS o, try_cast(w[i - 1] AS BIGINT) AS n, w[i] AS word FROM (SELECT doc_id, p, w, unnest(range(2, len(w) + 1)) AS i FROM words)),
  named AS (SELECT *, CASE WHEN contains(word, 'xpassed') THEN 'xp' WHEN contains(word, 'xfailed') THEN 'xf' WHEN contains(word, 'passed') THEN 'p' WHEN contains(word, 'failed') THEN 'f' WHEN contains(word, 'skipped') THEN 's' END AS c FROM pairs WHERE n IS NOT NULL),
  sums AS (SELECT doc_id, max_by(n, o) FILTER (c = 'p') AS p, max_by(n, o) FILTER (c = 'f') AS f, max_by(n, o) FILTER (c = 's') AS s, max_by(n, o) FILTER (c = 'xf') AS xf, max_by(n, o) FILTER (c = 'xp') AS xp FROM named GROUP BY doc_id),
  counted AS (SELECT done.doc_id, done.x, done.f AS fails, coalesce(sums.p, 0) AS p, coalesce(sums.f, 0) AS f, coalesce(sums.s, 0) AS s, coalesce(sums.xf, 0) AS xf, coalesce(sums.xp, 0) AS xp FROM done LEFT JOIN sums USING (doc_id)),
  entries AS (SELECT doc_id, i, len(fails) AS n, string_split(fails[i], chr(10)) AS l FROM (SELECT doc_id, fails, unnest(range(1, least(len(fails), 10) + 1)) AS i FROM counted)),
  shown AS (
    SELECT doc_id, i, CASE WHEN starts_with(l[1], 'FAILED') THEN i || '. [FAIL] ' || ltrim(string_split(l[1], ' - ')[1][8:], '') || chr(10) || CASE WHEN contains(l[1], ' - ') THEN '     ' || string_split(l[1], ' - ')[2] || chr(10) ELSE '' END
      ELSE CASE WHEN starts_with(l[1], '___') THEN i || '. [FAIL] ' || trim(trim(l[1], '_')) || chr(10) ELSE '' END
        || array_to_string(list_transform(list_filter(l[2:], lambda y: regexp_matches(y, '^[>E]') OR regexp_matches(lower(y), 'assert|error') OR contains(y, '.py:'))[1:3], lambda y: '     ' || CASE WHEN length(y) > 100 THEN left(y, 97) || '...' ELSE y END || chr(10)), '')
        || CASE WHEN i < n THEN chr(10) ELSE '' END END AS e
    FROM entries),
  listed AS (SELECT doc_id, string_agg(e, '' ORDER BY i) AS e FROM shown GROUP BY doc_id)
  SELECT counted.doc_id, CASE WHEN p + f + s + xf + xp = 0 THEN 'Pytest: No tests collected' WHEN f = 0 AND p > 0 AND s + xf + xp + len(x) = 0 THEN 'Pytest: ' || p || ' passed'
    ELSE trim('Pytest: ' || p || ' passed, ' || f || ' failed' || CASE WHEN s > 0 THEN ', ' || s || ' skipped' ELSE '' END || CASE WHEN xf > 0 THEN ', ' || xf || ' xfailed' ELSE '' END || CASE WHEN xp > 0 THEN ', ' || xp || ' xpassed' ELSE '' END || chr(10) || {_RULE} || chr(10)
      || CASE WHEN len(x) > 0 THEN chr(10) || 'Expected-failure outcomes:' || chr(10) || array_to_string(list_transform(x[1:10], lambda y: '  ' || CASE WHEN length(y) > 120 THEN left(y, 117) || '...' ELSE y END || chr(10)), '') || CASE WHEN len(x) > 10 THEN '  … +' || (len(x) - 10) || ' more' || chr(10) ELSE '' END ELSE '' END
      || CASE WHEN len(fails) > 0 THEN chr(10) || 'Failures:' || chr(10) || e || CASE WHEN len(fails) > 10 THEN chr(10) || '… +' || (len(fails) - 10) || ' more failures' || chr(10) ELSE '' END ELSE '' END, ' ' || chr(10)) END AS summary
  FROM counted LEFT JOIN listed USING (doc_id)""",
    "cargo_build_summaries": f"WITH {_lines_sql('cargo')}, {_BUILD} SELECT * FROM build",
    "cargo_test_summaries": f"""WITH {_lines_sql("cargo")}, {_BUILD},
  folded AS (
    SELECT doc_id, list_reduce(list(line ORDER BY line_no), lambda a, x: CASE
        WHEN regexp_matches(x, '^\\s*(Compiling|Download(ing|ed)|Finished)') OR starts_with(x, 'running ') OR regexp_matches(x, '^test .*\\.\\.\\. ok$') THEN a
        WHEN x = 'failures:' THEN {{'in': true, 'c': a.c, 'f': a.f, 's': a.s}}
        WHEN starts_with(x, 'test result:') THEN {{'in': false, 'c': a.c, 'f': a.f, 's': CASE WHEN a.in THEN list_append(list_append(a.s, x), x) ELSE list_append(a.s, x) END}}
        WHEN a.in AND (trim(x) <> '' OR starts_with(x, '    ')) THEN {{'in': true, 'c': list_append(a.c, x), 'f': a.f, 's': a.s}}
        WHEN a.in AND len(a.c) > 0 THEN {{'in': true, 'c': []::VARCHAR[], 'f': list_append(a.f, array_to_string(a.c, chr(10))), 's': a.s}}
        ELSE a END, {{'in': false, 'c': []::VARCHAR[], 'f': []::VARCHAR[], 's': []::VARCHAR[]}}) AS z,
      bool_or(regexp_matches(line, '^\\s*error[:\\[]')) AS broken, list(line ORDER BY line_no) FILTER (trim(line) <> '' AND NOT regexp_matches(line, '^\\s*Compiling')) AS useful
    FROM lines GROUP BY doc_id),
  done AS (SELECT doc_id, z.s AS s, CASE WHEN len(z.c) > 0 THEN list_append(z.f, array_to_string(z.c, chr(10))) ELSE z.f END AS f, broken, coalesce(useful, []) AS useful FROM folded),
  results AS (SELECT doc_id, regexp_extract(l, 'ok\\. (\\d+) passed; \\d+ failed; (\\d+) ignored; \\d+ measured; (\\d+) filtered out(; finished in ([\\d.]+)s)?', ['p', 'i', 'o', 'd', 't']) AS r FROM (SELECT doc_id, unnest(s) AS l FROM done)),
  sums AS (SELECT doc_id, count(*) AS suites, bool_and(r.p <> '') AS ok, sum(try_cast(r.p AS BIGINT)) AS p, sum(try_cast(r.i AS BIGINT)) AS i, sum(try_cast(r.o AS BIGINT)) AS o, bool_and(r.t <> '') AS timed, sum(try_cast(r.t AS DECIMAL(18, 4))) AS t FROM results GROUP BY doc_id),
  texts AS (
    SELECT done.*, sums.*, trim(CASE WHEN len(f) > 0 THEN 'FAILURES (' || len(f) || '):' || chr(10) || {_RULE} || chr(10) || array_to_string(list_transform(f[1:10], lambda x, n: n || '. ' || CASE WHEN length(x) > 200 THEN left(x, 197) || '...' ELSE x END || chr(10)), '')
        || CASE WHEN len(f) > 10 THEN chr(10) || '… +' || (len(f) - 10) || ' more failures' || chr(10) ELSE '' END || chr(10) ELSE '' END || array_to_string(list_transform(s, lambda x: x || chr(10)), ''), ' ' || chr(10)) AS whole
    FROM done LEFT JOIN sums ON done.doc_id = sums.doc_id)
  SELECT texts.doc_id, CASE WHEN len(f) = 0 AND suites > 0 AND ok THEN 'cargo test: ' || p || ' passed' || CASE WHEN i > 0 THEN ', ' || i || ' ignored' ELSE '' END || CASE WHEN o > 0 THEN ', ' || o || ' filtered out' ELSE '' END
      || ' (' || CASE WHEN suites = 1 THEN '1 suite' ELSE suites || ' suites' END || CASE WHEN timed THEN ', ' || t::DECIMAL(18, 2) || 's' ELSE '' END || ')'
    WHEN whole <> '' THEN whole WHEN broken AND starts_with(build.summary, 'cargo build:') THEN 'cargo test:' || build.summary[13:]
    ELSE trim(array_to_string(useful[greatest(len(useful) - 4, 1):], chr(10)), ' ' || chr(10)) END AS summary
  FROM texts JOIN build ON build.doc_id = texts.doc_id""",
    "tsc_summaries": f"""WITH {_lines_sql("tsc")},
  folded AS (
    SELECT doc_id, bool_or(contains(line, 'Found 0 errors')) AS none, list_reduce(list(line ORDER BY line_no), lambda a, x: CASE
        WHEN regexp_matches(x, '^.+?\\(\\d+,\\d+\\):\\s+(error|warning)\\s+TS\\d+:\\s+.+$') THEN {{'e': list_append(a.e, [x]), 'in': true}}
        WHEN a.in AND regexp_matches(x, '^(  |\\t)') THEN {{'e': list_append(a.e[1:len(a.e) - 1], list_append(a.e[len(a.e)], x)), 'in': true}}
        ELSE {{'e': a.e, 'in': false}} END, {{'e': []::VARCHAR[][], 'in': false}}).e AS e FROM lines GROUP BY doc_id),
  errors AS (SELECT doc_id, i, e[i] AS l, regexp_extract(e[i][1], '^(.+?)\\((\\d+),\\d+\\):\\s+\\w+\\s+(TS\\d+):\\s+(.+)$', ['file', 'line', 'code', 'say']) AS r FROM (SELECT doc_id, e, unnest(range(1, len(e) + 1)) AS i FROM folded)),
  texts AS (SELECT doc_id, i, r.file AS file, r.code AS code, '  L' || r.line || ': ' || r.code || ' ' || CASE WHEN length(r.say) > 120 THEN left(r.say, 117) || '...' ELSE r.say END || chr(10)
      || array_to_string(list_transform(l[2:], lambda x: '    ' || CASE WHEN length(trim(x, ' ' || chr(9))) > 120 THEN left(trim(x, ' ' || chr(9)), 117) || '...' ELSE trim(x, ' ' || chr(9)) END || chr(10)), '') AS t FROM errors),
  files AS (SELECT doc_id, file, count(*) AS n, file || ' (' || count(*) || ' errors)' || chr(10) || string_agg(t, '' ORDER BY i) || chr(10) AS t FROM texts GROUP BY doc_id, file),
  codes AS (SELECT doc_id, list(code || ' (' || n || 'x)' ORDER BY n DESC, code) AS c FROM (SELECT doc_id, code, count(*) AS n FROM texts GROUP BY doc_id, code) GROUP BY doc_id),
  listed AS (SELECT doc_id, sum(n) AS n, count(*) AS files, string_agg(t, '' ORDER BY n DESC, file) AS t FROM files GROUP BY doc_id)
  SELECT folded.doc_id, CASE WHEN len(e) = 0 THEN CASE WHEN none THEN 'TypeScript: No errors found' ELSE 'TypeScript compilation completed' END
    ELSE trim('TypeScript: ' || n || ' errors in ' || files || ' files' || chr(10) || {_RULE} || chr(10) || CASE WHEN len(c) > 1 THEN 'Top codes: ' || array_to_string(c[1:5], ', ') || chr(10) || chr(10) ELSE '' END || t, ' ' || chr(10)) END AS summary
  FROM folded LEFT JOIN listed USING (doc_id) LEFT JOIN codes USING (doc_id)""",
    "git_log_summaries": f"""WITH {_lines_sql("log")},
  commits AS (SELECT doc_id, unnest(parts[1:5]) AS c, generate_subscripts(parts[1:5], 1) AS i FROM (SELECT doc_id, string_split(string_agg(line, chr(10) ORDER BY line_no), '---END---') AS parts FROM lines GROUP BY doc_id)),
  clean AS (SELECT doc_id, i, list_filter(list_transform(string_split(c, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM commits),
  parts AS (SELECT doc_id, i, l[1] AS head, list_filter(l[2:], lambda x: NOT regexp_matches(x, '^(Signed-off-by:|Co-authored-by:)')) AS b FROM clean WHERE len(l) > 0),
  entries AS (SELECT doc_id, i, array_to_string(list_transform(list_prepend(head, b[1:3]), lambda x: CASE WHEN length(x) > 80 THEN left(x, 77) || '...' ELSE x END), chr(10) || '  ') || CASE WHEN len(b) > 3 THEN chr(10) || '  [+' || (len(b) - 3) || ' lines omitted]' ELSE '' END AS e FROM parts),
  listed AS (SELECT doc_id, string_agg(e, chr(10) ORDER BY i) AS summary FROM entries GROUP BY doc_id)
  SELECT doc_id, trim(coalesce(summary, ''), ' ' || chr(10)) AS summary FROM (SELECT DISTINCT doc_id FROM lines) LEFT JOIN listed USING (doc_id)""",
    "git_diff_summaries": f"""WITH {_lines_sql("diff")},
  folded AS (
    SELECT doc_id, list_reduce(list(line ORDER BY line_no), lambda a, x: CASE
        WHEN len(a.o) >= 50 THEN a
        WHEN starts_with(x, 'diff --git') THEN {{'o': list_append(list_concat(CASE WHEN a.k > 0 THEN list_append(a.o, '  ... (' || a.k || ' lines truncated)') ELSE a.o END, CASE WHEN a.f AND a.p + a.m > 0 THEN ['  +' || a.p || ' -' || a.m] ELSE [] END), chr(10) || coalesce(string_split(x, ' b/')[2], 'unknown')),
            'f': true, 'p': 0, 'm': 0, 'h': false, 's': 0, 'k': 0, 't': a.t OR a.k > 0}}
        WHEN starts_with(x, '@@') THEN {{'o': list_append(CASE WHEN a.k > 0 THEN list_append(a.o, '  ... (' || a.k || ' lines truncated)') ELSE a.o END, '  ' || x), 'f': a.f, 'p': a.p, 'm': a.m, 'h': true, 's': 0, 'k': 0, 't': a.t OR a.k > 0}}
        WHEN NOT a.h THEN a
        WHEN regexp_matches(x, '^(\\+([^+]|\\+[^+]|\\+?$)|-([^-]|-[^-]|-?$))') THEN {{'o': CASE WHEN a.s < 6 THEN list_append(a.o, '  ' || x) ELSE a.o END, 'f': a.f, 'p': a.p + (x[1] = '+')::INT, 'm': a.m + (x[1] = '-')::INT, 'h': true, 's': CASE WHEN a.s < 6 THEN a.s + 1 ELSE a.s END, 'k': a.k + (a.s >= 6)::INT, 't': a.t}}
        WHEN a.s > 0 AND a.s < 6 AND x[1] <> chr(92) THEN {{'o': list_append(a.o, '  ' || x), 'f': a.f, 'p': a.p, 'm': a.m, 'h': true, 's': a.s + 1, 'k': a.k, 't': a.t}}
        ELSE a END, {{'o': []::VARCHAR[], 'f': false, 'p': 0, 'm': 0, 'h': false, 's': 0, 'k': 0, 't': false}}) AS z FROM lines GROUP BY doc_id)
  SELECT doc_id, array_to_string(list_concat(z.o, CASE WHEN len(z.o) >= 50 THEN [chr(10) || '... (more changes truncated)'] ELSE [] END, CASE WHEN z.k > 0 THEN ['  ... (' || z.k || ' lines truncated)'] ELSE [] END,
    CASE WHEN z.f AND z.p + z.m > 0 THEN ['  +' || z.p || ' -' || z.m] ELSE [] END, CASE WHEN z.t OR z.k > 0 OR len(z.o) >= 50 THEN ['[full diff: git diff]'] ELSE [] END), chr(10)) AS summary FROM folded""",
    "cargo_build_blocks": f"WITH {_lines_sql('cargo')}, {_BUILD} SELECT doc_id, unnest(b) AS text, generate_subscripts(b, 1) AS block FROM built",
    "cargo_test_blocks": f"""WITH {_lines_sql("cargo")},
  folded AS (
    SELECT doc_id, list_reduce(list(line ORDER BY line_no), lambda a, x: CASE
        WHEN regexp_matches(x, '^\\s*(Compiling|Download(ing|ed)|Finished)') OR starts_with(x, 'running ') OR regexp_matches(x, '^test .*\\.\\.\\. (ok|FAILED)$') THEN a
        WHEN x = 'failures:' THEN {{'s': true, 'n': a.n OR a.s, 'in': a.in, 'b': a.b}}
        WHEN starts_with(x, 'test result:') THEN {{'s': false, 'n': false, 'in': a.in, 'b': a.b}}
        WHEN a.n THEN a
        WHEN a.s AND starts_with(x, '---- ') THEN {{'s': true, 'n': false, 'in': true, 'b': list_append(a.b, x)}}
        WHEN a.in AND a.s THEN {{'s': true, 'n': false, 'in': true, 'b': list_append(a.b[1:len(a.b) - 1], a.b[len(a.b)] || chr(10) || x)}}
        ELSE {{'s': a.s, 'n': false, 'in': false, 'b': a.b}} END, {{'s': false, 'n': false, 'in': false, 'b': []::VARCHAR[]}}).b AS b FROM lines GROUP BY doc_id)
  SELECT doc_id, unnest(b) AS text, generate_subscripts(b, 1) AS block FROM folded""",
    "tsc_blocks": f"""WITH {_lines_sql("tsc")},
  folded AS (
    SELECT doc_id, list_reduce(list({{'n': line_no, 'l': line}} ORDER BY line_no), lambda a, x: CASE
        WHEN starts_with(x.l, 'Found ') THEN a
        WHEN regexp_matches(x.l, '^.+?\\(\\d+,\\d+\\):\\s+(error|warning)\\s+TS\\d+:\\s+.+$') THEN {{'b': list_append(a.b, {{'f': x.n, 't': x.n, 'l': x.l}}), 'in': true}}
        WHEN a.in AND regexp_matches(x.l, '^(  |\\t)') THEN {{'b': list_append(a.b[1:len(a.b) - 1], {{'f': a.b[len(a.b)].f, 't': x.n, 'l': a.b[len(a.b)].l || chr(10) || x.l}}), 'in': true}}
        ELSE {{'b': a.b, 'in': false}} END, {{'b': []::STRUCT(f BIGINT, t BIGINT, l VARCHAR)[], 'in': false}}).b AS b FROM lines GROUP BY doc_id)
  SELECT doc_id, i AS block, b[i].f AS first_line, b[i].t AS last_line, b[i].l AS text FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM folded)""",
    "git_push_lines": f"WITH {_lines_sql('push')} SELECT * FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^\\s*((Enumerating|Counting|Compressing|Writing) objects:|Delta compression using|Total )')",
    "git_push_summaries": f"""WITH {_lines_sql("push")}, kept AS (SELECT *, regexp_extract(line, ' -> \\s*(\\S+)', 1) AS dest FROM lines WHERE line <> '' AND NOT regexp_matches(line, '^\\s*((Enumerating|Counting|Compressing|Writing) objects:|Delta compression using|Total )'))
  SELECT doc_id, CASE WHEN bool_or(contains(line, 'Everything up-to-date')) THEN 'ok (up-to-date)' ELSE 'ok' || coalesce(' ' || (list(dest ORDER BY line_no) FILTER (dest <> ''))[1], '') END AS summary FROM kept GROUP BY doc_id""",
}
