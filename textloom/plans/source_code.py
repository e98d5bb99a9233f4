"""Queries over source files made from the events table, a language a user: without comments, without bodies, truncated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import source_code
from textloom.sources.tables import table

NAMES = ("lib.rs", "mod.py", "app.tsx", "main.go", "x.rb", "run.sh", "conf.toml", "odd")
#: SQL that both engines read: e is the event.
LINE = """CASE e % 23 WHEN 0 THEN 'use a::b' || e || ';' WHEN 1 THEN 'import x' || e WHEN 2 THEN 'fn run' || e || '() {' WHEN 3 THEN 'pub async fn go' || e || '(a: b)' WHEN 4 THEN 'def f' || e || '():' WHEN 5 THEN '  let a = ' || e || ';'
  WHEN 6 THEN 'const B = ' || e WHEN 7 THEN '{' WHEN 8 THEN '}' WHEN 9 THEN '  if x' || e || ' {' WHEN 10 THEN '  }' WHEN 11 THEN '' WHEN 12 THEN '// note ' || e WHEN 13 THEN '/// doc ' || e WHEN 14 THEN '# note ' || e WHEN 15 THEN '/* one */'
  WHEN 16 THEN '/* open ' || e WHEN 17 THEN 'close */' WHEN 18 THEN '\"\"\"' WHEN 19 THEN '=begin' WHEN 20 THEN '=end' WHEN 21 THEN 'plain code of some length ' || e ELSE '/** doc ' || e END"""

def files(s: SparkSession, d: str) -> DataFrame:
    """doc_id, path, text."""
    numbered = table(s, d, "events").selectExpr("user_id AS u", "event_id AS e").select("u", "e", F.expr(LINE).alias("x"))
    text = numbered.groupBy("u").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda x: x["x"]), "\n").alias("text"))
    names = F.array(*map(F.lit, NAMES))
    return text.select(F.col("u").alias("doc_id"), F.get(names, (F.col("u") % len(NAMES)).cast("int")).alias("path"), "text")


def _language() -> Column:
    return source_code.language_of(F.col("path"))


QUERIES = {
    "code_minimal": lambda s, d: source_code.minimal(files(s, d), _language(), chunk=32),
    "code_aggressive": lambda s, d: source_code.aggressive(files(s, d), _language(), chunk=32),
    "code_truncated": lambda s, d: source_code.smart_truncate(source_code.source_lines(files(s, d), _language()), 30),
}

_FILES = f"""made AS (SELECT user_id AS u, event_id AS e FROM events), lines AS (SELECT u AS doc_id, e, {LINE} AS x FROM made),
  marks AS (SELECT * FROM (VALUES (0, '//', '///', '/*', '*/', '/**'), (1, '#', NULL, '\"\"\"', '\"\"\"', '\"\"\"'), (2, '//', NULL, '/*', '*/', '/**'), (3, '//', NULL, '/*', '*/', '/**'), (4, '#', NULL, '=begin', '=end', NULL), (5, '#', NULL, NULL, NULL, NULL), (6, NULL, NULL, NULL, NULL, NULL), (7, '//', NULL, '/*', '*/', NULL)) AS m(l, c, d, b, z, k)),
  parts AS (SELECT doc_id, l, e, x, trim(x) AS t, coalesce(contains(x, b), false) AND NOT starts_with(trim(x), coalesce(k, '###')) AS b, coalesce(contains(x, z), false) AS z, l = 1 AND starts_with(trim(x), '\"\"\"') AS q,
    coalesce(starts_with(trim(x), c), false) AND NOT coalesce(starts_with(trim(x), d), false) AS c FROM lines JOIN marks ON l = doc_id % 8),
  whole AS (SELECT doc_id, any_value(l) AS l, string_agg(x, chr(10) ORDER BY e) AS text, list({{'x': x, 'b': b, 'z': z, 'q': q, 'c': c}} ORDER BY e) AS xs FROM parts GROUP BY doc_id),
  folded AS (SELECT doc_id, l, text, list_reduce(xs, lambda a, x: CASE
      WHEN a.s <> 'd' AND x.b OR a.s = 'c' THEN {{'s': CASE WHEN x.z THEN 'n' ELSE 'c' END, 'o': a.o}}
      WHEN x.q THEN {{'s': CASE WHEN a.s = 'd' THEN 'n' ELSE 'd' END, 'o': list_append(a.o, x.x)}}
      WHEN a.s = 'd' OR NOT x.c THEN {{'s': a.s, 'o': list_append(a.o, x.x)}} ELSE a END, {{'s': 'n', 'o': []::VARCHAR[]}}).o AS o FROM whole),
  minimal AS (SELECT doc_id, l, text, trim(regexp_replace(array_to_string(o, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS m FROM folded)"""
_KEEP = r"'^(use |import |from |require\(|#include)'"
_SIGN = r"'^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+'"
ORACLES = {
    "code_minimal": f"WITH {_FILES} SELECT doc_id, CASE WHEN strlen(text) < 512 THEN text ELSE m END AS text FROM minimal",
    "code_aggressive": f"""WITH {_FILES}, bodies AS (SELECT doc_id, l, text, m, list_reduce(string_split(m, chr(10)), lambda a, x: CASE
        WHEN regexp_matches(trim(x), {_KEEP}) THEN {{'in': a.in, 'd': a.d, 'o': list_append(a.o, x)}}
        WHEN regexp_matches(trim(x), {_SIGN}) THEN {{'in': true, 'd': 0, 'o': list_append(a.o, x)}}
        WHEN a.in THEN {{'d': a.d + length(regexp_replace(x, '[^{{]', '', 'g')) - length(regexp_replace(x, '[^}}]', '', 'g')), 'in': a.d + length(regexp_replace(x, '[^{{]', '', 'g')) - length(regexp_replace(x, '[^}}]', '', 'g')) > 0,
          'o': list_concat(a.o, CASE WHEN a.d + length(regexp_replace(x, '[^{{]', '', 'g')) - length(regexp_replace(x, '[^}}]', '', 'g')) <= 1 AND (trim(x) IN ('{{', '}}') OR x LIKE '%{{') THEN [x] ELSE [] END,
            CASE WHEN a.d + length(regexp_replace(x, '[^{{]', '', 'g')) - length(regexp_replace(x, '[^}}]', '', 'g')) <= 0 AND trim(x) NOT IN ('', '}}') THEN ['    // ... implementation'] ELSE [] END)}}
        WHEN regexp_matches(trim(x), '^(pub )?(const|static) |^let ') THEN {{'in': false, 'd': a.d, 'o': list_append(a.o, x)}} ELSE a END, {{'in': false, 'd': 0, 'o': []::VARCHAR[]}}).o AS o FROM minimal)
      SELECT doc_id, CASE WHEN strlen(text) < 512 THEN text WHEN l = 6 THEN m ELSE trim(array_to_string(o, chr(10)), ' ' || chr(10)) END AS text FROM bodies""",
    "code_truncated": f"""WITH {_FILES}, rows AS (SELECT doc_id, string_split(regexp_replace(text, '\\n\\z', ''), chr(10)) AS r FROM whole),
      cut AS (SELECT doc_id, r, len(r) AS n, list_reduce(r, lambda a, x: CASE WHEN len(a) >= 29 THEN a
        WHEN regexp_matches(trim(x), {_KEEP}) OR regexp_matches(trim(x), {_SIGN}) OR regexp_matches(trim(x), '^(pub |export )') OR trim(x) IN ('{{', '}}') OR len(a) < 15 THEN list_append(a, x) ELSE a END, []::VARCHAR[]) AS o FROM rows)
      SELECT doc_id, CASE WHEN n <= 30 THEN array_to_string(r, chr(10)) ELSE array_to_string(o, chr(10)) || chr(10) || '[' || (n - len(o)) || ' more lines]' END AS text FROM cut""",
}
