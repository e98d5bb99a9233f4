"""Queries over the three-tier parsers: reports of each user's events as JSON, after other output, as text, and as no report at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import tiers
from textloom.sources.tables import table


def _joined(s: SparkSession, d: str, item: str, separator: str) -> DataFrame:
    """u, n, items: each user's events by one expression each, joined in order, and how many."""
    rows = table(s, d, "events").selectExpr("user_id AS u", "event_id AS e").withColumn("x", F.expr(item))
    return rows.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("e") % 3 == 0, 1)).alias("bad"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda x: x["x"]), separator).alias("items"))


def vitest_reports(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text."""
    test = """concat('{"fullName":"t', e, '","status":"', if(e % 3 = 0, 'failed', 'passed'), '","failureMessages":[', if(e % 3 = 0, concat('"expected ', e, '","got \\\\u00e9"'), ''), ']}')"""
    as_json = _joined(s, d, test, ",")
    report = F.concat(F.lit('{"numTotalTests":'), "n", F.lit(',"numPassedTests":'), F.col("n") - F.col("bad"), F.lit(',"numFailedTests":'), "bad", F.lit(',"testResults":[{"name":"f.ts","assertionResults":['), "items", F.lit("]}]}"))
    as_text = _joined(s, d, "CASE e % 3 WHEN 0 THEN concat(' FAIL t', e) WHEN 1 THEN concat('  detail ', e, ' ') ELSE concat('plain ', e) END", "\n")
    counts = F.concat("items", F.lit("\n Tests  "), "bad", F.lit(" failed | "), F.col("n") - F.col("bad"), F.lit(" passed\n Duration  "), "n", F.lit(".5s"))
    both = as_json.select("u", report.alias("j")).join(as_text.select("u", counts.alias("t"), F.concat(F.lit("no report\n"), "items").alias("r")), "u")
    text = F.when(F.col("u") % 4 == 0, F.col("j")).when(F.col("u") % 4 == 1, F.concat(F.lit("> app@1.0 test\n"), "j", F.lit("\nDone"))).when(F.col("u") % 4 == 2, F.col("t")).otherwise(F.col("r"))
    return both.select(F.col("u").alias("doc_id"), text.alias("text"))


def outdated_reports(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text."""
    as_json = _joined(s, d, """concat('"p', lpad(e, 9, '0'), '":{"current":"1.', e % 4, '","latest":"1.', e % 5, '","dependencyType":"', if(e % 2 = 0, 'devDependencies', 'dependencies'), '"}')""", ",")
    as_text = _joined(s, d, "concat('p', lpad(e, 9, '0'), '  1.', e % 4, '  1.0  1.', e % 5)", "\n")
    both = as_json.select("u", F.concat(F.lit("{"), "items", F.lit("}")).alias("j")).join(as_text.select("u", F.concat(F.lit("Package  Current  Wanted  Latest\n"), "items").alias("t")), "u")
    return both.select(F.col("u").alias("doc_id"), F.when(F.col("u") % 3 == 0, F.col("j")).when(F.col("u") % 3 == 1, F.col("t")).otherwise("up to date").alias("text"))


def _shown(rows: DataFrame, parser, form) -> DataFrame:
    return rows.withColumn("p", parser(F.col("text"))).select("doc_id", "p.tier", form(F.col("p")).alias("shown"))


QUERIES = {
    "vitest_results": lambda s, d: _shown(vitest_reports(s, d), tiers.vitest, tiers.format_tests),
    "outdated_packages": lambda s, d: _shown(outdated_reports(s, d), tiers.pnpm_outdated, tiers.format_packages),
    "parser_tiers": lambda s, d: _shown(vitest_reports(s, d), tiers.vitest, tiers.format_tests).groupBy("tier").agg(F.count(F.lit(1)).alias("n")),
}

# what the reports say is computed from the events here, no report is parsed
_VITEST = r"""e AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  failed AS (SELECT u, e, row_number() OVER (PARTITION BY u ORDER BY e) AS i FROM e WHERE e % 3 = 0),
  -- of the text, the details that follow a failure without another line between
  details AS (SELECT e.u, f.e AS of, e.e FROM e ASOF JOIN failed f ON f.u = e.u AND f.e < e.e WHERE e.e % 3 = 1),
  kept AS (SELECT * FROM details WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.u = details.u AND x.e > details.of AND x.e < details.e AND x.e % 3 <> 1)),
  lines AS (SELECT f.u, f.i, CASE WHEN f.u % 4 < 2 THEN f.i || '. t' || f.e || chr(10) || '   expected ' || f.e || chr(10) || '   got é'
      ELSE f.i || '.  FAIL t' || f.e || coalesce((SELECT string_agg(chr(10) || '   detail ' || kept.e, '' ORDER BY kept.e) FROM kept WHERE kept.u = f.u AND kept.of = f.e), '') END AS s FROM failed f),
  listed AS (SELECT u, count(*) AS c, string_agg(s, chr(10) ORDER BY i) FILTER (WHERE i <= 5) AS s FROM lines GROUP BY u),
  users AS (SELECT u, count(*) AS n, count(*) FILTER (WHERE e % 3 = 0) AS bad, 'no report' || chr(10) || string_agg(CASE e % 3 WHEN 0 THEN ' FAIL t' || e WHEN 1 THEN '  detail ' || e || ' ' ELSE 'plain ' || e END, chr(10) ORDER BY e) AS raw FROM e GROUP BY u),
  shown AS (SELECT users.u AS doc_id, CASE WHEN users.u % 4 < 2 THEN 'full' WHEN users.u % 4 = 2 THEN 'degraded' ELSE 'raw' END AS tier,
      CASE WHEN users.u % 4 = 3 THEN CASE WHEN length(raw) > 2000 THEN left(raw, 2000) || '...' ELSE raw END
      ELSE 'PASS (' || (n - bad) || ') FAIL (' || bad || ')' || CASE WHEN bad > 0 THEN chr(10) || chr(10) || s || CASE WHEN c > 5 THEN chr(10) || chr(10) || '... +' || (c - 5) || ' more failures' ELSE '' END ELSE '' END
        || CASE WHEN users.u % 4 = 2 THEN chr(10) || chr(10) || 'Time: ' || (n * 1000 + 500) || 'ms' ELSE '' END END AS shown
    FROM users LEFT JOIN listed ON listed.u = users.u)"""
ORACLES = {
    "vitest_results": f"WITH {_VITEST} SELECT * FROM shown",
    "parser_tiers": f"WITH {_VITEST} SELECT tier, count(*) AS n FROM shown GROUP BY tier",
    "outdated_packages": """WITH e AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
      g AS (SELECT u, count(*) AS n, count(*) FILTER (WHERE e % 4 <> e % 5) AS late, string_agg(chr(10) || 'p' || lpad(e::VARCHAR, 9, '0') || ': 1.' || e % 4 || ' → 1.' || e % 5, '' ORDER BY e) FILTER (WHERE k <= 10 AND e % 4 <> e % 5) AS s FROM e GROUP BY u)
      SELECT u AS doc_id, ['full', 'degraded', 'raw'][u % 3 + 1] AS tier, CASE WHEN u % 3 = 2 THEN 'up to date' WHEN late = 0 THEN 'All packages up-to-date'
        ELSE late || ' outdated packages (of ' || n || ')' || coalesce(s, '') || CASE WHEN late > 10 THEN chr(10) || chr(10) || '... +' || (late - 10) || ' more' ELSE '' END END AS shown FROM g""",
}
