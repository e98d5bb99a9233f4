"""Queries over XML test reports, one a user and kind of event, made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources import reports
from textloom.sources.tables import table


def _made(s: SparkSession, d: str, item: str) -> DataFrame:
    rows = table(s, d, "events").selectExpr("user_id AS u", "event_type AS kind", "event_id AS e").withColumn("x", F.expr(item))
    bad = lambda k: F.count(F.when(F.col("e") % 4 == k, 1))
    return rows.groupBy("u", "kind").agg(F.count(F.lit(1)).alias("n"), bad(0).alias("f"), bad(1).alias("r"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("e", "x"))), lambda x: x["x"]), "").alias("items"))


def trx(s: SparkSession, d: str) -> DataFrame:
    """doc_id, kind, text; every seventh user's reports end too early."""
    item = """concat('<UnitTestResult testName="t', e, '" outcome="', CASE e % 4 WHEN 0 THEN 'Failed' WHEN 1 THEN 'NotExecuted' ELSE 'Passed' END, '"', if(e % 4 = 0, concat('><Output><ErrorInfo><Message>a &lt; ', e, '</Message><StackTrace> at A\n at B\n at C\n at D</StackTrace></ErrorInfo></Output></UnitTestResult>'), '/>'))"""
    head = F.concat(F.lit('<?xml version="1.0"?><TestRun xmlns="http://x/2010"><Times start="2024-01-01T00:00:00.000+00:00" finish="2024-01-01T00:00:'), F.lpad((F.col("n") % 60).cast("string"), 2, "0"), F.lit('.500+00:00"/><Results>'))
    text = F.concat(head, "items", F.lit('</Results><ResultSummary><Counters total="'), "n", F.lit('" passed="'), F.expr("n - f - r"), F.lit('" failed="'), "f", F.lit('"/></ResultSummary></TestRun>'))
    return _made(s, d, item).select(F.col("u").alias("doc_id"), "kind", F.when(F.col("u") % 7 == 3, F.left(text, F.length(text) - 20)).otherwise(text).alias("text"))


def surefire(s: SparkSession, d: str) -> DataFrame:
    item = """concat('<testcase classname="a.B" name="t', e, '">', CASE e % 4 WHEN 0 THEN concat('<failure message="expected &lt;', e, '&gt; ', repeat('long ', e % 30), '">at A</failure>') WHEN 1 THEN concat('<error>first ', e, '\n at B</error>') ELSE '' END, '</testcase>')"""
    text = F.concat(F.lit('<testsuite name="s" tests="'), "n", F.lit('" failures="'), "f", F.lit('" errors="'), "r", F.lit('" skipped="0"><properties/>'), "items", F.lit("</testsuite>"))
    return _made(s, d, item).select(F.col("u").alias("doc_id"), "kind", text.alias("text"))


def _trx_failures(s: SparkSession, d: str) -> DataFrame:
    rows = reports.parse_reports(trx(s, d), "trx").filter("report IS NOT NULL").withColumn("t", reports.trx_tests(F.col("report")))
    return rows.select("doc_id", "kind", "t.duration", F.explode("t.failed_tests").alias("x")).select("doc_id", "kind", "duration", "x.name", F.array_join("x.details", "|").alias("details"))


QUERIES = {
    "trx_totals": lambda s, d: reports.trx_totals(reports.parse_reports(trx(s, d), "trx"), ["doc_id"]),
    "trx_failures": _trx_failures,
    "surefire_summaries": lambda s, d: reports.surefire_summary(reports.parse_reports(surefire(s, d), "surefire"), "doc_id", "kind"),
}

_G = "g AS (SELECT user_id AS u, event_type AS kind, count(*) AS n, count(*) FILTER (event_id % 4 = 0) AS f, count(*) FILTER (event_id % 4 = 1) AS r FROM events GROUP BY ALL)"
ORACLES = {
    "trx_totals": f"WITH {_G} SELECT u AS doc_id, count(*) AS reports, sum(n)::BIGINT AS total, sum(n - f - r)::BIGINT AS passed, sum(f)::BIGINT AS failed, sum(r)::BIGINT AS skipped FROM g WHERE u % 7 <> 3 GROUP BY u",
    "trx_failures": f"""WITH {_G} SELECT u AS doc_id, kind, CASE WHEN n % 60 = 0 THEN '500 ms' ELSE (n % 60) || '.5 s' END AS duration, 't' || event_id AS name, 'a < ' || event_id || '|at A' || chr(10) || ' at B' || chr(10) || ' at C' AS details
      FROM g JOIN events ON user_id = u AND event_type = kind WHERE u % 7 <> 3 AND event_id % 4 = 0""",
    "surefire_summaries": f"""WITH {_G},
      m AS (SELECT user_id AS u, event_type AS kind, event_id AS e, CASE WHEN event_id % 4 = 1 THEN 'first ' || event_id ELSE 'expected <' || event_id || '> ' || repeat('long ', event_id % 30) END AS say FROM events WHERE event_id % 4 < 2),
      c AS (SELECT u, string_agg(CASE WHEN e % 4 = 1 THEN 'ERR' ELSE 'FAIL' END || ': a.B.t' || e || ' — ' || CASE WHEN length(say) > 80 THEN left(say, 80) || '…' ELSE say END || chr(10), '' ORDER BY kind, e) AS s FROM m GROUP BY u)
      SELECT g.u AS doc_id, 'TESTS: ' || sum(n) || ' OK=' || sum(n - f - r) || ' FAIL=' || sum(f) || ' ERR=' || sum(r) || ' SKIP=0' || chr(10) || coalesce(any_value(s), '') AS summary FROM g LEFT JOIN c ON c.u = g.u GROUP BY g.u""",
}
