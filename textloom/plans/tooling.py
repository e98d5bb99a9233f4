"""Queries over outputs of single tools, made from the events table in each tool's form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import dsl, tools
from textloom.sources.tables import table


def output(spark: SparkSession, sf_dir: str, *parts) -> DataFrame:
    """doc_id (a user), line_no, line: a line an event, joined of the parts (columns or text)."""
    line = F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else F.expr(p[1:]).cast("string") if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.expr("row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1").cast("long").alias("line_no"), line.alias("line"))


def _mypy(s, d):
    return output(s, d, "src/m", "$event_id % 7", ".py:", "$event_id", ": error: bad type  [", "$element_at(array('arg', 'ret', 'attr'), cast(event_id % 3 + 1 as int))", "]")


def _pytest(s, d):
    return output(s, d, "== ", "$event_id % 5", " passed, ", "$event_id % 3", " failed, ", "$event_id % 2", " skipped in 1s ==")


def _paths(s, d):
    return output(s, d, "/srv/d", "$event_id % 4", "/f", "$event_id % 11", "$element_at(array('.py', '.RS', ''), cast(event_id % 3 + 1 as int))")


def _status(s, d):
    return output(s, d, "$element_at(array('??', 'M ', ' M', 'UU', '##'), cast(event_id % 5 + 1 as int))", " f", "$event_id")


def _branches(s, d):
    return output(s, d, "$element_at(array('  b', '  remotes/origin/b', '* c'), cast(event_id % 3 + 1 as int))", "$event_id % 17")


def _env(s, d):
    return output(s, d, "$element_at(array('PATH', 'API_TOKEN', 'GOPATH', 'AWS_REGION'), cast(event_id % 4 + 1 as int))", "=v", "$event_id")


def _issues(s, d):
    """A JSON list of issues for each user."""
    e = table(s, d, "events")
    item = F.struct(F.col("event_id").alias("number"), F.col("event_type").alias("title"), F.lit("open").alias("state"))
    return e.groupBy(F.col("user_id").alias("doc_id")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("text"))


def _filters(s, d):
    commands = F.element_at(F.array(*map(F.lit, ("make all", "ping host", "terraform plan", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("make[1]: Entering directory\nPING host\n64 bytes from host\nRefreshing state... x\n\nline "), F.col("event_id").cast("string"))
    rows = table(s, d, "events").select("event_id", commands.alias("command"), text.alias("text"))
    chosen = {k: tools.FILTERS[k] for k in ("make", "ping", "terraform-plan")}
    return dsl.filter_outputs(rows, chosen).select("event_id", "filter", "filtered")


def _table(s, d):
    return tools.columns(output(s, d, "pod-", "$event_id", "   1/1   ", "$event_type", "   ", "$event_id % 9"), "kubectl")


QUERIES = {
    "tool_diagnostics": lambda s, d: tools.by_code(tools.diagnostics(_mypy(s, d), "mypy")),
    "tool_counters": lambda s, d: tools.counters(_pytest(s, d), "pytest").select("doc_id", "passed", "failed", "skipped"),
    "tool_columns": _table,
    "tool_records": lambda s, d: tools.records(_issues(s, d), "issues", 5),
    "tool_filters": _filters,
    "git_status_counts": lambda s, d: tools.git_status(_status(s, d)),
    "git_remote_only": lambda s, d: tools.remote_only(_branches(s, d)),
    "files_by_extension": lambda s, d: tools.by_extension(_paths(s, d)),
    "files_by_directory": lambda s, d: tools.by_directory(_paths(s, d)),
    "environment_masked": lambda s, d: tools.mask_environment(_env(s, d)),
}

E = "e AS (SELECT *, user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no FROM events)"
ORACLES = {
    "tool_diagnostics": f"""WITH {E}, g AS (SELECT doc_id, ['arg', 'ret', 'attr'][event_id % 3 + 1] AS code, count(*) AS n, count(DISTINCT event_id % 7) AS files, 'bad type' AS example FROM e GROUP BY 1, 2)
      SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, code) AS rank FROM g""",
    "tool_counters": f"WITH {E} SELECT doc_id, sum(event_id % 5)::BIGINT AS passed, sum(event_id % 3)::BIGINT AS failed, sum(event_id % 2)::BIGINT AS skipped FROM e GROUP BY 1",
    "tool_columns": f"WITH {E} SELECT doc_id, line_no, 'pod-' || event_id || ' 1/1 ' || event_type || ' ' || event_id % 9 AS shown FROM e WHERE line_no > 0",
    "tool_records": f"""WITH {E}, r AS (SELECT doc_id, event_id, event_id || ' ' || event_type || ' open' AS shown, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM e)
      SELECT doc_id, string_agg(shown, chr(10) ORDER BY k) FILTER (WHERE k <= 5) || CASE WHEN max(n) > 5 THEN chr(10) || '+' || (max(n) - 5) || ' more' ELSE '' END AS shown FROM r GROUP BY 1""",
    "tool_filters": """SELECT event_id, [ 'make', 'ping', 'terraform-plan', NULL ][event_id % 4 + 1] AS filter, CASE event_id % 4
      WHEN 0 THEN 'PING host' || chr(10) || '64 bytes from host' || chr(10) || 'Refreshing state... x' || chr(10) || 'line ' || event_id
      WHEN 1 THEN 'make[1]: Entering directory' || chr(10) || 'Refreshing state... x' || chr(10) || 'line ' || event_id
      WHEN 2 THEN 'make[1]: Entering directory' || chr(10) || 'PING host' || chr(10) || '64 bytes from host' || chr(10) || 'line ' || event_id
      ELSE 'make[1]: Entering directory' || chr(10) || 'PING host' || chr(10) || '64 bytes from host' || chr(10) || 'Refreshing state... x' || chr(10) || chr(10) || 'line ' || event_id END AS filtered FROM events""",
    "git_status_counts": f"WITH {E} SELECT doc_id, ['untracked', 'staged', 'changed', 'conflict'][event_id % 5 + 1] AS state, count(*) AS n FROM e WHERE event_id % 5 < 4 GROUP BY 1, 2",
    "git_remote_only": f"WITH {E} SELECT DISTINCT doc_id, 'b' || event_id % 17 AS name FROM e WHERE event_id % 3 = 1 EXCEPT SELECT doc_id, 'b' || event_id % 17 FROM e WHERE event_id % 3 = 0",
    "files_by_extension": f"WITH {E} SELECT doc_id, ['py', 'rs', 'none'][event_id % 3 + 1] AS extension, count(*) AS n FROM e GROUP BY 1, 2",
    "files_by_directory": f"""WITH {E}, p AS (SELECT doc_id, '/srv/d' || event_id % 4 AS dir, 'f' || event_id % 11 || ['.py', '.RS', ''][event_id % 3 + 1] AS name FROM e)
      SELECT doc_id, dir, count(*) AS n, (list_sort(list(DISTINCT name)))[1:10] AS names, row_number() OVER (PARTITION BY doc_id ORDER BY dir) AS rank FROM p GROUP BY 1, 2""",
    "environment_masked": f"""WITH {E} SELECT doc_id, ['PATH', 'API_TOKEN', 'GOPATH', 'AWS_REGION'][event_id % 4 + 1] AS name, ['path', 'other', 'path', 'cloud'][event_id % 4 + 1] AS "group",
      CASE WHEN event_id % 4 = 1 THEN CASE WHEN length('v' || event_id) <= 4 THEN '****' ELSE left('v' || event_id, 2) || '****' || right('v' || event_id, 2) END ELSE 'v' || event_id END AS value FROM e""",
}
