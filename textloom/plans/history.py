"""Savings analytics over the history of tool runs, and cost periods joined with savings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.sources.tables import FAILURES_SQL, HISTORY_SQL, failures, history, table

def totals() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("commands"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
        F.coalesce(F.sum("exec_time_ms"), F.lit(0)).alias("total_time_ms"),
    ]


TOTALS_SQL = "count(*) AS commands, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(saved_tokens), 0)::BIGINT AS saved_tokens, coalesce(sum(exec_time_ms), 0)::BIGINT AS total_time_ms"
# Tools by ecosystem.
ECOSYSTEMS = (
    ("git", ("git", "gh", "gt")),
    ("cargo", ("cargo",)),
    ("js", ("npm", "npx", "pnpm", "vitest", "tsc", "lint", "prettier", "next", "playwright", "prisma")),
    ("python", ("pytest", "ruff", "mypy", "pip")),
    ("go", ("go", "golangci-lint")),
    ("cloud", ("docker", "kubectl")),
    ("ruby", ("rspec", "rubocop", "rake")),
    ("dotnet", ("dotnet",)),
    ("system", ("ls", "tree", "grep", "find", "wc", "read", "env", "json", "log", "smart", "diff", "deps", "summary", "format")),
)


def ecosystem(command: Column) -> Column:
    """The ecosystem of a command's second word."""
    tool = F.get(F.split(command, r"\s+"), F.lit(1))
    return reduce(lambda c, e: c.when(tool.isin(*e[1]), e[0]), ECOSYSTEMS[1:], F.when(tool.isin(*ECOSYSTEMS[0][1]), ECOSYSTEMS[0][0])).otherwise("other")


def in_scope(path: Column, scope: str | None) -> Column:
    """True for the project itself and what lies below it; no scope takes all."""
    return F.lit(True) if scope is None else (path == scope) | path.startswith(scope + "/")


def summarize(facts: DataFrame, *keys) -> DataFrame:
    """Totals, and the derived share saved (a ratio of sums) and whole mean time."""
    sums = facts.groupBy(*keys).agg(*totals()) if keys else facts.agg(*totals())
    pct = F.when(F.col("input_tokens") > 0, F.col("saved_tokens") * 100.0 / F.col("input_tokens")).otherwise(0.0)
    mean = F.when(F.col("commands") > 0, F.expr("total_time_ms div commands")).otherwise(0)
    return sums.withColumns({"savings_pct": F.round(pct, 6), "avg_time_ms": mean})


DERIVED_SQL = "round(CASE WHEN input_tokens > 0 THEN saved_tokens * 100.0::DOUBLE / input_tokens ELSE 0 END, 6) AS savings_pct, CASE WHEN commands > 0 THEN total_time_ms // commands ELSE 0 END AS avg_time_ms"


def summary_sql(keys: str = "", suffix: str = "") -> str:
    by = f"{keys}, " if keys else ""
    group = f"GROUP BY ALL {suffix}" if keys else suffix
    return f"WITH {HISTORY_SQL} SELECT *, {DERIVED_SQL} FROM (SELECT {by}{TOTALS_SQL} FROM history {group})"


def newest(facts: DataFrame) -> Column:
    """The time of the newest row, as a literal that can be pushed into the scan."""
    return F.lit(str(facts.agg(F.max("ts")).first()[0])).cast("timestamp_ntz")


def retain(facts: DataFrame, days: int = 90) -> DataFrame:
    """Rows of the last days before the newest row."""
    return facts.filter(F.col("ts") >= newest(facts) - F.expr(f"INTERVAL {days} DAYS"))


def write_history(facts: DataFrame, path: str) -> None:
    """Append facts, partitioned by day."""
    facts.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_export(facts: DataFrame, path: str, kind: str) -> None:
    """Daily totals as CSV with a header or as JSON lines."""
    days = summarize(facts, F.to_date("ts").alias("day")).withColumn("savings_pct", F.round("savings_pct", 2))
    (days.write.option("header", True).csv(path) if kind == "csv" else days.write.json(path))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost per day: day, cost and tokens of each kind."""
    orders = table(spark, sf_dir, "orders")
    n = F.count(F.lit(1))
    return orders.groupBy(F.to_date("o_orderdate").alias("order_day")).agg(F.round(F.sum("o_totalprice"), 2).alias("cost"), n.alias("n")).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.datediff("order_day", F.lit("1992-01-01")), F.lit(45))).alias("day"), "cost", (F.col("n") * 100).alias("input_tok"), (F.col("n") * 40).alias("output_tok"), (F.col("n") * 10).alias("cache_write"), (F.col("n") * 70).alias("cache_read")
    ).groupBy("day").agg(F.round(F.sum("cost"), 2).alias("cost"), *[F.sum(c).alias(c) for c in ("input_tok", "output_tok", "cache_write", "cache_read")])


USAGE_SQL = """
usage AS (
  SELECT day, round(sum(cost), 2) AS cost, sum(n * 100)::BIGINT AS input_tok, sum(n * 40)::BIGINT AS output_tok, sum(n * 10)::BIGINT AS cache_write, sum(n * 70)::BIGINT AS cache_read
  FROM (SELECT DATE '2024-01-01' + CAST(((date_diff('day', DATE '1992-01-01', o_orderdate::DATE) % 45) + 45) % 45 AS INTEGER) AS day, round(sum(o_totalprice), 2) AS cost, count(*) AS n FROM orders GROUP BY o_orderdate::DATE)
  GROUP BY day)
"""


def economics(cost: DataFrame, facts: DataFrame, cost_label: Column, fact_label: Column) -> DataFrame:
    """Cost and savings by period: a full outer join; what lacks either side stays null.

    Weighted price of an input token: cost / (input + 5 output + 1.25 cache writes + 0.1 cache reads).
    """
    c = cost.groupBy(cost_label.alias("label")).agg(F.round(F.sum("cost"), 2).alias("cost"), *[F.sum(x).alias(x) for x in ("input_tok", "output_tok", "cache_write", "cache_read")])
    f = facts.groupBy(fact_label.alias("label")).agg(F.count(F.lit(1)).alias("commands"), F.sum("saved_tokens").alias("saved_tokens"))
    weighted = F.col("input_tok") + 5 * F.col("output_tok") + 1.25 * F.col("cache_write") + 0.1 * F.col("cache_read")
    active, total = F.col("input_tok") + F.col("output_tok"), F.col("input_tok") + F.col("output_tok") + F.col("cache_write") + F.col("cache_read")
    price = lambda units: F.when(units > 0, F.col("saved_tokens") * (F.col("cost") / units))
    return c.join(f, "label", "full").withColumns({"savings_weighted": F.round(price(weighted), 6), "savings_blended": F.round(price(total), 6), "savings_active": F.round(price(active), 6)})


def economics_sql(cost_label: str, fact_label: str) -> str:
    price = lambda units: f"round(CASE WHEN {units} > 0 THEN saved_tokens * (cost / ({units})) END, 6)"
    return f"""WITH {HISTORY_SQL}, {USAGE_SQL},
    c AS (SELECT {cost_label} AS label, round(sum(cost), 2) AS cost, sum(input_tok)::BIGINT AS input_tok, sum(output_tok)::BIGINT AS output_tok, sum(cache_write)::BIGINT AS cache_write, sum(cache_read)::BIGINT AS cache_read FROM usage GROUP BY 1),
    f AS (SELECT {fact_label} AS label, count(*) AS commands, sum(saved_tokens)::BIGINT AS saved_tokens FROM history GROUP BY 1)
    SELECT coalesce(c.label, f.label) AS label, cost, input_tok, output_tok, cache_write, cache_read, commands, saved_tokens,
           {price('input_tok + 5 * output_tok + 1.25::DOUBLE * cache_write + 0.1::DOUBLE * cache_read')} AS savings_weighted,
           {price('input_tok + output_tok + cache_write + cache_read')} AS savings_blended, {price('input_tok + output_tok')} AS savings_active
    FROM c FULL JOIN f ON c.label = f.label"""


def econ_totals(e: DataFrame) -> DataFrame:
    return e.agg(F.round(F.sum("cost"), 2).alias("cost"), F.sum("saved_tokens").alias("saved_tokens"), F.round(F.sum("savings_weighted"), 4).alias("savings_weighted"), F.round(F.avg("savings_active"), 4).alias("mean_active"), F.count("cost").alias("cost_days"), F.count("commands").alias("fact_days"))




def period(unit: str, column: str = "ts") -> Column:
    """The label of a day, week (its Monday) or month."""
    return F.date_format(column, "yyyy-MM") if unit == "month" else F.date_format(F.date_trunc(unit, column), "yyyy-MM-dd")


def day() -> Column:
    return F.to_date("ts").alias("day")


def week() -> Column:
    return F.to_date(F.date_trunc("week", "ts")).alias("week_start")


def month() -> Column:
    return period("month").alias("month")


LATEST = "(SELECT max(ts) FROM history)"


def snapshot(facts: DataFrame) -> DataFrame:
    """One row of counters: totals, tokens saved in the last day and 30 days, active days, projects, days since first seen."""
    last = newest(facts)
    since = lambda days: F.col("ts") >= last - F.expr(f"INTERVAL {days} DAYS")
    return facts.agg(
        F.count(F.lit(1)).alias("commands_total"), F.sum("saved_tokens").alias("tokens_saved"), F.sum(F.when(since(1), F.col("saved_tokens")).otherwise(0)).alias("saved_24h"), F.sum(F.when(since(30), F.col("saved_tokens")).otherwise(0)).alias("saved_30d"),
        F.round(F.sum("saved_tokens") * 100.0 / F.sum("input_tokens"), 6).alias("overall_pct"), F.countDistinct(F.when(since(30), F.to_date("ts"))).alias("active_days_30d"),
        F.countDistinct(F.when(F.col("project_path") != "", F.col("project_path"))).alias("projects"), F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("first_seen_days"),
        F.count_if(F.col("tool_cmd").startswith("tool view")).alias("meta_view"),
    )


def _history(f):
    return lambda spark, sf_dir: f(history(spark, sf_dir))


QUERIES = {
    "gain_by_command": _history(lambda h: h.groupBy("tool_cmd").agg(F.count(F.lit(1)).alias("n"), F.sum("saved_tokens").alias("saved"), F.round(F.avg("savings_pct"), 6).alias("avg_pct"), F.round(F.avg("exec_time_ms"), 6).alias("avg_ms")).orderBy(F.desc("saved"), "tool_cmd").limit(10)),
    "gain_summary": _history(summarize),
    "gain_by_day": _history(lambda h: summarize(h, day()).orderBy(F.desc("day")).limit(30)),
    "gain_all_days": _history(lambda h: summarize(h, day())),
    "gain_by_week": _history(lambda h: summarize(h, week()).withColumn("week_end", F.date_add("week_start", 6))),
    "gain_by_month": _history(lambda h: summarize(h, month())),
    "gain_recent": _history(lambda h: h.orderBy(F.desc("ts"), F.desc("id")).limit(10).select("id", "tool_cmd", "saved_tokens", F.round("savings_pct", 6).alias("savings_pct"))),
    "gain_rollup": _history(lambda h: h.rollup(month(), day()).agg(*totals())),
    "gain_cube": _history(lambda h: h.cube("tool_cmd", "project_path").agg(F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("n"))),
    "gain_scope": _history(lambda h: summarize(h.filter(in_scope(F.col("project_path"), "/p/3")))),
    "retention": _history(lambda h: retain(h, 7).groupBy(day()).agg(F.count(F.lit(1)).alias("n"))),
    "snapshot": _history(snapshot),
    "top_commands": _history(lambda h: h.groupBy("tool_cmd").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tool_cmd").limit(3).select(F.coalesce(F.get(F.split("tool_cmd", r"\s+"), F.lit(1)), "tool_cmd").alias("name"), "n")),
    "top_passthrough": _history(lambda h: h.filter("input_tokens = 0 and output_tokens = 0").groupBy(F.trim(F.substring_index("original_cmd", " ", 1)).alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(5)),
    "low_savings": _history(lambda h: h.filter("input_tokens > 0").groupBy("original_cmd").agg(F.avg("savings_pct").alias("a"), F.count(F.lit(1)).alias("n")).filter("a < 30 and a > 0").orderBy(F.desc("n"), "original_cmd").limit(10).select(F.array_join(F.slice(F.split("original_cmd", r"\s+"), 1, 3), " ").alias("name"), F.round("a", 6).alias("avg_pct"), "n")),
    "bypass_rates": _history(lambda h: h.groupBy(F.substring_index("original_cmd", " ", 1).alias("slug")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("input_tokens") == 0).alias("bypassed")).withColumn("rate", F.round(F.col("bypassed") / F.col("total"), 6))),
    "avg_of_averages": _history(lambda h: h.filter("input_tokens > 0").groupBy("tool_cmd").agg(F.avg("savings_pct").alias("a")).agg(F.round(F.avg("a"), 6).alias("avg_pct"))),
    "ecosystem_mix": _history(lambda h: h.groupBy(ecosystem(F.concat(F.lit("x "), F.element_at(F.array(*map(F.lit, ("git", "npm", "pytest", "ls", "zig"))), (F.col("id") % 5 + 1).cast("int")))).alias("ecosystem")).agg(F.count(F.lit(1)).alias("n")).withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))).orderBy(F.desc("n"), "ecosystem").limit(8)),
    "command_metrics": _history(lambda h: h.groupBy("tool_cmd", F.expr("width_bucket(exec_time_ms, 0, 500, 9)").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.sum("saved_tokens").alias("saved"))),
    "failure_summary": lambda s, d: failures(s, d).groupBy("raw_command").agg(F.count(F.lit(1)).alias("n"), F.count_if("fallback_succeeded").alias("recovered")).withColumn("recovery_pct", F.round(F.col("recovered") * 100.0 / F.col("n"), 6)).orderBy(F.desc("n"), "raw_command").limit(10),
    "econ_daily": lambda s, d: economics(usage(s, d), history(s, d), period("day", "day"), period("day")),
    "econ_weekly": lambda s, d: economics(usage(s, d), history(s, d), period("week", "day"), period("week")),
    "econ_monthly": lambda s, d: economics(usage(s, d), history(s, d), period("month", "day"), period("month")),
    "econ_totals": lambda s, d: econ_totals(economics(usage(s, d), history(s, d), period("day", "day"), period("day"))),
}

H = f"WITH {HISTORY_SQL} "
ORACLES = {
    "gain_by_command": H + "SELECT tool_cmd, count(*) AS n, sum(saved_tokens)::BIGINT AS saved, round(avg(savings_pct), 6) AS avg_pct, round(avg(exec_time_ms), 6) AS avg_ms FROM history GROUP BY 1 ORDER BY saved DESC, tool_cmd LIMIT 10",
    "gain_summary": summary_sql(),
    "gain_by_day": summary_sql("ts::DATE AS day", "ORDER BY day DESC LIMIT 30"),
    "gain_all_days": summary_sql("ts::DATE AS day"),
    "gain_by_week": f"SELECT *, week_start + 6 AS week_end FROM ({summary_sql('date_trunc($$week$$, ts)::DATE AS week_start')})",
    "gain_by_month": summary_sql("strftime(ts, '%Y-%m') AS month"),
    "gain_recent": H + "SELECT id, tool_cmd, saved_tokens, round(savings_pct, 6) AS savings_pct FROM history ORDER BY ts DESC, id DESC LIMIT 10",
    "gain_rollup": H + f"SELECT strftime(ts, '%Y-%m') AS month, ts::DATE AS day, {TOTALS_SQL} FROM history GROUP BY ROLLUP (strftime(ts, '%Y-%m'), ts::DATE)",
    "gain_cube": H + "SELECT tool_cmd, project_path, sum(saved_tokens)::BIGINT AS saved, count(*) AS n FROM history GROUP BY CUBE (tool_cmd, project_path)",
    "gain_scope": summary_sql("", "WHERE project_path = '/p/3' OR starts_with(project_path, '/p/3/')"),
    "retention": H + f"SELECT ts::DATE AS day, count(*) AS n FROM history WHERE ts >= {LATEST} - INTERVAL 7 DAYS GROUP BY 1",
    "snapshot": H + f"""SELECT count(*) AS commands_total, sum(saved_tokens)::BIGINT AS tokens_saved,
        coalesce(sum(saved_tokens) FILTER (WHERE ts >= {LATEST} - INTERVAL 1 DAYS), 0)::BIGINT AS saved_24h, coalesce(sum(saved_tokens) FILTER (WHERE ts >= {LATEST} - INTERVAL 30 DAYS), 0)::BIGINT AS saved_30d,
        round(sum(saved_tokens) * 100.0::DOUBLE / sum(input_tokens), 6) AS overall_pct, count(DISTINCT ts::DATE) FILTER (WHERE ts >= {LATEST} - INTERVAL 30 DAYS) AS active_days_30d,
        count(DISTINCT project_path) AS projects, date_diff('day', min(ts), max(ts)) AS first_seen_days, count(*) FILTER (WHERE starts_with(tool_cmd, 'tool view')) AS meta_view FROM history""",
    "top_commands": H + "SELECT string_split(tool_cmd, ' ')[2] AS name, count(*) AS n FROM history GROUP BY tool_cmd ORDER BY n DESC, tool_cmd LIMIT 3",
    "top_passthrough": H + "SELECT string_split(original_cmd, ' ')[1] AS name, count(*) AS n FROM history WHERE input_tokens = 0 AND output_tokens = 0 GROUP BY 1 ORDER BY n DESC, name LIMIT 5",
    "low_savings": H + "SELECT original_cmd AS name, round(avg(savings_pct), 6) AS avg_pct, count(*) AS n FROM history WHERE input_tokens > 0 GROUP BY original_cmd HAVING avg(savings_pct) < 30 AND avg(savings_pct) > 0 ORDER BY n DESC, original_cmd LIMIT 10",
    "bypass_rates": H + "SELECT string_split(original_cmd, ' ')[1] AS slug, count(*) AS total, count(*) FILTER (WHERE input_tokens = 0) AS bypassed, round(count(*) FILTER (WHERE input_tokens = 0) / count(*), 6) AS rate FROM history GROUP BY 1",
    "avg_of_averages": H + "SELECT round(avg(a), 6) AS avg_pct FROM (SELECT avg(savings_pct) AS a FROM history WHERE input_tokens > 0 GROUP BY tool_cmd)",
    "ecosystem_mix": "SELECT e AS ecosystem, n, round(n * 100.0::DOUBLE / sum(n) OVER ()) AS pct FROM (SELECT ['git', 'js', 'python', 'system', 'other'][event_id % 5 + 1] AS e, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, e LIMIT 8",
    "command_metrics": H + "SELECT tool_cmd, (exec_time_ms * 9 // 500 + 1)::BIGINT AS bucket, count(*) AS n, sum(saved_tokens)::BIGINT AS saved FROM history GROUP BY 1, 2",
    "failure_summary": f"WITH {FAILURES_SQL} SELECT raw_command, count(*) AS n, count(*) FILTER (WHERE fallback_succeeded) AS recovered, round(count(*) FILTER (WHERE fallback_succeeded) * 100.0::DOUBLE / count(*), 6) AS recovery_pct FROM failures GROUP BY 1 ORDER BY n DESC, raw_command LIMIT 10",
    "econ_daily": economics_sql("strftime(day, '%Y-%m-%d')", "strftime(ts, '%Y-%m-%d')"),
    "econ_weekly": economics_sql("strftime(date_trunc('week', day), '%Y-%m-%d')", "strftime(date_trunc('week', ts), '%Y-%m-%d')"),
    "econ_monthly": economics_sql("strftime(day, '%Y-%m')", "strftime(ts, '%Y-%m')"),
    "econ_totals": f"SELECT round(sum(cost), 2) AS cost, sum(saved_tokens)::BIGINT AS saved_tokens, round(sum(savings_weighted), 4) AS savings_weighted, round(avg(savings_active), 4) AS mean_active, count(cost) AS cost_days, count(commands) AS fact_days FROM ({economics_sql('strftime(day, $$%Y-%m-%d$$)', 'strftime(ts, $$%Y-%m-%d$$)')})",
}
