"""Reading tables, and the views of them that the queries work on.

history() is the fact table of tool runs, log_lines() the lines of tool output, text_lines() the lines of documents,
session_commands() the commands of agent sessions. The *_SQL strings define the same views for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, tool_cmd, original_cmd, project_path, input_tokens, output_tokens, saved_tokens, savings_pct, exec_time_ms.

    A run with no tokens on either side passed through unfiltered.
    """
    passed = F.col("event_id") % 11 == 0
    tokens = F.round(F.col("value") * 100).cast("long")
    facts = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        "ts",
        F.concat(F.lit("tool "), "event_type").alias("tool_cmd"),
        F.concat("event_type", F.lit(" --u "), F.col("user_id").cast("string")).alias("original_cmd"),
        F.concat(F.lit("/p/"), (F.col("user_id") % 7).cast("string"), F.lit("/s"), (F.col("user_id") % 3).cast("string")).alias("project_path"),
        F.when(passed, 0).otherwise(tokens).cast("long").alias("input_tokens"),
        F.when(passed, 0).otherwise(F.floor(tokens * (F.col("event_id") % 12) / 10)).cast("long").alias("output_tokens"),
        (F.col("event_id") % 500).alias("exec_time_ms"),
    )
    return with_savings(facts)


def with_savings(facts: DataFrame) -> DataFrame:
    """facts with saved_tokens, never negative, and savings_pct, 0 without input."""
    saved = F.greatest(F.col("input_tokens") - F.col("output_tokens"), F.lit(0))
    pct = F.when(F.col("input_tokens") > 0, saved * 100.0 / F.col("input_tokens")).otherwise(0.0)
    return facts.withColumns({"saved_tokens": saved, "savings_pct": pct})


HISTORY_SQL = """
raw_history AS (
  SELECT event_id AS id, ts, 'tool ' || event_type AS tool_cmd, event_type || ' --u ' || user_id AS original_cmd,
         '/p/' || (user_id % 7) || '/s' || (user_id % 3) AS project_path,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE round(value * 100)::BIGINT END AS input_tokens,
         CASE WHEN event_id % 11 = 0 THEN 0 ELSE floor(round(value * 100)::BIGINT * (event_id % 12) / 10)::BIGINT END AS output_tokens,
         event_id % 500 AS exec_time_ms
  FROM events),
history AS (
  SELECT *, greatest(input_tokens - output_tokens, 0) AS saved_tokens,
         CASE WHEN input_tokens > 0 THEN greatest(input_tokens - output_tokens, 0) * 100.0::DOUBLE / input_tokens ELSE 0 END AS savings_pct
  FROM raw_history)
"""


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ts, raw_command, error_message, fallback_succeeded: command lines that could not be parsed."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), "ts", F.concat("event_type", F.lit(" ??")).alias("raw_command"), F.lit("unexpected argument").alias("error_message"), (F.col("event_id") % 3 == 0).alias("fallback_succeeded")
    )


FAILURES_SQL = "failures AS (SELECT event_id AS id, ts, event_type || ' ??' AS raw_command, event_id % 3 = 0 AS fallback_succeeded FROM events)"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (a user's log), line_no from 0, line."""
    events = table(spark, sf_dir, "events")
    user, event = F.col("user_id").cast("string"), F.col("event_id")
    message = (
        F.when(event % 6 == 0, F.concat(F.lit("ERROR request "), (event * 1000).cast("string"), F.lit(" failed at /srv/u"), user, F.lit("/f.log")))
        .when(event % 6 == 1, F.concat(F.lit("WARN deprecated call 0x"), F.lower(F.hex(event)), F.lit(" by user="), user))
        .when(event % 6 == 2, F.lit("INFO total results: 12 passed"))
        .when(event % 6 == 3, F.concat(F.lit("    at com.example.Job.run(Job.java:"), (event % 90).cast("string"), F.lit(")")))
        .when(event % 6 == 4, F.lit("INFO heartbeat"))
        .otherwise(F.lit("----------------"))
    )
    line = F.when(event % 6 == 5, message).when(event % 6 == 3, message).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), message))
    return events.select(F.col("user_id").alias("doc_id"), F.expr("row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1").cast("long").alias("line_no"), line.alias("line"))


LOGS_SQL = """
logs AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no,
         CASE event_id % 6
           WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ERROR request ' || event_id * 1000 || ' failed at /srv/u' || user_id || '/f.log'
           WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' WARN deprecated call 0x' || lower(to_hex(event_id)) || ' by user=' || user_id
           WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO total results: 12 passed'
           WHEN 3 THEN '    at com.example.Job.run(Job.java:' || event_id % 90 || ')'
           WHEN 4 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' INFO heartbeat'
           ELSE '----------------' END AS line
  FROM events)
"""


def line_arrays(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, lines: text split at line feeds, a last empty line left out, carriage returns trimmed; documents without text are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.filter(text != "").select("doc_id", F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1).alias("lines"))


def to_lines(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """doc_id, line_no from 0, line: the elements of line_arrays()."""
    return line_arrays(docs, text_col).select("doc_id", F.posexplode("lines").alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


LINES_SQL = r"""
lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no
  FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n\z', ''), '\r?\n') AS ls FROM documents WHERE coalesce(text, '') <> ''))
"""


def session_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, seq, command, is_error, output: each assistant turn and the user turn that answers it, by a left join."""
    turns = table(spark, sf_dir, "conversations")
    uses = turns.filter("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.col("text"))
    results = turns.filter("role = 'user'").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("seq"), F.col("text").alias("output"))
    tools = F.array(*map(F.lit, ("git status", "cargo test", "git log", "npm run", "docker ps")))
    command = F.concat(F.element_at(tools, (F.pmod(F.length("text"), F.lit(5)) + 1).cast("int")), F.lit(" --n "), F.pmod(F.length("text"), F.lit(4)).cast("string"), F.when(F.col("seq") % 3 == 0, F.lit(" -v")).otherwise(""))
    joined = uses.join(results, ["session_id", "seq"], "left")
    failed = F.pmod(F.length("text"), F.lit(3)) == 0
    return joined.select("session_id", "seq", command.alias("command"), failed.alias("is_error"), F.when(failed, F.concat(F.lit("error: unknown option in "), F.col("text"))).otherwise(F.coalesce("output", F.lit(""))).alias("output"))


SESSIONS_SQL = """
sessions AS (
  SELECT a.conv_id AS session_id, a.turn AS seq,
         (['git status', 'cargo test', 'git log', 'npm run', 'docker ps'])[length(a.text) % 5 + 1] || ' --n ' || length(a.text) % 4 || CASE WHEN a.turn % 3 = 0 THEN ' -v' ELSE '' END AS command,
         length(a.text) % 3 = 0 AS is_error,
         CASE WHEN length(a.text) % 3 = 0 THEN 'error: unknown option in ' || a.text ELSE coalesce(b.text, '') END AS output
  FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - 1 = a.turn AND b.role = 'user'
  WHERE a.role = 'assistant')
"""
