"""Queries over scalar functions: numbers, paths, dates, hashes, costs, routes, and lines by number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.plans import texts
from textloom.sources.tables import FAILURES_SQL, HISTORY_SQL, LINES_SQL, LOGS_SQL, failures, history, log_lines, table, text_lines

TAIL = 5


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(spark, sf_dir).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return lines.select("doc_id", "line_no", X.numbered(F.col("line"), F.col("line_no") + 1, F.col("of")).alias("line"))


def _tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last lines of each document; Spark keeps TAIL rows of a document in each task before the shuffle."""
    back = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("line_no")))
    return text_lines(spark, sf_dir).withColumn("back", back).filter(F.col("back") <= TAIL).select("doc_id", "line_no", "line")


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    path = F.when(event % 3 == 0, "/usr/bin/").when(event % 3 == 1, "./tools/").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", X.strip_program_path(F.concat(path, "event_type", F.lit(" -x /a/b "), event.cast("string"))).alias("command"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = X.simple_cost(F.sum("input_tokens"), F.sum("output_tokens"))
    by = history(spark, sf_dir).groupBy("tool_cmd").agg(F.round(cost, 9).alias("dollars"), F.round(100.0 * cost / (cost + 1.0), 9).alias("percent"), F.sum("input_tokens").alias("n"))
    return by.select("tool_cmd", "dollars", "percent", X.cost_per_million(F.floor(F.col("n") % 97).cast("double") / 4_000_000.0).alias("rate"))


def _uuids(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    digest = F.md5(event.cast("string"))
    part = lambda a, n: F.substring(digest, a, n)
    made = F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))
    value = F.when(event % 3 == 0, made).when(event % 3 == 1, digest).otherwise(F.concat(made, F.lit("0")))
    return table(spark, sf_dir, "events").groupBy(X.is_uuid(value).alias("is_uuid")).agg(F.count(F.lit(1)).alias("n"))


def _directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory that the paths of each user share; a single path has none."""
    path = F.expr("concat('/srv/u', user_id % 3, '/d', event_id % (1 + user_id % 2), '/f', event_id)")
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(path).alias("low"), F.max(path).alias("high"), F.count(F.lit(1)).alias("n"))
    return by.select("user_id", F.when(F.col("n") > 1, X.common_directory(F.col("low"), F.col("high"))).otherwise("").alias("directory"))


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The format of each user's log, told by the first of its ten first lines that tells one."""
    forms = F.array(*map(F.lit, ("step", " t PASSED", "PASS a.test.js", "Compiling x", "npm WARN y", "make[1]: go", "PASS a", "done")))
    lines = table(spark, sf_dir, "events").select(
        "user_id", F.element_at(forms, (F.col("event_id") % 8 + 1).cast("int")).alias("line"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line_no")
    )
    told = X.line_format(F.col("line"))
    first = F.min_by(F.when(F.col("line_no") <= 10, told), F.when((F.col("line_no") <= 10) & told.isNotNull(), F.col("line_no")))
    return lines.groupBy("user_id").agg(F.coalesce(first, F.lit("generic")).alias("format"))


QUERIES = {
    "common_directories": _directories,
    "log_formats": _formats,
    "match_windows": lambda s, d: text_lines(s, d).select("doc_id", "line_no", X.window_around(F.col("line"), "an", 60).alias("shown")),
    "json_minified": lambda s, d: table(s, d, "events").select("event_id", X.minify_json(F.concat(F.lit(" "), F.replace(F.col("props"), F.lit(":"), F.lit(" :\n ")))).alias("props")),
    "numbered_lines": _numbered,
    "tail_lines": _tail,
    "stripped_programs": _commands,
    "simple_costs": _costs,
    "uuid_values": _uuids,
    "byte_entropy": lambda s, d: table(s, d, "documents").filter("text <> ''").select("doc_id", F.round(X.byte_entropy("text"), 6).alias("entropy")),
    "field_hashes": lambda s, d: table(s, d, "events").select(F.col("event_type").alias("name"), X.field_hash(F.col("event_type")).alias("hash")).distinct(),
    "passed_numbers": lambda s, d: log_lines(s, d).groupBy("doc_id").agg(F.sum(X.number_before(F.col("line"), "passed")).alias("passed")),
    "level_priorities": lambda s, d: log_lines(s, d).groupBy(X.level_priority(X.log_level(F.col("line"))).alias("priority")).agg(F.count(F.lit(1)).alias("n")),
    "content_routes": lambda s, d: table(s, d, "documents").select(F.coalesce("text", F.lit("")).alias("text")).groupBy(X.route(X.content_type(F.col("text"))).alias("route")).agg(F.count(F.lit(1)).alias("n")),
    "failures_since": lambda s, d: failures(s, d).filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).agg(F.count(F.lit(1)).alias("n")),
    "event_dates": lambda s, d: table(s, d, "events").groupBy(X.iso_date(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("date")).agg(F.count(F.lit(1)).alias("n")),
}

#: Values are written out here, not taken from the library.
ORACLES = {
    "common_directories": "SELECT user_id, CASE WHEN count(*) = 1 THEN '' ELSE '/srv/u' || user_id % 3 || '/' || CASE WHEN min(event_id % (1 + user_id % 2)) = max(event_id % (1 + user_id % 2)) THEN 'd' || min(event_id % (1 + user_id % 2)) || '/' ELSE '' END END AS directory FROM events GROUP BY user_id",
    "log_formats": "WITH l AS (SELECT user_id, event_id, event_id % 8 AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), f AS (SELECT user_id, arg_min(k, event_id) FILTER (r <= 10 AND k BETWEEN 1 AND 5) AS k FROM l GROUP BY 1) SELECT user_id, coalesce((['pytest', 'jest', 'cargo', 'npm', 'make'])[k], 'generic') AS format FROM f",
    "match_windows": f"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines), p AS (SELECT *, instr(lower(t), 'an') AS hit, length(t) AS n FROM t), q AS (SELECT *, CASE WHEN greatest(hit - 21, 0) + 60 >= n THEN greatest(n - 60, 0) ELSE greatest(hit - 21, 0) END AS b FROM p)
      SELECT doc_id, line_no, CASE WHEN strlen(t) <= 60 THEN t WHEN hit = 0 THEN left(t, 57) || '...' ELSE CASE WHEN b > 0 THEN '...' ELSE '' END || substring(t, b + 1, 60) || CASE WHEN b + 60 < n OR b = 0 THEN '...' ELSE '' END END AS shown FROM q""",
    "json_minified": "SELECT event_id, json(props)::VARCHAR AS props FROM events",
    "numbered_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, lpad((line_no + 1)::VARCHAR, length(n::VARCHAR)::INT, ' ') || ' │ ' || line AS line FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM lines)",
    "tail_lines": f"WITH {LINES_SQL} SELECT doc_id, line_no, line FROM (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines) WHERE line_no > last - 5",
    "stripped_programs": "SELECT event_id, event_type || ' -x /a/b ' || event_id AS command FROM events",
    "simple_costs": f"WITH {HISTORY_SQL}, c AS (SELECT tool_cmd, (sum(input_tokens) * 3.0::DOUBLE + sum(output_tokens) * 15.0::DOUBLE) / 1000000 AS c, (sum(input_tokens) % 97) / 4.0::DOUBLE AS r FROM history GROUP BY 1) SELECT tool_cmd, round(c, 9) AS dollars, round(100 * c / (c + 1), 9) AS percent, '$' || printf('%.2f', r) || '/MTok' AS rate FROM c",
    "uuid_values": "SELECT event_id % 3 = 0 AS is_uuid, count(*) AS n FROM events GROUP BY 1",
    "byte_entropy": "WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents WHERE text <> ''), n AS (SELECT doc_id, b, count(*) AS n FROM b GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1",
    "field_hashes": "SELECT DISTINCT event_type AS name, left(sha256(event_type), 8) AS hash FROM events",
    "passed_numbers": f"WITH {LOGS_SQL} SELECT doc_id, sum(CASE WHEN contains(line, '12 passed') THEN 12 END)::BIGINT AS passed FROM logs GROUP BY 1",
    "level_priorities": f"WITH {LOGS_SQL} SELECT CASE WHEN contains(line, ' ERROR ') THEN 100 WHEN contains(line, ' WARN ') THEN 70 WHEN contains(line, ' INFO ') THEN 40 ELSE 30 END AS priority, count(*) AS n FROM logs GROUP BY 1",
    "content_routes": f"SELECT CASE content_type WHEN 'json_array' THEN 'json' WHEN 'code' THEN 'code' WHEN 'search' THEN 'logs' WHEN 'build' THEN 'logs' WHEN 'diff' THEN 'git_diff' WHEN 'html' THEN 'html' ELSE 'plain_text' END AS route, count(*) AS n FROM ({texts.ORACLES['content_types']}) GROUP BY 1",
    "failures_since": f"WITH {FAILURES_SQL} SELECT count(*) AS n FROM failures WHERE ts >= TIMESTAMP '2024-01-15'",
    "event_dates": "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1",
}
