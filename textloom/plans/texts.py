"""Queries over lines and documents: estimators, classifiers, redaction, runs, ranking, filters, near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators import documents, dsl, neardup, runs
from textloom.sources.tables import LINES_SQL, LOGS_SQL, line_arrays, log_lines, table, text_lines

LOG, LINE = f"WITH {LOGS_SQL} ", f"WITH {LINES_SQL} "
WS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TRIM = f"trim(line, {WS})"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _docs(*columns):
    return lambda s, d: docs(s, d).select("doc_id", *(c() for c in columns))


def _logs(f):
    return lambda s, d: f(log_lines(s, d))


def _lines(f):
    return lambda s, d: f(text_lines(s, d))


def _alternation(words) -> str:
    return "|".join(words)


def severity_sql(line: str) -> str:
    rules = []
    for name, words in X.SEVERITY_WORDS:
        more = {"error": "|error:", "warning": "|warning:"}.get(name, "")
        rules.append(f"WHEN regexp_matches(lower({line}), '(^|[^a-z0-9_])({_alternation(words)})([^a-z0-9_]|$){more}') THEN '{name}'")
    return f"CASE {' '.join(rules)} ELSE 'unknown' END"


def keyword_sql(line: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({line}), '{_alternation(w)}') THEN '{n}'" for n, w in X.KEYWORDS) + " ELSE 'plain' END"


def level_sql(line: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({line}), '{_alternation(w)}') THEN '{n}'" for n, w in X.LOG_LEVELS) + " END"


def _replaced(column: str, rules) -> str:
    for pattern, replacement in rules:
        column = f"regexp_replace({column}, '{pattern.replace(chr(39), chr(39) * 2)}', '{replacement.replace('$1', chr(92) + '1').replace('$2', chr(92) + '2')}', 'g')"
    return column


def normalize_sql(line: str) -> str:
    return f"trim({_replaced(line, X.LOG_NORMAL)}, {WS})"


TEXT = "coalesce(text, '')"
JSON_LIKE = f"((starts_with(t, '{{') AND ends_with(t, '}}')) OR (starts_with(t, '[') AND ends_with(t, ']')))"
CODE_COUNT = " + ".join(f"contains({TEXT}, '{m}')::INT" for m in X.CODE_MARKS)
IMPORTANCE = """CASE WHEN regexp_matches(l, 'fatal|panic|critical') THEN 'error:0.98' WHEN regexp_matches(l, '^(error:|error\\])') THEN 'error:0.9025' WHEN regexp_matches(l, 'exception|errorcode|errno') THEN 'error:0.81'
 WHEN regexp_matches(l, 'failed| fail |failure') THEN 'error:0.7225' WHEN regexp_matches(l, 'warn') THEN 'warning:0.68' WHEN regexp_matches(l, 'deprecated') THEN 'warning:0.6' END"""
SPEC = dsl.Filter(
    name="sample",
    replace=({"pattern": r"\d+", "replacement": "#"},),
    match_output=({"pattern": "^heartbeat$", "message": "ok"},),
    strip_lines_matching=(r"heartbeat$", r"^-+$"),
    truncate_lines_at=40,
    head_lines=3,
    tail_lines=2,
    max_lines=5,
    on_empty="(nothing)",
)


def _dsl(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    outputs = log_lines(spark, sf_dir).groupBy("doc_id").agg(F.array_join(ordered, "\n").alias("text"))
    return outputs.select("doc_id", dsl.apply(SPEC, F.col("text")).alias("filtered"))


DSL_SQL = LOG + r""",
r AS (SELECT doc_id, line_no, regexp_replace(line, '\d+', '#', 'g') AS line FROM logs),
k AS (SELECT doc_id, list(CASE WHEN length(line) <= 40 THEN line ELSE left(line, 37) || '...' END ORDER BY line_no) FILTER (WHERE NOT regexp_matches(line, 'heartbeat$|^-+$')) AS ls FROM r GROUP BY doc_id),
h AS (SELECT doc_id, CASE WHEN len(ls) > 5 THEN list_concat(ls[1:3], ['... (' || (len(ls) - 5) || ' lines omitted)'], ls[-2:]) ELSE ls END AS ls FROM k),
m AS (SELECT doc_id, CASE WHEN len(ls) > 5 THEN list_concat(ls[1:5], ['... (' || (len(ls) - 5) || ' lines truncated)']) ELSE ls END AS ls FROM h)
SELECT doc_id, CASE WHEN coalesce(trim(array_to_string(ls, chr(10))), '') = '' THEN '(nothing)' ELSE array_to_string(ls, chr(10)) END AS filtered FROM m"""


def _level_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = log_lines(spark, sf_dir)
    return runs.cap_with_context(lines, X.severity(F.col("line")), {"error": 5, "warning": 3, "info": 2, "unknown": 1})


def _score(line=None):
    return X.lookup(X.keyword_level(F.col("line")), X.KEYWORD_SCORES) + F.when(X.is_stack_line(F.col("line")), 0.3).otherwise(0.0) + F.when(X.keyword_level(F.col("line")) == "summary", 0.4).otherwise(0.0)


SCORE_SQL = f"(CASE {keyword_sql('line')} WHEN 'error' THEN 1.0::DOUBLE WHEN 'security' THEN 0.85 WHEN 'warning' THEN 0.75 WHEN 'summary' THEN 0.4 ELSE 0 END + CASE WHEN starts_with({TRIM}, 'at ') AND contains(line, '(') THEN 0.3::DOUBLE ELSE 0 END + CASE {keyword_sql('line')} WHEN 'summary' THEN 0.4::DOUBLE ELSE 0 END)"


def _search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search output made of document lines: file:line:text, several files an output."""
    lines = text_lines(spark, sf_dir).filter("line <> ''")
    file = F.concat(F.lit("src/f"), (F.col("line_no") % 4).cast("string"), F.when(F.col("line_no") % 2 == 0, ".py").otherwise(".txt"))
    return lines.select("doc_id", "line_no", F.concat(file, F.lit(":"), F.col("line_no").cast("string"), F.lit(":"), "line").alias("line"))


SEARCH_SQL = LINE + r""",
s AS (SELECT doc_id, line_no, 'src/f' || line_no % 4 || CASE WHEN line_no % 2 = 0 THEN '.py' ELSE '.txt' END AS file, line AS content FROM lines WHERE line <> ''),
p AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(content, '^\d+:.') THEN 1 ELSE 0 END AS odd, file, content FROM s),
q AS (SELECT *, round(greatest(0, least(1, 0.3::DOUBLE + CASE WHEN regexp_matches(lower(content), 'error|fail|exception|panic|crash') THEN 0.3 ELSE 0 END
  + CASE WHEN regexp_matches(lower(content), 'warn|deprecated') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(lower(content), 'fn |def |class |struct |impl |trait |function ') THEN 0.2 ELSE 0 END
  + CASE WHEN regexp_matches(lower(content), 'test|spec|it\(|describe\(') THEN 0.1 ELSE 0 END + CASE WHEN ends_with(file, '.py') THEN 0.1 ELSE 0 END - CASE WHEN strlen(content) > 200 THEN 0.1 ELSE 0 END
  - CASE WHEN regexp_matches(trim(content), '^(//|#|/\*|\*)') THEN 0.15 ELSE 0 END)), 6) AS score FROM p WHERE odd = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, file ORDER BY score DESC, line_no) AS rank, round(max(score) OVER (PARTITION BY doc_id, file) + 0.5 * avg(score) OVER (PARTITION BY doc_id, file), 6) AS file_score FROM q WHERE score >= 0.1)
SELECT * FROM (SELECT doc_id, line_no, file, rank, dense_rank() OVER (PARTITION BY doc_id ORDER BY file_score DESC, file) AS file_rank FROM r) WHERE rank <= 10 AND file_rank <= 20"""


def _search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _search_lines(spark, sf_dir).filter(~F.col("line").rlike(r"^[^:]+:\d+:\d+:."))
    return documents.search_rank(lines).select("doc_id", "line_no", "file", "rank", "file_rank")


def _pairs_of_documents(spark: SparkSession, sf_dir: str):
    """Each document and its successor, as the two sides of a positional diff."""
    lines = text_lines(spark, sf_dir)
    return lines.filter("doc_id % 2 = 0"), lines.filter("doc_id % 2 = 1").withColumn("doc_id", F.col("doc_id") - 1)


def _positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _pairs_of_documents(spark, sf_dir)
    return documents.positional_diff(left, right).groupBy("doc_id", "change").agg(F.count(F.lit(1)).alias("n"))


def _entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = table(spark, sf_dir, "documents").filter("text <> ''")
    return some.select("doc_id", F.round(X.char_entropy("text"), 6).alias("entropy"))


def _set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (text_lines(spark, sf_dir).filter(f"doc_id % 2 = {i}").select("line") for i in (0, 1))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(name))
    return one(a.union(b).distinct(), "union").unionByName(one(a.intersect(b), "intersect")).unionByName(one(a.subtract(b), "except"))


def _diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A unified diff for each document: one hunk, every third line a change."""
    lines = text_lines(spark, sf_dir)
    mark = F.when(F.col("line_no") % 9 == 4, "+").when(F.col("line_no") % 9 == 5, "-").otherwise(" ")
    body = lines.select("doc_id", (F.col("line_no") + 2).alias("line_no"), F.concat(mark, "line").alias("line"))
    ids = lines.select("doc_id").distinct()
    head = ids.select("doc_id", F.lit(0).cast("long").alias("line_no"), F.lit("diff --git a/f b/f").alias("line")).unionByName(ids.select("doc_id", F.lit(1).cast("long").alias("line_no"), F.lit("@@ -1,9 +1,9 @@").alias("line")))
    return head.unionByName(body)


DIFF_SQL = LINE + """, d AS (SELECT doc_id, line_no + 2 AS line_no, CASE line_no % 9 WHEN 4 THEN '+' WHEN 5 THEN '-' ELSE ' ' END AS kind FROM lines)"""

QUERIES = {
    "line_explode": _lines(lambda x: x),
    "token_estimates": _docs(lambda: X.tokens_by_bytes(F.col("text")).alias("by_bytes"), lambda: X.tokens_by_content(F.col("text")).alias("by_content"), lambda: X.tokens_approximate(F.col("text")).alias("approximate"), lambda: X.words(F.col("text")).alias("words")),
    "severity_counts": _logs(lambda x: x.groupBy("doc_id", X.severity(F.col("line")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))),
    "keyword_levels": _logs(lambda x: x.groupBy(X.keyword_level(F.col("line")).alias("level")).agg(F.count(F.lit(1)).alias("n"))),
    "importance_signals": _logs(lambda x: x.withColumn("s", X.importance(F.col("line"))).filter("s is not null").groupBy(F.col("s.category").alias("category"), F.round(X.effective(F.col("s")), 6).alias("effective")).agg(F.count(F.lit(1)).alias("n"))),
    "separator_lines": _logs(lambda x: x.filter(X.separator_share(F.col("line")) >= 0.8).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))),
    "length_bands": _lines(lambda x: x.withColumn("s", X.length_signal(F.col("line"))).filter("s is not null").groupBy(F.col("s.priority").alias("priority"), F.col("s.confidence").alias("confidence")).agg(F.count(F.lit(1)).alias("n"))),
    "line_scores": _logs(lambda x: x.select("doc_id", "line_no", F.round(_score(), 6).alias("score"))),
    "select_by_score": _logs(lambda x: runs.select_by_score(x, F.round(_score(), 6), 12).select("doc_id", "line_no")),
    "default_scores": _lines(lambda x: x.groupBy(X.default_line_score(F.col("line")).alias("score")).agg(F.count(F.lit(1)).alias("n"))),
    "redact_text": _docs(lambda: X.redact(F.col("text")).alias("redacted")),
    # as a row of stack() the count is worked out once, not again in the filter
    "redact_counts": lambda s, d: docs(s, d).select("doc_id", F.stack(F.lit(1), X.redact_count(F.col("text"))).alias("n")).filter("n > 0"),
    "hash_paths": lambda s, d: table(s, d, "pages").select("page_id", X.hash_path(F.regexp_replace("url", r"^https?:/", "")).alias("hashed")),
    "mask_values": lambda s, d: table(s, d, "events").select("event_id", X.mask(F.col("event_type")).alias("masked"), X.mask(F.col("event_id").cast("string")).alias("masked_id")),
    "content_keys": _docs(lambda: X.content_marker(X.content_key(F.col("text"))).alias("marker"), lambda: X.secret_digest(F.col("text")).alias("digest")),
    "content_types": _docs(lambda: X.content_type(F.col("text")).alias("content_type")),
    "anchors_top": _logs(lambda x: x.withColumn("kind", X.anchor_type(F.col("line"))).filter("kind is not null").withColumn("rank", F.row_number().over(runs.by_doc().orderBy(F.desc(X.anchor_priority(F.col("line"))), "line_no"))).filter("rank <= 20").select("doc_id", "line_no", "kind", "rank")),
    "query_anchors": _docs(lambda: F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all("text", F.lit(f"({X.UUID})")), F.regexp_extract_all("text", F.lit(r"\b(\d{4,})\b")), F.regexp_extract_all("text", F.lit(r"([\w.+-]+@[\w-]+\.[\w.]+)"))))).alias("anchors")),
    "normalize_lines": _logs(lambda x: x.groupBy(X.normalize_log_line(F.col("line")).alias("template")).agg(F.count(F.lit(1)).alias("n"))),
    "log_summary": _logs(documents.log_summary),
    "run_length": _lines(lambda x: runs.run_length(x)),
    "adjacent_dedupe": _lines(lambda x: runs.adjacent_dedupe(x)),
    "dsl_pipeline": _dsl,
    "level_caps_context": _level_caps,
    "stack_traces": _logs(runs.stack_traces),
    "error_blocks": _logs(lambda x: runs.blocks(x, "ERROR").select("doc_id", "first_line", "last_line", F.sha2("block", 256).alias("block_sha256"))),
    "bigram_coverage": lambda s, d: runs.bigram_coverage(line_arrays(table(s, d, "documents"))).select("doc_id", "line_no", F.round("coverage", 6).alias("coverage")),
    "knee_lines": lambda s, d: runs.knee(line_arrays(table(s, d, "documents"))),
    "token_budget": _logs(lambda x: runs.token_budget(x, F.round(_score(), 6), 200).select("doc_id", "line_no")),
    "search_rank": _search_rank,
    "diff_positional": _positional,
    "diff_trim_context": lambda s, d: documents.trim_context(documents.parse_diff(_diff_lines(s, d))).select("doc_id", "line_no", "kind"),
    "hunk_scores": lambda s, d: documents.hunk_scores(documents.parse_diff(_diff_lines(s, d))).select("doc_id", F.round("score", 6).alias("score")),
    "set_operations": _set_operations,
    "entropy": _entropy,
    "fnv_simhash": _docs(lambda: neardup.simhash_udf(F.col("text")).alias("simhash")),
    "sip_simhash": _docs(lambda: neardup.sip_simhash_udf(F.col("text")).alias("simhash")),
    "neardup_pairs": lambda s, d: neardup.similar_pairs(docs(s, d).select(F.col("doc_id").alias("id"), neardup.simhash_udf(F.col("text")).alias("hash"))),
    "window_dedup": _logs(lambda x: neardup.window_dedup(x).select("doc_id", "line_no")),
    "unique_lines": _logs(lambda x: neardup.count_unique(x)),
    "code_filter": lambda s, d: documents.code_filter(docs(s, d), F.lit("python")).select("doc_id", F.sha2("code", 256).alias("code_sha256")),
    "overflow_lists": _lines(lambda x: x.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("items")).select("doc_id", X.join_with_overflow(F.col("items"), 3, "lines").alias("joined"))),
    "formats": lambda s, d: table(s, d, "events").select("event_id", X.format_tokens(F.col("event_id") * 977).alias("tokens"), X.format_duration((F.col("event_id") * 37).cast("long")).alias("duration"), X.truncate(F.col("props"), 7).alias("props")),
}

ORACLES = {
    "line_explode": LINE + "SELECT doc_id, line_no, line FROM lines",
    "token_estimates": rf"""SELECT doc_id, least(ceil(strlen({TEXT}) / 4), 1000000)::BIGINT AS by_bytes,
      CASE WHEN {TEXT} = '' THEN 0 ELSE greatest(1, floor(length(text) / CASE WHEN {JSON_LIKE} THEN 3.2::DOUBLE WHEN {CODE_COUNT} >= 2 THEN 3.5 ELSE 4.0 END)::BIGINT + 3 * len(regexp_extract_all(text, 'https?://')) + 2 * len(regexp_extract_all(text, '{X.UUID}'))) END AS by_content,
      CASE WHEN {TEXT} = '' THEN 0 ELSE greatest(1, ceil((length(text) / 3.5::DOUBLE + len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE) / 2)::BIGINT) END AS approximate, len(regexp_extract_all({TEXT}, '\S+')) AS words
      FROM (SELECT *, trim({TEXT}, {WS}) AS t FROM documents)""",
    "severity_counts": LOG + f"SELECT doc_id, {severity_sql('line')} AS severity, count(*) AS n FROM logs GROUP BY ALL",
    "keyword_levels": LOG + f"SELECT {keyword_sql('line')} AS level, count(*) AS n FROM logs GROUP BY ALL",
    "importance_signals": LOG + f"SELECT string_split(s, ':')[1] AS category, string_split(s, ':')[2]::DOUBLE AS effective, count(*) AS n FROM (SELECT {IMPORTANCE} AS s FROM (SELECT lower(line) AS l FROM logs)) WHERE s IS NOT NULL GROUP BY ALL",
    "separator_lines": LOG + f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, {TRIM} AS t FROM logs) WHERE length(t) >= 3 AND (length(t) - length(regexp_replace(t, '[-=*_~#.—─]', '', 'g'))) / length(t) >= 0.8 GROUP BY 1",
    "length_bands": LINE + f"SELECT CASE WHEN n < 10 THEN 0.2::DOUBLE WHEN n < 30 THEN 0.4 WHEN n < 100 THEN 0.6 WHEN n < 200 THEN 0.5 ELSE 0.3 END AS priority, CASE WHEN n < 10 THEN 0.3::DOUBLE WHEN n < 30 THEN 0.5 WHEN n < 200 THEN 0.7 ELSE 0.4 END AS confidence, count(*) AS n FROM (SELECT strlen({TRIM}) AS n FROM lines) WHERE n > 0 GROUP BY ALL",
    "line_scores": LOG + f"SELECT doc_id, line_no, round({SCORE_SQL}, 6) AS score FROM logs",
    "select_by_score": LOG + f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY (line_no = 0 OR line_no = last)::INT DESC, score DESC, line_no) AS r FROM (SELECT doc_id, line_no, max(line_no) OVER (PARTITION BY doc_id) AS last, round({SCORE_SQL}, 6) AS score FROM logs)) WHERE r <= 12",
    "token_budget": LOG + f"""SELECT doc_id, unnest(kept) AS line_no FROM (
      SELECT doc_id, list_reduce(list({{'n': line_no, 't': (strlen(line) + 3) // 4}} ORDER BY round({SCORE_SQL}, 6) DESC, line_no), lambda a, x:
        CASE WHEN x.t <= a.left THEN {{'left': a.left - x.t, 'kept': list_append(a.kept, x.n)}} ELSE a END, {{'left': 200::BIGINT, 'kept': []::BIGINT[]}}).kept AS kept FROM logs GROUP BY doc_id)""",
    "default_scores": LINE + f"SELECT CASE WHEN t = '' THEN 0::DOUBLE WHEN strlen(t) < 10 THEN 0.3 WHEN regexp_matches(t, '^(error|Error|FAILED|fatal)') THEN 0.9 WHEN regexp_matches(t, '^(warning|Warning|WARN)') THEN 0.7 ELSE 0.5 END AS score, count(*) AS n FROM (SELECT {TRIM} AS t FROM lines) GROUP BY ALL",
    "redact_text": f"SELECT doc_id, {_replaced(TEXT, X.REDACTIONS)} AS redacted FROM documents",
    "hash_paths": r"""SELECT page_id, CASE WHEN p = '' THEN p ELSE regexp_replace(CASE WHEN b = '' THEN 'root' ELSE b END, '[^A-Za-z0-9_.-]', '_', 'g') || '#' || left(sha256(p), 8) END AS hashed
      FROM (SELECT page_id, p, list_extract(string_split(regexp_replace(p, '/+$', ''), '/'), -1) AS b FROM (SELECT page_id, regexp_replace(url, '^https?:/', '') AS p FROM pages))""",
    "mask_values": "SELECT event_id, CASE WHEN length(event_type) <= 4 THEN '****' ELSE left(event_type, 2) || '****' || right(event_type, 2) END AS masked, CASE WHEN length(i) <= 4 THEN '****' ELSE left(i, 2) || '****' || right(i, 2) END AS masked_id FROM (SELECT *, event_id::VARCHAR AS i FROM events)",
    "content_keys": f"SELECT doc_id, '<<ccr:' || left(sha256({TEXT}), 24) || '>>' AS marker, '<redacted; ' || strlen({TEXT}) || ' bytes; sha256=' || left(sha256({TEXT}), 8) || '>' AS digest FROM documents",
    "normalize_lines": LOG + f"SELECT {normalize_sql('line')} AS template, count(*) AS n FROM logs GROUP BY 1",
    "log_summary": LOG + f""", g AS (SELECT doc_id, {level_sql('line')} AS level, {normalize_sql('line')} AS template, count(*) AS n, min_by(line, line_no) AS example FROM logs GROUP BY 1, 2, 3)
      SELECT doc_id, level, template, n, example FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY n DESC, template) AS r FROM g WHERE level IS NOT NULL) WHERE r <= CASE level WHEN 'error' THEN 10 WHEN 'warn' THEN 5 ELSE 0 END""",
    "run_length": LINE + """, s AS (SELECT *, CASE WHEN line = lag(line) OVER w THEN 0 ELSE 1 END AS b FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
      i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM s)
      SELECT doc_id, min(line_no) AS line_no, CASE WHEN count(*) >= 2 THEN line || ' [×' || count(*) || ']' ELSE line END AS line, count(*) AS run FROM i GROUP BY doc_id, island, i.line""",
    "adjacent_dedupe": LINE + "SELECT doc_id, line_no, line FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM lines) WHERE line_no = 0 OR line IS DISTINCT FROM p",
    "dsl_pipeline": DSL_SQL,
    "level_caps_context": LOG + f""", m AS (SELECT *, {severity_sql('line')} AS level FROM logs),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY line_no) AS r, max((level = 'error')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM m)
      SELECT doc_id, line_no, line, level FROM r WHERE near = 1 OR r <= CASE level WHEN 'error' THEN 5 WHEN 'warning' THEN 3 WHEN 'info' THEN 2 WHEN 'unknown' THEN 1 ELSE 0 END""",
    "stack_traces": LOG + f""", m AS (SELECT *, starts_with({TRIM}, 'at ') AND contains(line, '(') AS st FROM logs), s AS (SELECT *, CASE WHEN st = lag(st) OVER (PARTITION BY doc_id ORDER BY line_no) THEN 0 ELSE 1 END AS b FROM m),
      i AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM s)
      SELECT doc_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS frames FROM i WHERE st GROUP BY doc_id, island""",
    "bigram_coverage": LINE + r""", w AS (SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> '') AS ws FROM lines),
      p AS (SELECT doc_id, line_no, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM w),
      f AS (SELECT doc_id, line_no, count(*) AS fresh FROM (SELECT doc_id, pair, min(line_no) AS line_no FROM p GROUP BY 1, 2) GROUP BY 1, 2)
      SELECT doc_id, line_no, round(CASE WHEN sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id) > 0 THEN sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id ORDER BY line_no) / sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id) ELSE 1 END, 6) AS coverage
      FROM lines LEFT JOIN f USING (doc_id, line_no)""",
    "knee_lines": LINE + r""", w AS (SELECT doc_id, line_no, list_filter(string_split_regex(lower(line), '\s+'), lambda x: x <> '') AS ws FROM lines),
      p AS (SELECT doc_id, line_no, unnest(list_transform(range(1, greatest(len(ws), 1)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM w),
      f AS (SELECT doc_id, line_no, count(*) AS fresh FROM (SELECT doc_id, pair, min(line_no) AS line_no FROM p GROUP BY 1, 2) GROUP BY 1, 2),
      c AS (SELECT doc_id, line_no, CASE WHEN sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id) > 0 THEN (sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id ORDER BY line_no))::DOUBLE / (sum(coalesce(fresh, 0)) OVER (PARTITION BY doc_id))::DOUBLE ELSE 1 END AS coverage,
        count(*) OVER (PARTITION BY doc_id) AS n FROM lines LEFT JOIN f USING (doc_id, line_no)),
      g AS (SELECT doc_id, line_no, n, round(coverage - (line_no + 1)::DOUBLE / n, 9) AS gap FROM c),
      r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap DESC, line_no) AS k FROM g)
      SELECT doc_id, CASE WHEN n <= 8 OR gap < 0.05 THEN n ELSE line_no + 1 END AS keep_lines FROM r WHERE k = 1""",
    "error_blocks": LOG + r""", m AS (SELECT *, contains(line, 'ERROR') AS o, regexp_matches(line, '^\s+\S') AS g FROM logs),
      r AS (SELECT *, sum(CASE WHEN o OR NOT g THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM m)
      SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS block_sha256 FROM r GROUP BY doc_id, run HAVING bool_or(o)""",
    "redact_counts": "SELECT doc_id, n FROM (SELECT doc_id, " + " + ".join(f"len(regexp_extract_all({_replaced(TEXT, X.REDACTIONS[:i])}, '{p.replace(chr(39), chr(39) * 2)}'))" for i, (p, _) in enumerate(X.REDACTIONS)) + " AS n FROM documents) WHERE n > 0",
    "search_rank": SEARCH_SQL,
    "diff_trim_context": DIFF_SQL + " SELECT doc_id, line_no, kind FROM (SELECT *, max((kind <> ' ')::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM d) WHERE near = 1",
    "hunk_scores": DIFF_SQL + """, n AS (SELECT doc_id, line_no, last_value(CASE WHEN kind <> ' ' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b,
      first_value(CASE WHEN kind <> ' ' THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM d)
      SELECT doc_id, round(avg(CASE WHEN far = 0 THEN 1.0::DOUBLE WHEN far <= 2 THEN 0.8 WHEN far <= 5 THEN 0.5 ELSE 0.2 END), 6) AS score FROM (SELECT *, least(line_no - b, a - line_no) AS far FROM n) GROUP BY doc_id""",
    "set_operations": LINE + """, a AS (SELECT line FROM lines WHERE doc_id % 2 = 0), b AS (SELECT line FROM lines WHERE doc_id % 2 = 1)
      SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "entropy": "WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> ''), n AS (SELECT doc_id, c, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM n) SELECT doc_id, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1",
    "content_types": f"""SELECT doc_id, CASE WHEN t = '' THEN 'text' WHEN regexp_matches(t, '{X.DIFF_HEADER}') THEN 'diff' WHEN regexp_matches(t, '(?i)^\\s*<!DOCTYPE\\s+html|^\\s*<html[\\s>]') THEN 'html'
      WHEN starts_with(t, '[') AND ends_with(t, ']') THEN 'json_array' WHEN starts_with(t, '{{') AND ends_with(t, '}}') AND len(regexp_extract_all(t, '":')) >= 2 THEN 'text'
      WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{X.BUILD_ERROR}'))) > 0 THEN 'build' WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{X.SEARCH_LINE}'))) / len(ls) >= 0.3 THEN 'search'
      WHEN len(list_filter(ls, lambda x: regexp_matches(x, '{X.SOURCE_LINE}'))) >= 2 THEN 'code' ELSE 'text' END AS content_type
      FROM (SELECT doc_id, trim({TEXT}, {WS}) AS t, list_transform(string_split_regex({TEXT}, '\\r?\\n'), lambda x: trim(x, {WS})) AS ls FROM documents)""",
    "anchors_top": LOG + "SELECT doc_id, line_no, kind, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.ANCHOR_PRIORITIES.items()) + " END DESC, line_no) AS rank FROM (SELECT *, CASE WHEN kind0 = 'path' AND NOT contains(t, '/') AND NOT contains(t, chr(92)) THEN NULL ELSE kind0 END AS kind FROM (SELECT *, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{k}'" for k, p in X.ANCHORS) + f" END AS kind0 FROM (SELECT *, {TRIM} AS t FROM logs))) WHERE kind IS NOT NULL) WHERE rank <= 20",
    "query_anchors": rf"SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all({TEXT}, '{X.UUID}'), regexp_extract_all({TEXT}, '\b\d{{4,}}\b'), regexp_extract_all({TEXT}, '[\w.+-]+@[\w-]+\.[\w.]+')))) AS anchors FROM documents",
    "diff_positional": LINE + """, l AS (SELECT * FROM lines WHERE doc_id % 2 = 0), r AS (SELECT doc_id - 1 AS doc_id, line_no, line FROM lines WHERE doc_id % 2 = 1)
      SELECT doc_id, change, count(*) AS n FROM (SELECT coalesce(l.doc_id, r.doc_id) AS doc_id, CASE WHEN l.line IS NULL THEN 'added' WHEN r.line IS NULL THEN 'removed' WHEN l.line = r.line THEN 'same'
        WHEN len(list_intersect(list_distinct(string_split(l.line, '')), list_distinct(string_split(r.line, '')))) > 0.5 * len(list_distinct(list_concat(string_split(l.line, ''), string_split(r.line, '')))) THEN 'modified' ELSE 'replaced' END AS change
        FROM l FULL JOIN r ON l.doc_id = r.doc_id AND l.line_no = r.line_no) GROUP BY 1, 2""",
    "overflow_lists": LINE + "SELECT doc_id, CASE WHEN len(xs) > 3 THEN array_to_string(xs[1:3], ', ') || ', … +' || (len(xs) - 3) || ' more lines' ELSE array_to_string(xs, ', ') END AS joined FROM (SELECT doc_id, list_sort(list(DISTINCT line)) AS xs FROM lines GROUP BY 1)",
    # one decimal place, halves up
    "formats": """SELECT event_id, CASE WHEN t >= 1000000 THEN ((t + 50000) // 1000000) || '.' || ((t + 50000) // 100000 % 10) || 'M' WHEN t >= 1000 THEN ((t + 50) // 1000) || '.' || ((t + 50) // 100 % 10) || 'K' ELSE t::VARCHAR END AS tokens,
      CASE WHEN d < 1000 THEN d || 'ms' WHEN d < 60000 THEN ((d + 50) // 1000) || '.' || ((d + 50) // 100 % 10) || 's' ELSE (d // 60000) || 'm' || ((d % 60000) // 1000) || 's' END AS duration, CASE WHEN length(props) <= 7 THEN props ELSE left(props, 4) || '...' END AS props
      FROM (SELECT event_id, props, event_id * 977 AS t, event_id * 37 AS d FROM events)""",
}
