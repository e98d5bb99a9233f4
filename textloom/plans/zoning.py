"""Queries over frozen zones of tool outputs and over padding of documents to boundaries of tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import zones
from textloom.plans.outputs import LINES, lines
from textloom.sources.tables import table

TARGET = 256


def _aligned(s, d):
    docs = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made = docs.withColumn("a", zones.aligned(F.col("text"), X.tokens_by_bytes(F.col("text")), TARGET))
    return made.select("doc_id", F.col("a.tokens").cast("long").alias("tokens"), F.sha2("a.text", 256).alias("digest"))


QUERIES = {
    "frozen_zones": lambda s, d: zones.frozen_zones(lines(s, d, "cargo").unionByName(lines(s, d, "pytest").withColumn("doc_id", -1 - F.col("doc_id")))),
    "united_zones": lambda s, d: zones.united(zones.frozen_zones(lines(s, d, "cargo"))),
    "frozen_lines": lambda s, d: zones.frozen_lines(lines(s, d, "cargo")).groupBy("doc_id").agg(F.count(F.when(F.col("frozen"), 1)).alias("frozen"), F.count(F.lit(1)).alias("n")),
    "aligned_texts": _aligned,
}

_ZONES = r"""rows AS (SELECT doc_id, line_no, trim(line, ' ' || chr(9)) AS t, regexp_matches(trim(line, ' ' || chr(9)), '^(error|Error:|FAILED|warning:|Warning:)') AS bad, max(line_no) OVER (PARTITION BY doc_id) AS last FROM lines),
  islands AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM rows WHERE bad),
  found AS (SELECT doc_id, min(line_no) AS a, max(line_no) AS b, any_value(last) AS last, arg_min(t, line_no) AS head FROM islands GROUP BY doc_id, island HAVING count(*) > 1),
  zones AS (
    SELECT doc_id, a AS start_line, b AS end_line, CASE WHEN b = last THEN 'Error block at end' WHEN regexp_matches(head, '^(error|Error:)') THEN 'Error block' ELSE 'Warning block' END AS reason FROM found
    UNION ALL SELECT doc_id, line_no, least(line_no + 5, last), 'Summary block' FROM rows WHERE regexp_matches(lower(t), '^(test |tests:|result:)') OR contains(lower(t), 'passed')),
  -- a line is covered when a zone holds it; runs of covered lines are the united zones, as zones that follow each other are one
  covered AS (SELECT DISTINCT doc_id, unnest(range(start_line, end_line + 1)) AS l FROM zones),
  united AS (SELECT doc_id, min(l) AS start_line, max(l) AS end_line FROM (SELECT *, l - row_number() OVER (PARTITION BY doc_id ORDER BY l) AS g FROM covered) GROUP BY doc_id, g)"""
_NUMBERED = "numbered AS (SELECT user_id AS u, event_id AS e, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)"
_CARGO = f"{_NUMBERED}, lines AS (SELECT u AS doc_id, rn AS line_no, {LINES['cargo']} AS line FROM numbered), {_ZONES}"
ORACLES = {
    "frozen_zones": f"WITH {_NUMBERED}, lines AS (SELECT u AS doc_id, rn AS line_no, {LINES['cargo']} AS line FROM numbered UNION ALL SELECT -1 - u, rn, {LINES['pytest']} FROM numbered), {_ZONES} SELECT * FROM zones",
    "united_zones": f"WITH {_CARGO} SELECT united.doc_id, united.start_line, united.end_line, (SELECT string_agg(DISTINCT reason, ', ' ORDER BY reason) FROM zones z WHERE z.doc_id = united.doc_id AND z.start_line BETWEEN united.start_line AND united.end_line) AS reasons FROM united",
    "frozen_lines": f"WITH {_CARGO} SELECT lines.doc_id, count(*) FILTER (EXISTS (SELECT 1 FROM united z WHERE z.doc_id = lines.doc_id AND line_no > z.start_line AND line_no <= z.end_line)) AS frozen, count(*) AS n FROM lines GROUP BY lines.doc_id",
    "aligned_texts": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, (strlen(coalesce(text, '')) + 3) // 4 AS n FROM documents), m AS (SELECT *, ({TARGET} - n % {TARGET}) % {TARGET} AS missing FROM t)
      SELECT doc_id, n + missing AS tokens, sha256(CASE WHEN missing > 0 AND missing < {TARGET // 2} THEN text || repeat(chr(10), missing::INT) ELSE text END) AS digest FROM m""",
}
