"""Queries over the compression pipeline: the lines of all documents within a budget, the store, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import compression
from textloom.sources.tables import LINES_SQL, text_lines

BUDGET = 60


def _done(s: SparkSession, d: str) -> DataFrame:
    return compression.compress(text_lines(s, d), BUDGET, below=0.4)


def _texts(s: SparkSession, d: str) -> DataFrame:
    text = compression.render(_done(s, d))
    return text.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


def _restored(s: SparkSession, d: str) -> DataFrame:
    texts, store = compression.with_markers(_done(s, d))
    return compression.restore(texts, store).select("doc_id", F.sha2("text", 256).alias("digest"))


QUERIES = {
    "compressed_texts": _texts,
    "compressed_lines": lambda s, d: _done(s, d).filter("kept").select("doc_id", "line_no", "tokens"),
    "offloaded_store": lambda s, d: compression.stored(_done(s, d)).select("hash", F.octet_length("original").cast("long").alias("bytes")),
    "restored_texts": _restored,
}

_WALK = rf"""{LINES_SQL},
  runs AS (
    SELECT doc_id, line_no, line, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS run
    FROM (SELECT *, CASE WHEN lag(line) OVER (PARTITION BY doc_id ORDER BY line_no) = line THEN 0 ELSE 1 END AS fresh FROM lines)),
  collapsed AS (SELECT doc_id, min(line_no) AS line_no, any_value(line) || CASE WHEN count(*) > 1 THEN ' [×' || count(*) || ']' ELSE '' END AS line FROM runs GROUP BY doc_id, run),
  trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) AS t FROM collapsed),
  scored AS (
    SELECT *, (strlen(line) + 3) // 4 AS tokens,
      CASE WHEN t = '' THEN 0.0 WHEN strlen(t) < 10 THEN 0.3 WHEN regexp_matches(t, '^(error|Error|FAILED|fatal)') THEN 0.9 WHEN regexp_matches(t, '^(warning|Warning|WARN)') THEN 0.7 ELSE 0.5 END AS score
    FROM trimmed),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line_no) AS k, (sum(strlen(line)) OVER (PARTITION BY doc_id) + count(*) OVER (PARTITION BY doc_id) - 1 + 3) // 4 <= {BUDGET} AS whole FROM scored),
  walked AS (
    SELECT doc_id, k, line_no, CASE WHEN whole OR tokens <= {BUDGET} THEN {BUDGET} - CASE WHEN whole THEN 0 ELSE tokens END ELSE {BUDGET} END AS budget, whole OR tokens <= {BUDGET} AS kept FROM ranked WHERE k = 1
    UNION ALL
    SELECT r.doc_id, r.k, r.line_no, w.budget - CASE WHEN r.tokens <= w.budget AND NOT r.whole THEN r.tokens ELSE 0 END, r.whole OR r.tokens <= w.budget
    FROM walked w JOIN ranked r ON r.doc_id = w.doc_id AND r.k = w.k + 1),
  done AS (SELECT r.*, w.kept FROM ranked r JOIN walked w ON w.doc_id = r.doc_id AND w.k = r.k)"""

ORACLES = {
    "compressed_texts": f"""WITH RECURSIVE {_WALK}, texts AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE kept), '') AS text FROM done GROUP BY doc_id)
      SELECT doc_id, length(text) AS n_chars, sha256(text) AS digest FROM texts""",
    "compressed_lines": f"WITH RECURSIVE {_WALK} SELECT doc_id, line_no, tokens FROM done WHERE kept",
    "offloaded_store": f"WITH RECURSIVE {_WALK} SELECT DISTINCT sha256(line)[1:24] AS hash, strlen(line) AS bytes FROM done WHERE NOT kept AND (strlen(line) > 100 OR score < 0.4)",
    "restored_texts": f"WITH RECURSIVE {_WALK} SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM collapsed GROUP BY doc_id",
}
