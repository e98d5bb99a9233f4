"""Queries over protected tags: all documents and pages there and back, and what is protected in texts made from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import tags
from textloom.sources.tables import table


def _back(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = table(s, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    rows = docs.unionByName(pages)
    both = [rows.withColumn("p", tags.protect(F.col("text"), markers)).select("kind", "id", F.lit(markers).alias("markers"), F.sha2(tags.restore(F.col("p.text"), F.col("p.blocks")), 256).alias("digest")) for markers in (False, True)]
    return both[0].unionByName(both[1])


def _protected(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(
        F.lit("a <b>x</b> "),
        F.expr("CASE event_id % 4 WHEN 0 THEN concat('<think id=\"', event_id, '>\">deep <Think/> </THINK>') WHEN 1 THEN concat('<ns:x>', event_id, '<y></y>') WHEN 2 THEN '<self a=1 />' ELSE '</orphan> < 5 <z \"' END"),
        F.lit(" end <tool><in>1</in></tool>"),
    )
    rows = table(s, d, "events").select("event_id", tags.protect(text).alias("p"), tags.protect(text, True).alias("m"))
    return rows.select("event_id", "p.text", F.transform("p.blocks", lambda b: b["original"]).alias("originals"), F.size("m.blocks").cast("long").alias("n_markers"))


QUERIES = {"restored_tags": _back, "protected_tags": _protected}

ORACLES = {
    "restored_tags": """WITH rows AS (SELECT 'document' AS kind, doc_id AS id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'page', page_id, coalesce(html, '') FROM pages)
      SELECT kind, id, markers, sha256(t) AS digest FROM rows, (VALUES (true), (false)) AS m(markers)""",
    # what is protected follows from the kind of text; nothing is parsed
    "protected_tags": """WITH k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ['<think id="' || event_id || '>">deep <Think/> </THINK>'] WHEN 1 THEN ['<y></y>'] WHEN 2 THEN ['<self a=1 />'] ELSE [] END AS own FROM events),
      a AS (SELECT *, list_append(own, '<tool><in>1</in></tool>') AS originals FROM k)
      SELECT event_id, originals, [7, 7, 5, 4][event_id % 4 + 1]::BIGINT AS n_markers,
        'a <b>x</b> ' || CASE event_id % 4 WHEN 0 THEN '{{TAG_0}}' WHEN 1 THEN '<ns:x>' || event_id || '{{TAG_0}}' WHEN 2 THEN '{{TAG_0}}' ELSE '</orphan> < 5 <z "' END || ' end ' || CASE WHEN event_id % 4 = 3 THEN '{{TAG_0}}' ELSE '{{TAG_1}}' END AS text FROM a""",
}
