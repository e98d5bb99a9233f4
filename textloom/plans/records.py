"""Queries over JSON records, event-time windows, and the content store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators import documents
from textloom.sources.tables import table
from textloom.streaming import windows


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id (the user), json: one object per event; every seventh has a rare key."""
    e = table(spark, sf_dir, "events")
    rare = F.when(F.col("event_id") % 31 == 0, F.lit("x"))
    return e.select(F.col("user_id").alias("doc_id"), F.to_json(F.struct("event_id", "event_type", rare.alias("note"))).alias("json"), "event_id", "event_type")


def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the array of a user's objects as JSON."""
    objects = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "json"))), lambda x: x["json"])
    return items(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(objects, ","), F.lit("]")).alias("text"))


def put(store: DataFrame, new: DataFrame) -> DataFrame:
    """The content store after an upsert: of each hash the newest row stays; of equally new ones a row of new, then the longest to live."""
    both = store.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.desc("created_at"), F.desc("_new"), F.desc_nulls_first("ttl_seconds"), F.asc("original")]
    return both.withColumn("_rank", F.row_number().over(Window.partitionBy("hash").orderBy(*order))).filter("_rank = 1").drop("_rank", "_new")


def live(store: DataFrame, now) -> DataFrame:
    """Rows whose time to live has not passed; no time to live means for ever."""
    return store.filter(F.col("ttl_seconds").isNull() | (F.unix_timestamp("created_at") + F.col("ttl_seconds") > F.unix_timestamp(now)))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(X.content_key(F.col("props")).alias("hash"), F.col("props").alias("original"), F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 2 == 0, 604_800).cast("long").alias("ttl_seconds"), "event_id")
    kept = put(rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0"))
    return live(kept, F.lit("2024-02-02 00:00:00").cast("timestamp")).groupBy(F.col("ttl_seconds").isNull().alias("for_ever")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("original")).alias("bytes"))


def _windows(kind: str):
    return lambda s, d: windows.counts(table(s, d, "events"), kind)


QUERIES = {
    "json_rare_keys": lambda s, d: documents.rare_keys(items(s, d)),
    "json_rare_values": lambda s, d: documents.rare_values(items(s, d), F.get_json_object("json", "$.event_type")),
    "json_field_profile": lambda s, d: documents.field_profile(items(s, d), F.get_json_object("json", "$.event_id"), F.col("event_id")).select("doc_id", F.round("distinct_share", 6).alias("distinct_share"), F.round("even_share", 6).alias("even_share"), "rising"),
    "json_error_items": lambda s, d: items(s, d).filter(F.lower("json").rlike(documents.ERROR_WORDS)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")),
    "json_crush": lambda s, d: arrays(s, d).select("doc_id", F.length(documents.crush_json("text")).alias("crushed"), F.length("text").alias("raw")),
    "json_schema_view": lambda s, d: arrays(s, d).select("doc_id", documents.json_schema_view("text").alias("schema")),
    "content_store": _store,
    "tumbling_events": _windows("tumbling"),
    "sliding_events": _windows("sliding"),
    "session_events": _windows("session"),
}

ITEMS = "items AS (SELECT user_id AS doc_id, event_id, event_type FROM events)"
ORACLES = {
    "json_rare_keys": f"WITH {ITEMS} SELECT doc_id, 'note' AS key, n, total FROM (SELECT doc_id, count(*) FILTER (WHERE event_id % 31 = 0) AS n, count(*) AS total FROM items GROUP BY 1) WHERE n > 0 AND n < 0.2 * total",
    "json_rare_values": f"""WITH {ITEMS}, c AS (SELECT doc_id, event_type AS value, count(*) AS n FROM items GROUP BY 1, 2),
      s AS (SELECT *, sum(n) OVER o AS total, count(*) OVER o AS kinds, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY n DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WINDOW o AS (PARTITION BY doc_id)),
      t AS (SELECT *, before < ceil(total * 0.8::DOUBLE) AS top FROM s), w AS (SELECT *, sum(top::INT) OVER (PARTITION BY doc_id) AS width FROM t)
      SELECT doc_id, value, n FROM w WHERE kinds BETWEEN 2 AND 50 AND width <= 5 AND NOT top""",
    "json_field_profile": f"""WITH {ITEMS}, s AS (SELECT doc_id, event_id, event_id - lag(event_id) OVER (PARTITION BY doc_id ORDER BY event_id) AS step FROM items), m AS (SELECT *, avg(step) OVER (PARTITION BY doc_id) AS mean FROM s)
      SELECT doc_id, round(count(DISTINCT event_id) / count(event_id), 6) AS distinct_share, round(avg(CASE WHEN step IS NOT NULL THEN (step >= 0.5 * mean AND step <= 2 * mean)::INT END), 6) AS even_share, coalesce(min(step) >= 0, true) AS rising FROM m GROUP BY 1""",
    "json_error_items": f"WITH {ITEMS} SELECT doc_id, count(*) AS n FROM items WHERE event_type = 'error' GROUP BY 1",
    "content_store": """WITH r AS (SELECT left(sha256(props), 24) AS hash, props, ts, CASE WHEN event_id % 2 = 0 THEN 604800 END AS ttl, event_id % 3 <> 0 AS new FROM events), k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ts DESC, new DESC, ttl DESC NULLS FIRST) = 1)
      SELECT ttl IS NULL AS for_ever, count(*) AS n, sum(strlen(props))::BIGINT AS bytes FROM k WHERE ttl IS NULL OR floor(epoch(ts)) + ttl > epoch(TIMESTAMP '2024-02-02 00:00:00') GROUP BY 1""",
    "tumbling_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "sliding_events": "SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(2) t(k) GROUP BY ALL",
    "session_events": """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
      SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM i GROUP BY user_id, k""",
}
