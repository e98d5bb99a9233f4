"""Queries over JSON arrays made from the events table: arrays of each kind around each size at which a plan changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import json_arrays
from textloom.sources.tables import table

#: Sizes of the arrays that each 283 events make, one after the other, beside an empty one.
SIZES = (4, 5, 15, 16, 45, 46, 75, 77)
ENDS = tuple(sum(SIZES[: i + 1]) for i in range(len(SIZES)))
CYCLE = ENDS[-1]

#: SQL that both engines read: c is the array's number, p the element's place in it, e the event.
ELEMENT = """CASE (c / 8) % 7
  WHEN 0 THEN '{"id":' || e || ',"kind":"' || event_type || '","score":' || (99 - p) || '.5,"share":0.' || e % 10 || CASE WHEN e % 37 = 0 THEN ',"note":"it failed"' ELSE '' END || ',"state":' || CASE WHEN e % 29 = 0 THEN 'null' WHEN e % 31 = 0 THEN '"odd"' ELSE '"ok"' END || '}'
  WHEN 1 THEN '"name ' || e % 13 || '"' WHEN 2 THEN '' || e % 17 WHEN 3 THEN CASE WHEN e % 2 = 0 THEN 'true' ELSE 'false' END
  WHEN 4 THEN '[' || e || ',1]' WHEN 5 THEN CASE e % 3 WHEN 0 THEN '1' WHEN 1 THEN '"s"' ELSE 'null' END ELSE CASE WHEN e % 9 = 0 THEN 'null' ELSE '' || e % 5 || '.25' END END"""
_CASE = "CASE " + " ".join(f"WHEN q < {end} THEN {i}" for i, end in enumerate(ENDS)) + " END"
_FROM = "CASE " + " ".join(f"WHEN q < {end} THEN {end - size}" for end, size in zip(ENDS, SIZES, strict=True)) + " END"


def arrays(s: SparkSession, d: str) -> DataFrame:
    """doc_id, text: the arrays, the empty ones and some texts that are none."""
    placed = table(s, d, "events").selectExpr("event_id AS e", "event_type", f"event_id % {CYCLE} AS q", f"event_id div {CYCLE} AS r")
    placed = placed.selectExpr("e", "event_type", f"r * 8 + {_CASE} AS c", f"q - {_FROM} AS p")
    made = placed.select("c", "p", F.expr(ELEMENT.replace("(c / 8)", "(c div 8)")).alias("x"))
    whole = made.groupBy(F.col("c").alias("doc_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda x: x["x"]), ","), F.lit("]")).alias("text"))
    return whole.unionByName(whole.selectExpr("-1 - doc_id AS doc_id", "CASE WHEN doc_id % 2 = 0 THEN '[]' ELSE 'no json' END AS text"))


def items(s: SparkSession, d: str) -> DataFrame:
    return json_arrays.elements(arrays(s, d))


def _sketches(s: SparkSession, d: str) -> DataFrame:
    entries = json_arrays.fields(items(s, d))
    parts = [json_arrays.field_sketches(entries.filter(f"idx % 2 = {k}")) for k in (0, 1)]
    return json_arrays.merge_sketches(*parts)


QUERIES = {
    "json_array_plans": lambda s, d: json_arrays.plans(json_arrays.profiles(items(s, d))),
    "json_array_samples": lambda s, d: json_arrays.sampled(items(s, d), json_arrays.plans(json_arrays.profiles(items(s, d)))),
    "json_must_keep": lambda s, d: json_arrays.must_keep(items(s, d)),
    "json_score_fields": lambda s, d: json_arrays.score_fields(items(s, d)),
    "json_field_sketches": _sketches,
}

_ITEMS = f"""placed AS (SELECT event_id AS e, event_type, event_id % {CYCLE} AS q, event_id // {CYCLE} AS r FROM events),
  made AS (SELECT c, p, {ELEMENT.replace("(c / 8)", "(c // 8)")} AS x FROM (SELECT e, event_type, r * 8 + {_CASE} AS c, q - {_FROM} AS p FROM placed)),
  items AS (SELECT c AS doc_id, p AS idx, x AS element, CASE json_type(x) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN json_type(x) = 'VARCHAR' THEN json_extract_string(x, '$') ELSE x END AS value FROM made)"""
_PLANS = f"""{_ITEMS},
  sizes AS (SELECT doc_id, count(*) AS n, sum(strlen(element))::BIGINT AS bytes, list_sort(list(DISTINCT kind) FILTER (kind <> 'null' AND idx < 100)) AS kinds FROM items GROUP BY doc_id),
  typed AS (SELECT *, CASE WHEN kinds = ['object'] THEN 'dict' WHEN kinds = ['array'] THEN 'nested' WHEN len(kinds) = 1 THEN kinds[1] ELSE 'mixed' END AS type FROM sizes),
  seen AS (SELECT doc_id, count(DISTINCT CASE WHEN kind IN ('string', 'number') THEN value WHEN type = 'dict' THEN json_keys(element)[1] END) AS d FROM items JOIN typed USING (doc_id) WHERE CASE WHEN n <= 50 THEN true ELSE idx % (n // 50) = 0 AND idx // (n // 50) < 50 END GROUP BY doc_id),
  plans AS (
    SELECT doc_id, type, n, nullif(d, 0) AS "distinct",
      floor((1 - CASE WHEN type IN ('dict', 'nested') THEN CASE WHEN n > 50 THEN 20.0 / n WHEN n > 20 THEN 10.0 / n ELSE 1 END WHEN type = 'string' THEN CASE WHEN n > 100 THEN 0.3 WHEN n > 30 THEN 15.0 / n ELSE 1 END
        WHEN type = 'number' THEN CASE WHEN n > 50 THEN 10.0 / n ELSE 1 END WHEN n > 20 THEN 5.0 / n ELSE 1 END) * n * (bytes // n))::BIGINT AS savings,
      CASE WHEN type IN ('bool', 'mixed') OR n <= 15 THEN 'none' WHEN type IN ('dict', 'nested') THEN 'top' WHEN type = 'number' THEN 'cluster' WHEN n > 75 THEN 'sample' ELSE 'top' END AS strategy,
      CASE WHEN type IN ('bool', 'mixed') OR n <= 15 THEN n WHEN type IN ('dict', 'nested', 'number') THEN CASE WHEN n > 45 THEN 15 ELSE 10 END WHEN n > 75 THEN round(n * 0.2)::BIGINT ELSE 15 END AS keep
    FROM typed JOIN seen USING (doc_id))"""
_FIELDS = f"""{_ITEMS},
  entries AS (SELECT doc_id, idx, key, json_type(v) AS t, CASE WHEN json_type(v) = 'NULL' THEN '__none__' ELSE json_extract_string(v, '$') END AS value
    FROM (SELECT doc_id, idx, key, json_extract(element, '$."' || key || '"') AS v FROM (SELECT doc_id, idx, element, unnest(json_keys(element)) AS key FROM items WHERE kind = 'object')))"""

ORACLES = {
    "json_array_plans": f"WITH {_PLANS} SELECT * FROM plans",
    "json_array_samples": f"""WITH {_PLANS},
      placed_at AS (SELECT items.*, CASE strategy WHEN 'cluster' THEN ('0x' || left(md5(value), 8))::BIGINT % keep WHEN 'sample' THEN CASE WHEN idx % (n // keep) = 0 AND idx // (n // keep) < keep THEN idx // (n // keep) END ELSE CASE WHEN idx < keep THEN idx END END AS "at" FROM items JOIN plans USING (doc_id))
      SELECT doc_id, "at", min(idx) AS idx, arg_min(element, idx) AS element FROM placed_at WHERE "at" IS NOT NULL GROUP BY doc_id, "at" """,
    "json_must_keep": f"""WITH {_FIELDS}, total AS (SELECT doc_id, count(*) AS total FROM items GROUP BY doc_id HAVING count(*) >= 5),
      keys AS (SELECT doc_id, key, count(*) AS n, any_value(total) AS total FROM entries JOIN total USING (doc_id) GROUP BY doc_id, key),
      counts AS (SELECT doc_id, key, value, count(*) AS c, any_value(n) AS n FROM entries JOIN keys USING (doc_id, key) WHERE n >= 0.8 * total GROUP BY doc_id, key, value),
      ranked AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY doc_id, key ORDER BY c DESC, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < ceil(n * 0.8::DOUBLE) AS top, count(*) FILTER (value <> '__none__') OVER (PARTITION BY doc_id, key) AS kinds FROM counts),
      wide AS (SELECT *, count(*) FILTER (top) OVER (PARTITION BY doc_id, key) AS width FROM ranked)
      SELECT doc_id, idx, 'error' AS reason FROM items WHERE kind = 'object' AND regexp_matches(lower(element), 'error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected')
      UNION SELECT doc_id, idx, 'rare field' FROM entries JOIN keys USING (doc_id, key) WHERE n < 0.2 * total
      UNION SELECT doc_id, idx, 'rare value' FROM entries JOIN wide USING (doc_id, key, value) WHERE NOT top AND width <= 5 AND kinds BETWEEN 2 AND 50""",
    "json_score_fields": f"""WITH {_FIELDS}, x AS (SELECT doc_id, key, list(CASE WHEN t IN ('VARCHAR', 'NULL', 'BOOLEAN', 'OBJECT', 'ARRAY') THEN NULL ELSE value::DOUBLE END ORDER BY idx) AS v FROM entries GROUP BY doc_id, key),
      steps AS (SELECT doc_id, key, v, list_transform(range(2, len(v) + 1), lambda i: v[i] - v[i - 1]) AS d FROM x WHERE len(list_filter(v, lambda y: y IS NULL)) = 0),
      judged AS (SELECT doc_id, key, v, d, d[1:49] AS s, list_min(v) AS low, list_max(v) AS high FROM steps),
      sure AS (SELECT doc_id, key, len(v) >= 4 AND list_min(s) >= 0 AND list_avg(s) > 0 AND len(list_filter(s, lambda y: y >= list_avg(s) * 0.5 AND y <= list_avg(s) * 2)) >= 0.7 * len(s) AS rising,
        CASE WHEN low >= 0 AND high <= 1 THEN 0.4 WHEN low >= 0 AND high <= 10 THEN 0.3 WHEN low >= 0 AND high <= 100 THEN 0.25 WHEN low >= -1 AND high <= 1 THEN 0.35 END::DOUBLE
        + CASE WHEN len(v) >= 5 AND len(list_filter(d, lambda y: y <= 0)) / (len(v) - 1) > 0.7 THEN 0.3 ELSE 0 END::DOUBLE + CASE WHEN len(list_filter(v[1:20], lambda y: y <> trunc(y))) > 0.3 * len(v[1:20]) THEN 0.1 ELSE 0 END::DOUBLE AS c FROM judged)
      SELECT doc_id, key, round(c, 6) AS confidence FROM sure WHERE NOT coalesce(rising, false) AND c >= 0.4 - 1e-9""",
}
