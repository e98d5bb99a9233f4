"""Operator 11: interaction audit of five text filters in all 120 orders, by Walsh-Hadamard sums.

A document's failures are a mask of five bits, one a filter (A: few words, B: repeated words, C: capitals, D: marks,
E: identical to the text of a smaller doc_id). Per part (source) and label class (all, good, toxic) the documents are
aggregated to 32 sums of signs (-1)**bits(mask & k): 96 numbers a part, added up on the map side, so that a source with a
third of all rows is one row a task. The inverse transform turns the sums exactly into the count of each mask; every order
and step is then read from these 32 counts. Shapley's sums need no order at all: a document that fails j filters is
removed by each of them in 120 / j of the orders.

A text's first holder is found by a 128-bit digest: minima are taken on the map side, and only digests that documents of
different ids share are joined back; a digest that a third of all rows hold is one large key of an equi join, which
Spark splits (adaptive skew join).

Defined results: null or empty text has no words and no code points (it fails A alone, and E when a smaller id is empty,
too); null source is the empty string; each row is a document, rows of one doc_id never count as copies of each other,
and a null doc_id is never a copy, though it takes part in no minimum either; a document is good or toxic when any label
row of its id says so, repeated label rows count once, null labels not at all; extra columns of docs are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import load, materialize, text_bytes

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
CLASSES = {"all": F.lit, "good": lambda _: F.col("good"), "toxic": lambda _: F.col("toxic")}
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 200, 50, 2, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
SLICE = 1 << 20


def code_points(text: bytes) -> int:
    """UTF-8 continuation bytes left out, counted in slices so that scratch space stays bounded."""
    if text.isascii():
        return len(text)
    buf = np.frombuffer(text, np.int8)
    return sum(int(np.count_nonzero(buf[i : i + SLICE] >= -64)) for i in range(0, len(buf), SLICE))


def own_failures(text: bytes) -> int:
    """The mask of filters A to D that a text fails by itself."""
    words = text.split()  # for bytes: maximal runs without \x20 and \x09-\x0D
    a = len(words) < MIN_WORDS
    b = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    c = 100 * capitals > CAPITAL_PERCENT * code_points(text)
    d = any(m in text for m in MARKS)
    return a | b << 1 | c << 2 | d << 3


def facts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """(doc_id, part, own, h1, h2) for each row of docs: its own failures and its text's digest."""

    def run(batches):
        for batch in batches:
            own, digests = [], []
            for text in text_bytes(batch.column(2)):
                own.append(own_failures(text))
                digests.append(hashlib.blake2b(text, digest_size=16).digest())
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["doc_id", "part", "own", "h1", "h2"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, f"doc_id {kind}, part string, own int, h1 long, h2 long")


def masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows of facts() as (part, mask, good, toxic); labels holds (doc_id, quality, toxic)."""
    shared = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first <> last").drop("last")
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    found = rows.join(shared, ["h1", "h2"], "left").join(marks, "doc_id", "left")
    return found.select(
        "part",
        F.col("own").bitwiseOR(F.shiftleft(copy, len(FILTERS) - 1)).alias("mask"),
        F.coalesce("good", F.lit(0)).alias("good"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
    )


def _sign(mask: Column, k: int) -> Column:
    return F.lit(1) - F.lit(2) * (F.bit_count(mask.bitwiseAND(F.lit(k))) % 2)


def parity_sums(found: DataFrame) -> DataFrame:
    """(part, all, good, toxic): for each label class the array of its 32 signed sums."""
    sums = [F.sum(_sign(F.col("mask"), k) * weight(1)).alias(f"{name}_{k}") for name, weight in CLASSES.items() for k in range(CELLS)]
    summed = found.groupBy("part").agg(*sums)
    return summed.select("part", *[F.array(*[f"{name}_{k}" for k in range(CELLS)]).alias(name) for name in CLASSES])


def invert(sums: Column) -> Column:
    """The count of each mask from its signed sums: the transform is its own inverse, times the number of cells."""

    def cell(mask: Column) -> Column:
        signed = F.transform(sums, lambda v, k: F.when(F.bit_count(mask.bitwiseAND(k)) % 2 == 0, v).otherwise(-v))
        return F.shiftright(F.aggregate(signed, F.lit(0).cast("long"), lambda x, y: x + y), len(FILTERS))  # exact: the count times 32

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)


def audit(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """One row a part, order and step; see the module's docstring."""
    found = masks(materialize(facts(docs, **columns), "filter-facts"), labels)
    cells = parity_sums(found).select("part", *[invert(F.col(name)).alias(name) for name in CLASSES])
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bits = lambda text: reduce(lambda x, y: x + y, [F.when(F.contains(text, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])
    steps = steps.withColumns({"f": bits(F.substring("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substring("filter_order", F.lit(1), F.col("step") - 1))})

    def total(name: str, keep) -> Column:
        chosen = F.transform(F.col(name), lambda n, m: F.when(keep(m), n).otherwise(F.lit(0)))
        return F.aggregate(chosen, F.lit(0).cast("long"), lambda x, y: x + y)

    own = lambda m: m.bitwiseAND(F.col("f")) != 0
    early = lambda m: m.bitwiseAND(F.col("before")) != 0
    shares = F.transform(F.col("all"), lambda n, m: F.when(own(m), n * F.floor(F.lit(120) / F.bit_count(m))).otherwise(F.lit(0)))
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("all", lambda m: ~own(m) & ~early(m)).alias("kept"),
        total("all", lambda m: own(m) & ~early(m)).alias("removed"),
        total("all", lambda m: own(m) & early(m)).alias("redundant"),
        F.get("all", F.col("f")).cast("long").alias("unique_fails"),
        total("good", lambda m: own(m) & ~early(m)).alias("good_lost"),
        total("toxic", lambda m: own(m) & ~early(m)).alias("toxic_lost"),
        F.aggregate(shares, F.lit(0).cast("long"), lambda x, y: x + y).alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return audit(docs, load(spark, sf_dir, "labels"))


#: Every order is walked document by document here; texts are compared as texts.
ORACLE = r"""
WITH RECURSIVE labelled AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT t, min(doc_id) AS first FROM split GROUP BY t),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
          100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
          regexp_matches(t, '[#$%&*|]'), coalesce(split.doc_id > first, false)] AS fails
  FROM split JOIN firsts USING (t) LEFT JOIN labelled ON labelled.doc_id = split.doc_id),
orders AS (
  SELECT '' AS o UNION ALL
  SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS u(f) WHERE length(o) < 5 AND NOT contains(o, f)),
steps AS (SELECT o AS filter_order, s::INT AS step FROM orders, range(1, 6) AS r(s) WHERE length(o) = 5),
walked AS (
  SELECT part, filter_order, step, good, toxic,
         fails[instr('ABCDE', filter_order[step])] AS own,
         len(list_filter(range(1, step), lambda i: fails[instr('ABCDE', filter_order[i])])) > 0 AS early,
         len(list_filter(fails, lambda x: x)) = 1 AS single
  FROM judged, steps),
counted AS (
  SELECT part, filter_order, step, count(*) FILTER (NOT own AND NOT early) AS kept, count(*) FILTER (own AND NOT early) AS removed,
         count(*) FILTER (own AND early) AS redundant, count(*) FILTER (own AND single) AS unique_fails,
         count(*) FILTER (own AND NOT early AND good = 1) AS good_lost, count(*) FILTER (own AND NOT early AND toxic = 1) AS toxic_lost
  FROM walked GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM counted
"""
