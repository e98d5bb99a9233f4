"""Operator 8: mixing sources to target weights, in DataFrame functions only.

A source's token share p is raised to an exponent t in [0, 1] and normalised: w = p**t / sum(p**t). t is found by
bisection: the largest exponent whose weights have at least the target entropy, or the smallest whose weights repeat no
source more often than the repetition limit. Four bisection steps run per aggregation over the table of sources.

The weights are realised as block permutations under a token budget: a source's documents are ordered by a seeded digest
and cut into blocks along that order; whole passes over the permutation are taken while the source's budget lasts, then
blocks, then documents of the one block in which the budget ends. Sums run over blocks first, so that a source with a
third of all documents is never ordered in one task.

Defined results: words are the tokens; a null source is a source of its own; documents without words cost nothing and
come with the permutation's prefix; repeated rows are documents of their own (ties in the permutation share a prefix
sum); columns of docs named like an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import load, materialize

ENTROPY_SHARE, SEED, STEPS, BLOCK = 0.95, "mix-1", 24, 256
#: Up to so many sources the table of sources is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 20_000
MADE = ("n_tokens", "weight", "copies", "block")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _join(docs: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    small = small.withColumnRenamed("source", "_source")
    return docs.join(F.broadcast(small) if rows <= BROADCAST_SOURCES else small, F.col("_mix_source").eqNullSafe(F.col("_source"))).drop("_source")


def find_exponent(sources: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float | None, steps: int = STEPS) -> float:
    """Bisect the exponent over sources (tokens). One of entropy_share and max_repeats is given.

    entropy_share: at least this share of the largest possible entropy. max_repeats: no source's budget is over so many
    passes; without a budget the budget is what takes the source of the largest share once.
    """
    live = sources.filter("tokens > 0")
    total, count = live.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    if not count or count == 1:
        return 1.0
    share = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, 1.0

    def fits(points: list[float]) -> list[bool]:
        aggs = []
        for i, t in enumerate(points):
            power = F.exp(F.log(share) * t)
            if entropy_share is not None or budget is not None:
                aggs.append(F.sum(power).alias(f"s{i}"))
            if entropy_share is not None:
                aggs.append(F.sum(power * F.log(share)).alias(f"l{i}"))
            else:
                aggs.append(F.max(F.exp(F.log(share) * (t - 1))).alias(f"r{i}"))
                if budget is None:
                    aggs.append(F.min(F.exp(F.log(share) * (t - 1))).alias(f"m{i}"))
        row = live.agg(*aggs).first()
        out = []
        for i, t in enumerate(points):
            if entropy_share is not None:
                out.append(math.log(row[f"s{i}"]) - t * row[f"l{i}"] / row[f"s{i}"] >= entropy_share * math.log(count))
            else:
                repeats = row[f"r{i}"] / row[f"m{i}"] if budget is None else row[f"r{i}"] / row[f"s{i}"] * budget / total
                out.append(repeats <= max_repeats)
        return out

    up = entropy_share is not None  # entropy falls as the exponent grows, repeats do too
    none, whole = fits([0.0, 1.0])
    if whole and up:
        return 1.0
    if not up and none:
        return 0.0
    if not up and not whole:
        raise ValueError(f"a budget of {budget:.0f} tokens over {total} takes some source more than {max_repeats} times, whatever the exponent")
    for _ in range(-(-steps // 4)):
        width = (high - low) / 16
        points = [low + width * k for k in range(1, 16)]
        good = fits(points)
        at = 8  # four halvings with the fifteen points at hand
        for half in (4, 2, 1, 0.5):
            move = half if good[int(at) - 1] == up else -half
            at += move
        low, high = low + width * (at - 0.5), low + width * (at + 0.5)
    return low if up else high


def mix(
    docs: DataFrame,
    entropy_share: float | None = ENTROPY_SHARE,
    max_repeats: float | None = None,
    budget: int | str = "total",
    seed: str = SEED,
    text_col: str = "text",
    id_col: str = "doc_id",
    source_col: str = "source",
) -> DataFrame:
    """docs with n_tokens, weight (of the source), copies (how often the mixture takes the document) and block.

    budget: tokens of the mixture; "total": as many as docs has; "cover": as many as take each document at least once.
    """
    docs = docs.drop(*(c for c in MADE if c not in (text_col, id_col, source_col)))
    work = docs.withColumns({"n_tokens": word_count(F.col(text_col)), "_mix_source": F.col(source_col), "_key": F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))})
    sources = materialize(work.groupBy(F.col("_mix_source").alias("source")).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    n_sources, total = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    exponent = find_exponent(sources, entropy_share, max_repeats, None if budget == "cover" else float(total if budget == "total" else budget))
    power = F.when(F.col("tokens") > 0, F.exp(F.log(F.col("tokens") / F.lit(float(max(total, 1)))) * exponent)).otherwise(0.0)
    norm = sources.agg(F.sum(power)).first()[0] or 1.0
    weighted = sources.withColumn("weight", power / F.lit(norm))
    if budget == "cover":
        tokens = weighted.agg(F.max(F.when(F.col("weight") > 0, F.col("tokens") / F.col("weight")))).first()[0] or 0.0
    else:
        tokens = float(total if budget == "total" else budget)
    planned = weighted.select(
        "source",
        "weight",
        F.when(F.col("tokens") > 0, F.floor(F.round(F.col("weight") * F.lit(tokens), 3) / F.col("tokens"))).otherwise(1).cast("long").alias("passes"),
        F.when(F.col("tokens") > 0, F.round(F.col("weight") * F.lit(tokens), 3) - F.floor(F.round(F.col("weight") * F.lit(tokens), 3) / F.col("tokens")) * F.col("tokens")).otherwise(0).cast("double").alias("rest"),
        F.ceil(F.col("n_docs") / F.greatest(F.lit(float(BLOCK)), F.sqrt(F.col("n_docs")))).alias("n_blocks"),
    )
    unit = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    placed = _join(work, planned, n_sources).withColumn("block", F.floor(unit * F.col("n_blocks")).cast("long"))

    # where each source's budget ends: prefix sums over blocks, then over the documents of one block
    blocks = placed.groupBy("_mix_source", "block").agg(F.sum("n_tokens").alias("in_block"), F.first("rest").alias("rest"))
    before = F.coalesce(F.sum("in_block").over(Window.partitionBy("_mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = blocks.withColumn("before", before).filter("before <= rest and before + in_block > rest")
    edges = materialize(edges.select(F.col("_mix_source").alias("source"), F.col("block").alias("edge"), "before"), "edges")
    inside = _join(placed.select("_mix_source", "_key", "n_tokens", "block", "rest"), edges, n_sources).filter("block = edge")
    running = F.sum("n_tokens").over(Window.partitionBy("_mix_source").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("upto", F.col("before") + running).filter("upto <= rest").groupBy("_mix_source").agg(F.max("_key").alias("last_key"))
    ends = edges.join(last, edges["source"].eqNullSafe(last["_mix_source"]), "left").select("source", "edge", "last_key")
    ends = (F.broadcast(ends) if n_sources <= BROADCAST_SOURCES else ends).withColumnRenamed("source", "_source")
    out = placed.join(ends, placed["_mix_source"].eqNullSafe(ends["_source"]), "left")
    extra = F.col("edge").isNull() | (F.col("block") < F.col("edge")) | ((F.col("block") == F.col("edge")) & (F.col("_key") <= F.col("last_key")))
    copies = F.col("passes") + F.when((F.col("rest") > 0) & F.coalesce(extra, F.lit(False)), 1).otherwise(0)
    return out.select(*docs.columns, "n_tokens", "weight", copies.cast("long").alias("copies"), "block")


def realise(mixed: DataFrame) -> DataFrame:
    """One row for each copy the mixture takes; copy counts from 0."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "source", "n_tokens", "copies")


def oracle(entropy_share: float = ENTROPY_SHARE, seed: str = SEED, steps: int = STEPS) -> str:
    """DuckDB SQL for query(): the same bisection as a recursive table over the list of shares."""
    return rf"""
WITH RECURSIVE base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens, md5('{seed}:' || doc_id) AS k
  FROM documents),
src AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS n_docs FROM base GROUP BY source),
lst AS (SELECT list(tokens / (SELECT sum(tokens) FROM src)) AS p FROM src WHERE tokens > 0),
bis AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END
  FROM (SELECT step, lo, hi, mid, ln(s) - mid * l / s >= {entropy_share} * ln(n) AS good
        FROM (SELECT step, lo, hi, (lo + hi) / 2 AS mid, len(p) AS n,
                     list_sum(list_transform(p, lambda x: exp(ln(x) * (lo + hi) / 2))) AS s,
                     list_sum(list_transform(p, lambda x: exp(ln(x) * (lo + hi) / 2) * ln(x))) AS l
              FROM bis, lst WHERE step < {steps}))),
expo AS (
  SELECT CASE WHEN -list_sum(list_transform(p, lambda x: x * ln(x))) >= {entropy_share} * ln(len(p)) OR len(p) = 1 THEN 1.0
              ELSE (SELECT lo FROM bis WHERE step = {steps}) END AS t FROM lst),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN exp(ln(tokens / (SELECT sum(tokens) FROM src)) * (SELECT t FROM expo)) ELSE 0 END AS pw FROM src),
plan AS (
  SELECT source, tokens, round(pw / (SELECT sum(pw) FROM w) * (SELECT sum(tokens) FROM src), 3) AS b FROM w),
prefix AS (
  SELECT base.*, tokens, b, sum(n_tokens) OVER (PARTITION BY base.source ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM base JOIN plan ON base.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens,
       (CASE WHEN tokens > 0 THEN floor(b / tokens) + CASE WHEN b - floor(b / tokens) * tokens > 0 AND upto <= b - floor(b / tokens) * tokens THEN 1 ELSE 0 END ELSE 1 END)::BIGINT AS copies
FROM prefix
"""
