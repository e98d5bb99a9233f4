"""The compression pipeline over ordered lines: repeats collapsed, lines scored, kept within a budget, the rest put into a store.

The budget is an ordered fold: Spark sorts lines by document, falling score and number, and each task walks its sorted rows with
the budget left as its only state, batch by batch; a document of any length needs no more memory than a batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators import runs

#: A line that is a marker of the store by itself.
MARKER = "^<<ccr:([0-9a-f]{24})>>$"


def compress(lines: DataFrame, budget: int, score: Column | None = None, collapse: bool = True, longer_than: int = 100, below: float | None = None) -> DataFrame:
    """(doc_id, line_no, line, score, tokens, kept, offloaded) of each line after repeats are collapsed.

    All lines of an output within the budget are kept. Of lines that are not kept, those of more than longer_than bytes, and
    those whose score is lower than below, are offloaded; the others are dropped. A line that looks like a marker is not kept.
    """
    rows = runs.run_length(lines).drop("run") if collapse else lines.select("doc_id", "line_no", "line")
    rows = rows.withColumns({"score": X.default_line_score(F.col("line")) if score is None else score, "tokens": X.tokens_by_bytes(F.col("line"))})
    sizes = rows.groupBy("doc_id").agg((F.sum(F.octet_length("line")) + F.count(F.lit(1)) - 1).alias("bytes"))
    sizes = sizes.select(F.col("doc_id").alias("_doc"), (F.ceil(F.col("bytes") / 4) <= budget).alias("_whole"))
    rows = rows.join(sizes, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")
    cost = F.when(F.col("line").rlike(MARKER), budget + 1).when(F.col("_whole"), 0).otherwise(F.col("tokens")).cast("long")
    done = runs.take_within(rows.withColumn("_cost", cost), budget, "_cost", [F.desc("score"), F.asc("line_no")])
    bloat = F.octet_length("line") > longer_than
    if below is not None:
        bloat = bloat | (F.col("score") < below)
    return done.withColumn("offloaded", ~F.col("kept") & bloat).drop("_whole", "_cost")


def _joined(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n").alias(name))


def render(done: DataFrame) -> DataFrame:
    """(doc_id, text): the kept lines in order; an output of which nothing is kept has an empty text."""
    kept = _joined(done.filter("kept"), "line_no", "line", "text").withColumnRenamed("doc_id", "_doc")
    return done.select("doc_id").distinct().join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def stored(done: DataFrame) -> DataFrame:
    """(hash, original): a row for each distinct offloaded line."""
    return done.filter("offloaded").select(X.content_key(F.col("line")).alias("hash"), F.col("line").alias("original")).distinct()


def with_markers(done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) in which each run of lines that are not kept is one marker, and the store (hash, original) of these runs."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    fresh = F.when(F.lag("kept").over(order) == F.col("kept"), 0).otherwise(1)
    rows = done.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    parts = rows.groupBy("doc_id", "_run").agg(F.first("kept").alias("kept"), F.array_join(lines, "\n").alias("original"))
    parts = parts.withColumn("hash", F.when(~F.col("kept"), X.content_key(F.col("original"))))
    shown = parts.withColumn("part", F.when(F.col("kept"), F.col("original")).otherwise(X.content_marker(F.col("hash"))))
    return _joined(shown, "_run", "part", "text"), parts.filter("not kept").select("hash", "original").distinct()


def restore(texts: DataFrame, store: DataFrame) -> DataFrame:
    """(doc_id, text) with each marker line replaced by what the store holds for it; unknown markers stay."""
    parts = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("_at", "_part"))
    known = parts.withColumn("hash", F.nullif(F.regexp_extract("_part", MARKER, 1), F.lit(""))).join(store.select("hash", "original"), "hash", "left")
    return _joined(known.withColumn("_line", F.coalesce("original", "_part")), "_at", "_line", "text")
