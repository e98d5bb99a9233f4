"""Frozen zones: stretches of lines that stay together, found as islands, united where they touch; and padding to a boundary of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators import runs

#: How lines of error blocks and of summaries begin, and how many lines after a summary line belong to it.
ERRORS = ("error", "Error:", "FAILED", "warning:", "Warning:")
SUMMARIES = ("test ", "tests:", "result:")
AFTER = 5


def _begins(t: Column, prefixes: tuple[str, ...]) -> Column:
    out = t.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | t.startswith(p)
    return out


def frozen_zones(lines: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, reason): runs of two and more error lines, and each summary line with the lines after it."""
    t = X.trim(F.col("line"))
    last = F.max("line_no").over(Window.partitionBy("doc_id"))
    rows = lines.select("doc_id", "line_no", t.alias("t"), _begins(t, ERRORS).alias("bad"), last.alias("last"))
    islands = runs.islands(rows, ~F.col("bad").eqNullSafe(F.lag("bad").over(runs.in_order()))).filter("bad")
    zones = islands.groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.min_by(_begins(F.col("t"), ERRORS[:2]), "line_no").alias("error"), F.max("last").alias("last"))
    reason = F.when(F.col("end_line") == F.col("last"), "Error block at end").when(F.col("error"), "Error block").otherwise("Warning block")
    errors = zones.filter("end_line > start_line").select("doc_id", "start_line", "end_line", reason.alias("reason"))
    low = F.lower("t")
    told = rows.filter(_begins(low, SUMMARIES) | low.contains("passed"))
    return errors.unionByName(told.select("doc_id", F.col("line_no").alias("start_line"), F.least(F.col("line_no") + AFTER, F.col("last")).alias("end_line"), F.lit("Summary block").alias("reason")))


def united(zones: DataFrame) -> DataFrame:
    """(doc_id, start_line, end_line, reasons): zones that overlap or follow each other directly as one, with their distinct reasons."""
    order = Window.partitionBy("doc_id").orderBy("start_line", "end_line")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = zones.withColumn("fresh", F.when(reach + 1 >= F.col("start_line"), 0).otherwise(1))
    rows = rows.withColumn("zone", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "zone").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"), F.array_join(F.array_sort(F.collect_set("reason")), ", ").alias("reasons")).drop("zone")


def frozen_lines(lines: DataFrame) -> DataFrame:
    """lines with frozen: whether a cut must not fall between the line and the one before it."""
    zones = united(frozen_zones(lines))
    zones = zones.filter("end_line > start_line")
    inside = zones.select(F.col("doc_id").alias("_doc"), F.explode(F.sequence(F.col("start_line") + 1, F.col("end_line"))).alias("_line"))
    joined = lines.join(inside, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line")), "left")
    return joined.withColumn("frozen", F.col("_line").isNotNull()).drop("_doc", "_line")


def aligned(text: Column, tokens: Column, target: int = 1024, pad: str = "\n") -> Column:
    """struct(text, tokens): padded to the next boundary where less than half of one is missing; tokens always at a boundary."""
    missing = F.pmod(-tokens, F.lit(target))
    padded = F.when((missing > 0) & (missing < target // 2), F.concat(text, F.repeat(F.lit(pad), missing.cast("int")))).otherwise(text)
    return F.struct(padded.alias("text"), (tokens + missing).alias("tokens"))
