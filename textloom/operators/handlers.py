"""Handlers of tool outputs that keep blocks or lines, for tables here and for streams in streaming/blocks.py.

A block handler is a machine and a classifier; a block is closed when the next one opens, when a line ends it, or at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import summaries
from textloom.operators.machines import CHUNK, Machine, walk


def _test_move(state: str, kind: str) -> tuple[str, str]:
    """cargo test: in the failures or not, in the list of their names or not, in a block or not."""
    section, names, inside = state
    if kind == "skip":
        return state, ""
    if kind == "failures":
        return f"1{'1' if section == '1' else names}{inside}", ""
    if kind == "result":
        return f"00{inside}", "result"
    if names == "1":
        return state, ""
    if section == "1" and kind == "start":
        return f"{section}{names}1", "open"
    if inside == "1":
        return (state, "in") if section == "1" else (f"{section}{names}0", "")
    return state, ""


CARGO_TEST = Machine.of(tuple(a + b + c for a in "01" for b in "01" for c in "01"), ("skip", "failures", "result", "start", "text"), _test_move)


def cargo_test_kind(line: Column) -> Column:
    t = F.regexp_replace(line, r"^\s+", "")
    skip = t.startswith("Compiling") | t.startswith("Downloading") | t.startswith("Downloaded") | t.startswith("Finished") | line.startswith("running ")
    skip = skip | (line.startswith("test ") & (line.endswith("... ok") | line.endswith("... FAILED")))
    return F.when(skip, "skip").when(line == "failures:", "failures").when(line.startswith("test result:"), "result").when(line.startswith("---- "), "start").otherwise("text")


def _tsc_move(state: str, kind: str) -> tuple[str, str]:
    if kind == "skip":
        return state, ""
    if kind == "error":
        return "in", "open"
    return ("in", "in") if state == "in" and kind == "indent" else ("out", "")


TSC = Machine.of(("out", "in"), ("skip", "error", "indent", "text"), _tsc_move)

BLOCKS: dict[str, tuple[Machine, Callable[[Column], Column]]] = {
    "cargo build": (summaries.CARGO_BUILD, summaries.cargo_build_kind),
    "cargo test": (CARGO_TEST, cargo_test_kind),
    "tsc": (TSC, lambda line: F.when(line.startswith("Found "), "skip").otherwise(summaries.tsc_kind(line))),
}


def output_blocks(lines: DataFrame, tool: str, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, block, first_line, last_line, text): the blocks that the tool's handler keeps."""
    machine, kind = BLOCKS[tool]
    rows = walk(lines, machine, kind(F.col("line")), chunk).filter(F.col("tag").isin("open", "in"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return rows.groupBy("doc_id", "block").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(ordered, "\n").alias("text"))


#: How progress lines of a push begin.
PUSH_NOISE = ("Enumerating objects:", "Counting objects:", "Compressing objects:", "Writing objects:", "Delta compression using", "Total ")


def push_lines(lines: DataFrame) -> DataFrame:
    """lines of a push without empty and progress lines."""
    t = F.regexp_replace("line", r"^\s+", "")
    noise = F.col("line") == ""
    for p in PUSH_NOISE:
        noise = noise | t.startswith(p)
    return lines.filter(~noise)


def push_summary(lines: DataFrame) -> DataFrame:
    """(doc_id, summary): up to date, or the first destination; only lines that stay are looked at."""
    line = F.col("line")
    to = F.regexp_extract(line, r" -> \s*(\S+)", 1)
    found = push_lines(lines).groupBy("doc_id").agg(F.max(line.contains("Everything up-to-date").cast("int")).alias("same"), F.min_by(to, F.when(line.contains(" -> ") & (to != ""), F.col("line_no"))).alias("to"))
    all_docs = lines.select("doc_id").distinct().withColumnRenamed("doc_id", "_doc")
    out = F.when(F.col("same") == 1, "ok (up-to-date)").otherwise(X.trim(F.concat(F.lit("ok "), F.coalesce("to", F.lit("")))))
    return all_docs.join(found, F.col("_doc").eqNullSafe(F.col("doc_id")), "left").select(F.col("_doc").alias("doc_id"), F.coalesce(out, F.lit("ok")).alias("summary"))
