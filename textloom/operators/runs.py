"""Operators over ordered lines (doc_id, line_no, line): runs, caps with context, ranking, budgets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window, WindowSpec

from textloom.functions import text as X


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def in_order() -> WindowSpec:
    return by_doc().orderBy("line_no")


def so_far() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def islands(lines: DataFrame, starts: Column, name: str = "island") -> DataFrame:
    """lines with the number of the run each belongs to; starts is true on the first line of a run."""
    return lines.withColumn(name, F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(so_far()).cast("long"))


def run_length(lines: DataFrame, least: int = 2, mark: str = " [×%d]") -> DataFrame:
    """One row a run of equal neighbours; runs of least lines or more are marked with their length, others stay."""
    runs = islands(lines, ~F.col("line").eqNullSafe(F.lag("line").over(in_order())) | F.lag("line_no").over(in_order()).isNull())
    groups = runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("line_no"), F.first("line").alias("line"), F.count(F.lit(1)).alias("run"))
    one = F.when(F.col("run") >= least, F.concat("line", F.format_string(mark, F.col("run")))).otherwise(F.col("line"))
    return groups.select("doc_id", "line_no", one.alias("line"), "run")


def adjacent_dedupe(lines: DataFrame) -> DataFrame:
    previous = F.lag("line").over(in_order())
    return lines.withColumn("_p", previous).filter("line_no = 0 or not line <=> _p").drop("_p")


def cap_with_context(lines: DataFrame, level: Column, caps: dict[str, int], context: int = 2, error: str = "error") -> DataFrame:
    """The first lines of each level up to its cap, and the lines around errors, in order."""
    marked = lines.withColumn("level", level)
    rank = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy("line_no"))
    near = F.max((F.col("level") == error).cast("int")).over(in_order().rowsBetween(-context, context)) == 1
    cap = F.coalesce(X.lookup(F.col("level"), caps), F.lit(0))
    return marked.withColumns({"_rank": rank, "_near": near, "_cap": cap}).filter("_rank <= _cap or _near").select("doc_id", "line_no", "line", "level")


def select_by_score(lines: DataFrame, score: Column, most: int) -> DataFrame:
    """The first and last line and the best of the rest, most in all; ties go to earlier lines."""
    last = F.max("line_no").over(by_doc())
    edge = (F.col("line_no") == 0) | (F.col("line_no") == last)
    scored = lines.withColumns({"score": score, "_edge": edge.cast("int")})
    rank = F.row_number().over(by_doc().orderBy(F.desc("_edge"), F.desc("score"), "line_no"))
    return scored.withColumn("_rank", rank).filter(F.col("_rank") <= most).select("doc_id", "line_no", "line", "score")


def take_within(rows: DataFrame, budget: int, cost: str, by: list[Column], group: str = "doc_id") -> DataFrame:
    """rows with kept: in the order of by, each row that still fits the group's budget takes its cost from it, others are passed over."""
    ordered = rows.repartition(group).sortWithinPartitions(group, *by)
    names = ordered.columns
    g, c = names.index(group), names.index(cost)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = object(), budget
        for batch in batches:
            kept = []
            for key, need in zip(batch.column(g).to_pylist(), batch.column(c).to_pylist(), strict=True):
                if key != now:
                    now, left = key, budget
                fits = need <= left
                left -= need if fits else 0
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], [*names, "kept"])

    return ordered.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema), "kept boolean"]))


def token_budget(lines: DataFrame, score: Column, budget: int, tokens: Column | None = None) -> DataFrame:
    """Lines taken by falling score whenever they still fit the budget; lines that don't fit are passed over."""
    scored = lines.withColumns({"score": score, "tokens": X.tokens_by_bytes(F.col("line")) if tokens is None else tokens})
    return take_within(scored, budget, "tokens", [F.desc("score"), F.asc("line_no")]).filter("kept").drop("kept")


def blocks(lines: DataFrame, start: str, continues: str = r"^\s+\S") -> DataFrame:
    """Blocks that begin at a line matching start and go on over lines matching continues: a row a block."""
    opens, goes = F.col("line").rlike(start), F.col("line").rlike(continues)
    runs = islands(lines, opens | ~goes, "_run")
    inside = runs.withColumn("_open", F.max(opens.cast("int")).over(Window.partitionBy("doc_id", "_run"))).filter("_open = 1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"])
    return inside.groupBy("doc_id", "_run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.array_join(ordered, "\n").alias("block")).drop("_run")


def stack_traces(lines: DataFrame) -> DataFrame:
    """Runs of two or more stack-trace lines: doc_id, start_line, end_line, frames."""
    marked = lines.withColumn("_stack", X.is_stack_line(F.col("line")))
    runs = islands(marked, ~F.col("_stack").eqNullSafe(F.lag("_stack").over(in_order()))).filter("_stack")
    return runs.groupBy("doc_id", "island").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count(F.lit(1)).alias("frames")).drop("island")


@F.arrow_udf(ArrayType(LongType()))
def pairs_upto(lines: pa.Array) -> pa.Array:
    """Of each document's lines: how many distinct pairs of neighbouring words the lines up to each hold. Pairs never cross lines."""
    words, at = lines.flatten().cast(pa.binary()), np.concatenate([[0], np.cumsum(lines.value_lengths().to_numpy())])
    return pa.array([_pairs_upto([line.split() for line in words[a:b].to_pylist()]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int64()))


def _pairs_upto(lines: list[list[bytes]]) -> np.ndarray:
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    words = np.fromiter(map(number.__getitem__, chain.from_iterable(lines)), np.int64, sizes.sum())
    line = np.repeat(np.arange(len(lines)), sizes)
    ends = np.flatnonzero(line[1:] == line[:-1]) + 1
    first = np.unique(words[ends - 1] * len(number) + words[ends], return_index=True)[1]
    return np.cumsum(np.bincount(line[ends[first]], minlength=len(lines)))


def _curves(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", pairs_upto(F.transform("lines", F.lower)).alias("upto")).select("doc_id", "upto", F.element_at("upto", -1).alias("total"))


def bigram_coverage(docs: DataFrame) -> DataFrame:
    """The share of a document's distinct word pairs that its first lines hold: doc_id, line_no, coverage.

    docs: doc_id, lines. Each row is a document of its own and is read where it lies; no pair of words is shuffled.
    """
    curve = _curves(docs).select("doc_id", "total", F.posexplode("upto").alias("line_no", "upto"))
    return curve.select("doc_id", F.col("line_no").cast("long").alias("line_no"), _share(F.col("upto")).alias("coverage"))


def _share(upto: Column) -> Column:
    return F.when(F.col("total") > 0, upto / F.col("total")).otherwise(1.0)


def knee(docs: DataFrame) -> DataFrame:
    """How many lines a document (doc_id, lines) needs: where coverage is farthest above the straight line; all lines of short ones."""
    n = F.size("upto")
    gaps = _curves(docs).select("doc_id", n.alias("n"), F.transform("upto", lambda x, i: F.round(_share(x) - (i + 1) / n, 9)).alias("gaps"))
    best = F.array_max("gaps")
    return gaps.select("doc_id", F.when((F.col("n") <= 8) | (best < 0.05), F.col("n")).otherwise(F.array_position("gaps", best)).cast("long").alias("keep_lines"))


def per_document(lines: DataFrame, fold: Callable[[list[str]], list[str]]) -> DataFrame:
    """lines rewritten document by document by fold, for rules that only a walk over the lines can follow."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = fold(part.sort_values("line_no").line.tolist())
        return pd.DataFrame({"doc_id": part.doc_id.iloc[0], "line_no": range(len(out)), "line": out})

    return lines.groupBy("doc_id").applyInPandas(run, "doc_id long, line_no long, line string")
