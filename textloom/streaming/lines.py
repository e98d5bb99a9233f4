"""Stateful line filters on streams: near-duplicate lines and error blocks, with the same results as on a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.neardup import Recent, simhash

LINES = "doc_id long, line_no long, line string"


def dedup_stream(lines: DataFrame, most: int = 3, size: int = 1000) -> DataFrame:
    """Lines of each document that are near none of its last size kept ones; the fingerprints are the state."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = Recent(most, size, list(state.get[0]) if state.exists else [])
        for part in parts:
            part = part.sort_values("line_no")
            keep = [not x.strip() or not recent.duplicate(simhash(x)) for x in part.line]
            yield part[keep][["doc_id", "line_no", "line"]]
        state.update((list(recent.held),))

    return lines.groupBy("doc_id").applyInPandasWithState(step, LINES, "held array<long>", "append", GroupStateTimeout.NoTimeout)


def error_stream(lines: DataFrame, start: str = r"ERROR|error") -> DataFrame:
    """Lines of error blocks: from a line that matches start on, until two blank lines or a line without indent."""
    import re

    begins = re.compile(start)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside, blanks = state.get if state.exists else (False, 0)
        for part in parts:
            part, keep = part.sort_values("line_no"), []
            for line in part.line:
                if begins.search(line):
                    inside, blanks = True, 0
                elif inside and not line.strip():
                    blanks += 1
                    inside = blanks < 2
                elif inside and line[:1] not in (" ", "\t"):
                    inside = False
                keep.append(inside)
            yield part[keep][["doc_id", "line_no", "line"]]
        state.update((inside, blanks))

    return lines.groupBy("doc_id").applyInPandasWithState(step, LINES, "inside boolean, blanks int", "append", GroupStateTimeout.NoTimeout)
