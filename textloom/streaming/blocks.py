"""Block handlers on streams of lines: the machines of operators/handlers.py with the state kept between batches.

A document's state is the machine's place and the lines of its open block. A block is sent when the next one opens; a timer
sends the open block when no line came for idle_ms, so that the last one does not wait for ever. A block that goes on after
its timer is sent as a further row of the same number: texts of equal (doc_id, block) joined in the order of first_line are
the block of output_blocks(). Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from textloom.operators.handlers import BLOCKS
from textloom.operators.machines import Machine

OUT = "doc_id long, block long, first_line long, last_line long, text string"


class _Blocks(StatefulProcessor):
    def __init__(self, machine: Machine, idle_ms: int):
        self.machine, self.idle_ms = machine, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "state string, block long, timer long")
        self.held = handle.getListState("held", "line_no long, line string")

    def _send(self, doc: Any, block: int) -> list[tuple]:
        held = list(self.held.get())
        self.held.clear()
        return [(doc, block, held[0][0], held[-1][0], "\n".join(x[1] for x in held))] if held else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["doc_id", "block", "first_line", "last_line", "text"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, block, timer = self.place.get() if self.place.exists() else (self.machine.states[0], 0, -1)
        out, new = [], []
        for part in [pd.concat(list(rows)).sort_values("line_no")]:
            for number, line, kind in zip(part.line_no, part.line, part.kind, strict=True):
                state, tag = self.machine.moves[kind][state]
                if tag == "open":
                    self.held.appendList(new) if new else None
                    out += self._send(key[0], block)
                    new, block = [], block + 1
                if tag in ("open", "in"):
                    new.append((int(number), line))
        if new:
            self.held.appendList(new)
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        self.place.update((state, block, timer))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        state, block, _ = self.place.get()
        out = self._send(key[0], block)
        self.place.update((state, block, -1))
        yield self._frame(out)

    def close(self) -> None:
        pass


def block_stream(lines: DataFrame, tool: str, idle_ms: int = 60_000) -> DataFrame:
    """The blocks of a stream of (doc_id, line_no, line) whose lines come in order within each document."""
    machine, kind = BLOCKS[tool]
    marked = lines.select("doc_id", "line_no", "line", kind(F.col("line")).alias("kind"))
    return marked.groupBy("doc_id").transformWithStateInPandas(_Blocks(machine, idle_ms), OUT, "Append", "ProcessingTime")
