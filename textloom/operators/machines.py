"""Line state machines over ordered lines (doc_id, line_no, line), walked in parallel within a document.

A machine is a table: for each state and class of line the next state and a tag ('open': the line begins a block and is in
it, 'in': it belongs to the block last opened, any other text: kept for the caller). What a stretch of lines does to a
machine is a function from its state before to its state after and the number of blocks opened, and such functions compose.
So documents are cut into stretches of CHUNK lines, functions are composed level by level until one is left for each
document, start states are handed down again, and each stretch is walked by itself: a document of 10**7 lines is 78,125
independent rows of at most CHUNK lines, and no task holds more of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 128


@dataclass(frozen=True)
class Machine:
    """states (the first one is the start), classes, and moves[class][state] = (next state, tag)."""

    states: tuple[str, ...]
    classes: tuple[str, ...]
    moves: dict[str, dict[str, tuple[str, str]]]

    @classmethod
    def of(cls, states: tuple[str, ...], classes: tuple[str, ...], move: Callable[[str, str], tuple[str, str]]) -> Machine:
        """The table of move(state, class)."""
        return cls(states, classes, {c: {s: move(s, c) for s in states} for c in classes})

    def table(self) -> Column:
        """By class, then by state: the next state's number, whether a block opens, and the tag."""
        number = {s: i for i, s in enumerate(self.states)}
        one = lambda to, tag: F.struct(F.lit(number[to]).alias("to"), F.lit(int(tag == "open")).alias("opens"), F.lit(tag).alias("tag"))
        return F.array(*[F.array(*[one(*self.moves[c][s]) for s in self.states]) for c in self.classes])


def _place(to: Column, opened: Column) -> Column:
    return F.struct(to.cast("int").alias("to"), opened.cast("long").alias("opened"))


def _then(first: Column, second: Column) -> Column:
    """The place that a function leads to from the place first."""
    move = F.get(second, first["to"])
    return _place(move["to"], first["opened"] + move["opened"])


def _starts(functions: DataFrame, states: int, last_chunk: int, chunk: int) -> DataFrame:
    """(doc_id, part, start): the place before each part, from (doc_id, part, f)."""
    start = _place(F.lit(0), F.lit(0))
    if last_chunk == 0:
        return functions.select("doc_id", "part", start.alias("start"))
    above = F.expr(f"part div {chunk}").alias("above")
    parts = functions.groupBy("doc_id", above).agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("parts"))
    same = F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda s: _place(s, F.lit(0)))
    whole = F.aggregate("parts", same, lambda acc, x: F.transform(acc, lambda place: _then(place, x["f"])))
    begun = _starts(parts.select("doc_id", F.col("above").alias("part"), whole.alias("f")), states, last_chunk // chunk, chunk)
    begun = begun.select(F.col("doc_id").alias("_doc"), F.col("part").alias("_above"), "start")
    joined = parts.join(begun, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("above") == F.col("_above")))
    kind = "array<struct<part:bigint,start:struct<to:int,opened:bigint>>>"
    step = lambda acc, x: F.struct(_then(acc["now"], x["f"]).alias("now"), F.concat(acc["out"], F.array(F.struct(x["part"].alias("part"), acc["now"].alias("start")))).alias("out"))
    walked = F.aggregate("parts", F.struct(F.col("start").alias("now"), F.array().cast(kind).alias("out")), step)["out"]
    return joined.select("doc_id", F.explode(walked).alias("x")).select("doc_id", "x.*")


def walk(lines: DataFrame, machine: Machine, kind: Column, chunk: int = CHUNK) -> DataFrame:
    """lines with kind (its class, one of the machine's), state (after the line), tag, and block (opened so far).

    lines holds (doc_id, line_no, line); line_no counts from 0 without gaps that matter, null never occurs.
    """
    last = lines.agg(F.max("line_no")).first()[0] or 0
    number = F.coalesce(*[F.when(kind == c, i) for i, c in enumerate(machine.classes)])
    part = F.expr(f"line_no div {chunk}").alias("part")
    parts = lines.select("doc_id", "line_no", "line", number.alias("c"), part).groupBy("doc_id", "part").agg(F.array_sort(F.collect_list(F.struct("line_no", "c", "line"))).alias("lines"))
    table = machine.table()
    step = lambda place, c: F.get(F.get(table, c), place["to"])
    moved = lambda place, c: _place(step(place, c)["to"], place["opened"] + step(place, c)["opens"])
    same = F.transform(F.sequence(F.lit(0), F.lit(len(machine.states) - 1)), lambda s: _place(s, F.lit(0)))
    whole = F.aggregate("lines", same, lambda acc, x: F.transform(acc, lambda place: moved(place, x["c"])))
    if last // chunk == 0:
        begun = parts.withColumn("start", _place(F.lit(0), F.lit(0)))
    else:
        starts = _starts(parts.select("doc_id", "part", whole.alias("f")), len(machine.states), last // chunk, chunk)
        starts = starts.select(F.col("doc_id").alias("_doc"), F.col("part").alias("_part"), "start")
        begun = parts.join(starts, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")))
    shape = "array<struct<line_no:bigint,c:int,line:string,to:int,tag:string,block:bigint>>"

    def one(acc: Column, x: Column) -> Column:
        now = moved(acc["now"], x["c"])
        row = F.struct(x["line_no"].cast("long").alias("line_no"), x["c"].alias("c"), x["line"].alias("line"), now["to"].alias("to"), step(acc["now"], x["c"])["tag"].alias("tag"), now["opened"].alias("block"))
        return F.struct(now.alias("now"), F.concat(acc["out"], F.array(row)).alias("out"))

    walked = F.aggregate("lines", F.struct(F.col("start").alias("now"), F.array().cast(shape).alias("out")), one)["out"]
    name = lambda names, i: F.get(F.array(*map(F.lit, names)), i)
    rows = begun.select("doc_id", F.explode(walked).alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "line_no", "line", name(machine.classes, F.col("c")).alias("kind"), name(machine.states, F.col("to")).alias("state"), "tag", "block")
