"""The declarative line filter: a specification becomes a chain of Column expressions in eight fixed stages."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import text as X


@dataclass(frozen=True)
class Filter:
    """One filter. Stages: strip ANSI, replace, match_output, strip or keep lines, truncate, head/tail, max_lines, on_empty."""

    match_command: str = ""
    description: str = ""
    strip_ansi: bool = False
    replace: tuple = ()  # dicts with pattern, replacement
    match_output: tuple = ()  # dicts with pattern, message and perhaps unless
    strip_lines_matching: tuple = ()
    keep_lines_matching: tuple = ()
    truncate_lines_at: int | None = None
    head_lines: int | None = None
    tail_lines: int | None = None
    max_lines: int | None = None
    on_empty: str | None = None
    filter_stderr: bool = False
    name: str = field(default="", compare=False)

    def __post_init__(self):
        if self.strip_lines_matching and self.keep_lines_matching:
            raise ValueError(f"{self.name}: strip_lines_matching and keep_lines_matching exclude each other")
        patterns = [self.match_command, *self.strip_lines_matching, *self.keep_lines_matching, *(r["pattern"] for r in (*self.replace, *self.match_output))]
        for p in patterns:
            re.compile(p)


def parse(text: str) -> dict[str, Filter]:
    """Filters of a TOML text with schema_version 1; unknown fields are errors."""
    spec = tomllib.loads(text)
    if spec.pop("schema_version", None) != 1:
        raise ValueError("schema_version must be 1")
    if unknown := spec.keys() - {"filters", "tests"}:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    known = Filter.__dataclass_fields__.keys() - {"name"}
    out = {}
    for name, fields in spec.get("filters", {}).items():
        if unknown := fields.keys() - known:
            raise ValueError(f"{name}: unknown fields {sorted(unknown)}")
        out[name] = Filter(name=name, **{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
    return out


def inline_tests(text: str) -> list[tuple[str, str, str, str]]:
    """(filter, test name, input, expected) of a TOML text."""
    return [(f, t["name"], t["input"], t["expected"]) for f, tests in tomllib.loads(text).get("tests", {}).items() for t in tests]


def lines_of(text: Column) -> Column:
    """The lines of a text; a last line feed ends a line and begins none."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1))


def _java(replacement: str) -> str:
    return re.sub(r"\$\{(\w+)\}", r"$\1", replacement)


def apply(spec: Filter, text: Column) -> Column:
    """The text that the filter makes of text, in built-in functions throughout."""
    lines = lines_of(F.coalesce(text, F.lit("")))
    if spec.strip_ansi:
        lines = F.transform(lines, X.strip_ansi)
    for rule in spec.replace:
        lines = F.transform(lines, _replacer(rule))
    blob = F.array_join(lines, "\n")
    if spec.strip_lines_matching:
        lines = F.filter(lines, lambda x: ~x.rlike("|".join(f"(?:{p})" for p in spec.strip_lines_matching)))
    if spec.keep_lines_matching:
        lines = F.filter(lines, lambda x: x.rlike("|".join(f"(?:{p})" for p in spec.keep_lines_matching)))
    if spec.truncate_lines_at is not None:
        lines = F.transform(lines, lambda x: X.truncate(x, spec.truncate_lines_at))
    n, head, tail = F.size(lines), spec.head_lines, spec.tail_lines
    said = lambda count, what="omitted": F.array(F.concat(F.lit("... ("), count.cast("string"), F.lit(f" lines {what})")))
    last = lambda k: F.slice(lines, F.greatest(n - k + 1, F.lit(1)), F.lit(k)) if k else F.array().cast("array<string>")
    if head is not None and tail is not None:
        lines = F.when(n > head + tail, F.concat(F.slice(lines, 1, head), said(n - head - tail), last(tail))).otherwise(lines)
    elif head is not None:
        lines = F.when(n > head, F.concat(F.slice(lines, 1, head), said(n - head))).otherwise(lines)
    elif tail is not None:
        lines = F.when(n > tail, F.concat(said(n - tail), last(tail))).otherwise(lines)
    if spec.max_lines is not None:
        n = F.size(lines)
        lines = F.when(n > spec.max_lines, F.concat(F.slice(lines, 1, spec.max_lines), said(n - spec.max_lines, "truncated"))).otherwise(lines)
    out = F.array_join(lines, "\n")
    if spec.on_empty is not None:
        out = F.when(X.trim(out) == "", F.lit(spec.on_empty)).otherwise(out)
    for rule in reversed(spec.match_output):
        hit = blob.rlike(rule["pattern"])
        if rule.get("unless"):
            hit = hit & ~blob.rlike(rule["unless"])
        out = F.when(hit, F.lit(rule["message"])).otherwise(out)
    return out


def _replacer(rule: dict):
    return lambda x: F.regexp_replace(x, rule["pattern"], _java(rule["replacement"]))


def choose(command: Column, filters: dict[str, Filter]) -> Column:
    """The name of the first filter whose match_command fits."""
    return X.first_match(command, [(n, f.match_command) for n, f in filters.items() if f.match_command])


def filter_outputs(outputs: DataFrame, filters: dict[str, Filter], command_col: str = "command", text_col: str = "text") -> DataFrame:
    """outputs with filter (name or null) and filtered: each text by the first filter that fits its command."""
    chosen = outputs.withColumn("filter", choose(F.col(command_col), filters))
    out = F.col(text_col)
    for name, spec in filters.items():
        out = F.when(F.col("filter") == name, apply(spec, F.col(text_col))).otherwise(out)
    return chosen.withColumn("filtered", X.never_worse(F.col(text_col), out))
