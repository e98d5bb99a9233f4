"""Queries over shell command lines made from the events table: tokens and chains of quoted, escaped and broken lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import shell
from textloom.sources.tables import table

#: A command line (@ is the event), its tokens (kind initial, value) and the commands of its chain.
LINES = (
    ('git commit -m "a && b; @" && cargo test', 'a git|a commit|a -m|a "a && b; @"|o &&|a cargo|a test', 'git commit -m "a && b; @"|cargo test'),
    ("make 2>&1 ; tee out@.log", "a make|r 2>&1|o ;|a tee|a out@.log", "make 2>&1|tee out@.log"),
    ("echo $HOME/x > /tmp/@ &> y &>> z", "a echo|a $HOME|a /x|r >|a /tmp/@|r &>|a y|r &>>|a z", "echo $HOME/x > /tmp/@ &> y &>> z"),
    ("(cd a; ls *.rs) && true@ &", "s (|a cd|a a|o ;|a ls|s *|a .rs|s )|o &&|a true@|s &", "(cd a|ls *.rs)|true@ &"),
    ("grep 'it;''s' a\\ b\\;c@ < in << EOF", "a grep|a 'it;''s'|a a\\ b\\;c@|r <|a in|r <<|a EOF", "grep 'it;''s' a\\ b\\;c@ < in << EOF"),
    ('printf "x\\"y;" $(date) `id` !@ ${V}', 'a printf|a "x\\"y;"|s $|s (|a date|s )|s `|a id|s `|s !|a @|s $|s {|a V|s }', 'printf "x\\"y;" $(date) `id` !@ ${V}'),
    ('echo "open @ && never', 'a echo|a "open @ && never', 'echo "open @ && never'),
    ("a1>b 12>c x&&y@;;", "a a1|r >|a b|r 12>|a c|a x|o &&|a y@|o ;|o ;", "a1>b 12>c x|y@"),
)


def commands(s: SparkSession, d: str) -> DataFrame:
    """event_id, command."""
    lines = F.array(*[F.lit(line) for line, _, _ in LINES])
    chosen = F.get(lines, (F.col("event_id") % len(LINES)).cast("int"))
    return table(s, d, "events").select("event_id", F.replace(chosen, F.lit("@"), F.col("event_id").cast("string")).alias("command"))


QUERIES = {
    "shell_tokens": lambda s, d: commands(s, d).select("event_id", F.posexplode(shell.tokens(F.col("command"))).alias("pos", "t")).select("event_id", "pos", "t.kind", "t.value"),
    "shell_chains": lambda s, d: commands(s, d).select("event_id", F.posexplode(shell.chain(F.col("command"))).alias("pos", "part")),
}


def _listed(column: int) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    return "[" + ", ".join(quote(line[column]) for line in LINES) + f"][event_id % {len(LINES)} + 1]"


# what a line's parts are is written out above; nothing is parsed
_SPLIT = "SELECT event_id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS part FROM (SELECT event_id, string_split(replace({}, '@', event_id::VARCHAR), '|') AS parts FROM events)"
ORACLES = {
    "shell_tokens": f"SELECT event_id, pos, CASE left(part, 1) WHEN 'a' THEN 'arg' WHEN 'o' THEN 'operator' WHEN 'r' THEN 'redirect' ELSE 'shellism' END AS kind, part[3:] AS value FROM ({_SPLIT.format(_listed(1))})",
    "shell_chains": _SPLIT.format(_listed(2)),
}
