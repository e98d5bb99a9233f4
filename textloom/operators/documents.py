"""Compressors of whole outputs: logs, search results, diffs, positional diffs, source code, JSON arrays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators.runs import by_doc, so_far


def log_summary(lines: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Templates of each log: doc_id, level, template, n, example (first line), by falling count up to the level's cap."""
    caps = caps or {"error": 10, "warn": 5, "info": 0}
    marked = lines.select("doc_id", "line_no", "line", X.log_level(F.col("line")).alias("level"), X.normalize_log_line(F.col("line")).alias("template")).filter("level is not null")
    groups = marked.groupBy("doc_id", "level", "template").agg(F.count(F.lit(1)).alias("n"), F.min_by("line", "line_no").alias("example"))
    rank = F.row_number().over(Window.partitionBy("doc_id", "level").orderBy(F.desc("n"), "template"))
    return groups.withColumn("_rank", rank).filter(F.col("_rank") <= X.lookup(F.col("level"), caps)).drop("_rank")


SEARCH_FORMS = (r"(.+?):(\d+):\d+:(.+)", r"(.+?):(\d+):(.+)", r"(.+?):(.+)")


def parse_matches(lines: DataFrame) -> DataFrame:
    """doc_id, line_no, file, number, content of lines file:line:col:text, file:line:text or file:text."""
    line = F.col("line")
    # one match a line: its groups, joined by a control character; the first form that fits wins
    joined = F.regexp_replace(line, f"^(?:{'|'.join(SEARCH_FORMS)})$", "$1$4$7\u0001$2$5\u0001$3$6$8")
    parts = F.filter(F.array(F.split(joined, "\u0001", 3)), lambda x: F.size(x) == 3)
    formed = lines.filter(line.contains(":")).select("doc_id", "line_no", F.explode(parts).alias("p"))
    return formed.select("doc_id", "line_no", F.col("p")[0].alias("file"), F.coalesce(F.col("p")[1].try_cast("long"), F.lit(0)).alias("number"), F.col("p")[2].alias("content"))


def match_score(file: Column, content: Column) -> Column:
    low, trimmed = F.lower(content), X.trim(content)
    add = lambda hit, x: F.when(hit, x).otherwise(0.0)
    score = (
        F.lit(0.3)
        + add(low.rlike("error|fail|exception|panic|crash"), 0.3)
        + add(low.rlike("warn|deprecated"), 0.15)
        + add(low.rlike("fn |def |class |struct |impl |trait |function "), 0.2)
        + add(low.rlike(r"test|spec|it\(|describe\("), 0.1)
        + add(F.lower(file).rlike(r"\.(rs|py|ts|js|go|rs\.bk)$"), 0.1)
        - add(F.octet_length(content) > 200, 0.1)
        - add(trimmed.rlike(r"^(//|#|/\*|\*)"), 0.15)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def search_rank(lines: DataFrame, per_file: int = 10, files: int = 20, least: float = 0.1) -> DataFrame:
    """The best matches of the best files of each search output; a file scores its best plus half its mean."""
    score = F.array(F.round(match_score(F.col("file"), F.col("content")), 6))
    scored = parse_matches(lines).withColumn("score", F.explode(F.filter(score, lambda x: x >= least)))  # worked out once
    of_file = Window.partitionBy("doc_id", "file")
    ranked = scored.withColumns({"rank": F.row_number().over(of_file.orderBy(F.desc("score"), "line_no")), "file_score": F.round(F.max("score").over(of_file) + 0.5 * F.avg("score").over(of_file), 6)})
    place = F.dense_rank().over(by_doc().orderBy(F.desc("file_score"), "file"))
    return ranked.withColumn("file_rank", place).filter((F.col("rank") <= per_file) & (F.col("file_rank") <= files))


def parse_diff(lines: DataFrame) -> DataFrame:
    """Lines of a unified diff with file_id, hunk_id, kind (+, -, space) and content."""
    line = F.col("line")
    file_id = F.sum(line.startswith("diff --git").cast("int")).over(so_far())
    hunk_id = F.sum(line.startswith("@@").cast("int")).over(so_far())
    marked = lines.withColumns({"file_id": file_id.cast("long"), "hunk_id": hunk_id.cast("long")})
    body = ~line.rlike(r"^(diff --git|index |--- |\+\+\+ |@@|new file|deleted file|similarity|rename )") & line.rlike(r"^[-+ ]") & (F.col("hunk_id") > 0)
    return marked.filter(body).select("doc_id", "line_no", "file_id", "hunk_id", F.left(line, F.lit(1)).alias("kind"), F.substring(line, 2, 1 << 30).alias("content"))


def trim_context(diff: DataFrame, context: int = 3) -> DataFrame:
    """Diff lines that are changes or lie within context lines of one."""
    hunk = Window.partitionBy("doc_id", "hunk_id").orderBy("line_no")
    near = F.max((F.col("kind") != " ").cast("int")).over(hunk.rowsBetween(-context, context))
    return diff.withColumn("_near", near).filter("_near = 1").drop("_near")


def hunk_scores(diff: DataFrame) -> DataFrame:
    """Mean over a hunk's lines: 1 for changes, less the farther from one (0.8 to 2 lines, 0.5 to 5, 0.2 beyond)."""
    hunk = Window.partitionBy("doc_id", "hunk_id").orderBy("line_no")
    change = F.when(F.col("kind") != " ", F.col("line_no"))
    before = F.last(change, ignorenulls=True).over(hunk.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(change, ignorenulls=True).over(hunk.rowsBetween(0, Window.unboundedFollowing))
    far = F.least(F.col("line_no") - before, after - F.col("line_no"))
    score = F.when(far == 0, 1.0).when(far <= 2, 0.8).when(far <= 5, 0.5).otherwise(0.2)
    return diff.withColumn("s", score).groupBy("doc_id", "file_id", "hunk_id").agg(F.avg("s").alias("score"))


def char_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.filter(F.split(a, ""), lambda c: c != "")), F.array_distinct(F.filter(F.split(b, ""), lambda c: c != ""))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def positional_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Line by line: doc_id, line_no, change (same, modified, removed, added, replaced)."""
    both = left.select("doc_id", "line_no", F.col("line").alias("old")).join(right.select("doc_id", "line_no", F.col("line").alias("new")), ["doc_id", "line_no"], "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").when(char_jaccard(F.col("old"), F.col("new")) > 0.5, "modified").otherwise("replaced")
    return both.withColumn("change", change)


# Comment marks by language.
COMMENTS = {"rust": ("//", "/*", "*/", "///"), "python": ("#", '"""', '"""', None), "javascript": ("//", "/*", "*/", "/**"), "go": ("//", "/*", "*/", None), "java": ("//", "/*", "*/", "/**"), "shell": ("#", None, None, None)}
EXTENSIONS = {"rs": "rust", "py": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "javascript", "tsx": "javascript", "go": "go", "java": "java", "sh": "shell", "bash": "shell"}
KEEPS = re.compile(r"^\s*(?:pub\s+|export\s+|async\s+|static\s+)*(?:use|import|from|require|fn|def|class|struct|enum|trait|impl|interface|type|func|function|const|let|package|module|mod)\b")


def strip_code(text: str, language: str, aggressive: bool = False) -> str:
    """Source without comments and runs of blank lines; aggressive keeps imports, signatures and top-level lines."""
    line_mark, opens, closes, doc = COMMENTS.get(language, (None,) * 4)
    out, inside, blank = [], False, False
    for line in text.split("\n"):
        t = line.strip()
        if inside:
            inside = closes not in t
            continue
        if opens and language != "python" and t.startswith(opens) and not (doc and t.startswith(doc)):
            inside = closes not in t[len(opens) :]
            continue
        if line_mark and t.startswith(line_mark) and not (doc and t.startswith(doc)) and not t.startswith("#!"):
            continue
        if aggressive and t and not KEEPS.match(line) and line[:1] in " \t":
            continue
        if not t and blank:
            continue
        blank = not t
        out.append(line)
    return "\n".join(out).strip("\n")


def code_filter(docs: DataFrame, language: Column, aggressive: bool = False) -> DataFrame:
    """docs with code, the text filtered for its language."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([strip_code(t or "", lang, aggressive) for t, lang in zip(texts, languages, strict=True)])

    return docs.withColumn("code", run(F.col("text"), language))


# JSON arrays -----------------------------------------------------------------------------------------------------------
ERROR_WORDS = "error|exception|failed|failure|critical|fatal|crash|panic|abort|timeout|denied|rejected"


def crush_plan(kind: str, n: int, k: int = 15) -> int:
    """How many of n elements of an array stay: all of small arrays, fewer of long ones."""
    if n <= k:
        return n
    factor = 1 if n <= 3 * k else 2 if n <= 5 * k else 3
    return {"number": max(5, k // factor), "bool": max(5, k // factor)}.get(kind, k)


def element_kind(values: list) -> str:
    kinds = {"bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "object" if isinstance(v, dict) else "nested" if isinstance(v, list) else "null" for v in values[:100]}
    return "empty" if not values else kinds.pop() if len(kinds) == 1 else "mixed"


def crush(value, depth: int = 0):
    """value with long arrays reduced: errors and structural outliers stay, the rest is sampled at even steps."""
    if depth > 20:
        return value
    if isinstance(value, dict):
        return {k: crush(v, depth + 1) for k, v in value.items()}
    if not isinstance(value, list):
        return value
    n, keep = len(value), crush_plan(element_kind(value), len(value))
    if keep >= n:
        return [crush(v, depth + 1) for v in value]
    counts: dict[str, int] = {}
    for v in value:
        for key in v if isinstance(v, dict) else ():
            counts[key] = counts.get(key, 0) + 1
    must = {i for i, v in enumerate(value) if re.search(ERROR_WORDS, json.dumps(v).lower()) or (isinstance(v, dict) and any(counts[k] < 0.2 * n for k in v))}
    step = n // keep
    chosen = sorted(must | {i * step for i in range(keep)})
    return [crush(value[i], depth + 1) for i in chosen]


@F.pandas_udf(StringType())
def crush_json(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return json.dumps(crush(json.loads(t)), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return t

    return texts.map(one)


def json_schema(value, depth: int = 0, most: int = 5) -> str:
    if depth >= most:
        return "..."
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {json_schema(v, depth + 1, most)}" for k, v in list(value.items())[:20]) + "}"
    if isinstance(value, list):
        return f"[{json_schema(value[0], depth + 1, most)}] ({len(value)})" if value else "[]"
    if isinstance(value, str):
        return "url" if value.startswith("http") else f"string[{len(value)}]" if len(value) > 50 else "string"
    return "null" if value is None else "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float"


@F.pandas_udf(StringType())
def json_schema_view(texts: pd.Series) -> pd.Series:
    def one(t: str | None) -> str | None:
        try:
            return json_schema(json.loads(t))
        except (TypeError, ValueError):
            return None

    return texts.map(one)


def rare_keys(items: DataFrame, group: str = "doc_id", share: float = 0.2) -> DataFrame:
    """Structural outliers: keys that fewer than share of a group's JSON objects (column json) hold."""
    keys = items.select(group, F.explode(F.json_object_keys("json")).alias("key")).groupBy(group, "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = items.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    return keys.join(sizes, group).filter(F.col("n") < share * F.col("total"))


def rare_values(items: DataFrame, value: Column, group: str = "doc_id", cover: float = 0.8, most: int = 5) -> DataFrame:
    """Values outside the commonest few that cover most rows of a group; for 2 to 50 distinct values only."""
    counts = items.groupBy(group, value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy(group)
    order = own.orderBy(F.desc("n"), "value")
    seen = counts.withColumns({"total": F.sum("n").over(own), "kinds": F.count(F.lit(1)).over(own), "before": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), "rank": F.row_number().over(order)})
    top = seen.withColumn("top", F.coalesce("before", F.lit(0)) < F.ceil(F.col("total") * cover))
    width = F.sum(F.col("top").cast("int")).over(own)
    return top.withColumn("width", width).filter(f"kinds between 2 and 50 and width <= {most} and not top").select(group, "value", "n")


def field_profile(items: DataFrame, value: Column, order: Column, group: str = "doc_id") -> DataFrame:
    """Whether a field looks like an id (nearly unique, or rising in even steps) per group: share distinct, share of even steps."""
    rows = items.select(group, value.cast("double").alias("v"), order.alias("o"))
    step = F.col("v") - F.lag("v").over(Window.partitionBy(group).orderBy("o"))
    steps = rows.withColumn("step", step)
    mean = F.avg("step").over(Window.partitionBy(group))
    even = steps.withColumn("even", F.when(F.col("step").isNotNull(), (F.col("step") >= 0.5 * mean) & (F.col("step") <= 2 * mean)))
    return even.groupBy(group).agg((F.countDistinct("v") / F.count("v")).alias("distinct_share"), F.avg(F.col("even").cast("double")).alias("even_share"), F.coalesce(F.min("step") >= 0, F.lit(True)).alias("rising"))


