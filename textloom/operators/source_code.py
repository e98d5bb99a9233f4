"""Source files without comments or bodies, as operators over ordered lines: comments and docstrings are a line state machine,
bodies end where prefix sums of braces come back to zero, so no file is walked by Python.

source_lines() gives the lines of files with their language; minimal() and aggressive() give (doc_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import text as X
from textloom.operators.machines import CHUNK, Machine, walk

#: Files shorter than this many bytes stay as they are.
LEAST_BYTES = 512
#: Languages by file extension.
LANGUAGES = {
    "rust": ("rs",),
    "python": ("py", "pyw"),
    "javascript": ("js", "mjs", "cjs"),
    "typescript": ("ts", "tsx"),
    "go": ("go",),
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh"),
    "java": ("java",),
    "ruby": ("rb",),
    "shell": ("sh", "bash", "zsh"),
    "data": ("json", "jsonc", "json5", "yaml", "yml", "toml", "xml", "csv", "tsv", "graphql", "gql", "sql", "md", "markdown", "txt", "env", "lock"),
}
#: Of each language the mark of a line comment, of a line of documentation, and the start, end and documenting start of a block.
MARKS = {
    "rust": ("//", "///", "/*", "*/", "/**"),
    "python": ("#", None, '"""', '"""', '"""'),
    **dict.fromkeys(("javascript", "typescript", "go", "c", "cpp", "java"), ("//", None, "/*", "*/", "/**")),
    "ruby": ("#", None, "=begin", "=end", None),
    "shell": ("#", None, None, None, None),
    "data": (None, None, None, None, None),
    "unknown": ("//", None, "/*", "*/", None),
}
#: Lines of imports and signatures, and how other lines that stay begin.
IMPORT = r"^(use |import |from |require\(|#include)"
SIGNATURE = r"^(pub\s+)?(async\s+)?(fn|def|function|func|class|struct|enum|trait|interface|type)\s+\w+"
DECLARED = ("const ", "static ", "let ", "pub const ", "pub static ")
BODY = "    // ... implementation"


def language_of(path: Column) -> Column:
    """The language of a file by its extension, unknown without one that is listed."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.coalesce(X.lookup(extension, {e: name for name, es in LANGUAGES.items() for e in es}), F.lit("unknown"))


def _mark(language: Column, i: int) -> Column:
    return X.lookup(language, {name: marks[i] for name, marks in MARKS.items() if marks[i]})


def source_lines(docs: DataFrame, language: Column, text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, language, short); short: the whole file is too short to be filtered. Null texts are empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n", -1)
    rows = docs.select("doc_id", language.alias("language"), (F.octet_length(text) < LEAST_BYTES).alias("short"), F.posexplode(lines).alias("line_no", "line"))
    return rows.select("doc_id", F.col("line_no").cast("long").alias("line_no"), "line", "language", "short")


# a class is whether the line holds a block's start and its end, and what it is besides: a docstring's quote, a comment or text


def _move(state: str, kind: str) -> tuple[str, str]:
    start, end, rest = kind[0] == "1", kind[1] == "1", kind[2]
    if start and state != "docstring":
        state = "comment"
    if state == "comment":
        return ("code" if end else "comment"), ""
    if rest == "q":
        return ("code" if state == "docstring" else "docstring"), "keep"
    return state, "keep" if state == "docstring" or rest == "t" else ""


COMMENTS = Machine.of(("code", "comment", "docstring"), tuple(a + b + c for a in "01" for b in "01" for c in "qct"), _move)


def _kind(line: Column, language: Column) -> Column:
    t = X.trim(line)
    holds = lambda mark: F.coalesce(F.contains(t, mark), F.lit(False))
    begins = lambda mark: F.coalesce(F.startswith(t, mark), F.lit(False))
    start = holds(_mark(language, 2)) & ~F.startswith(t, F.coalesce(_mark(language, 4), F.lit("###")))
    rest = F.when((language == "python") & t.startswith('"""'), "q").when(begins(_mark(language, 0)) & ~begins(_mark(language, 1)), "c").otherwise("t")
    flag = lambda c: F.when(c, "1").otherwise("0")
    return F.concat(flag(start), flag(holds(_mark(language, 3))), rest)


def minimal_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, line) without comments, and with one blank line where there are several, none at both ends."""
    # the language goes through the machine in front of the line
    sent = lines.select("doc_id", "line_no", F.concat("language", F.lit("\n"), "line").alias("line"))
    language, line = F.substring_index("line", "\n", 1), F.regexp_replace("line", r"\A[^\n]*\n", "")
    kept = walk(sent, COMMENTS, _kind(line, language), chunk).filter("tag = 'keep'").select("doc_id", "line_no", line.alias("line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    blank = X.trim(F.col("line")) == ""
    some = F.count(F.when(~blank, 1))
    every = kept.withColumns({"blank": blank, "before": some.over(order.rowsBetween(Window.unboundedPreceding, 0)), "all": some.over(Window.partitionBy("doc_id")), "last_blank": F.lag(blank).over(order)})
    inside = (F.col("before") > 0) & (F.col("before") < F.col("all"))
    return every.filter(~F.col("blank") | (inside & ~F.coalesce("last_blank", F.lit(True)))).select("doc_id", "line_no", F.when(F.col("blank"), "").otherwise(F.col("line")).alias("line"))


def _texts(lines: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each file joined and trimmed; short files as they are."""
    joined = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("code")).withColumnRenamed("doc_id", "_doc")
    return raw.join(joined, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", F.when(F.octet_length("text") < LEAST_BYTES, F.col("text")).otherwise(F.coalesce(X.trim(F.col("code")), F.lit(""))).alias("text"))


def minimal(docs: DataFrame, language: Column, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text) without comments; documentation stays."""
    lines = source_lines(docs, language, text_col)
    return _texts(minimal_lines(lines.filter("not short"), chunk), docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("text")))


def aggressive_lines(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, line_no, line): imports, signatures, declarations outside of bodies, and of bodies their outer braces."""
    kept = minimal_lines(lines, chunk)
    t = X.trim(F.col("line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.withColumns({"t": t, "imports": t.rlike(IMPORT)}).withColumn("signs", ~F.col("imports") & F.col("t").rlike(SIGNATURE))
    rows = rows.withColumn("part", F.count(F.when(F.col("signs"), 1)).over(upto))
    braces = F.when(F.col("signs") | F.col("imports"), 0).otherwise(F.length(F.regexp_replace("t", r"[^{]", "")) - F.length(F.regexp_replace("t", r"[^}]", "")))
    part = Window.partitionBy("doc_id", "part").orderBy("line_no")
    rows = rows.withColumn("depth", F.sum(braces).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    plain = ~F.col("signs") & ~F.col("imports")
    ended = F.coalesce(F.max((plain & (F.col("depth") <= 0)).cast("int")).over(part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    rows = rows.withColumn("inside", plain & (F.col("part") > 0) & ~ended)
    brace = (F.col("depth") <= 1) & (F.col("t").isin("{", "}") | F.col("t").endswith("{"))
    declared = F.col("t").startswith(DECLARED[0])
    for word in DECLARED[1:]:
        declared = declared | F.col("t").startswith(word)
    own = F.when(F.col("imports") | F.col("signs") | (F.col("inside") & brace) | (plain & ~F.col("inside") & declared), F.array("line")).otherwise(F.array().cast("array<string>"))
    mark = F.when(F.col("inside") & (F.col("depth") <= 0) & ~F.col("t").isin("", "}"), F.array(F.lit(BODY))).otherwise(F.array().cast("array<string>"))
    shown = rows.select("doc_id", "line_no", F.posexplode(F.concat(own, mark)).alias("at", "line"))
    return shown.select("doc_id", (F.col("line_no") * 2 + F.col("at")).alias("line_no"), "line")


def aggressive(docs: DataFrame, language: Column, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text): signatures and declarations only; data formats lose comments only."""
    lines = source_lines(docs, language, text_col)
    code = aggressive_lines(lines.filter("not short and language <> 'data'"), chunk).unionByName(minimal_lines(lines.filter("not short and language = 'data'"), chunk))
    return _texts(code, docs.select("doc_id", F.coalesce(text_col, F.lit("")).alias("text")))


def smart_truncate(lines: DataFrame, most: int) -> DataFrame:
    """(doc_id, text) of at most most lines: the first half of them, then lines that matter, and how many are not shown."""
    t = X.trim(F.col("line"))
    matters = t.rlike(SIGNATURE) | t.rlike(IMPORT) | t.startswith("pub ") | t.startswith("export ") | t.isin("{", "}")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = lines.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("doc_id")), "place": F.row_number().over(order), "matters": matters})
    chosen = rows.filter((F.col("n") <= most) | (F.col("place") <= most // 2) | F.col("matters")).withColumn("k", F.row_number().over(order)).filter((F.col("n") <= most) | (F.col("k") < most))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    shown = chosen.groupBy("doc_id").agg(joined.alias("text"), F.max("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return shown.select("doc_id", F.when(F.col("n") > most, F.concat("text", F.lit("\n["), (F.col("n") - F.col("k")).cast("string"), F.lit(" more lines]"))).otherwise(F.col("text")).alias("text"))
