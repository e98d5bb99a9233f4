"""Scalar functions over lines and texts, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words, patterns, scores and formats that results must agree on.
SEVERITY_WORDS = (
    ("fatal", ("fatal", "panic", "panicked", "critical")),
    ("error", ("error", "fail", "failed", "failure")),
    ("warning", ("warning", "warn")),
    ("debug", ("debug", "trace")),
    ("info", ("info",)),
)
SEVERITY_SCORES = {"fatal": 1.0, "error": 0.9, "warning": 0.6, "info": 0.3, "debug": 0.1, "unknown": 0.2}
KEYWORDS = (
    ("error", ("error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout")),
    ("security", ("vulnerability", "injection", "exploit", "breach", "denied", "rejected")),
    ("warning", ("warn", "warning", "deprecated")),
    ("summary", ("summary", "total", "result", "passed", "skipped")),
)
KEYWORD_SCORES = {"error": 1.0, "security": 0.85, "warning": 0.75, "summary": 0.4, "plain": 0.0}
CODE_MARKS = ("fn ", "func ", "def ", "class ", "import ", "from ", "pub ", "let ", "const ", "var ", "async ", "await ", "impl ", "struct ", "enum ", "trait ", "#[", "//", "/*", "*/", "=>", "->", "::")
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
SECRET_NAMES = (
    "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN", "AWS_ACCESS_KEY_ID", "GH_TOKEN", "GITHUB_TOKEN", "GH_ENTERPRISE_TOKEN", "GITLAB_TOKEN", "OPENAI_API_KEY", "ANTHROPIC_API_KEY", "NPM_TOKEN",
    "HF_TOKEN", "HUGGING_FACE_HUB_TOKEN", "SLACK_TOKEN", "SLACK_BOT_TOKEN", "SLACK_APP_TOKEN", "DOCKER_PASSWORD", "DOCKERHUB_PASSWORD", "CI_JOB_TOKEN", "CARGO_REGISTRY_TOKEN",
    "RUBYGEMS_API_KEY", "PYPI_TOKEN", "DATABASE_URL", "PGPASSWORD",
)
#: Pattern and replacement, in the order in which they apply.
REDACTIONS = (
    (r"([a-zA-Z][a-zA-Z0-9+.-]*://)([^/@\s:]+):([^@\s]+)@", "$1****:****@"),
    (r"(?i)((?:authorization\s*[:=]\s*)?(?:bearer|basic|token))[ \t]+([^\s\"']+)", "$1 ****"),
    (r"(?i)(--(?:token|password|passwd|pwd|api[_-]?key|secret|auth|access[_-]?token|refresh[_-]?token))(=|\s+)([^\s\"']+)", "$1$2****"),
    (rf"\b({'|'.join(SECRET_NAMES)})=(\S+)", "$1=****"),
    (r"\b(?:ghp_|gho_|ghu_|ghs_|github_pat_|sk-live_|sk_live_|sk_test_|sk-|xoxb-|xoxp-|xoxa-|xoxs-|glpat-|AKIA|ASIA)[A-Za-z0-9_\-]{16,}\b", "****"),
)
#: For each rule, texts of which every match holds one, in small letters; most documents have none and need no search.
REDACTION_MARKS = (("://",), ("bearer", "basic", "token"), ("--",), ("=",), ("ghp_", "gho_", "ghu_", "ghs_", "github_pat_", "sk-", "sk_live_", "sk_test_", "xox", "glpat-", "akia", "asia"))
LOG_NORMAL = (
    (r"^\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}[.,]?\d*\s*", ""),
    (UUID, "<UUID>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"\b\d{4,}\b", "<NUM>"),
    (r"/[\w./\-]+", "<PATH>"),
)
LOG_LEVELS = (("error", ("error", "fatal", "panic", "critical", "alert", "emerg", "severe")), ("warn", ("warn", "notice")), ("info", ("info",)))
ANCHORS = (
    ("header", r"^(#{1,6}\s|={3,}|-{3,}|___)"),
    ("summary", r"(?i)(?:^summary|tests:|results:|total:|passed:|failed:|errors?:\s+\d|^\d+ passed|^\d+ failed)"),
    ("definition", r"^\s*(?:pub\s+)?(?:fn|def|class|struct|enum|trait|impl|function|async\s+fn|const|let|type|interface|typealias)\s+"),
    ("command", r"^(\$ |% |> |\||`).+"),
    ("key_value", r"^[a-zA-Z_][a-zA-Z0-9_]*\s*[=:]\s*.+"),
    ("path", r"(?i)(?:^|\s)(?:/[a-z0-9_./-]+|[a-zA-Z]:\\[a-z0-9_\.\\-]+|[a-z0-9_./-]+\.[a-z]+)"),
)
ANCHOR_PRIORITIES = {"header": 0.9, "summary": 0.75, "definition": 0.85, "command": 0.8, "key_value": 0.5, "path": 0.6}
ERROR_TYPES = (
    ("unknown_flag", r"(?i)(unexpected argument|unknown (option|flag)|unrecognized (option|flag)|invalid (option|flag))"),
    ("command_not_found", r"(?i)(command not found|not recognized as an internal|no such file or directory.*command)"),
    ("missing_arg", r"(?i)(requires a value|requires an argument|missing (required )?argument|expected.*argument)"),
    ("permission_denied", r"(?i)(permission denied|access denied|not permitted)"),
    ("wrong_path", r"(?i)(no such file or directory|cannot find the path|file not found)"),
)
USER_REJECTION = r"(?i)(user (doesn't want|declined|rejected|cancelled)|operation (cancelled|aborted) by user)"
DIFF_HEADER = r"^diff --git |^--- (?:[ab]/)?\S|^\+\+\+ (?:[ab]/)?\S|^@@\s+-?\d+"
BUILD_ERROR = r"(?i)((error|warning|fatal)(\[|:))|\berror\[E\d+\]|FAILED|Build failed|Compilation failed|cannot find|undefined reference"
SOURCE_LINE = r"^(pub(?:\s+|\([^)]*\)\s*)?)?(fn |func |def |class |import |from |package |module |namespace |struct |enum |trait |impl |type |const |let |var |async |use |extern |static |#\[|//|/\*|\*/)"
SEARCH_SUFFIXES = "rs py js ts go java kt swift c cpp cxx h hpp hh rb toml yaml yml json md txt sh bash zsh fish ps1 css scss less php sql xml conf cfg ini env log r lua hs ex exs vue svelte tex svg gradle sbt makefile dockerfile".split()
SEARCH_LINE = rf"^\S+\.(?:{'|'.join(SEARCH_SUFFIXES)}):\d+[:\-]"


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\u000b\f\r"))


def first_match(column: Column, rules, otherwise=None) -> Column:
    """The name of the first rule (name, regex) that the column matches."""
    return reduce(lambda c, r: c.when(column.rlike(r[1]), F.lit(r[0])), rules[1:], F.when(column.rlike(rules[0][1]), F.lit(rules[0][0]))).otherwise(F.lit(otherwise))


def lookup(column: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), column)


# token estimators: four definitions that differ on purpose
def tokens_by_bytes(text: Column) -> Column:
    return F.least(F.ceil(F.octet_length(text) / 4), F.lit(1_000_000)).cast("long")


def token_content_type(text: Column) -> Column:
    t = trim(text)
    json = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    code = reduce(lambda a, b: a + b, [text.contains(m).cast("int") for m in CODE_MARKS])
    return F.when(json, "json").when(code >= 2, "code").otherwise("text")


def tokens_by_content(text: Column) -> Column:
    ratio = lookup(token_content_type(text), {"json": 3.2, "code": 3.5, "text": 4.0})
    n = F.floor(F.length(text) / ratio) + 3 * F.regexp_count(text, F.lit("https?://")) + 2 * F.regexp_count(text, F.lit(UUID))
    return F.when(text == "", 0).otherwise(F.greatest(n, F.lit(1))).cast("long")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+")).cast("long")


def tokens_approximate(text: Column) -> Column:
    n = F.ceil((F.length(text) / 3.5 + words(text) * 1.3) / 2)
    return F.when(text == "", 0).otherwise(F.greatest(n, F.lit(1))).cast("long")


def severity(line: Column) -> Column:
    low = F.lower(line)
    rules = [(name, "(^|[^a-z0-9_])(" + "|".join(ws) + ")([^a-z0-9_]|$)") for name, ws in SEVERITY_WORDS]
    rules[1] = ("error", rules[1][1] + "|error:")
    rules[2] = ("warning", rules[2][1] + "|warning:")
    return first_match(low, rules, "unknown")


def keyword_level(line: Column) -> Column:
    return first_match(F.lower(line), [(name, "|".join(ws)) for name, ws in KEYWORDS], "plain")


def is_stack_line(line: Column) -> Column:
    t = trim(line)
    at = t.startswith("at ")
    return (
        (t.startswith('File "') & t.contains('", line '))
        | t.startswith("Traceback (most recent call last):")
        | (at & (t.contains("(") | t.contains(".js:") | t.contains(".rs:") | t.endswith(")")))
        | (at & t.contains(" in ") & t.contains(":line "))
        | t.startswith("Caused by:")
        | (t.startswith("--> ") & t.contains(".rs:"))
        | (t.startswith("goroutine ") & t.contains("[running]"))
        | (t.startswith("main.") & t.contains("()"))
    )


def importance(line: Column) -> Column:
    """struct(category, priority, confidence) of the first tier that fits; null if none."""
    low = F.lower(line)
    tiers = (
        (r"fatal|panic|critical", "error", 1.0, 0.98),
        (r"^(error:|error\])", "error", 0.95, 0.95),
        (r"exception|errorcode|errno", "error", 0.90, 0.90),
        (r"failed| fail |failure", "error", 0.85, 0.85),
        (r"warn", "warning", 0.80, 0.85),
        (r"deprecated", "warning", 0.75, 0.80),
    )
    made = [(low.rlike(p), F.struct(F.lit(c).alias("category"), F.lit(a).alias("priority"), F.lit(b).alias("confidence"))) for p, c, a, b in tiers]
    return reduce(lambda c, m: c.when(*m), made[1:], F.when(*made[0]))


def separator_share(line: Column) -> Column:
    """The share of separator characters of a line of three characters or more; null for shorter ones."""
    t = trim(line)
    return F.when(F.length(t) >= 3, (F.length(t) - F.length(F.regexp_replace(t, r"[-=*_~#.—─]", ""))) / F.length(t))


def length_signal(line: Column) -> Column:
    n = F.octet_length(trim(line))
    priority = F.when(n < 10, 0.2).when(n < 30, 0.4).when(n < 100, 0.6).when(n < 200, 0.5).otherwise(0.3)
    confidence = F.when(n < 10, 0.3).when(n < 30, 0.5).when(n < 200, 0.7).otherwise(0.4)
    return F.when(n > 0, F.struct(F.lit("info").alias("category"), priority.alias("priority"), confidence.alias("confidence")))


def effective(signal: Column) -> Column:
    return signal["priority"] * signal["confidence"]


def default_line_score(line: Column) -> Column:
    t = trim(line)
    return F.when(t == "", 0.0).when(F.octet_length(t) < 10, 0.3).when(t.rlike("^(error|Error|FAILED|fatal)"), 0.9).when(t.rlike("^(warning|Warning|WARN)"), 0.7).otherwise(0.5)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value worked out once however often use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _redacted(text: Column) -> Column:
    """struct(text, n) after all rules. A rule runs where the text has one of its marks; what rules put in makes no new marks."""

    def rule(low: Column, pattern: str, replacement: str, marks: tuple[str, ...]) -> Callable[[Column], Column]:
        marked = reduce(lambda a, b: a | b, (low.contains(m) for m in marks))
        struct = lambda x: F.struct(F.regexp_replace(x["text"], pattern, replacement).alias("text"), (x["n"] + F.regexp_count(x["text"], F.lit(pattern))).alias("n"))
        return lambda x: F.when(marked, struct(x)).otherwise(x)

    def rules(low: Column) -> Column:
        return reduce(lambda done, r: _let(done, rule(low, *r[0], r[1])), zip(REDACTIONS, REDACTION_MARKS, strict=True), F.struct(text.alias("text"), F.lit(0).alias("n")))

    return _let(F.lower(text), rules)


def redact(text: Column) -> Column:
    return _redacted(text)["text"]


def redact_count(text: Column) -> Column:
    """How many matches redact() replaces, each rule counted on what the rules before it left."""
    return F.when(text.isNotNull(), _redacted(text)["n"].cast("long"))


def hash_path(path: Column) -> Column:
    """Last part of a path, made safe, and 8 digits of its digest; paths in this form stay, empty ones too."""
    base = F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)
    safe = F.regexp_replace(F.when(base == "", "root").otherwise(base), "[^A-Za-z0-9_.-]", "_")
    return F.when((path == "") | path.rlike("^[A-Za-z0-9_.-]+#[0-9a-f]{8}$"), path).otherwise(F.concat(safe, F.lit("#"), F.left(F.sha2(path, 256), F.lit(8))))


def mask(value: Column) -> Column:
    return F.when(F.length(value) <= 4, "****").otherwise(F.concat(F.left(value, F.lit(2)), F.lit("****"), F.right(value, F.lit(2))))


def secret_digest(value: Column) -> Column:
    return F.concat(F.lit("<redacted; "), F.octet_length(value).cast("string"), F.lit(" bytes; sha256="), F.left(F.sha2(value, 256), F.lit(8)), F.lit(">"))


def content_key(data: Column) -> Column:
    """24 hexadecimal digits that name a content (SHA-256 here)."""
    return F.left(F.sha2(data, 256), F.lit(24))


def content_marker(key: Column) -> Column:
    return F.concat(F.lit("<<ccr:"), key, F.lit(">>"))


def normalize_log_line(line: Column) -> Column:
    return trim(reduce(lambda t, r: F.regexp_replace(t, *r), LOG_NORMAL, line))


def log_level(line: Column) -> Column:
    return first_match(F.lower(line), [(n, "|".join(ws)) for n, ws in LOG_LEVELS])


def content_type(text: Column) -> Column:
    """diff, html, json_array, build, search, code or text."""
    t = trim(text)
    lines = F.split(text, r"\r?\n")
    hits = lambda p, cut: F.size(F.filter(lines, lambda x: cut(x).rlike(p)))
    json_like = t.startswith("{") & t.endswith("}") & (F.regexp_count(t, F.lit('":')) >= 2)
    search = hits(SEARCH_LINE, trim)
    return (
        F.when(t == "", "text")
        .when(t.rlike(DIFF_HEADER), "diff")
        .when(t.rlike(r"(?i)^\s*<!DOCTYPE\s+html|^\s*<html[\s>]"), "html")
        .when(t.startswith("[") & t.endswith("]"), "json_array")
        .when(json_like, "text")
        .when(hits(BUILD_ERROR, trim) > 0, "build")
        .when((search > 0) & (search / F.size(lines) >= 0.3), "search")
        .when(hits(SOURCE_LINE, F.ltrim) >= 2, "code")
        .otherwise("text")
    )


def anchor_type(line: Column) -> Column:
    t = trim(line)
    found = first_match(t, ANCHORS)
    return F.when(t != "", F.when((found == "path") & ~t.contains("/") & ~t.contains("\\"), None).otherwise(found))


def anchor_priority(line: Column) -> Column:
    return lookup(anchor_type(line), ANCHOR_PRIORITIES)


def is_command_error(is_error: Column, output: Column) -> Column:
    return is_error & ~output.rlike(USER_REJECTION) & F.lower(output).rlike("error|failed|unknown|invalid|not found|permission denied|cannot")


def error_type(output: Column) -> Column:
    return first_match(output, ERROR_TYPES, "other")


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\\x1b\\[[0-9;]*[a-zA-Z]", "")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.lit("...") if n < 3 else F.concat(F.left(text, F.lit(n - 3)), F.lit("...")))


def join_with_overflow(items: Column, most: int, label: str) -> Column:
    more = F.size(items) - most
    head = F.array_join(F.slice(items, 1, most), ", ")
    return F.when(more > 0, F.concat(head, F.lit(", … +"), more.cast("string"), F.lit(f" more {label}"))).otherwise(head)


def never_worse(raw: Column, filtered: Column) -> Column:
    return F.when(tokens_by_bytes(filtered) > tokens_by_bytes(raw), raw).otherwise(filtered)


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1_000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def format_usd(x: Column) -> Column:
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, "$0.00").when(x >= 0.01, F.format_string("$%.2f", x)).otherwise(F.format_string("$%.4f", x))


def format_duration(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(ms < 60_000, F.format_string("%.1fs", ms / 1000.0)).otherwise(F.concat(F.floor(ms / 60_000).cast("string"), F.lit("m"), F.floor((ms % 60_000) / 1000).cast("string"), F.lit("s")))


def compact_path(path: Column) -> Column:
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when((F.length(path) <= 50) | (n <= 3), path).otherwise(F.concat(parts[0], F.lit("/.../"), F.try_element_at(parts, n - 1), F.lit("/"), F.try_element_at(parts, n)))


def base_command(command: Column) -> Column:
    """The first two words after leading assignments and sudo."""
    bare = F.regexp_replace(trim(command), r"^(?:sudo\s+|env\s+|[A-Za-z_][A-Za-z0-9_]*=\S+\s+)+", "")
    return F.array_join(F.slice(F.split(bare, r"\s+"), 1, 2), " ")


def omission_marker(omitted: Column, errors: Column, warnings: Column) -> Column:
    part = lambda n, word: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s")))
    parts = F.concat_ws(", ", part(errors, "error"), part(warnings, "warning"))
    return F.when(omitted == 0, "").otherwise(F.concat(F.lit("--- "), omitted.cast("string"), F.lit(" lines omitted"), F.when(parts != "", F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(""), F.lit(" ---")))


@F.pandas_udf(DoubleType())
def char_entropy(texts: pd.Series) -> pd.Series:
    """Shannon entropy of the characters over the logarithm of how many differ; 0 for fewer than two kinds, null for null."""
    return texts.map(lambda t: None if t is None else _entropy(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)))


@F.pandas_udf(DoubleType())
def byte_entropy(texts: pd.Series) -> pd.Series:
    """As char_entropy, of the UTF-8 bytes."""
    return texts.map(lambda t: None if t is None else _entropy(np.frombuffer(t.encode(), np.uint8)))


def _bits(counts: np.ndarray) -> float:
    p = counts[counts > 0] / max(counts.sum(), 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def _entropy(codes: np.ndarray) -> float:
    counts = np.unique(codes, return_counts=True)[1]
    return _bits(counts) / float(np.log2(len(counts))) if len(counts) > 1 else 0.0


def cost_per_million(cost_per_token: Column) -> Column:
    """A cost for each token as dollars a million tokens; costs that are not positive or not finite count as 0."""
    bad = cost_per_token.isNull() | F.isnan(cost_per_token) | (F.abs(cost_per_token) == float("inf")) | (cost_per_token <= 0)
    return F.when(bad, "$0.00/MTok").otherwise(F.format_string("$%.2f/MTok", cost_per_token * 1_000_000.0))


def iso_date(text: Column) -> Column:
    return F.left(text, F.lit(10))


def field_hash(name: Column) -> Column:
    return F.left(F.sha2(name, 256), F.lit(8))


def strip_program_path(command: Column) -> Column:
    """The command with its program's folder left out."""
    return F.regexp_replace(command, r"^[^ ]*/([^ /]+)(?= |\z)", "$1")


def is_uuid(text: Column) -> Column:
    return text.rlike(r"\A(?=[0-9A-Fa-f-]{36}\z).{8}-.{4}-.{4}-.{4}-")


def number_before(text: Column, word: str) -> Column:
    """The number that stands before word, null if there is none."""
    return F.regexp_extract(text, rf"(\d+)\s*{word}", 1).try_cast("long")


def numbered(line: Column, number: Column, of: Column) -> Column:
    """A line with its number, as wide as the last one's."""
    return F.concat(F.lpad(number.cast("string"), F.length(of.cast("string")), " "), F.lit(" │ "), line)


#: How detected kinds of content are routed, the priority of log levels, and dollars a million tokens in and out.
ROUTES = {"json_array": "json", "code": "code", "search": "logs", "build": "logs", "diff": "git_diff", "html": "html", "text": "plain_text"}
LEVEL_PRIORITIES = {"error": 100, "fail": 90, "warn": 70, "info": 40, "debug": 20, "trace": 10}
UNKNOWN_PRIORITY = 30
DOLLARS_IN, DOLLARS_OUT = 3.0, 15.0


def route(kind: Column) -> Column:
    return lookup(kind, ROUTES)


def level_priority(level: Column) -> Column:
    return F.coalesce(lookup(level, LEVEL_PRIORITIES), F.lit(UNKNOWN_PRIORITY))


def simple_cost(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * DOLLARS_IN + tokens_out * DOLLARS_OUT) / 1_000_000.0


def common_directory(low: Column, high: Column) -> Column:
    """The directories that the smallest and the largest of a set of paths share, and so all of them, with a slash at the end."""
    a, b = F.split(low, "/"), F.split(high, "/")
    n = F.least(F.size(a), F.size(b)) - 1
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x == y), False)
    shared = F.when(differ == 0, n.cast("long")).otherwise(differ - 1).cast("int")
    return F.when(shared > 0, F.concat(F.array_join(F.slice(a, F.lit(1), shared), "/"), F.lit("/"))).otherwise("")


def line_format(line: Column) -> Column:
    """The tool whose log a line tells, null if it tells none."""
    text = F.trim(line)
    return (
        F.when(text.rlike("PASSED|FAILED|test session"), "pytest")
        .when(text.rlike(r"^(PASS|FAIL) ") & text.contains(".test."), "jest")
        .when(text.rlike(r"^(Compiling|Finished) |error\[E"), "cargo")
        .when(text.rlike("npm (ERR|WARN)"), "npm")
        .when(text.rlike(r"^make\[|Entering directory"), "make")
    )


def window_around(line: Column, word: str, most: int) -> Column:
    """A trimmed line, cut to most characters around the first occurrence of a word in any case where it has more bytes."""
    text = F.regexp_replace(line, r"^\s+|\s+$", "")
    at, n = F.instr(F.lower(text), word.lower()), F.length(text)
    start = F.greatest(at - 1 - most // 3, F.lit(0))
    start = F.when(start + most >= n, F.greatest(n - most, F.lit(0))).otherwise(start)
    part = F.substring(text, start + 1, F.lit(most))
    tail = start + most >= n
    around = F.when((start > 0) & ~tail, F.concat(F.lit("..."), part, F.lit("..."))).when(start > 0, F.concat(F.lit("..."), part)).otherwise(F.concat(part, F.lit("...")))
    return F.when(F.octet_length(text) <= most, text).when(at > 0, around).otherwise(F.concat(F.left(text, F.lit(most - 3)), F.lit("...")))


def minify_json(text: Column) -> Column:
    """JSON without white space between values; other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)
