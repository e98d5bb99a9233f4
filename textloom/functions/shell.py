"""Shell command lines as tokens: one regular expression is the lexer, so tokens come from built-in functions throughout.

An argument is a run of plain characters, escaped ones and quoted stretches; quotes keep everything, a double quote its
escaped characters too, and a quote that is never closed goes on to the end. Values keep their quotes and escapes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An escaped character (or a last backslash), and quoted stretches.
ESCAPED = r"\\(?:.|\z)"
QUOTED = r"""(?:"(?:\\(?:.|\z)|[^"\\])*+(?:"|\z)|'[^']*+(?:'|\z))"""
_PLAIN = r"""[^\s$*?`(){}!|;&<>'"\\]"""
ARGUMENT = f"(?:{ESCAPED}|{QUOTED}|{_PLAIN})++"
#: Tokens in the order in which they are tried; the first that fits is taken.
KINDS = (
    ("redirect", r"[0-9]*+>>?(?:&[0-9-]*+)?|&>>?|<<?"),
    ("operator", r"\|\||&&|;"),
    ("pipe", r"\|"),
    ("arg", r"\$[A-Za-z_][A-Za-z0-9_]*+"),
    ("shellism", r"[$*?`(){}!&]"),
    ("arg", ARGUMENT),
)
TOKEN = "(?s)" + "|".join(f"(?:{p})" for _, p in KINDS)


def tokens(command: Column) -> Column:
    """array of struct(kind, value): the tokens of a command line in order; null has none."""
    found = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(TOKEN), 0)

    def named(value: Column) -> Column:
        kind = F.lit("arg")
        for name, pattern in reversed(KINDS[:-1]):
            kind = F.when(value.rlike(rf"(?s)\A(?:{pattern})\z"), name).otherwise(kind)
        return F.struct(kind.alias("kind"), value.alias("value"))

    return F.transform(found, named)


def chain(command: Column) -> Column:
    """The commands of a line joined by &&, ||, ; or |, trimmed; what is quoted or escaped joins nothing."""
    part = rf"(?s)((?:{ESCAPED}|{QUOTED}|(?<![&])&(?!&)|[^;&|\"'\\])++)"
    parts = F.transform(F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(part), 1), lambda x: F.regexp_replace(x, r"\A[\s\x0b]+|(?<!\\)[\s\x0b]+\z", ""))
    return F.filter(parts, lambda x: x != "")


def unquoted(value: Column) -> Column:
    """An argument's text: quotes are taken away, and backslashes before what they keep."""
    inside = F.regexp_replace(value, r'(?s)"((?:\\.|[^"\\])*+)"|' + r"'([^']*+)'", "$1$2")
    return F.regexp_replace(inside, r"(?s)\\(.)", "$1")


def has_shell_syntax(command: Column) -> Column:
    """Whether a line needs a shell: it has a token that is no argument, or a variable."""
    return F.exists(tokens(command), lambda t: (t["kind"] != "arg") | t["value"].startswith("$"))
