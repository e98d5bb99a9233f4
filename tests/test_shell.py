"""The shell lexer against a walk over the characters."""

import random

from pyspark.sql import functions as F

from textloom.functions import shell

SPACE = " \t\n\x0b\x0c\r"


def lex(text):
    out, now, i = [], "", 0

    def flush():
        nonlocal now
        if now:
            out.append(("arg", now))
        now = ""

    while i < len(text):
        c = text[i]
        if c == "\\":
            now, i = now + text[i : i + 2], i + 2
        elif c in "'\"":
            j = i + 1
            while j < len(text) and text[j] != c:
                j += 2 if c == '"' and text[j] == "\\" else 1
            now, i = now + text[i : j + 1], j + 1
        elif c == "$":
            flush()
            j = i + 1
            if j < len(text) and (text[j].isascii() and text[j].isalpha() or text[j] == "_"):
                while j < len(text) and text[j].isascii() and (text[j].isalnum() or text[j] == "_"):
                    j += 1
            out.append(("arg" if j > i + 1 else "shellism", text[i:j]))
            i = j
        elif c in "*?`(){}!":
            flush()
            out.append(("shellism", c))
            i += 1
        elif text[i : i + 2] in ("||", "&&"):
            flush()
            out.append(("operator", text[i : i + 2]))
            i += 2
        elif c in "|;":
            flush()
            out.append(("pipe" if c == "|" else "operator", c))
            i += 1
        elif c == "&":
            flush()
            n = 3 if text[i : i + 3] == "&>>" else 2 if text[i : i + 2] == "&>" else 1
            out.append(("redirect" if n > 1 else "shellism", text[i : i + n]))
            i += n
        elif c == ">":
            before = now if now.isascii() and now.isdigit() else ""
            now = "" if before else now
            flush()
            j = i + (2 if text[i : i + 2] == ">>" else 1)
            if text[j : j + 1] == "&":
                j += 1
                while j < len(text) and text[j] in "0123456789-":
                    j += 1
            out.append(("redirect", before + text[i:j]))
            i = j
        elif c == "<":
            flush()
            n = 2 if text[i : i + 2] == "<<" else 1
            out.append(("redirect", text[i : i + n]))
            i += n
        elif c in SPACE:
            flush()
            i += 1
        else:
            now, i = now + c, i + 1
    flush()
    return out


def test_tokens_by_a_walk(spark):
    rng = random.Random(12)
    parts = ["a", "b1", "12", "3", " ", "\n", "\\", '"', "'", "$", "$X", "_", "*", "(", ")", "|", "||", "&", "&&", ";", ">", ">>", "<", "é", "!", "-", "`"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [None, "", "\\", "'", "2>&1-", "a\\\nb"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", shell.tokens(F.col("text")).alias("t")).collect()
    for r in rows:
        assert [tuple(t) for t in r.t] == lex(texts[r.i] or ""), texts[r.i]


def test_chain_and_arguments(spark):
    cases = {"a && b || c; d | e": ["a", "b", "c", "d", "e"], "a 'x && y' \"p;\\\"q|\" 2>&1 & b": ["a 'x && y' \"p;\\\"q|\" 2>&1 & b"], "a\\;b; c\\ ": ["a\\;b", "c\\ "], "": [], ";;&&": [], "x 'open ; y": ["x 'open ; y"]}
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, text string").select("i", shell.chain(F.col("text")).alias("c"), shell.has_shell_syntax(F.col("text")).alias("s")).collect()
    assert {r.i: r.c for r in rows} == dict(enumerate(cases.values()))
    assert [r.s for r in sorted(rows)] == [True, True, True, False, True, False]
    words = {"'a b'": "a b", '"x\\"y"': 'x"y', "a\\ b": "a b", "pre'mid'\"end\"": "premidend"}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", shell.unquoted(F.col("w")).alias("u")).collect()
    assert {r.w: r.u for r in got} == words
