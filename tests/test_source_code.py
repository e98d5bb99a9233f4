"""Source filters against a plain walk over the lines, in all languages."""

import random
import re

from pyspark.sql import functions as F

from textloom.operators import source_code as S


def minimal(text, language):
    line_mark, doc_line, start, end, doc_start = S.MARKS[language]
    out, comment, doc = [], False, False
    for line in text.splitlines():
        t = line.strip()
        if start:
            if not doc and start in t and not t.startswith(doc_start or "###"):
                comment = True
            if comment:
                comment = end not in t
                continue
        if language == "python" and t.startswith('"""'):
            doc = not doc
        elif not doc and line_mark and t.startswith(line_mark) and not (doc_line and t.startswith(doc_line)):
            continue
        out.append(line if t or doc else "")
    return re.sub(r"\n[ \t]*(?:\n[ \t]*)+(?=\n)", "\n", "\n".join(out)).strip()


def aggressive(text, language):
    if language == "data":
        return minimal(text, language)
    out, depth, inside = [], 0, False
    for line in minimal(text, language).splitlines():
        t = line.strip()
        if re.match(S.IMPORT, t):
            out.append(line)
        elif re.match(S.SIGNATURE, t):
            out.append(line)
            inside, depth = True, 0
        elif inside:
            depth += t.count("{") - t.count("}")
            if depth <= 1 and (t in "{}" and t or t.endswith("{")):
                out.append(line)
            if depth <= 0:
                inside = False
                if t and t != "}":
                    out.append(S.BODY)
        elif t.startswith(S.DECLARED):
            out.append(line)
    return "\n".join(out).strip()


def truncated(lines, most):
    if len(lines) <= most:
        return "\n".join(lines)
    out = []
    for x in lines:
        t = x.strip()
        if re.match(S.SIGNATURE, t) or re.match(S.IMPORT, t) or t.startswith(("pub ", "export ")) or t in ("{", "}") or len(out) < most // 2:
            out.append(x)
        if len(out) >= most - 1:
            break
    return "\n".join([*out, f"[{len(lines) - len(out)} more lines]"])


def files(rng, n):
    parts = ["use x;", "import y", "fn run() {", "pub async fn go(a: b)", "def f():", "class A {", "  let a = 1;", "const B = 2;", "{", "}", "  if x {", "  }", "", "", "// note", "/// doc", "# note", "/* one */", "/* open", "close */", "/** doc", '"""', '"""doc"""', "=begin", "=end", "  x = '/* '", "### h", "plain", "export default"]
    out = []
    for i in range(n):
        language = rng.choice(list(S.MARKS))
        text = "\n".join(rng.choice(parts) for _ in range(rng.choice([0, 5, 90, 140])))
        out.append((i, language, text + rng.choice(["", "\n"])))
    return [*out, (n, "rust", None)]


def test_filters_by_a_walk(spark):
    rows = files(random.Random(21), 120)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    want = lambda f: {d: (t or "") if len((t or "").encode()) < S.LEAST_BYTES else f(t, lang) for d, lang, t in rows}
    assert sum(len((t or "").encode()) >= S.LEAST_BYTES for _, _, t in rows) > 40
    assert {r.doc_id: r.text for r in S.minimal(docs, F.col("lang"), chunk=32).collect()} == want(minimal)
    assert {r.doc_id: r.text for r in S.aggressive(docs, F.col("lang"), chunk=32).collect()} == want(aggressive)
    lines = S.source_lines(docs, F.col("lang"))
    for most in (2, 7, 40):
        assert {r.doc_id: r.text for r in S.smart_truncate(lines, most).collect()} == {d: truncated((t or "").splitlines() or [""], most) for d, _, t in rows}


def test_language(spark):
    paths = {"a/b.RS": "rust", "x.pyw": "python", "x.tsx": "typescript", "a.b/noext": "unknown", "x.h": "c", "x.hh": "cpp", "x.zsh": "shell", "Cargo.lock": "data", "x.rb": "ruby", "": "unknown"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in got} == paths
