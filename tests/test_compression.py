"""The compression pipeline: budget, offloaded lines, and the way back, against a plain walk."""

import random

from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.operators import compression, runs

LINES = "doc_id long, line_no long, line string"


def rows_of(rng):
    texts = ["", "short", "error: it broke", "Warning: odd", "a plain line of some length", "x" * 130, "<<ccr:0123456789abcdef01234567>>", "[×3]"]
    return [(d, i, t) for d, n in ((1, 0), (2, 1), (3, 60), (None, 25)) for i, t in enumerate(rng.choices(texts, k=n))]


def score(line):
    t = line.strip()
    return 0.0 if not t else 0.3 if len(t) < 10 else 0.9 if t.startswith("error") else 0.7 if t.startswith("Warning") else 0.5


def plain(rows, budget):
    out = {}
    for doc in {r[0] for r in rows}:
        lines = []
        for _, i, t in (r for r in rows if r[0] == doc):
            if lines and lines[-1][1] == t:
                lines[-1][2] += 1
            else:
                lines.append([i, t, 1])
        lines = [(i, t if n == 1 else f"{t} [×{n}]") for i, t, n in lines]
        left = budget
        whole = -(-len("\n".join(t for _, t in lines).encode()) // 4) <= budget
        for i, t in sorted(lines, key=lambda x: (-score(x[1]), x[0])):
            need = budget + 1 if t.startswith("<<ccr:") and t.endswith(">>") else 0 if whole else -(-len(t.encode()) // 4)
            out[doc, i] = (t, need <= left)
            left -= need if need <= left else 0
    return out


def test_compress_and_restore(spark):
    rows = rows_of(random.Random(2))
    lines = spark.createDataFrame(rows, LINES).repartition(3)
    for budget in (0, 3, 40, 10_000):
        done = compression.compress(lines, budget, below=0.2).cache()
        want = plain(rows, budget)
        assert {(r.doc_id, r.line_no): (r.line, r.kept) for r in done.collect()} == want
        assert {r.original for r in compression.stored(done).collect()} == {t for t, kept in want.values() if not kept and (len(t.encode()) > 100 or score(t) < 0.2)}
        texts, store = compression.with_markers(done)
        whole = {d: "\n".join(t for (doc, _), (t, _) in sorted(want.items(), key=lambda x: (str(x[0][0]), x[0][1])) if doc == d) for d in {r[0] for r in rows}}
        assert {r.doc_id: r.text for r in compression.restore(texts, store).collect()} == whole
        assert {r.doc_id for r in compression.render(done).collect()} == set(whole)
        done.unpersist()
    assert compression.compress(lines.limit(0), 5).count() == 0


def test_budget_walks_one_long_output(spark):
    lines = spark.range(300_000).select(F.lit(1).alias("doc_id"), F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"))
    kept = runs.token_budget(lines, X.default_line_score(F.col("line")), 100)
    assert kept.agg(F.sum("tokens"), F.max("line_no")).first()[0] <= 100
    assert "FlatMapGroupsInPandas" not in kept._jdf.queryExecution().toString()
