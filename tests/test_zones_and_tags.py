"""Frozen zones by brute force, and tags there and back."""

import random
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import tags, zones

LINES = "doc_id long, line_no long, line string"


def zones_brute(lines):
    bad = [x.strip().startswith(zones.ERRORS) for x in lines]
    out, i = [], 0
    while i < len(lines):
        j = i
        while j < len(lines) and bad[j]:
            j += 1
        if j - i > 1:
            out.append((i, j - 1, "Error block at end" if j == len(lines) else "Error block" if lines[i].strip().startswith(("error", "Error:")) else "Warning block"))
        i = max(j, i + 1)
    for i, x in enumerate(lines):
        if x.strip().lower().startswith(zones.SUMMARIES) or "passed" in x.lower():
            out.append((i, min(i + 5, len(lines) - 1), "Summary block"))
    return sorted(out)


def test_zones(spark):
    rng = random.Random(4)
    texts = ["error: x", "  Error: y", "warning: z", "FAILED a", "plain", "", "3 Passed", "Test a", "tests: 4"]
    docs = {d: [rng.choice(texts if d % 2 else texts[:6] + ["plain"] * 5) for _ in range(n)] for d, n in enumerate((0, 1, 2, 40, 60, 60))}
    lines = spark.createDataFrame([(d, i, x) for d, xs in docs.items() for i, x in enumerate(xs)], LINES)
    found = zones.frozen_zones(lines).cache()
    got = {d: [] for d in docs}
    for r in found.collect():
        got[r.doc_id].append((r.start_line, r.end_line, r.reason))
    assert {d: sorted(z) for d, z in got.items()} == {d: zones_brute(xs) for d, xs in docs.items()}
    whole = {(r.doc_id, n) for r in zones.united(found).collect() for n in range(r.start_line, r.end_line + 1)}
    assert whole == {(d, n) for d, zs in got.items() for a, b, _ in zs for n in range(a, b + 1)}
    edges = sorted((r.doc_id, r.start_line, r.end_line) for r in zones.united(found).collect())
    assert all(a[0] != b[0] or a[2] + 1 < b[1] for a, b in zip(edges, edges[1:]))
    frozen = {(r.doc_id, r.line_no) for r in zones.frozen_lines(lines).filter("frozen").collect()}
    assert frozen == {(d, n) for d, a, b in edges for n in range(a + 1, b + 1)}
    found.unpersist()


def test_aligned(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 100, 95, 49, 50, 51, 199)], "n long").select("n", zones.aligned(F.lit("x"), F.col("n"), 100).alias("a")).collect()
    assert [(r.n, len(r.a.text) - 1, r.a.tokens) for r in rows] == [(0, 0, 0), (100, 0, 100), (95, 5, 100), (49, 0, 100), (50, 0, 100), (51, 49, 100), (199, 1, 200)]


@pytest.mark.parametrize(
    ("text", "originals", "markers"),
    [
        ("", [], []),
        ("no tags", [], []),
        ("<P>a</p><DIV/>", [], []),
        ("<x>a<y>b</y></x>", ["<x>a<y>b</y></x>"], ["<x>", "<y>", "</y>", "</x>"]),
        ("<x>a<y>b</x></y>", ["<x>a<y>b</x>"], ["<x>", "<y>", "</x>"]),
        ("<x>a", [], ["<x>"]),
        ("a</x><x-1.b a='>'/>", ["<x-1.b a='>'/>"], ["<x-1.b a='>'/>"]),
        ("<x>one</X> <x>two</x >", ["<x>one</X>", "<x>two</x >"], ["<x>", "</X>", "<x>", "</x >"]),
        ("{{TAG_0}} <x></x>", ["<x></x>"], ["<x>", "</x>"]),
        ("<x <y></y>", [], ["<x <y>"]),
        ("<x 'open <y></y>", ["<y></y>"], ["<y>", "</y>"]),
    ],
)
def test_protected(text, originals, markers):
    assert [o for _, o in tags.protect_text(text)[1]] == originals
    assert [o for _, o in tags.protect_text(text, True)[1]] == markers


def test_there_and_back(spark):
    rng = random.Random(3)
    parts = ["<a>", "</a>", "<x>", "</x>", "<y ", ">", "/", '"', "'", " ", "<x/>", "{{TAG_", "0}}", "é", "<", "{{TAG_0_"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [None, "<think>" * 3 + "</think>" * 5]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for markers in (False, True):
        made = rows.withColumn("p", tags.protect(F.col("text"), markers)).select("i", tags.restore(F.col("p.text"), F.col("p.blocks")).alias("back"), F.col("p.text").alias("kept"), F.size("p.blocks").alias("n"))
        for r in made.collect():
            assert r.back == (texts[r.i] or "")
    lost = spark.createDataFrame([("a <x>1</x> b",)], "text string").withColumn("p", tags.protect(F.col("text")))
    assert lost.select(tags.restore(F.lit("a b"), F.col("p.blocks"))).first()[0] == "a b"


def test_long_and_broken_texts_take_linear_time():
    began = time.time()
    for part in ('<a "', "<x ", "<x>", "</x>", "<x \"\" '", "<", "<x><y></y>"):
        tags.protect_text(part * 100_000)
    tags.protect_text("<x>" * 100_000 + "</y>" * 100_000)
    assert time.time() - began < 40
