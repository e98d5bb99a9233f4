"""Filter audit, decontamination and source divergence against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import decontaminate, filter_audit, source_divergence

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"
low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)


def sample(rng, n):
    words = ["alpha", "Beta", "gamma#", "ÉTÉ", "été", "DELTA", "e$", "\x85", "a\xa0b", "中文"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 250, 400]))), rng.choice(["x", "y", None, ""])) for i in range(n)]
    rows += [(n, None, "x"), (n + 1, "", "y"), (n + 2, rows[0][1], "z"), (n + 2, rows[0][1], "z"), (0, rows[0][1], "x"), (None, rows[0][1], "x"), (n + 3, "w " * 300_000, "y")]
    return rows


def audit_brute(rows, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    firsts = {}
    for d, t, _ in rows:
        if d is not None:
            firsts[t or ""] = min(d, firsts.get(t or "", d))
    judged = []
    for d, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in t for c in "#$%&*|"), "E": d is not None and d > firsts[t]}
        judged.append((s or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [j for j in mine if f in j[1] and not j[1] & before]
                shapley[part, f] += len(here)
                out[part, order, k + 1] = [sum(not j[1] & (before | {f}) for j in mine), len(here), sum(f in j[1] and bool(j[1] & before) for j in mine), sum(j[1] == {f} for j in mine), sum(j[2] for j in here), sum(j[3] for j in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit(spark):
    rows = sample(random.Random(3), 40)
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 44, 3)] + [(3, 0, 0), (6, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"part": F.lit("clash"), "good": F.lit(1), "own": F.lit(7)})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1)))
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got.collect()} == audit_brute(rows, labels)
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    alone = filter_audit.audit(spark.createDataFrame([(1, None, None)], DOCS), spark.createDataFrame([], LABELS)).collect()
    assert len(alone) == 600 and {r.removed for r in alone if r.filter_order[r.step - 1] == "A"} == {1} and sum(r.removed for r in alone) == 120


def decontaminate_brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    needles = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if n else 0):
            needles[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in needles}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in needles:
                    hit |= set(range(k, k + n))
                    found |= needles[tuple(w[k : k + n])]
        out.append((d, len(w), len(hit), sorted(str(i) for i in found if i is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "x9", "中"] if seed == 1 else [f"w{i}" for i in range(60)]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " - ", "\n", "\x7f", "@"]) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 3, 7, 10, 14, 40]) if seed == 2 else rng.choice([4, 11, 20]))) for i in range(25)]
    items += [(3, "Zulu yankee"), (7, None), (8, "..."), (None, "xray victor tango"), (100, items[0][1]), (101, items[5][1].upper() if seed == 2 else items[5][1])]
    docs = [(i, text(rng.choice([0, 5, 60])) + rng.choice(items)[1].swapcase() + text(rng.choice([0, 9, 300])) if rng.random() < 0.7 else text(30)) for i in range(60) if not (i % 10 == 9)] if seed == 2 else [(i, text(rng.choice([0, 9, 200]))) for i in range(60)]
    docs = [(d, t) for d, t in docs] + [(200, None), (201, ""), (202, "Zulu! Yankee? xray victor tango zulu"), (203, "zulu"), (5, "again " + (items[4][1] or "")), (None, items[6][1]), (204, "tango " * 200_000 + (items[9][1]) + " victor" * 1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"t": F.lit(1), "row_id": F.lit("clash"), "n": F.lit(2)})
    got = decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.n_words, sum(s["last"] - s["first"] for s in r.spans), r["items"]) for r in got), key=repr) == decontaminate_brute(docs, items)
    assert all(a["last"] < b["first"] for r in got for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = lambda df: df.limit(0)
    assert decontaminate.contamination(none(docs), items).count() == 0
    for some in (none(items), items.select("item_id", F.lit(None).cast("string").alias("text")), items.select("item_id", F.lit("?").alias("text")), items.select("item_id", F.lit("z z z").alias("text"))):
        assert sorted((r.doc_id, r.n_words, r.spans, r["items"]) for r in decontaminate.contamination(docs, some).collect()) == [(1, 2, [], []), (2, 0, [], [])]


def divergence_brute(rows, min_docs, top):
    found = defaultdict(lambda: defaultdict(Counter))
    df, sources = defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text or ""))
        found[lang][source].update(terms)
        df[lang].update(set(terms))
        sources[lang].add(source)
    out = []
    for lang, groups in sources.items():
        kept = sorted((t for t, n in df[lang].items() if n >= min_docs), key=str.encode)
        v = len(kept)
        ps = {}
        for s in groups:
            n = sum(found[lang][s][t] for t in kept)
            ps[s] = {t: 1 + 10**9 * (found[lang][s][t] + 1) // (n + v) for t in kept}
        n = sum(found[lang][s][t] for t in kept for s in groups)
        q = {t: 1 + 10**9 * (sum(found[lang][s][t] for s in groups) + 1) // (n + v) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in groups:
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(ps[s][t], q[t]), t.encode(), t) for t in kept if found[lang][s][t] and ps[s][t] > q[t]]
            for part, ranked in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(ranked)]
    return sorted(out)


def test_source_divergence(spark):
    rng = random.Random(5)
    stems = ["the", "Then", "them", "té", "thé", "中文", "中", "z" * 3000, "thermo", "x"]
    text = lambda s: " ".join(rng.choice(stems) + rng.choice(["", "", "s", f"{chr(97 + s)}", "9a"]) for _ in range(rng.choice([0, 3, 40])))
    rows = [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None, "c"]), text(rng.randrange(5))) for _ in range(90)]
    rows += [("en", "empty", None), ("fr", "only", "un deux"), ("fr", "other", ""), ("it", "one", "uno uno uno"), *[("es", s, "igual igual") for s in "pqr"], ("en", "a", "the " * 500_000)]
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5).withColumns({"rank": F.lit("clash"), "unit": F.lit(1), "n": F.lit(1)})
    seen = lambda **k: sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in source_divergence.divergence(df, **k).collect())
    assert seen() == divergence_brute(rows, 3, 200)
    assert seen(min_docs=1, top=4, most=7, leaves=10) == divergence_brute(rows, 1, 4)  # tries sent early, prefixes cut again, many ranges
    assert source_divergence.divergence(df.limit(0)).count() == 0


def test_trie_merges_and_walks_in_byte_order():
    rng = random.Random(8)
    words = ["".join(rng.choice("ab中é") for _ in range(rng.choice([1, 2, 4, 7, 40]))).encode() for _ in range(400)]
    both, tries = Counter(), []
    for half in (0, 1):
        mine = [(w, i % 3, i) for i, w in enumerate(words) if i % 2 == half]
        names = [f"s{k}" for k in (range(3) if half else (2, 0, 1))]
        array = lambda k: np.array([m[k] for m in mine], np.int64)
        tries.append(source_divergence.RadixTrie.of(pa.array([m[0] for m in mine], pa.large_binary()), np.arange(len(mine)), names, array(1), array(2), np.ones(len(mine), np.int64)))
        for w, k, i in mine:
            both[w, names[k]] += i
    flat = lambda t: {(t.terms[i].as_py(), t.names[t.source[k]]): int(t.n[k]) for i in range(len(t.terms)) for k in range(t.begin[i], t.begin[i + 1])}
    for depth in (1, 3, 50):
        batches = [b for t in tries for b in t.pieces("x", depth)]
        units = [[r["unit"] for b in t.pieces("x", depth) for r in b.to_pylist()] for t in tries]
        assert all(u == sorted(set(u)) for u in units)
        assert all(r["size"] == len(r["n"]) == sum(r["width"]) and r["unit"] == r["rest"][0][:depth] for b in batches for r in b.to_pylist())
        merged = source_divergence.RadixTrie.of_pieces(pa.Table.from_batches(batches))
        assert merged.terms.to_pylist() == sorted(set(words))
        assert flat(merged) == dict(both) == flat(source_divergence.RadixTrie.merge(tries)) and merged.size == len(both)


def test_shares_are_exact():
    rng = random.Random(4)
    total = [rng.randrange(1, 1 << rng.randrange(1, 53)) for _ in range(500)]
    count = [rng.choice([0, t - 1, rng.randrange(t)]) for t in total]
    assert source_divergence.share(np.array(count), np.array(total)).tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count, total)]


def test_digest_columns(spark, sf_dir, duck):
    from textloom.llm import registry

    for name in ("op11_filter_audit", "op12_decontamination", "op13_source_divergence"):
        df = registry.QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        res = duck.execute(registry.ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == cols
        assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in res.fetchall())
    assert hashlib.sha256(b"").hexdigest() in {r.items_sha256 for r in registry.QUERIES["op12_decontamination"](spark, sf_dir).collect()}
