"""Line dedup, substring dedup, n-gram join and range join against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import line_dedup, ngram_join, range_join, substring_dedup
from textloom.llm.common import load

DOCS = "doc_id long, text string"


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def lines_brute(rows, min_docs):
    low = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).strip(" \t\n\x0b\x0c\r")
    df = Counter(k for _, t in rows for k in {low(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if df[low(x)] < min_docs]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(spark):
    rng = random.Random(1)
    common = ["Shared Line", "  shared line\t", "É", "é", "x" * 3000, "ab"]
    rows = [(i, "\n".join(rng.choice([*common, f"own {i}", "", f"own {rng.random()}"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, DOCS).withColumns({"n_lines": F.lit("clash"), "extra": F.lit(1)})
    got = line_dedup.dedup_lines(df, min_docs=5)
    assert {"extra", "kept_text"} <= set(got.columns)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()) == lines_brute(rows, 5)
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_line_index_is_reversible(spark):
    rng = random.Random(2)
    make = lambda a, b: spark.createDataFrame([(i, "\n".join(f"k{rng.randint(0, 30)}" for _ in range(6))) for i in range(a, b)], DOCS)
    one, two = make(0, 40), make(40, 70)
    refs = lambda index: {(r.h1, r.h2): r.refs for r in index.counts.collect()}
    first = line_dedup.LineIndex.empty(spark, 4).insert(one)
    both = first.insert(two)
    assert refs(both.delete(two)) == refs(first)
    assert refs(both) == refs(line_dedup.LineIndex.empty(spark, 4).insert(one.unionByName(two)))
    assert both.delete(one).delete(two).counts.count() == 0
    for f in both.filters.collect():
        keys = both.counts.filter(F.col("shard") == f.shard).toPandas()
        assert line_dedup.CuckooFilter.from_bytes(f["filter"]).contains(keys.h1.to_numpy(), keys.h2.to_numpy()).all()


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**62), 2**62, (2, 20_000))
    made = line_dedup.CuckooFilter.of(h[0], h[1])
    assert made.contains(h[0], h[1]).all()
    other = rng.integers(-(2**62), 2**62, (2, 20_000))
    assert made.contains(other[0], other[1]).mean() < 0.01
    made.delete(h[0][:500], h[1][:500])
    assert made.contains(h[0][500:], h[1][500:]).all()
    assert made.contains(h[0][:500], h[1][:500]).mean() < 0.05


def substrings_brute(rows):
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        starts = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_column_sort():
    rng = random.Random(1)
    strings = list({bytes(rng.choice(b"ab\xc3") for _ in range(rng.randint(1, 90))) for _ in range(80)})
    buf, size = np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings])
    owner, length, prefix = substring_dedup.column_sort(buf, np.cumsum(size) - size, size)
    suffixes = [strings[o][len(strings[o]) - n :] for o, n in zip(owner, length, strict=True)]
    assert suffixes == sorted(suffixes) and len(suffixes) == size.sum() + len(size)
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    assert prefix[1:].tolist() == [min(50, common(a, b)) for a, b in zip(suffixes, suffixes[1:], strict=False)]


def test_substring_dedup(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(40, 300))) for _ in range(15)]
    rows = []
    for i in range(120):
        t = ""
        for _ in range(rng.randint(0, 4)):
            b = rng.choice(base)
            a = rng.randint(0, len(b))
            t += b[a : a + rng.randint(0, 200)] + rng.choice(["", "x", "=" * rng.randint(0, 300), " " * 60, "ab" * 40])
        rows.append((i * 7 % 601, t))
    rows += [(1000, None), (1001, ""), (1002, "a" * 49), (1003, "a" * 50), (1004, "a" * 51)]
    rows += [(2000 + i, t) for i, t in enumerate(["q" * 30 + "XY" * 40 + "abcdefghijklmnop" * 3 + "zz", "XY" * 23 + "abcdefghijklmnop" * 3 + "zz", "abc" * 60, "abc" * 30 + "dd" + "abc" * 30, "0" * 500, "0" * 60 + "1" + "0" * 100])]
    df = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(0)).repartition(3)
    done = substring_dedup.dedup_substrings(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert sorted(map(tuple, done.collect())) == substrings_brute(rows)
    assert substring_dedup.dedup_substrings(spark.createDataFrame([], DOCS)).count() == 0
    # rows that repeat keep their own id, rows without id keep all
    odd = spark.createDataFrame([(1, "y" * 80), (1, "y" * 80), (None, "y" * 80), (2, "y" * 80)], DOCS)
    assert sorted(((r.doc_id or -1), r.n_removed) for r in substring_dedup.dedup_substrings(odd).collect()) == [(-1, 0), (1, 0), (1, 0), (2, 80)]


def test_substring_query(spark, sf_dir):
    rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert sorted(map(tuple, substring_dedup.query(spark, sf_dir).collect())) == substrings_brute(rows)


def shingles(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def ngram_brute(rows):
    sets, index, counts = {d: shingles(t) for d, t in rows}, defaultdict(list), Counter()
    for d, s in sets.items():
        for g in s:
            index[g].append(d)
    for ds in index.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                counts[a, b] += 1
    links = [(a, b) for (a, b), n in counts.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    group = components(sets, links)
    return {d: (len(s), group[d]) for d, s in sets.items()}


def near_copies(seed):
    rng = random.Random(seed)
    vocabulary, rows = [f"w{i}" for i in range(300)], []
    for _ in range(35):
        n = rng.choice([1, 3, 4, 5, 6, 7, 9, 12, 18, 25, 40, 60, 100, 200])
        words = [rng.choice(vocabulary) for _ in range(n)]
        for _ in range(rng.choice([1, 3, 12, 25])):
            own = list(words)
            for _ in range(rng.randint(0, max(1, n // 40))):
                own[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "small"), [(5, 8), (6, 2)])
def test_ngram_join(spark, seed, small):
    rows = near_copies(seed)
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "A b"), (9004, "a B"), (9005, "long " * 5000)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOCS).withColumn("n_shingles", F.lit("clash")).repartition(3), small=small)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == ngram_brute(rows)


def test_ngram_query(spark, sf_dir):
    rows = [tuple(r) for r in load(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.query(spark, sf_dir).collect()} == ngram_brute(rows)
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def vectors_brute(rows, threshold=0.9):
    good = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a, x in good.items() for b, y in good.items() if a < b and len(x) == len(y) and x @ y >= threshold]
    n = Counter(x for link in links for x in link)
    group = components([i for i, _ in rows], links)
    return {i: (n[i], group[i]) for i, _ in rows}


def test_range_join(spark, monkeypatch):
    monkeypatch.setattr(range_join, "ROWS_A_PIVOT", 20)
    monkeypatch.setattr(range_join, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * rng.choice([0.05, 0.3, 0.6])).tolist()) for i in range(240)]
    rows += [(500 + i, rows[3][1]) for i in range(20)] + [(600, (np.array(rows[3][1]) * 7).tolist())]
    rows += [(700, None), (701, []), (702, [0.0] * 6), (703, [float("nan")] * 6), (704, [None] * 6), (705, [float("inf")] + [0.0] * 5), (706, [1.0, 2.0]), (707, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    assert {r.vec_id: (r.n_links, r.component_id) for r in range_join.link_vectors(df).collect()} == vectors_brute(rows)
    assert range_join.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_and_repeated_ids(spark):
    """Rows by (id, text): the join and the pipeline's stage lose none of them and keep one of each group."""
    import corpus_pipeline

    text = lambda seed, n=60: [f"w{seed}x{i}" for i in range(n)]
    one, two, three, four = (text(k) for k in range(4))
    big = (1 << 53) + 1
    rows = [
        (None, one), (7, [*one, "more"]), (None, one), (big, one),  # a group whose first row has no id
        (None, two), (None, [*two, "x"]),  # a group without any id
        (9, three), (9, four), (3, [*four, "y"]),  # one id, two documents, the second with a near copy
        (9, three), (4, []), (None, []), (None, []), (big + 1, text(5)),
    ]
    rows = [(i, " ".join(t), k) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(1).sortWithinPartitions("n_chars")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.near_duplicates(df).collect())
    want = [(None, 56, 7), (7, 57, 7), (None, 56, 7), (big, 56, 7), (None, 56, None), (None, 57, None), (9, 56, 9), (9, 56, 3), (3, 57, 3), (9, 56, 9), (4, 0, 4), (None, 0, None), (None, 0, None), (big + 1, 56, big + 1)]
    assert got == sorted((i or 0, n, c or 0) for i, n, c in want)
    kept = corpus_pipeline.keep_one_of_each(spark, df, "")
    assert kept.columns == df.columns
    left = [r.n_chars for r in kept.collect()]
    assert len(set(left) & {4, 5}) == 1 and sorted(set(left) - {4, 5}) == [1, 6, 8, 10, 11, 12, 13] and len(left) == 8
    # a batch without any word
    bare = spark.createDataFrame([(None, ""), (1, None)], DOCS).coalesce(1)
    assert sorted(r.component_id or 0 for r in ngram_join.near_duplicates(bare).collect()) == [0, 1]


def test_range_join_with_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.99, 0.1, 0.0]), (2, [0.98, 0.12, 0.0]), (3, [0.0, 0.0, 1.0]), (None, [0.0, 0.05, 1.0])]
    got = range_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in got) == [(0, 1, 3), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 3)]


def test_range_join_sends_packs(spark, monkeypatch):
    """Vectors that prune nothing go to every cell: as packs, so no table has a row for each vector and cell or tile."""
    for name, value in (("ROWS_A_PIVOT", 20), ("BLOCK", 24), ("GATHER", 2)):
        monkeypatch.setattr(range_join, name, value, raising=False)
    tables, write = {}, range_join.materialize
    monkeypatch.setattr(range_join, "materialize", lambda df, name: tables.setdefault(name, write(df, name)))
    rng = np.random.default_rng(7)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 64)))]
    near = np.array(rows[0][1]) + rng.normal(size=(100, 64)) * 0.2  # more than one pack of a cell, linked
    rows += [(400 + i, v.tolist()) for i, v in enumerate(near)]
    got = range_join.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    assert {r.vec_id: (r.n_links, r.component_id) for r in got.collect()} == vectors_brute(rows)
    assert tables["homes"].groupBy("cell").count().count() > 10
    sizes = {name: t.count() for name, t in tables.items()}
    assert sizes["homes"] == 500 and max(sizes.values()) < 6 * 500, sizes


def test_range_join_batches_and_threshold(spark):
    fields = pa.schema([("k", pa.int64()), ("v", pa.binary())])
    made = list(range_join.in_batches(((k, bytes(1 << 20), 1 << 20) for k in range(100)), fields))
    assert sum(b.num_rows for b in made) == 100 and max(b.nbytes for b in made) <= range_join.BATCH_BYTES + (2 << 20)
    # cosines that single precision can't tell from 0.9, in tiles of several strips
    rng = np.random.default_rng(8)
    x = range_join.unit(rng.normal(size=(700, 32)))
    side = rng.normal(size=x.shape)
    side = range_join.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    c = 0.9 + rng.choice([-1e-6, -1e-9, -1e-12, 1e-12, 1e-9, 1e-6, 0.05], size=(700, 1))
    y = range_join.unit(c * x + np.sqrt(1 - c * c) * side)
    one = np.ones(700, np.int64)
    links, roots, places = range_join.tile(x, y, one, 2 * one, 0.9, False)
    want = (x @ y.T) >= 0.9
    assert (links == np.concatenate([2 * want.sum(axis=1), want.sum(axis=0)])).all() and 200 < want.sum() < 500
    assert len(roots) == len(places) == want.sum()  # the links are a forest here
    links, roots, places = range_join.tile(x, x, one, one, -1.1, True)
    assert (links[:700] == 699).all() and not links[700:].any() and len(places) == 699


def test_line_keys_beyond_the_heavy_bar(spark, monkeypatch):
    """Hot keys joined by broadcast, by a shuffle, or met in their shard: the same result."""
    rows = [(i, f"hot\nwarm {i % 4}\nown {i}") for i in range(80)]
    df = spark.createDataFrame(rows, DOCS)
    for shard, keys in ((65_536, 500_000), (5, 500_000), (5, 0)):
        monkeypatch.setattr(line_dedup, "SHARD_ROWS", shard)
        monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", keys)
        got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, min_docs=10).collect())
        assert got == lines_brute(rows, 10)


def test_ngram_join_on_odd_tables(spark):
    """Only texts without words, only short ones, large copies in one batch, and a large family around common passages."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    family = [f"f{i}" for i in range(80)]
    long_ = " ".join(f"w{i}" for i in range(150_000))
    some = []
    for i in range(120):
        own = list(family)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(80)] = f"x{rng.random()}"
        some.append((i, " ".join(own)))
        some.append((500 + i, " ".join([*passage, *(f"y{rng.random()}" for _ in range(40))])))
    for rows in ([(1, None), (2, ""), (3, " \t")], [(i, f"a{i % 3} b c") for i in range(9)], [(1, long_), (2, long_), (3, long_ + " end")], some):
        df = spark.createDataFrame(rows, DOCS).coalesce(1)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(df, small=4).collect()}
        assert got == ngram_brute(rows)


def test_keep_one_leaves_clashing_columns(spark, monkeypatch):
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, words, 7), (2, words, 8), (2, words, 6), (3, "", 9), (None, None, 5), (4, "other words stand alone here now", 4), (4, "other words stand alone here now", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long").withColumn("_gone", F.lit("x")).withColumn("_kept", F.lit("y"))
    expected = [(None, 5), (1, 7), (3, 9), (4, 3)]
    for bound in (ngram_join.BROADCAST_IDS, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_IDS", bound)
        kept = ngram_join.keep_one(df)
        assert kept.columns == df.columns
        assert sorted(((r.doc_id, r["_key"]) for r in kept.collect()), key=lambda x: x[0] or 0) == expected


def test_lone_sets_are_not_looked_up_again():
    """Sets that meet without a label on either side are compared as they are; only labels of more sets stay open."""
    ids, named, runs, signs = np.array([1, 2, 3]), np.array([7]), np.ones(3, np.int32), np.full(3, 5, np.uint32)
    block = np.array([3, 1], np.int64).tobytes() + ids.tobytes() + named.tobytes() + runs.tobytes() + signs.tobytes()
    met = ngram_join._meet(pa.table({"bucket": [0], "block": pa.array([block], pa.binary())}), ngram_join.SMALL).to_pylist()
    assert {(r["a"], r["b"], r["la"], r["lb"]): r["open"] for r in met} == {(1, 2, 7, 2): True, (1, 3, 7, 3): True, (2, 3, 2, 3): False}
