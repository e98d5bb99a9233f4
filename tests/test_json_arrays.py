"""JSON arrays as rows of elements: thresholds of plans for every kind, samples, constraints and sketches."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import json_arrays

KINDS = {"dict": lambda i: {"z": i, "a": 1}, "string": lambda i: f"s{i % 60}", "number": lambda i: i * 1.5, "nested": lambda i: [i], "bool": lambda i: i % 2 == 0, "mixed": lambda i: i if i % 2 else "s"}
#: What the plans must be: kind, then (size, strategy, keep).
WANT = {
    "dict": ((4, "none", 4), (5, "none", 5), (15, "none", 15), (16, "top", 10), (45, "top", 10), (46, "top", 15), (75, "top", 15), (76, "top", 15)),
    "nested": ((4, "none", 4), (16, "top", 10), (45, "top", 10), (46, "top", 15)),
    "string": ((5, "none", 5), (15, "none", 15), (16, "top", 15), (75, "top", 15), (76, "sample", 15), (78, "sample", 16)),
    "number": ((15, "none", 15), (16, "cluster", 10), (45, "cluster", 10), (46, "cluster", 15), (76, "cluster", 15)),
    "bool": ((16, "none", 16), (76, "none", 76)),
    "mixed": ((4, "none", 4), (76, "none", 76)),
}


@pytest.fixture(scope="module")
def arrays(spark):
    rows = [(f"{kind} {n}", json.dumps([make(i) for i in range(n)])) for kind, make in KINDS.items() for n, *_ in WANT[kind]]
    rows += [("empty", "[]"), ("bad", "[1,"), ("object", '{"a": 1}'), ("none", None), ("nulls", "[null, null, null, null, null]"), ("odd", '["", "é", "1", 1, 1.50, {"b": 2, "a": [1, {"c": null}]}, 12345678901234567890]')]
    items = json_arrays.elements(spark.createDataFrame(rows, "doc_id string, text string")).cache()
    yield items
    items.unpersist()


def test_elements(arrays):
    odd = [tuple(r)[2:] for r in arrays.filter("doc_id = 'odd'").orderBy("idx").collect()]
    assert odd == [("string", '""', "", None), ("string", '"é"', "é", None), ("string", '"1"', "1", None), ("number", "1", "1", None), ("number", "1.5", "1.5", None), ("object", '{"b":2,"a":[1,{"c":null}]}', '{"b":2,"a":[1,{"c":null}]}', "b"), ("number", "12345678901234567890", "12345678901234567890", None)]
    assert not arrays.filter("doc_id IN ('empty', 'bad', 'object', 'none')").count()


def test_plans(arrays):
    got = {r.doc_id: (r.type, r.n, r.strategy, r.keep) for r in json_arrays.plans(json_arrays.profiles(arrays)).collect()}
    for kind, cases in WANT.items():
        assert [got[f"{kind} {n}"] for n, *_ in cases] == [(kind, n, strategy, keep) for n, strategy, keep in cases]
    assert got["nulls"] == ("mixed", 5, "none", 5) and got["odd"][0] == "mixed"
    distinct = {r.doc_id: r.distinct for r in json_arrays.profiles(arrays).collect()}
    assert (distinct["dict 76"], distinct["string 76"], distinct["number 45"], distinct["nested 46"], distinct["nulls"]) == (1, 50, 45, None, None)


def test_samples(arrays):
    planned = json_arrays.plans(json_arrays.profiles(arrays))
    got = {}
    for r in json_arrays.sampled(arrays, planned).orderBy("doc_id", "at").collect():
        got.setdefault(r.doc_id, []).append(r.idx)
    assert got["dict 16"] == list(range(10)) and got["string 78"] == [4 * i for i in range(16)] and got["mixed 76"] == list(range(76))
    first = {}
    for i in range(46):
        first.setdefault(int(hashlib.md5(json.dumps(i * 1.5).removesuffix(".0").encode()).hexdigest()[:8], 16) % 15, i)
    plain = {}
    for r in arrays.filter("doc_id = 'number 46'").orderBy("idx").collect():
        plain.setdefault(int(hashlib.md5(r.value.encode()).hexdigest()[:8], 16) % 15, r.idx)
    assert got["number 46"] == [plain[b] for b in sorted(plain)] and len(first) == len(plain)


def test_elements_are_never_broadcast(spark):
    """Arrays of like elements are small in a shuffle and large as rows: joined to their plans they must not go through the driver."""
    texts = spark.range(40).select(F.col("id").alias("doc_id"), F.to_json(F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: F.struct(i.alias("id")))).alias("text"))
    items = json_arrays.elements(texts.groupBy("doc_id").agg(F.max("text").alias("text")))
    planned = json_arrays.plans(json_arrays.profiles(items))
    for df, n in ((planned, 40), (json_arrays.sampled(items, planned), 40 * 15), (json_arrays.must_keep(items), 0)):
        assert len(df.collect()) == n
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_constraints_and_sketches(spark):
    objects = [{"id": i, "state": "ok" if i % 25 else "late", "level": i % 40} | ({"note": "x"} if i == 7 else {}) | ({"say": "Panic!"} if i == 9 else {}) for i in range(100)]
    items = json_arrays.elements(spark.createDataFrame([(1, json.dumps(objects)), (2, json.dumps(objects[:4])), (3, '["error"]')], "doc_id long, text string"))
    got = {(r.doc_id, r.idx, r.reason) for r in json_arrays.must_keep(items).collect()}
    assert got == {(1, 7, "rare field"), (1, 9, "rare field"), (1, 9, "error"), *((1, i, "rare value") for i in (0, 25, 50, 75))}
    entries = json_arrays.fields(items)
    whole = {r.key: (r.distinct, r.n) for r in json_arrays.merge_sketches(json_arrays.field_sketches(entries)).collect()}
    parts = {r.key: (r.distinct, r.n) for r in json_arrays.merge_sketches(*[json_arrays.field_sketches(entries.filter(F.col("idx") % 3 == k)) for k in range(3)]).collect()}
    assert whole == parts and abs(whole["id"][0] - 100) <= 3 and whole["state"] == (2, 104)


def test_score_fields(spark):
    make = lambda f: json.dumps([{"f": f(i)} for i in range(30)])
    rows = [(1, make(lambda i: 1 - i / 30)), (2, make(lambda i: i)), (3, make(lambda i: 200 - i)), (4, make(lambda i: str(i))), (5, make(lambda i: 100 - 3 * i)), (6, make(lambda i: (i * 7) % 10))]
    got = {r.doc_id: r.confidence for r in json_arrays.score_fields(json_arrays.elements(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: 0.8, 5: 0.55}
