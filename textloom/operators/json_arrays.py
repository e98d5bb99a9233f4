"""Arrays of JSON elements as rows: what kind an array is, how much of it stays, and which elements must.

Arrays are exploded to (doc_id, idx, kind, element, ...), so that plans, samples and constraints are aggregations and windows
over elements, and one array of millions of elements is many rows and not one row's Python list. Counts are partial sums, the
number of distinct values of a field is a mergeable sketch, and a cluster sample is the first element of each hash bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Elements looked at for the kind and for distinct values, the size arrays are cut to, and the least size that is.
KIND_SAMPLE, UNIQUE_SAMPLE, KEEP, LEAST = 100, 50, 15, 5
#: Words of elements that always stay.
ERROR_WORDS = ("error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected")
CRUSHABLE = ("dict", "string", "number", "nested")


def elements(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, idx, kind, element, value, first_key) of the arrays of docs; texts that are no JSON array have no rows, nor have empty ones.

    kind: object, string, number, bool, array or null; element is JSON, value a string's own text or else element.
    """
    typed, plain = F.from_json(text_col, "array<variant>"), F.from_json(text_col, "array<string>")
    rows = docs.select("doc_id", F.posexplode(F.arrays_zip(typed.alias("v"), plain.alias("s"))).alias("idx", "x"))
    shape = F.schema_of_variant("x.v")
    kind = F.when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").when(shape == "STRING", "string").when(shape == "BOOLEAN", "bool").when((shape == "VOID") | F.col("x.v").isNull(), "null").otherwise("number")
    rows = rows.select("doc_id", F.col("idx").cast("long").alias("idx"), kind.alias("kind"), F.coalesce(F.to_json("x.v"), F.lit("null")).alias("json"), F.col("x.s").alias("plain"))
    element = F.when(F.col("kind").isin("object", "array"), F.col("plain")).otherwise(F.col("json"))
    return rows.select("doc_id", "idx", "kind", element.alias("element"), F.when(F.col("kind") == "string", F.col("plain")).otherwise(element).alias("value"), F.when(F.col("kind") == "object", F.coalesce(F.get(F.json_object_keys("plain"), F.lit(0)), F.lit(""))).alias("first_key"))


def _default_keep(kind: Column, n: Column) -> Column:
    """The share of an array that stays by the table of kinds alone."""
    top = lambda k: F.lit(float(k)) / n
    named = kind.isin("dict", "nested")
    return (
        F.when(named & (n > 50), top(20)).when(named & (n > 20), top(10)).when((kind == "string") & (n > 100), 0.3).when((kind == "string") & (n > 30), top(15))
        .when((kind == "number") & (n > 50), top(10)).when(kind.isin("bool", "mixed") & (n > 20), top(5)).otherwise(1.0)
    )


def _beside(rows: DataFrame, held: DataFrame) -> DataFrame:
    """rows with the columns that held, one row an array (_doc), has of their array.

    Always by merging: rows are elements made from arrays, and by the compressed size of the arrays Spark would send all of them to every task.
    """
    return rows.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_doc")))


def profiles(items: DataFrame) -> DataFrame:
    """(doc_id, type, n, distinct, savings): an array's type, size, distinct values among even samples, and bytes that the table of kinds would save."""
    sizes = items.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.octet_length("element")).alias("bytes"),
        F.collect_set(F.when((F.col("idx") < KIND_SAMPLE) & (F.col("kind") != "null"), F.col("kind"))).alias("kinds"),
    )
    one = F.get("kinds", F.lit(0))
    kind = F.when(F.size("kinds") != 1, "mixed").when(one == "object", "dict").when(one == "array", "nested").otherwise(one)
    typed = sizes.select(F.col("doc_id").alias("_doc"), kind.alias("type"), "n", "bytes")
    step = F.greatest(F.expr(f"n div {UNIQUE_SAMPLE}"), F.lit(1))
    key = F.when(F.col("kind").isin("string", "number"), F.col("value")).when((F.col("kind") == "object") & (F.col("type") == "dict"), F.col("first_key"))
    looked = (F.col("idx") % step == 0) & (F.col("idx") < step * UNIQUE_SAMPLE)
    whole = _beside(items, typed).groupBy("_doc", "type", "n", "bytes").agg(F.countDistinct(F.when(looked, key)).alias("distinct"))
    savings = F.floor((1.0 - _default_keep(F.col("type"), F.col("n"))) * F.col("n") * F.expr("greatest(bytes, 1) div n")).cast("long")
    return whole.select(F.col("_doc").alias("doc_id"), "type", "n", F.nullif("distinct", F.lit(0)).alias("distinct"), savings.alias("savings"))


def plans(profiled: DataFrame, k: int = KEEP) -> DataFrame:
    """profiled with strategy (none, top, sample, cluster) and keep, how many elements it leaves."""
    n, kind = F.col("n"), F.col("type")
    named = kind.isin("dict", "nested")
    strategy = F.when(~kind.isin(*CRUSHABLE) | (n < LEAST) | (n <= k), "none").when(named, "top").when(kind == "number", "cluster").when(n > 5 * k, "sample").otherwise("top")
    most = F.when(named, F.when(n > 3 * k, k).otherwise(max(k - 5, 5))).when(kind == "number", F.when(n > 3 * k, k).otherwise(max(k - 5, 3))).otherwise(k)
    keep = F.when(strategy == "none", n).when(strategy == "sample", F.greatest(F.round(n * 0.2), F.lit(1))).otherwise(F.least(most, n)).cast("long")
    return profiled.withColumns({"strategy": strategy, "keep": keep})


def bucket(key: Column, n: Column) -> Column:
    """The hash bucket of a key among n."""
    return F.conv(F.left(F.md5(key.cast("binary")), F.lit(8)), 16, 10).cast("long") % n


def sampled(items: DataFrame, planned: DataFrame) -> DataFrame:
    """(doc_id, idx, at, element): the elements that the plans keep, at being their new place.

    Of a cluster sample each bucket gives its first element; buckets that are empty give none.
    """
    held = planned.select(F.col("doc_id").alias("_doc"), "n", "strategy", "keep")
    rows = _beside(items, held)
    step = F.expr("n div keep")
    at = F.when(F.col("strategy").isin("none", "top") & (F.col("idx") < F.col("keep")), F.col("idx"))
    at = at.when((F.col("strategy") == "sample") & (F.col("idx") % step == 0) & (F.col("idx") < step * F.col("keep")), F.expr("idx div (n div keep)"))
    at = at.when(F.col("strategy") == "cluster", bucket(F.col("value"), F.col("keep")))
    rows = rows.withColumn("at", at).filter("at IS NOT NULL")
    return rows.groupBy("doc_id", "at").agg(F.min(F.struct("idx", "element")).alias("x")).select("doc_id", "x.idx", "at", "x.element")


def fields(items: DataFrame) -> DataFrame:
    """(doc_id, idx, key, kind, value): the entries of the objects among items; a string's own text or else JSON."""
    objects = items.filter("kind = 'object'")
    typed = F.from_json("element", "map<string,variant>")
    plain = F.from_json("element", "map<string,string>")
    rows = objects.select("doc_id", "idx", F.explode(F.map_entries(typed)).alias("x"), plain.alias("plain"))
    shape = F.schema_of_variant("x.value")
    kind = F.when((shape == "VOID") | F.col("x.value").isNull(), "null").when(shape == "STRING", "string").when(shape == "BOOLEAN", "bool").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("number")
    return rows.select("doc_id", "idx", F.col("x.key").alias("key"), kind.alias("kind"), F.when(kind == "null", F.lit("__none__")).when(kind.isin("string", "object", "array"), F.element_at("plain", F.col("x.key"))).otherwise(F.to_json("x.value")).alias("value"))


def field_sketches(entries: DataFrame) -> DataFrame:
    """(key, sketch, n): of each field over all arrays a mergeable sketch of its distinct values; see merge_sketches()."""
    return entries.groupBy("key").agg(F.hll_sketch_agg("value").alias("sketch"), F.count(F.lit(1)).alias("n"))


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """(key, distinct, n) over several results of field_sketches()."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"), F.sum("n").alias("n"))


def must_keep(items: DataFrame, cover: float = 0.8) -> DataFrame:
    """(doc_id, idx, reason): elements that must stay: with a rare field, with a rare value of a field of few values, or with an error word."""
    low = F.lower("element")
    wrong = low.contains(ERROR_WORDS[0])
    for word in ERROR_WORDS[1:]:
        wrong = wrong | low.contains(word)
    errors = items.filter((F.col("kind") == "object") & wrong).select("doc_id", "idx", F.lit("error").alias("reason"))
    entries = fields(items)
    sizes = items.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total")).filter(f"total >= {LEAST}").withColumnRenamed("doc_id", "_doc")
    counts = _beside(entries.groupBy("doc_id", "key", "value").agg(F.count(F.lit(1)).alias("c")), sizes)
    own = Window.partitionBy("doc_id", "key")
    order = own.orderBy(F.desc("c"), "value")
    counts = counts.withColumns({"n": F.sum("c").over(own), "kinds": F.count(F.when(F.col("value") != "__none__", 1)).over(own), "before": F.coalesce(F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    counts = counts.withColumn("top", F.col("before") < F.ceil(F.col("n") * cover)).withColumn("width", F.count(F.when(F.col("top"), 1)).over(own))
    odd = F.expr("n >= total * 0.8D AND kinds BETWEEN 2 AND 50 AND width <= 5 AND NOT top AND value IS NOT NULL")
    why = F.when(F.expr("n < total * 0.2D"), "rare field").when(odd, "rare value")
    found = counts.select("_doc", F.col("key").alias("_key"), F.col("value").alias("_value"), why.alias("reason")).filter("reason IS NOT NULL")
    # one join for both reasons, by merging as in _beside()
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")) & F.col("value").eqNullSafe(F.col("_value"))
    rare = entries.join(found.hint("merge"), same).select("doc_id", "idx", "reason")
    return errors.unionByName(rare).distinct()


def score_fields(items: DataFrame) -> DataFrame:
    """(doc_id, key, confidence): numeric fields that look like scores, 0.4 and more: bounded, not in even rising steps, mostly falling."""
    numbers = fields(items).withColumn("x", F.when(F.col("kind") == "number", F.col("value").try_cast("double")))
    own = Window.partitionBy("doc_id", "key").orderBy("idx")
    numbers = numbers.withColumns({"place": F.row_number().over(own), "step": F.col("x") - F.lag("x").over(own)})
    first = F.col("place") <= UNIQUE_SAMPLE
    stats = numbers.groupBy("doc_id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.count("x").alias("numbers"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.count(F.when(F.col("step") <= 0, 1)).alias("falling"),
        F.count(F.when(first, 1)).alias("sampled"), F.min(F.when(first, F.col("step"))).alias("least"), F.avg(F.when(first, F.col("step"))).alias("mean"),
        F.collect_list(F.when(first, F.col("step"))).alias("steps"),
        F.count(F.when((F.col("place") <= 20) & (F.col("x") != F.floor("x")), 1)).alias("broken"), F.count(F.when(F.col("place") <= 20, 1)).alias("seen"))
    stats = stats.filter("numbers = n")
    within = lambda a, b: F.col("low").between(a, b) & F.col("high").between(a, b)
    bounded = F.when(within(0, 1), 0.4).when(within(0, 10), 0.3).when(within(0, 100), 0.25).when((F.col("low") >= -1) & (F.col("high") <= 1), 0.35)
    even = F.size(F.filter("steps", lambda d: (d >= F.col("mean") * 0.5) & (d <= F.col("mean") * 2.0)))
    rising = F.coalesce((F.col("sampled") >= 4) & (F.col("least") >= 0) & (F.col("mean") > 0) & (even >= F.size("steps") * 0.7), F.lit(False))
    sure = bounded + F.when((F.col("n") >= 5) & (F.col("falling") / (F.col("n") - 1) > 0.7), 0.3).otherwise(0.0) + F.when(F.col("broken") > F.col("seen") * 0.3, 0.1).otherwise(0.0)
    return stats.filter(~rising & bounded.isNotNull()).select("doc_id", "key", F.round(F.least(sure, F.lit(0.95)), 6).alias("confidence")).filter("confidence >= 0.4")
