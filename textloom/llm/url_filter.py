"""Operator 4: URL filters, rules first and gradient-boosted trees on lexical features for the rest. DataFrame functions only.

A rule is a verdict for a host, its subdomains and a path prefix; of the rules that fit, the longest wins (of equally
long ones the one with the longer host, then block). URLs that a rule decides are the labelled examples: at most SAMPLE
of each verdict (those with the smallest hashes; a documented bound) train boosted trees. Features: lengths, depth, digit
ratio, character entropy, parameter counts, and the smoothed share of blocked URLs for the host's last label and for the
first path segment, counted over one half of all URLs that a rule decides; the trees learn from the other half, so they
see how far these shares can be trusted. Training grows trees level by level from gradient sums per node, feature and bin, which Spark
aggregates; the finished ensemble is one expression over the features of a row.

Defined results: a url that is null or has no "://" has empty host and path, fits no rule and is judged by the trees;
without examples of both verdicts the trees say the verdict there is, or allow; repeated rows are judged as given; other
columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import load, materialize

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
SAMPLE, TREES, DEPTH, RATE, BINS, L2 = 5_000, 10, 3, 0.4, 16, 1.0
#: More rules than this are joined instead of held in the expression of every row.
INLINE_RULES = 256
#: More values of a share than this are joined by a shuffle.
BROADCAST_VALUES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ("url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "digit_ratio", "host_digit_ratio", "entropy", "host_entropy", "n_params", "n_hyphens", "tail_share", "head_share")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """urls (host, path) with rule (host and path of the rule that decides) and ruled (its verdict), null where none fits."""
    better = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] == "allow"))
    if len(better) <= INLINE_RULES:
        fits = [((F.col("host") == h.lower()) | F.col("host").endswith("." + h.lower())) & F.col("path").startswith(p) for _, h, p in better]
        pick = lambda values: reduce(lambda c, fv: c.when(fv[0], F.lit(fv[1])), zip(fits[1:], values[1:], strict=True), F.when(fits[0], F.lit(values[0])))
        if not better:
            return urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
        return urls.withColumns({"rule": pick([h + p for _, h, p in better]), "ruled": pick([v for v, _, _ in better])})
    spark = urls.sparkSession
    table = spark.createDataFrame([(i, v, h.lower(), p, h + p) for i, (v, h, p) in enumerate(better)], "rank long, ruled string, rule_host string, rule_path string, rule string")
    # a host's suffixes meet the rules of that host; distinct (host, path) pairs only, so a hot host counts once a path
    pairs = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = pairs.withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    hit = tails.join(table, F.col("tail") == F.col("rule_host")).filter("startswith(path, rule_path)").groupBy("host", "path").agg(F.min_by(F.struct("rule", "ruled"), "rank").alias("won"))
    return urls.join(hit, ["host", "path"], "left").withColumns({"rule": F.col("won.rule"), "ruled": F.col("won.ruled")}).drop("won")


def _entropy(text: Column) -> Column:
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda a, b: a + b)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (url, host, path) with the lexical features, and tail and head for the shares."""
    url = F.coalesce(F.col("url"), F.lit(""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", "")) / F.greatest(F.length(c), F.lit(1))
    return urls.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "query_length": F.length(query).cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "digit_ratio": digits(url),
        "host_digit_ratio": digits(F.col("host")),
        "entropy": _entropy(url),
        "host_entropy": _entropy(F.col("host")),
        "n_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))).cast("double"),
        "n_hyphens": F.regexp_count("url", F.lit("[-_]")).cast("double"),
        **_tail_and_head(),
    })


def _shares(known: DataFrame, key: str) -> DataFrame:
    """(key, share): the smoothed share of blocked URLs for every value of key."""
    counts = known.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "block").alias("blocked"))
    return materialize(counts.select(F.col(key).alias(f"_{key}"), ((F.col("blocked") + 1) / (F.col("n") + 2)).alias(f"{key}_share")), f"{key}-shares")


def _look_up(urls: DataFrame, shares: dict[str, DataFrame]) -> DataFrame:
    """urls with tail_share and head_share; 0.5 for unknown values."""
    for key, table in shares.items():
        few = table.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
        urls = urls.join(F.broadcast(table) if few else table, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return urls.fillna(0.5, [f"{key}_share" for key in shares])


def _tail_and_head() -> dict[str, Column]:
    """The host's last label and the first segment of the path."""
    return {"tail": F.element_at(F.split("host", r"\."), -1), "head": F.coalesce(F.get(F.filter(F.split("path", "/"), lambda x: x != ""), F.lit(0)), F.lit(""))}


def _score(trees: list[dict], base: float) -> Column:
    def walk(tree: dict, node: int) -> Column:
        if "value" in tree[node]:
            return F.lit(tree[node]["value"])
        return F.when(F.col(tree[node]["feature"]) <= tree[node]["cut"], walk(tree, 2 * node)).otherwise(walk(tree, 2 * node + 1))

    return reduce(lambda a, t: a + walk(t, 1), trees, F.lit(base))


def _node_of(tree: dict, depth: int) -> Column:
    """The node of the tree, grown to depth levels, in which a row lies (null in a leaf above)."""

    def walk(node: int, level: int) -> Column:
        if level == depth or node not in tree:
            return F.lit(node)
        if "value" in tree[node]:
            return F.lit(None).cast("int")
        return F.when(F.col(tree[node]["feature"]) <= tree[node]["cut"], walk(2 * node, level + 1)).otherwise(walk(2 * node + 1, level + 1))

    return walk(1, 0)


def boost(examples: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Column:
    """The log-odds of block as an expression; examples hold FEATURES and y (1: block)."""
    n, blocked = examples.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not n or blocked in (0, n):
        return F.lit(1.0 if n and blocked == n else -1.0)
    found = examples.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first()
    cuts = [sorted(set(found[f])) for f in FEATURES]
    # the bin of a value: how many cuts lie below it
    bins = F.array(*[sum(((F.col(f) > cut).cast("int") for cut in c), F.lit(0)) for f, c in zip(FEATURES, cuts, strict=True)])
    examples = materialize(examples.withColumn("bins", bins), "url-bins")
    base, grown = math.log(blocked / (n - blocked)), []
    leaf = lambda g, h: {"value": RATE * g / (h + L2)}
    for _ in range(trees):
        p = 1 / (1 + F.exp(-_score(grown, base)))
        tree: dict[int, dict] = {}
        for level in range(depth):
            rows = examples.select(_node_of(tree, level).alias("node"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), "bins").filter("node is not null")
            rows = rows.select("node", "g", "h", F.posexplode("bins").alias("f", "bin"))
            sums: dict[int, dict] = {}
            for r in rows.groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # nodes x features x bins
                sums.setdefault(r.node, {}).setdefault(r.f, {})[r.bin] = (r.g, r.h)
            for node, by in sums.items():
                whole = [sum(x[i] for x in by[0].values()) for i in (0, 1)]
                best = (1e-6, None)
                for f in sorted(by):
                    g = h = 0.0
                    for i, cut in enumerate(cuts[f]):
                        g, h = g + by[f].get(i, (0, 0))[0], h + by[f].get(i, (0, 0))[1]
                        if min(h, whole[1] - h) > 1e-9:
                            gain = g * g / (h + L2) + (whole[0] - g) ** 2 / (whole[1] - h + L2) - whole[0] ** 2 / (whole[1] + L2)
                            if gain > best[0]:
                                best = (gain, (f, cut, g, h))
                if best[1] is None:
                    tree[node] = leaf(*whole)
                    continue
                f, cut, g, h = best[1]
                tree[node] = {"feature": FEATURES[f], "cut": cut}
                if level == depth - 1:
                    tree[2 * node], tree[2 * node + 1] = leaf(g, h), leaf(whole[0] - g, whole[1] - h)
        grown.append(tree)
    return _score(grown, base)


def judge_urls(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict and log_odds (of block, by the trees); columns of these names are replaced."""
    made = ("host", "path", "rule", "verdict", "log_odds")
    pages = pages.drop(*(c for c in made if c != url_col))
    url = F.col(url_col)
    ruled = match_rules(pages.withColumns({"host": host_of(url), "path": path_of(url)}), rules)
    known = ruled.filter("ruled is not null").select(url.alias("url"), "host", "path", "ruled").distinct()
    known = materialize(known.withColumns({"order": F.xxhash64("url"), **_tail_and_head()}), "ruled-urls")
    shares = {k: _shares(known.filter("order % 2 = 0"), k) for k in ("tail", "head")}
    half = known.filter("order % 2 <> 0").drop("tail", "head")
    picked = reduce(DataFrame.unionByName, [half.filter(F.col("ruled") == v).orderBy("order", "url").limit(SAMPLE) for v in ("allow", "block")])
    examples = lexical(picked).withColumn("y", F.when(F.col("ruled") == "block", 1.0).otherwise(0.0))
    examples = materialize(_look_up(examples, shares).select(*FEATURES, "y"), "url-features")
    odds = boost(examples)
    scored = _look_up(lexical(ruled.withColumn("_url", url).drop(url_col).withColumnRenamed("_url", "url")), shares).withColumn("log_odds", odds)
    if url_col != "url":
        scored = scored.withColumnRenamed("url", url_col)
    verdict = F.coalesce(F.col("ruled"), F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select(*pages.columns, "host", "path", "rule", "verdict", "log_odds")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
