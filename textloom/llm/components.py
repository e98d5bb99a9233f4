"""Connected components by min-label propagation with pointer jumping, all in joins and aggregations.

Each round joins labels to edges and takes minima (partial aggregation before the shuffle, so a hub costs one row a
task), then follows each label to its own label. A star needs one round, a chain about the logarithm of its length.
Nothing but whether a label changed reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import materialize


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component_id) for every id that occurs in edges (a long, b long); component_id is the smallest id reachable."""
    edges = edges.filter("a <> b").selectExpr("least(a, b) AS a", "greatest(a, b) AS b").distinct()
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        return edges.selectExpr("a AS id", "b AS component_id")
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))
    labels = materialize(both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("label")).withColumnRenamed("src", "id"), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("label").alias("seen"))
        step = labels.join(near, labels["id"] == near["src"]).select("id", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        over = labels.select(F.col("id").alias("via"), F.col("label").alias("jump"))
        new = step.join(over, step["label"] == over["via"], "left").select("id", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        new = materialize(new, "labels")
        settled = new.filter("old <> label").isEmpty()
        labels = new.select("id", "label")
        if settled:
            return labels.withColumnRenamed("label", "component_id")
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
