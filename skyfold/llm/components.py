"""Connected components of a table of links, by contraction.

Each round every node takes its smallest neighbour (if smaller) as parent, chains of parents are shortened by
jumping, and the links are rewritten between the roots; those inside one root vanish. Links shrink by half or more a round and live in
written tables, never on the driver. Joins have one row per node on one side, so a hot node splits like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.session import stored


def _shortened(parents: DataFrame) -> DataFrame:
    """Parents (``node``, ``parent``) with every node pointing at its root; roots themselves are left out."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        moved = parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved"))
        moved = stored(moved, "parents")
        if moved.filter("moved").isEmpty():
            return moved.select("node", "parent")
        parents = moved.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (a node of it) for every node of the links (``a``, ``b``)."""
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    spark = links.sparkSession
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).filter("parent < node")
        roots = _shortened(stored(parents, "parents"))
        if labels is None:
            nodes = both.select(F.col("a").alias("node")).distinct()
            labels = nodes.join(roots, "node", "left").select("node", F.coalesce("parent", "node").alias("component"))
        else:
            up = roots.select(F.col("node").alias("component"), "parent")
            labels = labels.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = stored(labels, "labels")
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        links = links.join(a, "a", "left").join(b, "b", "left")
        links = links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a <> b").distinct()
        links = stored(links, "links")
    if labels is None:
        kind = links.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"node {kind}, component {kind}")
    return labels
