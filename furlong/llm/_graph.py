"""Connected components of a link table, by contraction on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furlong.llm._shared import dropped, stored


def _to_roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping: every node's parent becomes the root of its tree; a tree of depth d takes log2(d) rounds."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = stored(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), F.col("grand").isNotNull().alias("moved")), "jump")
        moved = jumped.filter("moved").limit(1).count()
        dropped(parents)
        parents = jumped.select("node", "parent")
        if not moved:
            return parents


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) that has a link, root being the smallest node reachable.

    Each round points every node at its smallest smaller neighbour, jumps the
    pointers to the roots, and rewrites the links between roots.  Aggregates
    combine before the shuffle, joins read stored tables (so a node that holds
    many links is split at run time), and only counts reach the driver.  Null
    ends and self-links are left out; an empty table gives an empty result.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct(), "edges")
    roots: DataFrame | None = None
    while edges.limit(1).count():
        nearest = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")), "nearest")
        flat = _to_roots(nearest)
        if roots is None:
            merged = flat.select("node", F.col("parent").alias("root"))
        else:
            step = flat.select(F.col("node").alias("root"), "parent")
            moved = roots.join(step, "root", "left").select("node", F.coalesce("parent", "root").alias("root"))
            # a root of the earlier rounds that now has a parent is a node of its own
            merged = moved.unionByName(flat.select("node", F.col("parent").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
            merged = stored(merged, "roots")
        to_a, to_b = flat.select(F.col("node").alias("a"), F.col("parent").alias("pa")), flat.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        mapped = edges.join(to_a, "a", "left").select(F.coalesce("pa", "a").alias("a"), "b").join(to_b, "b", "left").select("a", F.coalesce("pb", "b").alias("b"))
        following = stored(mapped.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        dropped(edges)
        edges, roots = following, merged
    if roots is None:
        node = links.schema["a"].dataType
        return spark.range(0).select(F.col("id").cast(node).alias("node"), F.col("id").cast(node).alias("root"))
    tops = roots.select(F.col("root").alias("node"), "root").distinct()
    return roots.unionByName(tops)
