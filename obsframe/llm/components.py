"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.session import write_once


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of the links (a, b); the label is one node of its component.

    Each round gives every node its smallest neighbour (or itself), replaces the nodes of all links by
    these and drops links within one; at least half of the nodes of a component go, so the
    rounds grow as the logarithm of the longest path. All state is written once per round to the shared folder.
    """
    edges = write_once(links.select("a", "b").where("a != b").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = write_once(nodes.withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        least = write_once(both.groupBy(F.col("a").alias("old")).agg(F.least(F.min("b"), F.min("a")).alias("new")), "least")
        labels = write_once(labels.join(least, labels["label"] == least["old"], "left").select(
            "node", F.coalesce("new", "label").alias("label")), "labels")
        left = edges.join(least.select(F.col("old").alias("a"), F.col("new").alias("x")), "a")
        moved = left.join(least.select(F.col("old").alias("b"), F.col("new").alias("y")), "b")
        edges = write_once(moved.where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return labels


def extend(classes: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, label) that ``classes`` become by further links: only the links between classes are worked on."""
    if links.isEmpty():
        return classes
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    ends = write_once(nodes.join(classes.withColumnRenamed("label", "known"), "node", "left").select("node", "known"), "ends")
    named = ends.select("node", F.coalesce("known", "node").alias("label"))
    one, other = (named.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")) for end in "ab")
    between = links.join(one, "a").join(other, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    merged = components(between).select(F.col("node").alias("label"), F.col("label").alias("into"))
    fresh = named.join(ends.where("known is null").select("node"), "node", "left_semi")
    every = classes.select("node", "label").unionByName(fresh).join(merged, "label", "left")
    return write_once(every.select("node", F.coalesce("into", "label").alias("label")), "labels")
