"""Connected components by repeated contraction; nodes and links stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offsetlake.llm.scratch import drop, materialise
from offsetlake.llm.skew import hot_join, hot_keys


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of the links (a, b), label being the smallest node of its component.

    Each round points every node at its smallest neighbour or itself and contracts the links; a component of k nodes
    ends after at most about log2(k) rounds in usual graphs. A node with very many links, and a label of very many nodes, are split in the joins.
    Links with a null end are ignored; no links, no rows. The result is a table in the shared folder; those of earlier rounds are deleted.
    """
    links = materialise(links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to"), F.count("*").alias("n")), "pointers")
        if labels is None:
            after = materialise(point.select(F.col("a").alias("node"), F.col("to").alias("label")), "labels")
        else:
            often = hot_keys(labels.groupBy("label").agg(F.count("*").alias("n")), "label")
            after = materialise(hot_join(labels, point.select(F.col("a").alias("label"), "to"), ["label"], often, "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
            drop(labels)
        labels = after
        hot = hot_keys(point, "a")
        ends = hot_join(links, point.select("a", F.col("to").alias("x")), ["a"], hot).select("b", "x")
        hot_b = type(hot)(("b",), [type(r)(b=r["a"], n=r["n"]) for r in hot.rows], hot.limit)
        ends = hot_join(ends, point.select(F.col("a").alias("b"), F.col("to").alias("y")), ["b"], hot_b)
        left = materialise(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        drop(links, point)
        links = left
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    drop(links)
    return labels
