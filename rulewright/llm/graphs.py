"""Connected components of edge tables, without gathering edges or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """(node, comp) of all nodes of ``edges`` (a, b); comp is the least node of the component. Each round points every node
    at its least neighbour, follows the pointers to their roots by doubling, and contracts; rounds and doublings are
    logarithmic, and each is cut off in a stored table."""
    labels, e = None, edges
    while True:
        both = e.select(F.col("a").alias("node"), F.col("b").alias("near")).union(e.select("b", "a"))
        p = work.save(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("comp")), "point", thin=True)
        while True:
            q = p.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            jumped = p.join(q, "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved"))
            jumped = work.save(jumped, "jump", thin=True)
            moved = jumped.agg(F.max("moved")).first()[0]
            work.drop(p)
            p = jumped
            if not moved:
                break
        p = p.select("node", "comp")
        if labels is None:
            labels = p
        else:
            q = p.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            labels = work.save(labels.join(q, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels", thin=True)
        a, b = p.select(F.col("node").alias("a"), F.col("comp").alias("ca")), p.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        e = work.save(e.join(a, "a").join(b, "b").where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "edges", thin=True)
        if not e.count():
            return labels


class Components:
    """Labels that grow with the edges added: only edges between components are worked on."""

    def __init__(self, work: Scratch):
        self.work = work
        self.labels: DataFrame | None = None

    def add(self, edges: DataFrame) -> None:
        if self.labels is None:
            if edges.count():
                self.labels = components(edges, self.work)
            return
        a, b = self.labels.select(F.col("node").alias("a"), F.col("comp").alias("ca")), self.labels.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        across = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct()
        across = self.work.save(across, "across", thin=True)
        if not across.count():
            return
        new = components(across, self.work)
        moved = self.labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        self.labels = self.work.save(moved.union(new.join(self.labels, "node", "left_anti").select("node", "comp")), "labels", thin=True)

    def of(self, nodes: DataFrame) -> DataFrame:
        """nodes (node, ...) with ``comp``; a node without an edge is its own."""
        if self.labels is None:
            return nodes.withColumn("comp", F.col("node"))
        return nodes.join(small(self.labels), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
