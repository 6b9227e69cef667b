"""Connected components of a link table by contraction: nothing of it goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsphere.llm.common import broadcast_checked, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is one of the component's nodes, the same for all of them.

    Each step maps every node to the smallest of its neighbours and itself, and replaces the links' ends by what they
    map to. A node that is no local minimum vanishes, so the steps are about logarithmic in the size of a component.
    """
    edges = materialize(links.select("a", "b").filter("a <> b").distinct(), "links")
    steps = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialize(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("to")).select(F.col("a").alias("node"), "to"), "step")
        steps.append(step)
        small = broadcast_checked(step)
        edges = edges.join(small.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(small.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        edges = materialize(edges.select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "links")
        if not edges.limit(1).count():
            break
    out = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        nxt = broadcast_checked(step.select(F.col("node").alias("root"), F.col("to").alias("next")))
        out = out.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return materialize(out, "components")
