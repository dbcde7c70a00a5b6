"""Connected components of an edge list (single-linkage cut).

Min-label propagation with pointer jumping: each round every node takes the
smallest label among itself and its neighbours, then jumps to its label's
label. Rounds are bounded by about log of the diameter in practice. Rounds
are persisted, and every ``checkpoint_every``-th round's labels are written
with a reliable ``checkpoint()`` to the shared checkpoint folder, so lineage
stays short and a lost executor recomputes at most a few rounds. The stop test is one ``count()`` per round (a driver scalar).
A hub node (one label shared by a third of all nodes) makes the jump join
skewed on that label; AQE's skew join splits it.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut_lineage


rounds_used = [0]  # rounds of the last run (for inspection)


def connected_components(edges: DataFrame, nodes: DataFrame | None = None,
                         src: str = "i", dst: str = "j", node_col: str = "unit_id",
                         max_rounds: int = 60, checkpoint_every: int = 3) -> DataFrame:
    """``node_col, component`` where component is the smallest node id in it.

    ``nodes`` (optional, column ``node_col``) adds isolated nodes as their own
    component.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where(F.col("u") != F.col("v"))
    # both directions from one pass: a union of two would find the edges twice
    e = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))).distinct()
    e = cut_lineage(e)
    labels = e.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("node"), F.least("u", "m").alias("label"))
    held = None
    for rnd in range(max_rounds):
        nb = e.join(labels.select(F.col("node").alias("v"), F.col("label").alias("nl")), "v") \
            .groupBy("u").agg(F.min("nl").alias("nl"))
        step = labels.join(nb.withColumnRenamed("u", "node"), "node", "left") \
            .select("node", F.col("label").alias("old"),
                    F.least("label", F.coalesce("nl", "label")).alias("label"))
        parent = step.select(F.col("node").alias("label"), F.col("label").alias("pl"))
        jumped = step.join(parent, "label", "left").select(
            "node", "old", F.least("label", F.coalesce("pl", "label")).alias("label"))
        if (rnd + 1) % checkpoint_every == 0:
            jumped = cut_lineage(jumped)      # lineage cut: a lost executor redoes few rounds
        else:
            jumped = jumped.persist(StorageLevel.MEMORY_AND_DISK)
        changed = jumped.where(F.col("label") != F.col("old")).count()  # materialises this round
        if held is not None:
            held.unpersist()
        held = jumped if jumped.storageLevel.useMemory or jumped.storageLevel.useDisk else None
        labels = jumped.select("node", "label")
        rounds_used[0] = rnd + 1
        if changed == 0:
            break
    else:
        raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    out = labels.select(F.col("node").alias(node_col), F.col("label").alias("component"))
    if nodes is not None:
        n = nodes.select(node_col).distinct()
        out = n.join(out, node_col, "left").select(
            node_col, F.coalesce("component", F.col(node_col)).alias("component"))
    return out


def component_sizes(components: DataFrame, comp_col: str = "component") -> DataFrame:
    """A10: members per component."""
    return components.groupBy(comp_col).agg(F.count(F.lit(1)).alias("size"))
