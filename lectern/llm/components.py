"""Connected components of a link table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Map every node that is not the smallest of its component to that smallest node.

    Returns ``(node, component)`` with ``component < node``; nodes without a
    row are their own component.  Self links, repeated links, links in either
    direction and links with a null end are allowed; the last have no effect.

    Each round hooks every node to its smallest smaller neighbour (an
    aggregate that combines before the shuffle), shortens the hooks by pointer
    jumping, and contracts the links to the roots.  The smallest node of a
    component never gets a hook, so it is the root that remains.  Links shrink
    at least by half per round; hubs are spread by AQE's skew join.
    """
    links = materialize(_ordered(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))), "links")
    labels = None
    while not links.isEmpty():
        hooks = _compressed(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))
        if labels is None:
            merged = hooks
        else:
            up = hooks.select(F.col("node").alias("component"), F.col("component").alias("root"))
            merged = labels.join(up, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(hooks)
            merged = materialize(merged, "labels")
            discard(labels)
        labels = merged
        at_a = hooks.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        at_b = hooks.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        contracted = links.join(at_b, "b", "left").join(at_a, "a", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        before, links = links, materialize(_ordered(contracted), "links")
        discard(before)
    if labels is None:
        return links.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return labels


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _compressed(hooks: DataFrame) -> DataFrame:
    """Pointer jumping: follow hooks, twice as far each time, until all end at roots."""
    now = materialize(hooks, "hooks")
    while True:
        up = now.select(F.col("node").alias("component"), F.col("component").alias("above"))
        step = now.join(up, "component", "left").select("node", F.coalesce("above", "component").alias("component"), F.col("above").isNotNull().alias("moved"))
        step = materialize(step, "hooks")
        moved = not step.where("moved").isEmpty()
        discard(now)
        now = step.drop("moved")
        now.scratch_path = step.scratch_path
        if not moved:
            return now
