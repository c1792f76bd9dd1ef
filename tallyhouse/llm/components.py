"""Connected components by contraction: every round at least halves what is left of each component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (a, b: long, not null).

    A round hooks each node to its smallest neighbour if that is smaller, follows
    the hooks one step further, and renames the links by what they lead to. Hooks
    only lead downwards, so the smallest node of a component is never renamed and
    is what is left in the end. Minima are taken in the tasks before they are
    shuffled, and adaptive execution splits the joins at a node with many links.
    Each round is written to the shared folder, so a lost executor costs no more
    than its part of the round.
    """
    links = stored(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links"
    )
    roots = None
    while not links.isEmpty():
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        hooks = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("to")), "hooks")
        onward = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hooks = stored(hooks.join(onward, "to").select("node", F.col("next").alias("to")), "hooks")
        if roots is None:
            roots = hooks.select("node", F.col("to").alias("root"))
        else:
            moved = hooks.select(F.col("node").alias("root"), "to")
            roots = stored(roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        first, second = (hooks.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        renamed = links.join(first, "a").join(second, "b").filter("a_to <> b_to")
        links = stored(renamed.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if roots is None:
        roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
