"""Hierarchies kept as (child, parent) rows.

Chains are followed by doubling: after round r every node knows its ancestor 2^r steps up, so a hierarchy of depth d
takes log2(d) joins, each one row per node. The state of a round is staged, so lineage does not grow. These joins are left
joins with one row per node on the right, which adaptive execution splits when many rows point at one parent.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from feedwright.operators.joins import assert_unique_keys
from feedwright.registry import operator
from feedwright.staging import stage


@operator("chain_ends")
def chain_ends(links: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """Follow (node, next) to the end: (node, end, steps). ``next`` is NULL, or not a node, at the end of a chain.

    ``on_cycle`` is ``raise``, or ``null`` to give nodes that lead into a cycle a NULL end.
    """
    if on_cycle not in ("raise", "null"):
        raise ValueError("on_cycle must be 'raise' or 'null'")
    nodes = links.select(F.col("node").alias("_known"))
    state = stage(
        links.join(nodes, F.col("next") == F.col("_known"), "left").select(
            "node",
            F.coalesce("_known", "node").alias("at"),
            F.col("_known").isNotNull().cast("long").alias("steps"),
            F.col("_known").isNull().alias("done"),
        ),
        "chain",
    )
    rounds = math.ceil(math.log2(max(state.count(), 2))) + 1
    # Finished nodes are written once; only nodes still on their way are written again each round.
    finished, going = state.where("done"), state.where("not done")
    for _ in range(rounds):
        if going.isEmpty():
            break
        ahead = finished.unionByName(going).select(*[F.col(name).alias(f"_{name}") for name in finished.columns])
        moved = going.join(ahead, F.col("at") == F.col("_node"), "left").select(
            "node",
            F.col("_at").alias("at"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.col("_done").alias("done"),
        )
        moved = stage(moved, "chain")
        finished, going = finished.unionByName(moved.where("done")), moved.where("not done")
    ends = finished.select("node", F.col("at").alias("end"), "steps")
    if going.isEmpty():
        return ends
    if on_cycle == "raise":
        raise ValueError("the parent pointers form a cycle")
    nothing = F.lit(None).cast("bigint")
    return ends.unionByName(
        going.select("node", nothing.cast(ends.schema["end"].dataType).alias("end"), nothing.alias("steps"))
    )


@operator("step_tree")
def step_tree(config: DataFrame, group: str, root: int | None = None, ordered: bool = True) -> DataFrame:
    """Enabled steps of a group with their level, in sequence order.

    The level of a step counts the steps on its chain of parents, disabled ones included. With ``root`` only steps
    below that step are given, its children at level 1.
    """
    steps = config.where(F.col("processing_group_name") == group)
    pairs = assert_unique_keys(steps.select("sequence_order", "parent_sequence_order"), ["sequence_order"])
    parent = F.col("parent_sequence_order")
    if root is not None:
        # Children of the root end their chain there; the root itself is left out, so only its tree can end so.
        pairs = pairs.where(F.col("sequence_order") != root)
        link = F.when(parent == root, F.lit(None)).otherwise(parent)
    else:
        link = parent
    ends = chain_ends(pairs.select(F.col("sequence_order").alias("node"), link.alias("next")))
    enabled = steps.where(F.col("disable_flag") == 0)
    levels = enabled.join(ends, enabled["sequence_order"] == ends["node"])
    if root is not None:
        tops = pairs.where(parent == root).select(F.col("sequence_order").alias("_top"))
        levels = levels.join(tops, F.col("end") == F.col("_top"), "left_semi")
    result = levels.select(
        "sequence_order",
        "parent_sequence_order",
        "template_name",
        (F.col("steps") + 1).cast("int").alias("recursion_level"),
    )
    return result.orderBy("sequence_order") if ordered else result


@operator("root_blocker")
def root_blocker(edges: DataFrame) -> DataFrame:
    """Per waiting process every blocker that is not itself waiting: (waiting, blocking, root, depth).

    One row per direct blocker and root behind it, with the fewest steps. A direct blocker behind which only a wait
    cycle lies has one row with a NULL root.

    Pointers are doubled: after round r a process points at what it reaches in exactly 2^r steps, and at every root it
    reaches in fewer. So there are as many rounds as the logarithm of the longest way, on a chain one pointer per process
    and round, and a way around a cycle ends when it is longer than there are processes. What a round has found is staged.
    """
    waits = stage(edges.select("waiting", "blocking").distinct(), "waits")
    processes = waits.select(F.col("waiting").alias("_waiting")).distinct()
    first = waits.join(processes, F.col("blocking") == F.col("_waiting"), "left").select(
        F.col("waiting").alias("node"), F.col("blocking").alias("at"), F.lit(1).cast("long").alias("steps"), F.col("_waiting").isNull().alias("done")
    )
    state = stage(first, "waits")
    rounds = math.ceil(math.log2(max(processes.count(), 2))) + 1
    finished, going = state.where("done"), state.where("not done")
    for _ in range(rounds):
        if going.isEmpty():
            break
        onward = finished.unionByName(going).select(*[F.col(name).alias(f"_{name}") for name in state.columns])
        moved = going.join(onward, F.col("at") == F.col("_node")).select(
            "node", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done")
        )
        state = stage(finished.unionByName(moved).groupBy("node", "at", "done").agg(F.min("steps").alias("steps")), "waits")
        finished, going = state.where("done"), state.where("not done")
    roots = finished.select(F.col("node").alias("_node"), F.col("at").alias("_root"), (F.col("steps") + 1).alias("_steps"))
    direct = waits.join(processes, F.col("blocking") == F.col("_waiting"), "left").join(roots, F.col("blocking") == F.col("_node"), "left")
    is_root = F.col("_waiting").isNull()
    return direct.select(
        "waiting",
        "blocking",
        F.when(is_root, F.col("blocking")).otherwise(F.col("_root")).alias("root"),
        F.when(is_root, 1).otherwise(F.col("_steps")).cast("int").alias("depth"),
    )
