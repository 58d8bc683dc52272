"""Mixing sources to target weights by hierarchical budgeting.

Weights hang on a tree whose levels are columns of the items (domain,
language, source, or fewer).  A budget runs down the tree in proportion to the
weights; what a leaf can't use, because its items may be repeated only so
often, goes to its siblings first and to the ancestors' other children only
when all siblings are full.  A leaf then takes whole epochs of its items and a
prefix of one more epoch in seeded order.  The prefix is found through the
token sums of hash buckets, so no leaf is ever sorted as a whole in one task.

The tree and its sums have as many rows as the ``weights`` argument; only they
reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arborlake.runtime import broadcast_if_small, cut

#: Hash buckets of a leaf's epoch; one bucket is sorted in one task.
BUCKETS = 4096
#: The weights' tree is a parameter table; it may not have more leaves than this.
MAX_LEAVES = 100_000


@dataclass
class Node:
    weight: float = 0.0
    capacity: float = 0.0
    children: dict[object, Node] = field(default_factory=dict)
    budget: float = 0.0
    #: What the weights alone would give, before shortages are handed on.
    wanted: float = 0.0

    def close(self) -> None:
        """Weights and capacities of inner nodes are the sums of their children's."""
        for child in self.children.values():
            child.close()
        if self.children:
            self.weight = sum(c.weight for c in self.children.values())
            self.capacity = sum(c.capacity for c in self.children.values())


def spread(node: Node, budget: float) -> None:
    """Give ``budget`` to the leaves below by weight; shortages go to siblings, in proportion to weight, before they go up.

    Children are filled in the order in which a growing budget would fill them, so one pass over the sorted children settles a node.
    """
    node.budget = min(budget, node.capacity)
    if not node.children:
        return
    everyone = list(node.children.values())
    for c in everyone:
        c.wanted = node.wanted * c.weight / node.weight if node.weight > 0 else 0.0
    takers = sorted((c for c in everyone if c.capacity > 0 and c.weight > 0), key=lambda c: c.capacity / c.weight)
    left, weight = node.budget, sum(c.weight for c in takers)
    given = {id(c): 0.0 for c in everyone}
    for c in takers:
        part = min(c.capacity, left * c.weight / weight) if weight > 0 else 0.0
        given[id(c)] = part
        left, weight = left - part, weight - c.weight
    for c in everyone:
        spread(c, given[id(c)])
    node.budget = sum(c.budget for c in everyone)


@dataclass
class Mix:
    """``items``: key, the levels, ``size`` and ``uses``.  ``report``: a row per leaf with its target and what was reached."""

    items: DataFrame
    report: DataFrame


def mix(items: DataFrame, key: str, size: str, levels: Sequence[str], weights: DataFrame, weight: str, repeats: str, total: float | None = None, seed: int = 0) -> Mix:
    """How often each item is used so that the leaves of ``weights`` reach their shares of ``total``.

    ``items`` has ``key``, ``size`` and the ``levels``, ``weights`` the levels,
    the ``weight`` of each leaf (as shares of ``total``) and ``repeats``, how
    often an item may be used in all.  ``total`` is by default the size of all
    items, those without a leaf included.

    Items whose leaf is not among the weights, or is null, are used 0 times;
    null and negative sizes count as 0; repeated keys are separate items; a
    leaf with null or negative weight or repeats gets nothing; two rows of
    weights for one leaf are refused.  An empty table gives no items and a
    report of empty leaves.  ``wanted`` is what the weights give a leaf,
    ``budget`` what it is to have after shortages were handed on, ``reached``
    what the items chosen for it have.  ``short`` marks leaves whose items are
    all chosen as often as they may be and still stay below what is wanted.
    """
    rows = items.select(F.col(key).alias("id"), *levels, F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("size"))
    leaves = weights.select(*levels, F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("weight"), F.coalesce(F.col(repeats).cast("bigint"), F.lit(0)).alias("repeats")).na.drop(subset=list(levels))
    parameters = leaves.limit(MAX_LEAVES + 1).collect()
    if len(parameters) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    if len({tuple(r[c] for c in levels) for r in parameters}) < len(parameters):
        raise ValueError("a leaf has more than one row of weights")
    spark = items.sparkSession
    # the leaf's number: one row per row of the parameter table
    numbered = spark.createDataFrame([(i, *(r[c] for c in levels)) for i, r in enumerate(parameters)], T.StructType([T.StructField("leaf", T.IntegerType()), *leaves.select(*levels).schema.fields]))
    joined = rows.join(broadcast_if_small(numbered, len(parameters)), list(levels), "left")
    placed = joined.select("id", *levels, "size", "leaf", F.pmod(F.xxhash64(F.lit(seed), "leaf", "id"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.xxhash64(F.lit(seed + 1), "id").alias("rank"))
    placed = cut(placed)
    # leaves x BUCKETS rows at most, of which the driver sees the leaves only
    buckets = placed.groupBy("leaf", "bucket").agg(F.sum("size").alias("tokens"), F.count("*").alias("n"))
    sums = {r.leaf: r for r in buckets.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.sum("n").alias("n")).collect()}
    everything = float(sum(r.tokens for r in sums.values())) if total is None else float(total)
    root = Node()
    ends: list[Node] = []
    for i, r in enumerate(parameters):
        node = root
        for c in levels:
            node = node.children.setdefault(r[c], Node())
        held = sums[i].tokens if i in sums else 0
        node.weight, node.capacity = max(0.0, r.weight), float(held * max(0, r.repeats))
        ends.append(node)
    root.close()
    root.wanted = everything * root.weight
    spread(root, everything * min(1.0, root.weight))
    plan: list[tuple] = []
    report: list[tuple] = []
    for i, (r, node) in enumerate(zip(parameters, ends)):
        held, n = (sums[i].tokens, sums[i].n) if i in sums else (0, 0)
        budget = round(node.budget)
        epochs = min(budget // held, r.repeats) if held else 0
        plan.append((i, int(epochs), int(budget - epochs * held)))
        report.append((i, *(r[c] for c in levels), float(r.weight), int(r.repeats), int(n), int(held), float(node.wanted), int(budget)))
    plan_table = spark.createDataFrame(plan, "leaf int, epochs bigint, more bigint")
    w = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.filter("leaf is not null").withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    bounds = starts.join(F.broadcast(plan_table), "leaf").select("leaf", "bucket", "epochs", "before", "tokens", "more")
    # a bucket is inside, outside, or the one where the prefix ends: the latter occurs once a leaf at most
    whole = F.col("before") + F.col("tokens") <= F.col("more")
    edge = cut(bounds.filter(~whole & (F.col("before") < F.col("more"))).select("leaf", F.col("bucket").alias("edge"), (F.col("more") - F.col("before")).alias("room")))
    cuts = plan_table.join(edge, "leaf", "left").join(
        bounds.groupBy("leaf").agg(F.max(F.when(whole & (F.col("more") > 0), F.col("bucket"))).alias("last")), "leaf", "left"
    )
    by_leaf = placed.join(F.broadcast(cuts.select("leaf", "epochs", "edge", "room", "last")), "leaf", "left")
    inside = F.col("bucket") <= F.coalesce("last", F.lit(-1))
    at_edge = F.col("bucket") == F.col("edge")
    order = Window.partitionBy("leaf", "bucket").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, 0)
    base = F.coalesce("epochs", F.lit(0))
    plain = by_leaf.filter(~F.coalesce(at_edge, F.lit(False))).select("id", *levels, "leaf", "size", (base + F.when(inside, 1).otherwise(0)).alias("uses"))
    ending = by_leaf.filter(at_edge).withColumn("_to", F.sum("size").over(order)).select("id", *levels, "leaf", "size", (base + F.when(F.col("_to") <= F.col("room"), 1).otherwise(0)).alias("uses"))
    used = plain.unionByName(ending)
    schema = T.StructType(
        [T.StructField("leaf", T.IntegerType()), *leaves.select(*levels).schema.fields]
        + [T.StructField(n, t) for n, t in (("target_share", T.DoubleType()), ("max_repeats", T.LongType()), ("items", T.LongType()), ("tokens", T.LongType()), ("wanted", T.DoubleType()), ("budget", T.LongType()))]
    )
    reached = used.groupBy("leaf").agg(F.sum(F.col("size") * F.col("uses")).alias("reached"), F.min("uses").alias("least_uses"), F.max("uses").alias("most_uses"))
    table = spark.createDataFrame([Row(*r) for r in report], schema).join(reached, "leaf", "left").withColumn("reached", F.coalesce("reached", F.lit(0)))
    total_reached: Column = F.sum("reached").over(Window.partitionBy(F.lit(0)))
    exhausted = F.coalesce(F.col("least_uses") >= F.col("max_repeats"), F.lit(True))
    table = table.withColumn("short", exhausted & (F.col("reached") < F.col("wanted")))
    # one row per leaf of the parameter table: a window over all of them is small
    table = table.withColumn("actual_share", F.when(total_reached > 0, F.col("reached") / total_reached).otherwise(0.0))
    return Mix(used.drop("leaf"), table.drop("leaf"))
