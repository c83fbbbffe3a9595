"""Ancestors in trees of expressions, and how an expression is used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import forget, settle

#: Kinds of expressions that pass on how they are used to the expression inside (fixed values).
PASSING_ON = ["field", "drop_temps"]


def nearest(nodes: DataFrame) -> DataFrame:
    """node, ancestor, via: the nearest ancestor that does not pass on, and its child through which the node lies; null where all ancestors pass on.

    nodes(node, parent, passes_on), parent null at a root. Each node points to its parent; where that one passes on, the node takes over what it points to.
    The ways double from round to round, so chains of any depth take rounds by its logarithm, and only nodes that can still go on are looked up."""
    at = settle(nodes.select("node", F.col("parent").alias("ancestor"), F.col("node").alias("via")))
    passing = settle(nodes.filter("passes_on").select("node"))
    done = None
    while True:
        ahead = at.join(passing.toDF("ancestor"), "ancestor", "left_semi").select("node", "ancestor")
        steps = settle(ahead.join(at.toDF("ancestor", "far", "far_via"), "ancestor").select("node", F.col("far").alias("ancestor"), F.col("far_via").alias("via")))
        if steps.isEmpty():
            break
        after = settle(at.join(steps.select("node"), "node", "left_anti").union(steps.select("node", "ancestor", "via")))
        forget(at, steps)
        at, done = after, after
    return (at if done is None else done).select("node", "ancestor", F.when(F.col("ancestor").isNotNull(), F.col("via")).alias("via"))


def contexts(exprs: DataFrame) -> DataFrame:
    """expr, context: value, address, store or compound_store, the use that is made of each of exprs(expr, parent, kind, slot).

    The nearest ancestor that is no PASSING_ON kind tells: an `assign` or `assign_op` stores into its left side (slot 0), an `addr_of` takes the
    address, a `method_as_mut_ptr` that of its receiver (slot 0), a `binding_by_ref` that of its value; all others, and none, read the value."""
    at = nearest(exprs.select(F.col("expr").alias("node"), "parent", F.col("kind").isin(PASSING_ON).alias("passes_on")))
    to = exprs.select(F.col("expr").alias("ancestor"), F.col("kind").alias("_kind"))
    side = exprs.select(F.col("expr").alias("via"), F.col("slot").alias("_slot"))
    first = F.col("_slot") == 0
    use = (
        F.when((F.col("_kind") == "assign") & first, "store").when((F.col("_kind") == "assign_op") & first, "compound_store")
        .when((F.col("_kind") == "addr_of") | (F.col("_kind") == "binding_by_ref") | ((F.col("_kind") == "method_as_mut_ptr") & first), "address").otherwise("value")
    )
    return at.join(to, "ancestor", "left").join(side, "via", "left").select(F.col("node").alias("expr"), use.alias("context"))
