"""Adaptive windows: leaves with too many records are split at their middle day until each is small enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, ident
from ..sources.shared import staged

#: Nodes of a run's tree at most; halvings of any span of dates.
MOST_NODES, MOST_DEPTH = 1024, 40
NODE = "id string, parent string, depth int, first date, last date"


def child_id(parent: Column, first: Column, last: Column) -> Column:
    """A window's id by its parent's and its days: the same whenever the tree is made."""
    return ident.window_id(parent, first, last)


def split_tree(windows: DataFrame, days: DataFrame, most: int, most_nodes: int = MOST_NODES) -> DataFrame:
    """``(run, id, parent, depth, first, last, records, state)``: the nodes of each run's tree of windows.

    ``windows`` are the planned ones ``(run, first, last)``, ``days`` the records of each ``(run, day, n)``. A node with more than
    ``most`` records is split, unless it is a day (minimum_reached) or its run has no room for two more nodes
    (leaf_limit_reached: levels split one after the other, a level's windows by their first day). Other nodes are leaves.
    Leaves tile the planned windows. Rounds are as many as the tree is deep; each moves the days to their window's child.
    Days outside the windows, and null ones, are no records of theirs; a run without windows has no nodes.
    """
    root = child_id(F.lit("plan"), F.col("first"), F.col("last"))
    frontier = windows.select("run", root.alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), "first", "last")
    frontier = frontier.withColumn("nodes", F.count("*").over(Window.partitionBy("run")))
    own = windows.select(F.col("run").alias("_run"), "first", "last", root.alias("id"))
    inside = F.col("run").eqNullSafe(F.col("_run")) & F.col("day").between(F.col("first"), F.col("last"))
    placed = staged(days.groupBy("run", "day").agg(F.sum("n").alias("n")).join(F.broadcast(own), inside).select("run", "day", "n", "id"), "split-days")
    done = None
    for _ in range(MOST_DEPTH):
        sizes = placed.groupBy(F.col("run").alias("_run"), F.col("id").alias("_id")).agg(F.sum("n").cast("long").alias("records"))
        judged = frontier.join(sizes, F.col("run").eqNullSafe(F.col("_run")) & (F.col("id") == F.col("_id")), "left").withColumn("records", F.coalesce("records", F.lit(0)))
        judged = judged.withColumn("large", F.col("records") > most)
        turn = F.count_if(F.col("large") & (F.col("last") > F.col("first"))).over(Window.partitionBy("run").orderBy("first", "last"))
        state = F.when(~F.col("large"), "leaf").when(F.col("last") <= F.col("first"), "minimum_reached").when(F.col("nodes") + 2 * turn > most_nodes, "leaf_limit_reached").otherwise("split")
        judged = judged.withColumn("state", state).withColumn("nodes", F.col("nodes") + 2 * F.count_if(F.col("state") == "split").over(Window.partitionBy("run")))
        judged = staged(judged.drop("_run", "_id", "large"), "split-level")
        level = judged.drop("nodes")
        done = level if done is None else done.unionByName(level)
        split = judged.filter("state = 'split'").withColumn("mid", dates.midpoint(F.col("first"), F.col("last")))
        if split.isEmpty():
            break
        after = F.date_add("mid", 1)
        halves = F.explode(F.array(F.struct(F.col("first").alias("a"), F.col("mid").alias("z")), F.struct(after.alias("a"), F.col("last").alias("z"))))
        frontier = split.select("run", F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"), "nodes", halves.alias("h")).select("run", child_id(F.col("parent"), F.col("h.a"), F.col("h.z")).alias("id"), "parent", "depth", F.col("h.a").alias("first"), F.col("h.z").alias("last"), "nodes")
        half = split.select(F.col("run").alias("_run"), F.col("id").alias("_id"), "mid", child_id(F.col("id"), F.col("first"), F.col("mid")).alias("left"), child_id(F.col("id"), after, F.col("last")).alias("right"))
        moved = placed.join(half, F.col("run").eqNullSafe(F.col("_run")) & (F.col("id") == F.col("_id")))
        placed = staged(moved.select("run", "day", "n", F.when(F.col("day") <= F.col("mid"), F.col("left")).otherwise(F.col("right")).alias("id")), "split-days")
    return done
