"""Pointer doubling: every node of a forest finds its root in logarithmically many self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import Scratch

MAX_ROUNDS = 64


def resolve_pointers(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes``: id, ptr, one row per id; a root points to itself. Returns id, root for all nodes.

    Each round joins the table with itself and replaces every pointer by its pointer's pointer, so
    a chain of length n takes log2(n) rounds. Only nodes whose pointer is not yet known to be a root
    are joined, and until then no two nodes of a chain share a pointer, so the join has no hot key.
    A pointer to an absent node counts as a root. Cycles raise ValueError.
    """
    roots = nodes.where(F.col("id") == F.col("ptr")).select("id", F.col("ptr").alias("root"))
    table, path = scratch.cut(nodes.where(F.col("id") != F.col("ptr")).select("id", "ptr", F.lit(False).alias("done")))
    for _ in range(MAX_ROUNDS):
        if table.where(~F.col("done")).isEmpty():
            return roots.unionByName(table.select("id", F.col("ptr").alias("root")))
        jump = table.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("done").alias("next_done"))
        moved = (
            table.where(~F.col("done"))
            .join(jump, "ptr", "left")
            .select("id", F.coalesce("next", "ptr").alias("ptr"), (F.col("next").isNull() | F.col("next_done")).alias("done"))
        )
        new, new_path = scratch.cut(table.where("done").unionByName(moved))
        scratch.drop(path)
        table, path = new, new_path
    raise ValueError("the pointers have a cycle")
