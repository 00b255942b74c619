"""Splits that keep related records together, by random-mate contraction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.core import is_filler
from tidemark.llm.pointers import resolve_pointers
from tidemark.operators.skew import hot_values, spread_join
from tidemark.session import Scratch

MAX_ROUNDS = 200
#: Components of at least this share of the weight are placed first; there are at most 1/share.
GIANT_SHARE = 0.0005
BUCKETS = 4096


def vertex(prefix: str, c: Column) -> Column:
    """A vertex name that tells columns apart; null for values that relate nothing."""
    return F.when(~is_filler(c), F.concat(F.lit(prefix), F.trim(c)))


def relation_edges(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct edges (u, v) that join the values of each row in a path."""
    names = [vertex(f"{i}:", F.col(c)) for i, c in enumerate(cols)]
    combos = rows.select(*[n.alias(f"k{i}") for i, n in enumerate(names)]).distinct()
    chain = F.array_compact(F.array(*[F.col(f"k{i}") for i in range(len(cols))]))
    pairs = F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.get(F.col("chain"), i - 1).alias("u"), F.get(F.col("chain"), i).alias("v")))
    return combos.select(chain.alias("chain")).where(F.size("chain") > 1).select(F.inline(pairs)).distinct()


def _heads(c: Column, round_: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(round_)), F.lit(2)) == 0


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root for every vertex that an edge touches; equal roots mean one component.

    Each round every vertex tosses a coin (a hash of its name and the round). A tail with a head
    among its neighbours is merged into the smallest of them; the edges are renamed by two joins,
    loops and repeats are dropped, until no edges are left. The merges form a forest whose roots
    pointer doubling finds. Repeats of a hot vertex's edges vanish in each ``distinct``.
    """
    table, path = scratch.cut(edges)
    merges: DataFrame | None = None
    for round_ in range(MAX_ROUNDS):
        if table.isEmpty():
            break
        hu, hv = _heads(F.col("u"), round_), _heads(F.col("v"), round_)
        pair = F.when(~hu & hv, F.struct(F.col("u").alias("id"), F.col("v").alias("ptr"))).when(hu & ~hv, F.struct(F.col("v").alias("id"), F.col("u").alias("ptr")))
        mates = table.select(pair.alias("p")).where(F.col("p").isNotNull()).select("p.*").groupBy("id").agg(F.min("ptr").alias("ptr"))
        mates, _ = scratch.cut(mates)
        merges = mates if merges is None else merges.unionByName(mates)
        mu = mates.select(F.col("id").alias("u"), F.col("ptr").alias("pu"))
        mv = mates.select(F.col("id").alias("v"), F.col("ptr").alias("pv"))
        renamed = table.join(mu, "u", "left").join(mv, "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
        left = renamed.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
        new, new_path = scratch.cut(left)
        scratch.drop(path)
        table, path = new, new_path
    else:
        raise ValueError("contraction did not end")
    if merges is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    found = resolve_pointers(merges, scratch)
    roots = found.select(F.col("root").alias("id")).distinct().withColumn("root", F.col("id"))
    return found.unionByName(roots)


def component_groups(labels: DataFrame, prefix: str = "0:") -> DataFrame:
    """Members of one kind in components with at least two of them, and the smallest member."""
    own = labels.where(F.col("id").startswith(prefix)).withColumn("member", F.substring("id", len(prefix) + 1, 2**30))
    groups = own.groupBy("root").agg(F.min("member").alias("group_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return spread_join(own, groups, "root").select("member", "group_id", "n")


def assign_splits(weights: DataFrame, proportions: Sequence[tuple[str, float]] = (("train", 0.8), ("validation", 0.1), ("test", 0.1))) -> DataFrame:
    """component, weight -> component, split, by cumulative weight.

    Components of ``GIANT_SHARE`` of the weight come first, largest first; the others follow in the
    order of a hash. A component goes to the split in which its cumulative weight begins; what the
    first split overshoots is taken from the others in proportion. The running sum is over hash
    buckets first and inside a bucket then, so no task holds all components.
    """
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"))
    giant = F.col("weight") >= F.col("total") * GIANT_SHARE
    keyed = weights.crossJoin(F.broadcast(total)).withColumn("h", F.xxhash64("component")).withColumn("bucket", F.when(giant, F.lit(-1)).otherwise(F.pmod("h", F.lit(BUCKETS))))
    by_bucket = keyed.groupBy("bucket").agg(F.sum("weight").alias("w"))
    before = by_bucket.select("bucket", (F.sum("w").over(Window.orderBy("bucket")) - F.col("w")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(F.when(F.col("bucket") < 0, -F.col("weight")), "h", "component").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(F.broadcast(before), "bucket").withColumn("start", F.col("before") + F.sum("weight").over(inside) - F.col("weight"))
    first, share = proportions[0]
    edge = placed.where(F.col("start") < F.col("total") * share).agg(F.max(F.col("start") + F.col("weight")).alias("edge"))
    out = placed.crossJoin(F.broadcast(edge))
    rest, acc = 1.0 - share, 0.0
    pick = F.when(F.col("start") < F.col("total") * share, F.lit(first))
    for name, part in proportions[1:-1]:
        acc += part
        pick = pick.when(F.col("start") < F.col("edge") + (F.col("total") - F.col("edge")) * (acc / rest), F.lit(name))
    return out.select("component", "weight", pick.otherwise(F.lit(proportions[-1][0])).alias("split"))


def grouped_splits(rows: DataFrame, cols: Sequence[str], id_col: str, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """Every row with a split such that no value of ``cols`` is shared between two.

    Null, blank and filler values relate nothing; a row without any value is a component of its own,
    keyed by ``id_col``. Rows are counted per first value before the components are joined, and the
    joins spread hot values and giant components, so that none meets in one task. Columns ``component`` and ``split`` are added;
    where the table has such already, ValueError is raised.
    """
    if clash := {"component", "split", "tm_vertex"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    labels = contract(relation_edges(rows, cols), scratch) if labels is None else labels
    labels, _ = scratch.cut(labels)
    first = F.coalesce(*[vertex(f"{i}:", F.col(c)) for i, c in enumerate(cols)], F.concat(F.lit("row:"), F.coalesce(F.col(id_col), F.lit(""))))
    keyed = rows.withColumn("tm_vertex", first)
    counts = keyed.groupBy("tm_vertex").agg(F.count(F.lit(1)).alias("n"))
    named = counts.join(labels.withColumnRenamed("id", "tm_vertex"), "tm_vertex", "left").withColumn("component", F.coalesce("root", "tm_vertex"))
    named, _ = scratch.cut(named.select("tm_vertex", "n", "component"))
    splits = assign_splits(named.groupBy("component").agg(F.sum("n").alias("weight")))
    by_vertex = spread_join(named, splits.select("component", "split"), "component").select("tm_vertex", "component", "split")
    return spread_join(keyed, by_vertex, "tm_vertex", hot=hot_values(named.select("tm_vertex", "n"), "tm_vertex", "n")).drop("tm_vertex")
