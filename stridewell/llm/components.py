"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridewell.llm.common import Scratch


#: A node is a hub if it has more than this part of all ends (so there are fewer
#: hubs than this), and no fewer than so many.
HUBS, LEAST_HUB = 256, 2000


def _large_star(edges: DataFrame, ends: int) -> DataFrame:
    """``ends``: twice the number of edges.  Hubs meet their edges by a
    broadcast of fewer than HUBS rows, so that no task gets a hub's edges."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    low = low.select("u", F.least("u", "m").alias("m"), "n")
    up = both.where(F.col("v") > F.col("u"))
    many = max(LEAST_HUB, ends // HUBS)
    if ends <= many:
        met = up.join(low, "u")
    else:
        hubs = F.broadcast(low.where(F.col("n") > many).select("u", F.col("m").alias("hub")))
        named = up.join(hubs, "u", "left")
        rest = named.where("hub is null").select("u", "v").join(low.where(F.col("n") <= many), "u")
        met = rest.select("u", "v", "m").union(named.where("hub is not null").select("u", "v", F.col("hub").alias("m")))
    return met.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    # The row of the least neighbour itself, of which no edge comes, stands for
    # the edge from u.
    end = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return down.join(low, "u").select(end.alias("u"), F.col("m").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("large"), F.lit(0).alias("small")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("large"), F.lit(1).alias("small")),
    )).alias("e")).select("e.*")
    uses = ends.groupBy("node").agg(F.sum("large").alias("large"), F.max("small").alias("small"))
    return uses.where("large > 1 or (large = 1 and small = 1)").isEmpty()


def components(scratch: Scratch, edges: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, comp) for every node with an edge; comp is the smallest node
    reachable.  ``edges`` has longs u and v; null ends, loops and repeats are
    ignored; no edges give no rows.

    A step is two aggregations (combined before the shuffle, so a hub costs a
    row per task) and two equi-joins, from which hubs are left out.  Each
    round is written to the shared folder.  It ends when what is left is stars:
    every larger end once, and none that is a smaller end too.  As u > v, the
    centre is then the smallest of its component.  Repeated edges are no stars;
    a round makes them one.  Raises if ``most`` rounds
    (far above the logarithmic bound) do not settle it.
    """
    now = scratch.table(
        edges.where("u is not null and v is not null and u <> v").select(
            F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")
        ),
        f"{name}-0",
    )
    for k in range(1, most + 1):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                now.select(F.col("v"), F.col("v")).distinct()
            )
        now = scratch.table(_small_star(_large_star(now, 2 * now.count())), f"{name}-{k}")
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
    raise RuntimeError(f"components did not settle in {most} rounds")
