"""Connected components of links between numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import Scratch

ROUNDS = 60  # far above what the alternation needs for any graph that fits a cluster


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root (its component's smallest node) for every node of links(a long, b long).

    Large-star and small-star steps alternate (Kiveris et al. 2014) until the links no longer change. Each
    round's links are written to the shared folder, so lineage stays short and a lost executor costs one
    round at most. Links of a node to itself are dropped; no links give no rows.
    """
    state = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = scratch.keep(state, "links-0")
    seen = None
    for turn in range(1, ROUNDS):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        state = scratch.keep(small, f"links-{turn}")
        scratch.drop(f"links-{turn - 1}")
        mark = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max("u")).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
