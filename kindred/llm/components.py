"""Connected components of an edge table by alternating star contractions.

Each round links every node's larger neighbours to its smallest neighbour (large star), then its smaller
neighbours and itself to the smallest (small star), until the edges are stars around each component's smallest
node; the number of rounds grows with the logarithm of a component's diameter. Minima are pre-aggregated before
the shuffle and the joins are split by AQE where a node has very many edges. Each round's edges are written to
the shared folder, so a lost executor costs at most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm import shared as S


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge table (a, b); root is the smallest node of the component.

    Loops and repeated edges do no harm; an empty table gives no rows.
    """
    now = S.stage_table(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = S.stage_table(small.where(F.col("u") != F.col("v")).distinct(), "star")
        S.drop_table(now)
        now = after
        new_state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new_state == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new_state
    raise RuntimeError("components did not settle")
