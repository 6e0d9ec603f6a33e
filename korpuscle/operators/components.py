"""Connected components of a graph given as links, by alternating large and small stars.

Each round joins a node's neighbours to the least of them (large star: the greater ones,
small star: the lesser ones and itself) until nothing changes; the depth of every
component shrinks by half or more in a round. Rounds are written to the checkpoint folder.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the checkpoint folder that the cluster names and cut its lineage.

    The folder comes from ``spark.checkpoint.dir``; a temporary one is set only where the
    session names none and runs on one machine, as in tests.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="korpuscle-checkpoint-"))
    return df.checkpoint(eager=True)


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b), root being the least node it reaches.

    Links to itself, repeated links and both directions are fine; null ends are dropped.
    """
    now = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        now = cut(small.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        size = now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = tuple(size)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
