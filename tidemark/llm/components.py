"""Connected components by alternating stars: a logarithmic number of rounds, each a few joins on one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


def _least(edges: DataFrame) -> DataFrame:
    """(u, v, m) for each (u, v): m is the least of u and its neighbours.

    Pre-aggregated; grouped by a struct, so that the join deals both sides anew and Spark may split a hub's rows.
    """
    least = edges.groupBy(F.struct("u").alias("at")).agg(F.min("v").alias("w")).select("at.u", "w")
    return edges.hint("merge").join(least, "u").withColumn("m", F.least("u", "w")).drop("w")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, component) of every id in the edges; component is the least id that it reaches.

    Loops and repeated edges are allowed, rows with a null end count for nothing, no edges give no rows.
    """
    tmp = Scratch(edges.sparkSession, "cc")
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null")
    e = tmp.write(e.distinct(), "edges")
    loops = e.where("u = v").select("u")
    e = e.where("u <> v")
    for at in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = tmp.write(large, f"large{at}")
        m = _least(large)
        small = m.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = tmp.write(small, f"small{at}")
        tmp.drop(f"large{at}", *([f"small{at - 1}"] if at else []))
        # stars: every u once, and no centre v is a u
        clash = e.groupBy("u").agg(F.count("*").alias("n")).join(e.select(F.col("v").alias("u")).distinct().withColumn("bad", F.lit(1)), "u", "left").where("n > 1 or bad = 1")
        if not clash.limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    found = tmp.write(stars.unionByName(roots).unionByName(alone).groupBy("id").agg(F.min("component").alias("component")), "components")
    tmp.drop("edges", f"small{at}")
    return found
