"""Connected components of a table of links by alternating large and small stars, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

MAX_ROUNDS = 60  # rounds grow with the logarithm of a component's size; beyond this an error is raised
SALTS = 32


def _with_least(links: DataFrame) -> DataFrame:
    """links (u, v, salt) with m, the least of each u's neighbours. A node's links are dealt over salts, so that none meets all of
    them in one task: the least of each part, then of all parts, goes back to the parts."""
    parts = links.groupBy("u", "salt").agg(F.min("v").alias("part"))
    whole = parts.groupBy("u").agg(F.min("part").alias("m"))
    return links.join(parts.select("u", "salt").join(whole, "u"), ["u", "salt"])


def _salted(links: DataFrame) -> DataFrame:
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _stars(links: DataFrame) -> DataFrame:
    """One round over links (u > v): every node's larger neighbours, then its smaller ones, move to its least neighbour."""
    both = _with_least(_salted(links.union(links.select("v", "u")).toDF("u", "v")))
    large = both.where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u > v").distinct()
    least = _with_least(_salted(large))
    # a node whose neighbour moved still keeps its own link to the least
    moved = least.select(F.explode(F.array(F.struct(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), "m"), F.struct("u", "m"))).alias("l"))
    return moved.select("l.u", F.col("l.m").alias("v")).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), both of one ordered type. Returns (node, root): the least node reachable, for all but the roots themselves.

    Each round is written to the shared folder. Nothing but a count and a checksum reaches the driver.
    """
    now = cut(links.toDF("u", "v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "links")
    mark = None
    for _ in range(MAX_ROUNDS):
        print_ = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if print_["n"] == 0 or (print_["n"], print_["s"]) == mark:
            return now.toDF("node", "root")
        mark = (print_["n"], print_["s"])
        now = cut(_stars(now), "links")
    raise RuntimeError("components: no fixed point within MAX_ROUNDS")
