"""Connected components of a graph whose links may not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvermart.llm.common import Scratch


def _toward_least(links: DataFrame, smaller_only: bool) -> DataFrame:
    """One star step: the neighbours of a node are linked to the least of them instead.

    The step for larger neighbours moves those above the node, the other one those below and the
    node itself. Least neighbours come from a grouped minimum, so no list of neighbours is built.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    seen = both.where("v < u") if smaller_only else both
    least = seen.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    moved = (seen if smaller_only else both.where("v > u")).join(least, "u")
    found = moved.select(F.col("m").alias("a"), F.col("v").alias("b"))
    if smaller_only:
        found = found.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return found.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    ).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, least) for every node of the links (a, b) but the least of its component itself.

    Star steps in turn until the links no longer change; each round is stored, so what follows a
    lost executor starts from the last round.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = scratch.store(f"{name}-0", links.where("a <> b").distinct())
    before, turn = None, 0
    while True:
        mark = links.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if mark == before or not mark["n"]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("least"))
        before, turn = mark, turn + 1
        links = scratch.store(
            f"{name}-{turn}", _toward_least(_toward_least(links, False), True)
        )
        scratch.discard(f"{name}-{turn - 1}")
