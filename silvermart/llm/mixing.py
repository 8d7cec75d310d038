"""Mixing sources to target weights with Pareto order sampling.

A source's target is reached in two steps. Every document is taken as many whole times as the
target holds the source whole; those copies are certain. What is left of the target is drawn: a
document's rank is its random odds divided by its inclusion odds, and documents are taken in the
order of rank until the rest of the target is met as closely as whole documents allow.

The order of a source is never sorted in one task. Ranks fall into `BINS` bins per source; sums
per bin, combined before they are shuffled, tell which bin the target ends in, and only the
documents of that bin are put in order.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from itertools import cycle

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from silvermart.llm.common import SPACE_CLASS, stored, uniform

# Fixed values of the mix: weights in the order of the sources, share of all words, most copies.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BINS = 1 << 14


def word_count(text: Column) -> Column:
    found = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS[1:]}+"))
    return found.cast("long")


def targets(
    sizes: dict[str | None, int],
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
) -> dict[str | None, float]:
    """Words to take from each source.

    Sources in code point order, NULL last, get `weights` in turn. A target stops at `most_copies`
    times its source; what is beyond is shared among the others by weight until none is above.
    Computed in fractions, so that it does not depend on the order of the sums.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, cycle(weights)))
    left = Fraction(share) * sum(sizes.values())
    result: dict[str | None, Fraction] = {}
    open_sources = list(order)
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        full = [s for s in open_sources if left * weight[s] / total >= most_copies * sizes[s]]
        if not full:
            result |= {s: left * weight[s] / total for s in open_sources}
            break
        for s in full:
            result[s] = Fraction(most_copies * sizes[s])
        left = max(Fraction(0), left - sum(result[s] for s in full))
        open_sources = [s for s in open_sources if s not in result]
    return {s: float(result[s]) for s in order}


def by_length(size: Column, usual: int = 400) -> Column:
    """A tilt for `mix`: 1 for a text of the usual length, towards 0 and 2 on either side."""
    return 2 * size / (size + usual)


def pareto_rank(draw: Column, inclusion: Column) -> Column:
    """Random odds divided by inclusion odds, folded into 0 to 1 without changing the order."""
    odds = (draw / (1 - draw)) * ((1 - inclusion) / inclusion)
    return odds / (1 + odds)


def _sized(rows: DataFrame, id_column: str, text_column: str, source_column: str, seed: int):
    """What the mix needs of every row: its source, its size and its random number."""
    text, doc = F.col(f"__row.`{text_column}`"), F.col(f"__row.`{id_column}`")
    return rows.withColumns(
        {
            "__source": F.col(f"__row.`{source_column}`"),
            "__size": word_count(text),
            "__draw": uniform(doc, F.coalesce(F.xxhash64(text), F.lit(0)), seed=seed),
        }
    )


def _ranked(sized: DataFrame, plan: DataFrame, lean, bins: int) -> DataFrame:
    """Adds the source's plan, the rank of each row and the bin it falls in."""
    # One row per source, the mix's configuration.
    planned = sized.join(F.broadcast(plan), F.col("__source").eqNullSafe(F.col("source_key")))
    chance = F.col("missing") / F.greatest(F.col("source_size"), F.lit(1))
    if lean is not None:
        chance = chance * lean(F.col("__size"))
    bounded = F.least(F.greatest(chance, F.lit(1e-9)), F.lit(1 - 1e-9))
    rank = pareto_rank(F.col("__draw"), bounded)
    return planned.withColumn("__rank", rank).withColumn(
        "__bin", F.least(F.floor(F.col("__rank") * bins), F.lit(bins - 1)).cast("int")
    )


def plan_mix(
    sized: DataFrame,
    weights: tuple[int, ...],
    share: float,
    most_copies: int,
    lean: Callable[[Column], Column] | None,
    bins: int,
) -> DataFrame:
    """One row per source: sizes, target, certain copies and the last rank that is still drawn."""
    spark = sized.sparkSession
    sums = {
        r["__source"]: r["words"]
        for r in sized.groupBy("__source").agg(F.sum("__size").alias("words")).collect()
    }
    wanted = targets(sums, weights, share, most_copies)
    plan = spark.createDataFrame(
        [(s, sums[s], t, int(t // sums[s]) if sums[s] else 0) for s, t in wanted.items()],
        "source_key string, source_size long, target double, certain int",
    ).withColumn("missing", F.col("target") - F.col("certain") * F.col("source_size"))

    # At most `bins` rows per source.
    drawn = _ranked(sized, plan, lean, bins).where("__size > 0 and missing > 0")
    upto = Window.partitionBy("source_key").orderBy("__bin")
    edges = (
        drawn.groupBy("source_key", "__bin")
        .agg(F.sum("__size").alias("words"), F.first("missing").alias("missing"))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where("before < missing")
        .groupBy("source_key")
        .agg(F.max_by(F.struct("__bin", "before"), "__bin").alias("edge"))
        .select(
            F.col("source_key").alias("edge_source"),
            F.col("edge.__bin").alias("edge_bin"),
            F.col("edge.before").alias("edge_before"),
        )
    )
    # Inside the last bin: whole documents while the middle of the next one is still below.
    in_order = Window.partitionBy("source_key").orderBy("__rank", "__size")
    upto_row = in_order.rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        drawn.join(
            F.broadcast(edges),
            F.col("source_key").eqNullSafe(F.col("edge_source"))
            & (F.col("__bin") == F.col("edge_bin")),
        )
        .withColumn("reached", F.col("edge_before") + F.sum("__size").over(upto_row))
        .groupBy("source_key")
        .agg(
            F.first("edge_bin").alias("last_bin"),
            F.max(
                F.when(
                    F.col("reached") - F.col("__size") / 2 < F.col("missing"), F.col("__rank")
                )
            ).alias("last_rank"),
        )
        .withColumnRenamed("source_key", "cut_source")
    )
    # As few rows as there are sources.
    return plan.join(
        F.broadcast(cuts), F.col("source_key").eqNullSafe(F.col("cut_source")), "left"
    ).drop("cut_source")


def mix(
    rows: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most_copies: int = MOST_COPIES,
    lean: Callable[[Column], Column] | None = None,
    seed: int = 7,
    bins: int = BINS,
) -> DataFrame:
    """`rows` with what each gives to the mix: size, source_size, target, copies, taken.

    The chance of a document is the share of its source that is still missing, tilted by `lean`,
    a positive weight computed from the size (by default nothing is tilted). The sources are the
    mix's configuration: their sizes, one number per source, are the only thing the driver holds.
    The rows themselves are not shuffled; what decides is a plan with one row per source.

    NULL or empty texts have size 0 and give nothing; rows without a source form the source NULL;
    repeated rows have equal ranks and are drawn alike; an empty table gives an empty result;
    columns of the added names are replaced, other columns stay, whatever their names.
    """
    added = ("size", "source_size", "target", "copies", "taken")
    names = [F.col(f"__row.`{c}`") for c in rows.columns if c not in added]
    # The row travels as one value, so that its names meet none of the plan's.
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row")
    sized = _sized(rows.select(whole), id_column, text_column, source_column, seed)
    inner = ["__source", "__size", "__draw"]
    plan = plan_mix(stored(sized.select(*inner)), weights, share, most_copies, lean, bins)
    last = F.coalesce(F.col("last_bin"), F.lit(-1))
    extra = (F.col("__bin") < last) | (
        (F.col("__bin") == last) & (F.col("__rank") <= F.coalesce("last_rank", F.lit(-1.0)))
    )
    drawn = (F.col("__size") > 0) & (F.col("missing") > 0) & extra
    copies = F.col("certain") + drawn.cast("int")
    return _ranked(sized, plan, lean, bins).select(
        *names,
        F.col("__size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("__size")).alias("taken"),
    )
