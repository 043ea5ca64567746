"""Ranks of rows within large groups, without a task that holds a group.

A group's rows lie in cells by the leading part of their order. Cells are counted, and each starts where those before it end: a
histogram, one small row for each cell. A cell of many rows is cut at bounds that a sample of its rows gives, and the pieces are
counted in the same way. Rows are sorted within a piece alone. Where the bounds fall decides how even the pieces are, never a rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchlens.functions.staging import stored

PIECE = 50_000
#: Sampled rows for each bound.
DRAWN = 4


def ranked(rows: DataFrame, keys: list[str], cell: list[str], order: list[Column], name: str = "rank", piece: int = PIECE) -> DataFrame:
    """rows with `name`, from 1 within keys by (cell, order). order must tell any two rows of a cell apart; keys may be null.

    The rows become a table first, as they are read several times.
    """
    rows = stored(rows, "ranked")
    place = [*keys, *cell]
    keyed = rows.withColumn("_o", F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)]))
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"))
    # at most one cell in `piece` rows is cut, so these are few: their bounds are broadcast
    large = sizes.where(F.col("_n") > piece).select(*[F.col(c).alias(f"_{c}") for c in place], F.ceil(F.col("_n") / piece).alias("_cuts"), F.col("_n").alias("_size"))
    same = [keyed[c].eqNullSafe(large[f"_{c}"]) for c in place]
    drawn = keyed.join(F.broadcast(large), same).where(F.pmod(F.xxhash64(*[c for c in keyed.columns if c != "_o"]), F.col("_size")) < F.col("_cuts") * DRAWN)
    bounds = drawn.groupBy(*[f"_{c}" for c in place]).agg(F.array_sort(F.collect_list("_o")).alias("_all"))
    bounds = bounds.select(*[f"_{c}" for c in place], F.filter("_all", lambda x, i: i % DRAWN == 0).alias("_bounds"))
    cut = keyed.join(F.broadcast(bounds), [keyed[c].eqNullSafe(bounds[f"_{c}"]) for c in place], "left")
    below = F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("_o"))), F.lit(0))
    cut = cut.select(*[keyed[c] for c in keyed.columns], F.when(F.col("_bounds").isNull(), 0).otherwise(below).alias("_piece"))
    counts = cut.groupBy(*place, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(*cell, "_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_{c}") for c in place], F.col("_piece").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy(*place, "_piece").orderBy("_o")))
    both = inside.join(starts, [*[inside[c].eqNullSafe(starts[f"_{c}"]) for c in place], inside["_piece"] == starts["_p"]])
    return both.select(*[inside[c] for c in rows.columns], (F.col("_start") + F.col("_at")).cast("int").alias(name))
