"""Column expressions that are built once for each set of options.

Building some thousand expressions from Python takes seconds, and they don't depend on the data: they name columns only.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Step = dict[str, Column]


def built_once(build: Callable[..., list[Step]]) -> Callable[..., list[Step]]:
    """build(*options) -> steps, kept for as long as the same gateway to a JVM is in use; without one (a remote session) built each time."""
    held: dict[tuple, list[Step]] = {}

    @functools.wraps(build)
    def found(*options: object) -> list[Step]:
        if SparkContext._gateway is None:
            return build(*options)
        if any(k[0] is not SparkContext._gateway for k in held):  # columns of a JVM that is gone
            held.clear()
        key = (SparkContext._gateway, *options)  # held, so that no other gateway can take its place
        if key not in held:
            held[key] = build(*options)
        return held[key]

    return found


def once(column: Column) -> Column:
    """column, worked out once for each row.

    Spark copies an expression that is read once into the step that reads it, also where that step reads it for each item of an
    array. One that counts as nondeterministic is never copied; the condition always holds.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def applied(df: DataFrame, steps: list[Step]) -> DataFrame:
    """df with the columns of each step, one step after the other."""
    for step in steps:
        df = df.withColumns(step)
    return df
