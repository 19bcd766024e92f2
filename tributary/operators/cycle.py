"""Backflow cycles: a step applied until rows have converged, with a cap on rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import KIND, MESSAGE, Lanes, marked
from ..storage import materialise

MAX_ITERATIONS = 30


def iterate(df: DataFrame, step: Callable[[DataFrame], DataFrame], done: Column | str, max_iterations: int = MAX_ITERATIONS) -> Lanes:
    """Rows leave when `done` holds; the others enter the next round. Adds _cycle_depth.

    What has not converged after max_iterations is marked Unknown and goes to the error lane. Each round is
    written once, so the plan does not grow with the number of rounds.
    """
    test = F.coalesce(F.expr(done) if isinstance(done, str) else done, F.lit(False))
    todo, out = df.withColumn("_cycle_depth", F.lit(0)), None
    for depth in range(max_iterations + 1):
        todo = materialise(todo, f"cycle{depth}")
        left = todo.filter(test)
        out = left if out is None else out.unionByName(left)
        todo = todo.filter(~test)
        if todo.isEmpty():
            return Lanes(marked(out), marked(todo))
        if depth < max_iterations:
            todo = step(todo.drop("_cycle_depth")).withColumn("_cycle_depth", F.lit(depth + 1))
    stuck = todo.withColumn(KIND, F.lit("Unknown")).withColumn(MESSAGE, F.lit(f"more than {max_iterations} iterations"))
    return Lanes(marked(out), stuck)
