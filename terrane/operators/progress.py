"""How many rows have passed, counted by the tasks that pass them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Callable[[], int]]:
    """df, and a function that gives its number of rows once an action on it has ended.

    Nothing is read twice for it: the count is taken where rows pass.
    """
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), lambda: seen.get["n"]
