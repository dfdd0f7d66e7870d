"""Arrow UDFs that are made when they are first used, so modules can be imported without a session (as workers do)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(fn: Callable, kind: str, fields: tuple[str, ...] = ()) -> Callable[..., Column]:
    """A column function that applies fn to each value; for a struct type (of `fields`) fn gives dicts or None."""
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([fn(v) for v in x], dtype=object)

    def run_struct(x: pd.Series) -> pd.DataFrame:
        rows = [fn(v) or {} for v in x]
        return pd.DataFrame({k: [r.get(k) for r in rows] for k in fields}, dtype=object)

    made: list = []

    def column(c: Column | str) -> Column:
        if not made:
            made.append(F.pandas_udf(run_struct if fields else run, kind))
        return made[0](c)

    return column
