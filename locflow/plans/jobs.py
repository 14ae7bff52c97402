"""The plans of all jobs of a query, also of those that write the tables it stages while it is built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

WRITES = ("parquet", "text", "json", "save")


def all_plans(query: Callable[[], DataFrame]) -> tuple[DataFrame, list[str]]:
    """The query's DataFrame, and the physical plans of every written table and of the query itself, in order.

    For tests and summaries: while the query is built, writers note the plan
    of what they write.
    """
    plans: list[str] = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    kept = {name: getattr(DataFrameWriter, name) for name in WRITES}

    def noting(write):
        def noted(self, *args, **kwargs):
            plans.append(plan(self._df))
            return write(self, *args, **kwargs)
        return noted

    try:
        for name, write in kept.items():
            setattr(DataFrameWriter, name, noting(write))
        df = query()
    finally:
        for name, write in kept.items():
            setattr(DataFrameWriter, name, write)
    return df, [*plans, plan(df)]
