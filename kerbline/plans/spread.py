"""Rows dealt to tasks by key, in numbers that one task can hold at any size of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task groups and sorts at a time.
TASK_ROWS = 500_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """The rows of a key in one partition, in so many partitions that one holds about ``TASK_ROWS`` rows; small tables are left to AQE.

    What groups, windows or joins by these keys (and more) needs no other shuffle of ``df``.  ``rows``: how many there are, roughly;
    if not given they are counted, which for a table that is only projected reads its files' footers.
    """
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*keys)
