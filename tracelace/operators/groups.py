"""Groups that Python works on, spread over the cluster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def spread(*keys: str) -> Callable[[DataFrame], DataFrame]:
    """Deals rows by the keys to four times the shuffle partitions; a number that is named isn't lowered at run time.

    Spark joins small partitions by their bytes, but groups whose work is Python's take long though their bytes are few.
    """

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

    return deal
