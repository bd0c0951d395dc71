"""Key-value tables of runs and environments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two (name, value) tables side by side with their state: only_left, only_right, same or different."""
    a = left.select("name", F.col("value").alias("left_value"), F.lit(True).alias("_a"))
    b = right.select("name", F.col("value").alias("right_value"), F.lit(True).alias("_b"))
    state = F.when(F.col("_a").isNull(), "only_right").when(F.col("_b").isNull(), "only_left").when(F.col("left_value") == F.col("right_value"), "same").otherwise("different")
    return a.join(b, "name", "full_outer").select("name", "left_value", "right_value", state.alias("state"))


def run_states(lines: DataFrame) -> DataFrame:
    """(run, line) log lines to run, last_epoch, best, state: done if a line says so, failed on an error, else running."""
    epoch = F.regexp_extract("line", r"epoch\s+(\d+)", 1)
    value = F.regexp_extract("line", r"(?:score|loss)=([0-9.]+)", 1)
    got = lines.select("run", F.when(epoch != "", epoch.cast("int")).alias("e"), F.when(value != "", value.cast("double")).alias("v"), F.col("line").rlike("finished").alias("d"), F.lower("line").rlike("error|traceback").alias("f"))
    out = got.groupBy("run").agg(F.max("e").alias("last_epoch"), F.max("v").alias("best"), F.bool_or("d").alias("_d"), F.bool_or("f").alias("_f"))
    return out.select("run", "last_epoch", "best", F.when(F.col("_d"), "done").when(F.col("_f"), "failed").otherwise("running").alias("state"))
