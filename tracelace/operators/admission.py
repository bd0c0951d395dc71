"""Greedy admission in rounds: what a pass over proposals in a fixed order would take, without such a pass.

A proposal uses places (a parent, a child, a frame) that hold so many. A sequential pass takes it if all its places have
room when its turn comes. The same set comes from rounds: a proposal is taken as soon as it is among the first so many open
ones at each of its places as there is room, for then nothing before it can fill them; one whose place is full is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.storage import scratch, written

#: A place by its columns, and how many proposals it holds: a number or a column of the proposals.
Place = tuple[tuple[str, ...], Column | int]


def admit(proposals: DataFrame, order: Sequence[str | Column], places: Sequence[Place]) -> DataFrame:
    """The rows of ``proposals`` that a pass in ``order`` takes.

    ``order`` should tell rows apart; rows that it doesn't are taken in any order. A round takes the first open proposal of
    every connected group at least, and most of the open ones on usual inputs; its open rows are written, and those of the
    round before go. No group is gathered: a place's proposals are ranked by a window.
    """
    columns = proposals.columns
    left = [f"_left{i}" for i in range(len(places))]
    with scratch(proposals.sparkSession) as keep:
        rooms = {name: (F.lit(room) if isinstance(room, int) else room).cast("long") for name, (_, room) in zip(left, places, strict=True)}
        open_rows = keep(proposals.withColumns(rooms).withColumn("_id", F.monotonically_increasing_id()), "0")
        taken, number = [], 0
        room = reduce(Column.__and__, [F.col(name) > 0 for name in left])
        while True:
            number += 1
            ranked = open_rows.filter(room)
            for i, (place, _) in enumerate(places):
                ranked = ranked.withColumn(f"_rank{i}", F.row_number().over(W.partitionBy(*place).orderBy(*order, "_id")))
            ranked = ranked.withColumn("_take", reduce(Column.__and__, [F.col(f"_rank{i}") <= F.col(name) for i, name in enumerate(left)]))
            for name, (place, _) in zip(left, places, strict=True):
                ranked = ranked.withColumn(name, F.col(name) - F.sum(F.col("_take").cast("int")).over(W.partitionBy(*place)))
            decided = keep(ranked.select(*columns, *left, "_id", "_take"), str(number))
            taken.append(decided.filter("_take").select(*columns))
            open_rows = decided.filter(~F.col("_take")).drop("_take")
            if open_rows.filter(room).isEmpty():
                break
        return written(reduce(DataFrame.union, taken), "admitted")
