"""Finds where a crop's chain runs inside public tracks, by step lengths alone.

A chain's step lengths stay the same under any shift and rotation. Steps of the public tracks are quantised to cells of twice
the tolerance, so a step of the chain agrees with steps of two cells at most, and runs of ``grams`` cells are the keys of an
equi-join. As all steps of a chain must agree, one seed is enough: each chain takes the seed that is rarest among the public
runs, and what meets there is verified over the whole chain. Tracks aren't compared with chains that share no seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import norm
from tracelace.operators import audits, motion

XYZ = ("uz", "uy", "ux")


def needles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """dataset, chain_id, steps: the step lengths of each dataset's longest chain, of equal ones the least chain_id.

    Only edges between two of the nodes are links: a fork with one daughter that isn't among them goes on as a chain.
    """
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.select("dataset", F.col("node_id").alias(end)), ["dataset", end], "left_semi")
    chained = motion.chains(nodes, edges)
    longest = audits.longest_chain(chained)
    rows = motion.steps(chained).join(longest, ["dataset", "chain_id"], "left_semi")
    return rows.groupBy("dataset", "chain_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]).alias("steps"))


def with_power(found: DataFrame, tolerance: float, least: int = 12) -> DataFrame:
    """With n_nodes, spread (greatest less least step) and tested: at least ``least`` nodes, and a spread above two tolerances.

    A chain whose steps all lie in one band agrees with any slow track, so neither a hit nor a miss says anything.
    """
    spread = F.array_max("steps") - F.array_min("steps")
    return found.withColumns({"n_nodes": F.size("steps") + 1, "spread": spread, "tested": (F.size("steps") + 1 >= least) & (spread > 2.0 * tolerance)})


def runs(tracks: DataFrame, stride: int = 1) -> DataFrame:
    """track_id, t (of the first step), steps: unbroken series of steps over ``stride`` frames.

    ``tracks``: track_id, t, uz, uy, ux. Frames of one remainder by the stride make a series; a missing frame ends it. Of
    rows with equal track and frame the least by place counts; rows without a track or a frame aren't taken.
    """
    one = tracks.filter("track_id is not null and t is not null").groupBy("track_id", "t").agg(F.min(F.struct(*XYZ)).alias("_p")).select("track_id", "t", "_p.*")
    own = one.withColumn("_k", F.pmod("t", F.lit(stride)))
    w = W.partitionBy("track_id", "_k").orderBy("t")
    steps = own.withColumns({f"_{a}": F.lead(a).over(w) - F.col(a) for a in XYZ} | {"_dt": F.lead("t").over(w) - F.col("t")}).filter(F.col("_dt") == stride)
    island = F.floor(F.col("t") / stride) - F.row_number().over(w)
    cut = steps.select("track_id", "_k", "t", norm(F.col("_uz"), F.col("_uy"), F.col("_ux")).alias("step"), island.alias("_i"))
    got = cut.groupBy("track_id", "_k", "_i").agg(F.sort_array(F.collect_list(F.struct("t", "step"))).alias("_s"))
    return got.select("track_id", F.col("_s")[0]["t"].alias("t"), F.transform("_s", lambda x: x["step"]).alias("steps"))


def _products(options: Column) -> Column:
    """All ways to take one of each inner array, as strings joined by commas."""
    join = lambda so_far, cells: F.flatten(F.transform(so_far, lambda s: F.transform(cells, lambda c: F.concat(s, F.lit(","), c.cast("string")))))
    return F.aggregate(options, F.array(F.lit("")), join)


def placed(found: DataFrame, public: DataFrame, tolerance: float = 1.5, grams: int = 4, stride: int = 1) -> DataFrame:
    """dataset, track_id, t: every place where a public run agrees with all of a chain's steps within the tolerance, inclusive.

    ``found``: dataset, steps, a row a dataset; a chain of fewer steps than ``grams`` can't be sought and gives no rows, as
    does one without steps. ``public``: rows of ``runs``, whose ``t`` grows by ``stride`` a step.
    """
    width, reach = 2.0 * tolerance, tolerance * (1 + 1e-9)
    at = lambda n: F.explode(F.sequence(F.lit(0), n - grams))
    long_enough = F.size("steps") >= grams
    sought = found.select("dataset", "steps").filter(long_enough)
    cells = lambda s: F.sequence(F.floor((s - reach) / width), F.floor((s + reach) / width))
    seeds = sought.select("dataset", F.transform("steps", cells).alias("_c"), at(F.size("steps")).alias("_p"))
    seeds = seeds.select("dataset", "_p", F.explode(_products(F.slice("_c", F.col("_p") + 1, grams))).alias("_key"))

    named = public.filter(long_enough).select("track_id", "t", F.transform("steps", lambda s: F.floor(s / width).cast("string")).alias("_c"), at(F.size("steps")).alias("_q"))
    keys = named.select("track_id", "t", "_q", F.concat(F.lit(","), F.array_join(F.slice("_c", F.col("_q") + 1, grams), ",")).alias("_key"))
    wanted = seeds.select("_key").distinct()
    common = keys.join(wanted, "_key", "left_semi").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    cost = seeds.join(common, "_key", "left").groupBy("dataset", "_p").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    rarest = cost.groupBy("dataset").agg(F.min(F.struct("_n", "_p")).alias("_m")).filter("_m._n > 0").select("dataset", F.col("_m._p").alias("_p"))

    meet = seeds.join(rarest, ["dataset", "_p"]).join(keys, "_key").filter("_q >= _p").select("dataset", "track_id", "t", (F.col("_q") - F.col("_p")).alias("_start"))
    both = meet.join(public.select("track_id", "t", F.col("steps").alias("_run")), ["track_id", "t"]).join(sought, "dataset")
    whole = both.filter(F.col("_start") + F.size("steps") <= F.size("_run"))
    fits = F.forall(F.zip_with(F.slice("_run", F.col("_start") + 1, F.size("steps")), "steps", lambda a, b: F.abs(a - b) <= tolerance), lambda x: x)
    return whole.filter(fits).select("dataset", "track_id", (F.col("t") + F.col("_start") * stride).alias("t"))
