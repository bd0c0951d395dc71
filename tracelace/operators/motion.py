"""Chains and their motion: steps, turns, mean squared displacement, drift."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import cosine, norm
from tracelace.operators.components import components
from tracelace.storage import written

XYZ = ("uz", "uy", "ux")
#: Frames of a block in which a task follows chains.
BLOCK = 32


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Maximal runs of one-in, one-out links to the next frame, longer than one node: dataset, chain_id, pos, node_id, t and place.

    A chain is followed within blocks of ``BLOCK`` frames, each in a task; only the runs that cross a block's border are
    joined in rounds. Its nodes are in consecutive frames, so a node's position is its frame less the chain's first.
    """
    ends = ["dataset", "node_id"]
    ahead = edges.groupBy("dataset", F.col("source_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("target_id").alias("_next")).filter("_n = 1").drop("_n")
    back = edges.groupBy("dataset", F.col("target_id").alias("node_id")).agg(F.count(F.lit(1)).alias("_n"), F.min("source_id").alias("_prev")).filter("_n = 1").drop("_n")
    at = nodes.select("dataset", "node_id", "t", *XYZ).filter("t is not null").join(ahead, ends, "left").join(back, ends, "left").filter("_next is not null or _prev is not null")
    own = F.floor(F.col("t") / BLOCK)
    # a block also gets the next one's first frame
    dealt = at.withColumn("_block", F.explode(F.when(F.col("t") % BLOCK == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    kinds = dict(at.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("dataset", "node_id", "t", *XYZ)) + f", _head {kinds['node_id']}, _start {kinds['t']}, _least {kinds['node_id']}, _many boolean, _border boolean"
    rows = written(dealt.groupBy("dataset", "_block").applyInArrow(_followed, schema), "chain-blocks")
    crossing = components(rows.filter("_border").select("dataset", F.col("_head").alias("_a"), F.col("node_id").alias("_b")), "_a", "_b", ("dataset",)).withColumnRenamed("node", "_head")
    heads = rows.filter("not _border and node_id = _head").select("dataset", "_head", "_least", "_start").join(crossing, ["dataset", "_head"])
    whole = heads.groupBy("dataset", "root").agg(F.min("_least").alias("_id"), F.min("_start").alias("_first"))
    named = written(crossing.join(whole, ["dataset", "root"]).drop("root"), "chain-names")
    out = rows.filter("not _border").join(named, ["dataset", "_head"], "left").filter("_many or _id is not null")
    return out.select("dataset", F.coalesce("_id", "_least").alias("chain_id"), (F.col("t") - F.coalesce("_first", "_start")).alias("pos"), "node_id", "t", *XYZ)


def _followed(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """The nodes of a block with their run's head, its frame, its least id and whether it has others; a node of the next
    block's first frame (``_border``) only where a link leads to it."""
    ids, t = block.column("node_id").to_numpy(), block.column("t").to_numpy()
    (nxt, leads), (prev, follows) = ((c.fill_null(0).to_numpy(), c.is_valid().to_numpy()) for c in (block.column("_next"), block.column("_prev")))
    order = np.argsort(ids)
    at = order[np.minimum(np.searchsorted(ids, prev, sorter=order), len(ids) - 1)]
    linked = follows & (ids[at] == prev) & leads[at] & (nxt[at] == ids) & (t - t[at] == 1)
    head = np.where(linked, at, np.arange(len(ids)))
    while not (head[head] == head).all():
        head = head[head]
    least = ids.copy()
    np.minimum.at(least, head, ids)
    border = t // BLOCK != key[1].as_py()
    many = np.bincount(head, minlength=len(ids)) > 1
    out = block.select(["dataset", "node_id", "t", *XYZ])
    for name, column in (("_head", ids[head]), ("_start", t[head]), ("_least", least[head]), ("_many", many[head]), ("_border", border)):
        out = out.append_column(name, pa.array(column))
    return out.filter(pa.array(~border | linked))


def _along() -> W:
    return W.partitionBy("dataset", "chain_id").orderBy("pos")


def steps(chained: DataFrame) -> DataFrame:
    """A row for each step of a chain: from pos to pos + 1, its parts vz, vy, vx and its length."""
    ahead = chained.withColumns({f"v{a[1]}": F.lead(a).over(_along()) - F.col(a) for a in XYZ}).filter("vz is not null")
    return ahead.withColumn("step", norm(F.col("vz"), F.col("vy"), F.col("vx")))


def turns(stepped: DataFrame) -> DataFrame:
    """A row for each two steps in a row: the cosine between them (those without length are left out) and the first's length."""
    nxt = {f"_n{a}": F.lead(f"v{a}").over(_along()) for a in "zyx"}
    j = stepped.withColumns(nxt).filter("_nz is not null")
    c = cosine(tuple(F.col(f"v{a}") for a in "zyx"), tuple(F.col(f"_n{a}") for a in "zyx"))
    return j.withColumn("cosine", c).filter("cosine is not null").select("dataset", "chain_id", "pos", "step", "cosine")


def msd(chained: DataFrame, lags: int) -> DataFrame:
    """lag, n and mean squared displacement over all places of all chains, in one pass for all lags."""
    away = lambda k, a: F.lead(a, k).over(_along()) - F.col(a)
    sq = [sum((away(k, a) * away(k, a) for a in XYZ[1:]), away(k, "uz") * away(k, "uz")).alias(f"_s{k}") for k in range(1, lags + 1)]
    one = chained.select(*sq).agg(*[F.struct(F.count(f"_s{k}").alias("n"), F.avg(f"_s{k}").alias("msd"), F.lit(k).alias("lag")).alias(f"_s{k}") for k in range(1, lags + 1)])
    return one.select(F.inline(F.array(*[f"_s{k}" for k in range(1, lags + 1)])))


def msd_exponent(curve: DataFrame) -> DataFrame:
    """The slope of ln msd over ln lag from lag 2 on, null with fewer than three lags."""
    c = curve.filter("lag >= 2 and msd > 0")
    return c.agg(F.count(F.lit(1)).alias("n_lags"), F.regr_slope(F.ln("msd"), F.ln("lag")).alias("_s")).select("n_lags", F.when(F.col("n_lags") >= 3, F.col("_s")).alias("exponent"))


def furth_fit(curve: list[tuple[int, float]], rounds: int = 200) -> tuple[float, float, float]:
    """Speed, persistence time and noise of msd = 2 s² P (t - P (1 - exp(-t / P))) + noise by damped Gauss-Newton; runs on the curve's few rows."""
    t = np.array([a for a, _ in curve], float)
    y = np.array([b for _, b in curve], float)

    def model(q):
        s2, tau, noise = np.exp(q)
        return 2 * s2 * tau * (t - tau * (1 - np.exp(-t / tau))) + noise

    def descend(q):
        lam = 1e-2
        for _ in range(rounds):
            r = y - model(q)
            jac = np.stack([(model(q + 1e-5 * e) - model(q - 1e-5 * e)) / 2e-5 for e in np.eye(3)], axis=1)
            step = np.clip(np.linalg.solve(jac.T @ jac + lam * np.diag(np.diag(jac.T @ jac) + 1e-12), jac.T @ r), -1, 1)
            if ((y - model(q + step)) ** 2).sum() < (r**2).sum():
                q, lam = q + step, max(lam / 3, 1e-12)
            else:
                lam *= 3
            if np.abs(step).max() < 1e-10:
                break
        return float(((y - model(q)) ** 2).sum()), q

    # from several persistence times and shares of noise, as the sum of squares has more than one valley
    starts = [np.log(np.maximum([y[0], tau, share * y[0]], 1e-6)) for tau in (0.3, 1.0, 3.0, 10.0) for share in (0.01, 0.1, 0.5)]
    _, q = min((descend(x) for x in starts), key=lambda x: x[0])
    s2, tau, noise = np.exp(q)
    return float(np.sqrt(s2)), float(tau), float(noise)


def drift_share(stepped: DataFrame, least: int = 3) -> DataFrame:
    """By dataset and frame with ``least`` steps: length of the mean step over the mean length."""
    g = stepped.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{a}").alias(f"m{a}") for a in "zyx"], F.avg("step").alias("mean_step")).filter(F.col("n") >= least)
    return g.withColumn("share", F.try_divide(norm(F.col("mz"), F.col("my"), F.col("mx")), F.col("mean_step")))


def comoving(chained: DataFrame, stepped: DataFrame) -> DataFrame:
    """Chains with the running sum of the frames' mean steps taken off."""
    mean = stepped.groupBy("dataset", "t").agg(*[F.avg(f"v{a}").alias(f"_m{a}") for a in "zyx"])
    before = W.partitionBy("dataset").orderBy("t").rowsBetween(W.unboundedPreceding, -1)
    frames = chained.select("dataset", "t").distinct().join(mean, ["dataset", "t"], "left").fillna(0.0)
    off = frames.select("dataset", "t", *[F.coalesce(F.sum(f"_m{a}").over(before), F.lit(0.0)).alias(f"_o{a}") for a in "zyx"])
    return chained.join(off, ["dataset", "t"]).withColumns({f"u{a}": F.col(f"u{a}") - F.col(f"_o{a}") for a in "zyx"}).drop("_oz", "_oy", "_ox")


def banded(value: Column, edges: tuple[float, ...]) -> Column:
    """The number of edges at or below the value: which half-open band it is in."""
    return sum((F.when(value >= e, 1).otherwise(0) for e in edges[1:]), F.when(value >= edges[0], 1).otherwise(0))


def displacement_votes(pairs: DataFrame, width: float) -> DataFrame:
    """Candidate displacements counted by whole bins: dataset, t, bz, by, bx, n; columns dz, dy, dx are needed."""
    bins = [F.floor(F.col(f"d{a}") / width + 0.5).cast("int").alias(f"b{a}") for a in "zyx"]
    return pairs.select("dataset", "t", *bins).groupBy("dataset", "t", "bz", "by", "bx").agg(F.count(F.lit(1)).alias("n"))


def drift_peak(votes: DataFrame, width: float) -> DataFrame:
    """The commonest displacement of each gap (equal counts to the lowest bin) and its sharpness, its share of the votes."""
    top = votes.groupBy("dataset", "t").agg(F.max(F.struct("n", (-F.col("bz")).alias("z"), (-F.col("by")).alias("y"), (-F.col("bx")).alias("x"))).alias("m"), F.sum("n").alias("total"))
    return top.select("dataset", "t", *[(-F.col(f"m.{a}") * width).alias(f"v{a}") for a in "zyx"], (F.col("m.n") / F.col("total")).alias("sharpness"))


def walk_back(nodes: DataFrame, edges: DataFrame, most: int = 3) -> DataFrame:
    """dataset, node_id, span and vz, vy, vx: the mean velocity over up to ``most`` steps back, as long as a node has one predecessor; 0 without one."""
    single = edges.groupBy("dataset", F.col("target_id").alias("_at")).agg(F.min("source_id").alias("_prev"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").drop("_n")
    at = nodes.select("dataset", F.col("node_id").alias("_at"), F.col("t").alias("_t"), *[F.col(f"u{a}").alias(f"_u{a}") for a in "zyx"])
    out = nodes.select("dataset", "node_id", "t", "uz", "uy", "ux", F.col("node_id").alias("_at"))
    for _ in range(most):
        out = out.join(single, ["dataset", "_at"], "left").withColumn("_at", F.coalesce("_prev", "_at")).drop("_prev")
    span = F.col("t") - F.col("_t")
    mean = lambda a: F.when(span > 0, (F.col(f"u{a}") - F.col(f"_u{a}")) / span).otherwise(F.lit(0.0))
    return out.join(at, ["dataset", "_at"]).select("dataset", "node_id", span.alias("span"), *[mean(a).alias(f"v{a}") for a in "zyx"])
