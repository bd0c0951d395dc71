"""Recovery after linking: gaps of one and of two frames, cytokinesis, and the chain of output filters with its counters.

Proposals are gated joins; what a pass over them would admit comes from rounds (``admission``), and one-to-one choices of a
frame from its connected pieces (``assign``). No stage gathers a dataset.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.functions.geometry import AXES, Spacing, norm, to_um
from tracelace.operators import assign, forks, joins, placing, repair, stages
from tracelace.operators.admission import admit
from tracelace.storage import written

XYZ = ("uz", "uy", "ux")


@dataclass(frozen=True)
class GapClose:
    """Gaps of one frame. A step's gate is ``base``, moved by the local spacing of points against ``reference``."""

    base: float = 6.0
    adaptive: bool = True
    reference: float = 6.5
    gain: float = 0.04
    most_delta: float = 0.125
    neighbours: int = 3
    reuse: float = 3.2
    most_share: float = 0.05
    most_added: int = 2000
    #: Bridges through a new point of this length and more need a confirmed centre within ``confirm`` of it, if centres are given.
    confirm_span: float = 9.0
    confirm: float = 3.2


@dataclass(frozen=True)
class StrictGap:
    """Gaps of two frames that the motion on one side at least bears out."""

    most_total: float = 10.2
    most_step: float = 4.4
    need_context: bool = True
    least_cosine: float = -0.25
    most_change: float = 6.0
    most_share: float = 0.0045
    most_links: int = 180
    frame_share: float = 0.006


@dataclass(frozen=True)
class Cytokinesis:
    """Gates of a parent with its daughters; borders in voxels of y and x."""

    least_nodes: int = 0
    parent_gate: float = 8.5
    least_sister: float = 8.5
    most_sister: float = 13.5
    border: tuple[float, float] = (20.0, 236.0)
    least_track: int = 12
    least_divergence: float = 1.2
    least_angle: float = 140.0


def local_spacing(nodes: DataFrame, k: int, alone: float) -> DataFrame:
    """dataset, node_id, local: the median distance to the ``k`` nearest others of the frame; ``alone`` without any."""
    near = joins.k_nearest(nodes, k).groupBy("dataset", "node_id").agg(F.sort_array(F.collect_list("d")).alias("_d"))
    middle = (F.get("_d", F.floor((F.size("_d") - 1) / 2).cast("int")) + F.get("_d", F.floor(F.size("_d") / 2).cast("int"))) / 2
    return nodes.select("dataset", "node_id").join(near, ["dataset", "node_id"], "left").select("dataset", "node_id", F.coalesce(middle, F.lit(float(alone))).alias("local"))


def gap_proposals(nodes: DataFrame, edges: DataFrame, knobs: GapClose = GapClose()) -> DataFrame:
    """Ends and the starts two frames on: dataset, t, end_id, start_id, d, gate, in_base and allowed.

    ``gate`` is 2 (base + step) with step = gain (local - reference), held to ``most_delta`` both ways; local is the mean of
    both ends' spacings. All pairs within the widest gate that a step can give are there, so those that it shut out, too.
    """
    slim = nodes.select("dataset", "node_id", "t", *XYZ)
    ends, starts = joins.ends_and_starts(slim, edges)
    local = written(local_spacing(slim, knobs.neighbours, knobs.reference), "local-spacing") if knobs.adaptive else slim.select("dataset", "node_id", F.lit(knobs.reference).alias("local"))
    pairs = joins.gated(ends.join(local, ["dataset", "node_id"]), starts.join(local, ["dataset", "node_id"]), 2 * (knobs.base + knobs.most_delta), 2)
    step = knobs.gain * (0.5 * (F.col("a_local") + F.col("b_local")) - knobs.reference)
    held = F.greatest(F.lit(-knobs.most_delta), F.least(F.lit(knobs.most_delta), step))
    rows = pairs.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("end_id"), F.col("b_node_id").alias("start_id"), "d", (2 * knobs.base + 2 * held).alias("gate"))
    return rows.withColumn("in_base", F.col("d") <= 2 * knobs.base).withColumn("allowed", F.col("d") <= F.col("gate"))


def _at(nodes: DataFrame, key: str, prefix: str, *more: str) -> DataFrame:
    return nodes.select("dataset", F.col("node_id").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in (*XYZ, *AXES, *more)])


def _share(n: Column, share: float, most: int) -> Column:
    """One at least, ``most`` at most, else the share, half to even."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.bround(n * share).cast("int")))


def _edges(rows: DataFrame, pairs: list[tuple[Column, Column]]) -> DataFrame:
    made = rows.select("dataset", F.explode(F.array(*[F.struct(a.alias("s"), b.alias("e")) for a, b in pairs])).alias("_l"))
    return made.select("dataset", F.col("_l.s").cast("long").alias("source_id"), F.col("_l.e").cast("long").alias("target_id")).withColumn("edge_seq", F.col("target_id"))


@dataclass
class Recovered:
    """Nodes and edges after a stage, and its counters as tables of (dataset, ...) whose rows are what is counted."""

    nodes: DataFrame
    edges: DataFrame
    counted: dict[str, DataFrame] = field(default_factory=dict)

    def counters(self) -> DataFrame:
        """dataset, counter, n where n isn't 0."""
        parts = [df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n")).select("dataset", F.lit(name).alias("counter"), "n") for name, df in self.counted.items()]
        return reduce(DataFrame.unionByName, parts)


def close_gaps(nodes: DataFrame, edges: DataFrame, knobs: GapClose = GapClose(), centres: DataFrame | None = None, spacing: Spacing = Spacing()) -> Recovered:
    """One-frame gaps under gates of their own, each frame's one-to-one by least distance.

    In order of the ends, a bridge goes through the nearest isolated point within ``reuse`` of its middle that none has
    taken, else through a new point there, frame by frame while the cap lasts. With ``centres`` (dataset, t, uz, uy, ux) a
    long bridge through a new point needs one close to it, and one that has none doesn't count against the cap.
    """
    proposals = written(gap_proposals(nodes, edges, knobs), "gap-proposals")
    allowed = proposals.filter("allowed").select("dataset", "t", F.col("end_id").alias("source_id"), F.col("start_id").alias("target_id"), "d", "in_base")
    chosen = assign.gated_hungarian(allowed).join(allowed, ["dataset", "t", "source_id", "target_id"]).withColumnsRenamed({"source_id": "end_id", "target_id": "start_id"})
    chosen = chosen.join(_at(nodes, "end_id", "_a"), ["dataset", "end_id"]).join(_at(nodes, "start_id", "_b"), ["dataset", "start_id"])
    middle = written(chosen.select("dataset", F.col("end_id").alias("node_id"), "end_id", "start_id", (F.col("t") + 1).cast("int").alias("t"), "d", "in_base", *[((F.col(f"_a{a}") + F.col(f"_b{a}")) / 2).alias(a) for a in (*XYZ, *AXES)]), "gap-middles")
    touched = edges.select("dataset", F.col("source_id").alias("node_id")).union(edges.select("dataset", F.col("target_id").alias("node_id")))
    alone = nodes.join(touched, ["dataset", "node_id"], "left_anti").select("dataset", "node_id", "t", *XYZ)
    free = joins.gated(middle.select("dataset", "node_id", "t", *XYZ), alone, knobs.reuse).select(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("end_id"), F.col("b_node_id").alias("via"), F.col("d").alias("_off"))
    reused = admit(free, ["end_id", "_off", "via"], [(("dataset", "end_id"), 1), (("dataset", "via"), 1)]).select("dataset", "end_id", "via")
    fresh = middle.join(reused, ["dataset", "end_id"], "left_anti")
    if centres is not None:
        near = joins.gated(fresh.select("dataset", "node_id", "t", *XYZ), centres.select("dataset", "t", *XYZ), knobs.confirm).select(F.col("a_dataset").alias("dataset"), F.col("a_node_id").alias("end_id")).distinct().withColumn("_sure", F.lit(True))
        fresh = fresh.join(near, ["dataset", "end_id"], "left").filter((F.col("d") < knobs.confirm_span) | F.col("_sure")).drop("_sure")
    size = nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"), F.max("node_id").alias("_top"))
    ranked = fresh.withColumn("_rank", F.row_number().over(W.partitionBy("dataset").orderBy("t", "end_id"))).join(size, "dataset").filter(F.col("_rank") <= _share(F.col("_n"), knobs.most_share, knobs.most_added))
    new = ranked.withColumn("via", F.col("_top") + F.col("_rank"))
    columns = ["dataset", "end_id", "start_id", "t", "d", "in_base", "via", *AXES]
    bridged = written(middle.join(reused, ["dataset", "end_id"]).withColumn("_new", F.lit(False)).select(*columns, "_new").unionByName(new.withColumn("_new", F.lit(True)).select(*columns, "_new")), "gap-bridges")
    points = bridged.filter("_new").select("dataset", F.col("via").alias("node_id"), "t", *[F.greatest(F.rint(a), F.lit(0.0)).cast("int").alias(a) for a in AXES])
    links = _edges(bridged, [(F.col("end_id"), F.col("via")), (F.col("via"), F.col("start_id"))])
    out_nodes = to_um(nodes.select("dataset", "node_id", "t", *AXES).unionByName(points), spacing)
    counted = {
        "gap_candidates": proposals.filter("allowed"),
        "gap_expanded": proposals.filter("allowed and not in_base"),
        "gap_restricted": proposals.filter("in_base and not allowed"),
        "gap_selected": bridged,
        "gap_selected_outside_base": bridged.filter("not in_base"),
        "gap_reused": bridged.filter("not _new"),
        "gap_added_nodes": bridged.filter("_new"),
    }
    return Recovered(out_nodes, edges.select("dataset", "source_id", "target_id", "edge_seq").unionByName(links), counted)


def _single(edges: DataFrame, key: str, other: str) -> DataFrame:
    """The one neighbour of nodes that have one only: dataset, node_id, next_id."""
    one = edges.groupBy("dataset", F.col(key).alias("node_id")).agg(F.min(other).alias("next_id"), F.count(F.lit(1)).alias("_n"))
    return one.filter("_n = 1").drop("_n")


def strict_proposals(nodes: DataFrame, edges: DataFrame, knobs: StrictGap = StrictGap()) -> DataFrame:
    """Ends and the starts three frames on: dataset, t, end_id, start_id, d, penalty, score, frame_cap and cap.

    The step is a third of the way. Where the end has one parent, or the start one child, that link's step is compared with
    it: one such side must turn by a cosine above ``least_cosine`` and change by ``most_change`` at most, or hardly move;
    the penalty sums what the cosines fall short of 1/4, and score = d + 2 penalty. ``frame_cap`` is a share of the frame's
    ends and ``cap`` of the dataset's edges, one at least.
    """
    slim = nodes.select("dataset", "node_id", "t", *XYZ)
    ends, starts = joins.ends_and_starts(slim, edges)
    before = _single(edges, "target_id", "source_id").join(_at(nodes, "next_id", "_p"), ["dataset", "next_id"]).select("dataset", "node_id", *[F.col(f"_p{a}") for a in XYZ])
    after = _single(edges, "source_id", "target_id").join(_at(nodes, "next_id", "_s"), ["dataset", "next_id"]).select("dataset", "node_id", *[F.col(f"_s{a}") for a in XYZ])
    per_frame = ends.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("_ends"))
    left = ends.join(before, ["dataset", "node_id"], "left").join(per_frame, ["dataset", "t"])
    right = starts.join(after, ["dataset", "node_id"], "left")
    pairs = joins.gated(left, right, min(knobs.most_total, 3 * knobs.most_step), 3).filter(F.col("d") / 3 <= knobs.most_step)
    step = {a: (F.col(f"b_{a}") - F.col(f"a_{a}")) / 3 for a in XYZ}
    sides = {"p": {a: F.col(f"a_{a}") - F.col(f"a__p{a}") for a in XYZ}, "s": {a: F.col(f"b__s{a}") - F.col(f"b_{a}") for a in XYZ}}
    length = norm(*step.values())
    fits, penalty = F.lit(False), F.lit(0.0)
    for move in sides.values():
        own = norm(*move.values())
        cosine = sum((move[a] * step[a] for a in XYZ[1:]), move["uz"] * step["uz"]) / (own * length + 1e-9)
        still = (own <= 0.01) | (length <= 0.01)
        change = norm(*[move[a] - step[a] for a in XYZ])
        fits = fits | F.coalesce(still | ((cosine > knobs.least_cosine) & (change <= knobs.most_change)), F.lit(False))
        penalty = penalty + F.coalesce(F.when(still, 0.0).otherwise(F.greatest(F.lit(0.0), 0.25 - cosine)), F.lit(0.0))
    if knobs.need_context:
        pairs = pairs.filter(fits)
    else:
        penalty = F.lit(0.0)
    caps = edges.groupBy("dataset").agg(_share(F.count(F.lit(1)), knobs.most_share, knobs.most_links).alias("cap"))
    rows = pairs.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("end_id"), F.col("b_node_id").alias("start_id"), "d", penalty.alias("penalty"), _share(F.col("a__ends"), knobs.frame_share, 1 << 30).alias("frame_cap"))
    return rows.withColumn("score", F.col("d") + 2 * F.col("penalty")).join(caps, "dataset")


def strict_gaps(nodes: DataFrame, edges: DataFrame, knobs: StrictGap = StrictGap(), spacing: Spacing = Spacing()) -> Recovered:
    """Two-frame gaps: the best proposals (score, then frame, end and start), each end and start once, under the frames' and the datasets' caps.

    A dataset's cap ends the pass, so it cuts what is admitted without it. Two new points stand at the thirds of the way.
    """
    order = ["score", "t", "end_id", "start_id"]
    proposals = written(strict_proposals(nodes, edges, knobs), "strict-proposals")
    got = admit(proposals, order, [(("dataset", "end_id"), 1), (("dataset", "start_id"), 1), (("dataset", "t"), F.col("frame_cap"))])
    kept = written(got.withColumn("_rank", F.row_number().over(W.partitionBy("dataset").orderBy(*order))).filter("_rank <= cap"), "strict-admitted")
    top = nodes.groupBy("dataset").agg(F.max("node_id").alias("_top"))
    placed = kept.join(top, "dataset").join(_at(nodes, "end_id", "_a"), ["dataset", "end_id"]).join(_at(nodes, "start_id", "_b"), ["dataset", "start_id"])
    first = F.col("_top") + 2 * F.col("_rank") - 1
    way = placed.withColumn("_k", F.explode(F.array(F.lit(1), F.lit(2))))
    points = way.select("dataset", (first + F.col("_k") - 1).alias("node_id"), (F.col("t") + F.col("_k")).cast("int").alias("t"), *[F.greatest(F.rint(F.col(f"_a{a}") + (F.col(f"_b{a}") - F.col(f"_a{a}")) * F.col("_k") / 3), F.lit(0.0)).cast("int").alias(a) for a in AXES])
    links = _edges(placed, [(F.col("end_id"), first), (first, first + 1), (first + 1, F.col("start_id"))])
    out_nodes = to_um(nodes.select("dataset", "node_id", "t", *AXES).unionByName(points), spacing)
    counted = {"gap2_candidates": proposals, "gap2_selected": kept, "gap2_added_nodes": points}
    return Recovered(out_nodes, edges.select("dataset", "source_id", "target_id", "edge_seq").unionByName(links), counted)


def goes_on(edges: DataFrame, steps: int) -> DataFrame:
    """dataset, node_id: nodes from which ``steps`` links lead on, each its source's only one; by doubling, so few joins."""
    jump = written(_single(edges, "source_id", "target_id"), "single-links")
    on = lambda a, b: a.join(b.select("dataset", F.col("node_id").alias("next_id"), F.col("next_id").alias("_to")), ["dataset", "next_id"]).select("dataset", "node_id", F.col("_to").alias("next_id"))
    reach, left = None, steps
    while left:
        if left & 1:
            reach = jump if reach is None else on(reach, jump)
        left >>= 1
        if left:
            jump = written(on(jump, jump), "single-links")
    return reach.select("dataset", "node_id")


def cytokinesis(nodes: DataFrame, edges: DataFrame, knobs: Cytokinesis = Cytokinesis()) -> DataFrame:
    """Second daughters (dataset, t, source_id, kept_id, target_id, sister, angle) of parents whose kept child has an orphan near.

    The orphan is the one nearest to the kept child. Gates: both distances from the parent, the sisters' distance from both
    sides, the border for all three, the daughters' single tracks, how far their successors part, the angle at the parent.
    What is rescued in a frame changes nothing that a later frame asks for, so no order is needed; two parents may take the
    same orphan.
    """
    big = nodes.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= knobs.least_nodes).select("dataset")
    own = nodes.join(big, "dataset", "left_semi")
    orphans = own.join(edges.select("dataset", F.col("target_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
    single = _single(edges, "source_id", "target_id")
    kept = single.select("dataset", F.col("node_id").alias("source_id"), F.col("next_id").alias("kept_id"))
    parents = own.select("dataset", F.col("node_id").alias("source_id"), "t").join(kept, ["dataset", "source_id"])
    children = own.join(parents.select("dataset", F.col("kept_id").alias("node_id")).distinct(), ["dataset", "node_id"], "left_semi")
    near = joins.nearest(children, orphans, within=knobs.most_sister).filter("nearest_id is not null").select("dataset", F.col("node_id").alias("kept_id"), F.col("nearest_id").alias("target_id"), F.col("d").alias("sister"))
    rows = parents.join(near, ["dataset", "kept_id"]).filter(F.col("sister") >= knobs.least_sister)
    for key, prefix in (("source_id", "_a"), ("kept_id", "_b"), ("target_id", "_c")):
        rows = rows.join(_at(nodes, key, prefix, "t") if key != "source_id" else _at(nodes, key, prefix), ["dataset", key])
    rows = rows.filter((F.col("_bt") == F.col("t") + 1) & (F.col("_ct") == F.col("t") + 1))
    first, second = ({a: F.col(f"{p}{a}") - F.col(f"_a{a}") for a in XYZ} for p in ("_b", "_c"))
    d1, d2 = norm(*first.values()), norm(*second.values())
    inside = reduce(Column.__and__, [(F.col(f"{p}{a}") >= knobs.border[0]) & (F.col(f"{p}{a}") <= knobs.border[1]) for p in ("_a", "_b", "_c") for a in ("y", "x")])
    cosine = sum((first[a] * second[a] for a in XYZ[1:]), first["uz"] * second["uz"]) / (d1 * d2 + 1e-6)
    angle = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    rows = rows.filter((d1 <= knobs.parent_gate) & (d2 <= knobs.parent_gate) & inside).withColumn("angle", angle).filter(F.col("angle") >= knobs.least_angle)
    for key in ("kept_id", "target_id"):
        if knobs.least_track > 1:
            rows = rows.join(goes_on(edges, knobs.least_track - 1).withColumnRenamed("node_id", key), ["dataset", key], "left_semi")
        at = single.select("dataset", F.col("node_id").alias(key), F.col("next_id").alias(f"_n{key}"))
        rows = rows.join(at, ["dataset", key]).join(_at(nodes, f"_n{key}", f"_{key}"), ["dataset", f"_n{key}"])
    parted = norm(*[F.col(f"_kept_id{a}") - F.col(f"_target_id{a}") for a in XYZ]) - F.col("sister")
    return rows.filter(parted >= knobs.least_divergence).select("dataset", "t", "source_id", "kept_id", "target_id", "sister", "angle")


@dataclass(frozen=True)
class OutputFilter:
    """The chain's switches; a stage that is None or False is left out."""

    longest: float = 14.0
    one_parent: bool = True
    one_child: bool = False
    gaps: GapClose | None = GapClose(adaptive=False)
    strict: StrictGap | None = None
    #: Gates of safe divisions: parent, sister, child, divergence, shares of a frame's parents and of the edges.
    safe: tuple[float, float, float, float, float, float] | None = None
    #: Gates of a fork's links and of its daughters; a fork beyond them keeps its best link, or all with ``keep_bad``.
    fork: tuple[float, float] | None = None
    keep_bad: bool = False
    prune: bool = True
    least_track: int = 6
    line_reach: int = 2
    line_weight: float = 0.8


def _length(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with both ends' frames (_ta, _tb) and d; those with an end that isn't there go."""
    a, b = _at(nodes, "source_id", "_a", "t"), _at(nodes, "target_id", "_b", "t")
    p = F.col("p") if "p" in edges.columns else F.lit(None).cast("double")
    placed = edges.select("dataset", "source_id", "target_id", "edge_seq", p.alias("p")).join(a, ["dataset", "source_id"]).join(b, ["dataset", "target_id"])
    return placed.select("dataset", "source_id", "target_id", "edge_seq", "p", F.col("_at").alias("_ta"), F.col("_bt").alias("_tb"), norm(*[F.col(f"_a{c}") - F.col(f"_b{c}") for c in XYZ]).alias("d"))


def _better() -> list[Column]:
    """Links are better by p (none counts as 0), then shorter, then earlier."""
    return [F.desc(F.coalesce(F.col("p"), F.lit(0.0))), F.col("d"), F.col("edge_seq"), F.col("source_id"), F.col("target_id")]


def fork_geometry(nodes: DataFrame, edges: DataFrame, parent_gate: float, sister_gate: float, keep_bad: bool = False) -> DataFrame:
    """``edges`` (with p) whose forks keep their two best links if these are near enough, of the next frame, and the daughters near each other; else the best one, or all with ``keep_bad``."""
    ranked = _length(nodes, edges).withColumn("_rank", F.row_number().over(W.partitionBy("dataset", "source_id").orderBy(*_better())))
    two = ranked.filter("_rank <= 2").join(_at(nodes, "target_id", "_q"), ["dataset", "target_id"])
    top = two.groupBy("dataset", "source_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("d").alias("_far"), F.max(F.col("_tb") - F.col("_ta")).alias("_last"), F.min(F.col("_tb") - F.col("_ta")).alias("_next"),
        *[F.max_by(f"_q{a}", "_rank").alias(f"_two{a}") for a in XYZ], *[F.min_by(f"_q{a}", "_rank").alias(f"_one{a}") for a in XYZ],
    )
    sister = norm(*[F.col(f"_one{a}") - F.col(f"_two{a}") for a in XYZ])
    good = (F.col("_far") <= parent_gate) & (sister <= sister_gate) & (F.col("_last") == 1) & (F.col("_next") == 1)
    verdict = top.select("dataset", "source_id", F.when(F.col("_n") < 2, 1).when(good, 2).otherwise((1 << 30) if keep_bad else 1).alias("_most"))
    return ranked.join(verdict, ["dataset", "source_id"]).filter("_rank <= _most").select("dataset", "source_id", "target_id", "edge_seq", "p")


def output_filter(nodes: DataFrame, edges: DataFrame, knobs: OutputFilter = OutputFilter(), spacing: Spacing = Spacing()) -> Recovered:
    """The chain of filters and repairs over an emitted graph, in its fixed order, with a counter for what each stage did.

    Links to other frames than the next and long ones go; targets keep their best parent (and sources their best child); gaps
    of one and two frames are closed; safe divisions are added and forks of bad geometry cut; points without links and
    short components go; and tracks are drawn towards lines. Each stage's graph is written once for its readers.
    """
    counted: dict[str, DataFrame] = {}
    base = ["dataset", "source_id", "target_id", "edge_seq", "p"]
    keep = lambda df, name: written(df, f"output-{name}")

    def lost(name: str, before: DataFrame, after: DataFrame) -> None:
        counted[name] = before.select("dataset", "source_id", "target_id", "edge_seq").exceptAll(after.select("dataset", "source_id", "target_id", "edge_seq"))

    placed = keep(_length(nodes, edges), "placed")
    counted["dropped_nonconsecutive"] = placed.filter("_tb <> _ta + 1")
    counted["dropped_long"] = placed.filter((F.col("_tb") == F.col("_ta") + 1) & (F.col("d") > knobs.longest))
    e = placed.filter((F.col("_tb") == F.col("_ta") + 1) & (F.col("d") <= knobs.longest)).select(*base, "d")
    for on, side, name in ((knobs.one_parent, "target_id", "dropped_multi_parent"), (knobs.one_child, "source_id", "dropped_multi_child")):
        if on:
            ranked = keep(e.withColumn("_rank", F.row_number().over(W.partitionBy("dataset", side).orderBy(*_better()))), name)
            counted[name] = ranked.filter("_rank > 1")
            e = ranked.filter("_rank = 1").drop("_rank")
    e, n = keep(e.select(*base), "linked"), nodes
    for stage, run in ((knobs.gaps, close_gaps), (knobs.strict, strict_gaps)):
        if stage is not None:
            done = run(n, e, stage, spacing=spacing)
            counted |= done.counted
            n = keep(done.nodes, "nodes")
            e = keep(done.edges.join(e.select("dataset", "source_id", "target_id", "p"), ["dataset", "source_id", "target_id"], "left").select(*base), "bridged")
    if knobs.safe is not None:
        parent, sister, child, diverge, frame_share, total_share = knobs.safe
        found = forks.cues(stages.division_candidates(n, e, parent, sister), n, e)
        orphans = n.join(e.select("dataset", F.col("target_id").alias("node_id")), ["dataset", "node_id"], "left_anti")
        new = keep(forks.safe_divisions(found, orphans, n, e, child, sister, diverge, frame_share, total_share), "safe")
        counted["safe_divisions_added"] = new
        e = keep(e.unionByName(new.select("dataset", "source_id", "target_id", F.col("target_id").alias("edge_seq"), F.lit(None).cast("double").alias("p"))), "divided")
    if knobs.fork is not None:
        cut = keep(fork_geometry(n, e, *knobs.fork, knobs.keep_bad), "forks")
        lost("dropped_division", e, cut)
        e = cut
    if knobs.prune:
        joined = keep(repair.without_isolated(n, e), "pruned")
        counted["pruned_isolated"] = n.select("dataset", "node_id").join(joined.select("dataset", "node_id"), ["dataset", "node_id"], "left_anti")
        n = joined
    if knobs.least_track > 1:
        labels = keep(repair.labelled(n, e), "labels")
        kept = keep(repair.short_tracks(n, e, labels, knobs.least_track), "tracks")
        gone = labels.join(kept, ["dataset", "component"], "left_anti")
        counted["short_components_removed"] = gone.select("dataset", "component").distinct()
        counted["short_nodes_removed"] = gone
        n, e = repair.of_components(n, e, labels, kept)
        n, e = keep(n, "long-nodes"), keep(e, "long-edges")
    if knobs.line_reach:
        n = placing.line_fitted(n, e, knobs.line_reach, knobs.line_weight)
    return Recovered(n, e.select(*base), counted)
