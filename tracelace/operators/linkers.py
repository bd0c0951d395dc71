"""Linkers: candidate pairs or detections to edges.

Linkers of single gaps work on connected pieces of a gap. The motion linker and the flow linker carry something from
frame to frame, so their unit is a dataset; its frames are read in order and only one frame's state is held by the former.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import assign, costs, joins
from tracelace.operators.admission import admit
from tracelace.operators.groups import spread


def nearest_neighbour(nodes: DataFrame, gate: float) -> DataFrame:
    """Hungarian on distances within the gate, each gap by itself."""
    return _edges(assign.gated_hungarian(joins.candidates(nodes, gate)))


def assignment(pairs: DataFrame, bonus: float, disappearance: float) -> DataFrame:
    """Skips allowed; cost d - bonus * p."""
    return _edges(assign.with_skips(costs.bonus_cost(pairs, bonus), "cost", disappearance))


def integer_program(pairs: DataFrame, bonus: float, reward: float = 1.0) -> DataFrame:
    """One parent and up to two children, cost d - bonus * p against a reward for each kept link; gaps don't interact."""
    return _edges(assign.with_divisions(costs.bonus_cost(pairs, bonus), "cost", reward))


def division_aware(nodes: DataFrame, gate: float) -> DataFrame:
    """Nearest-neighbour links, then each unparented target takes the nearest parent with exactly one child; one child more each."""
    pairs = joins.candidates(nodes, gate)
    first = assign.gated_hungarian(pairs)
    single = first.select("dataset", "source_id").distinct()
    orphan = pairs.join(first.select("dataset", "target_id"), ["dataset", "target_id"], "left_anti").join(single, ["dataset", "source_id"], "left_semi")
    more = admit(orphan, ["target_id", "d", "source_id"], [(("dataset", "target_id"), 1), (("dataset", "source_id"), 1)]).select("dataset", "t", "source_id", "target_id")
    return _edges(first.unionByName(more))


def _edges(links: DataFrame) -> DataFrame:
    return links.select("dataset", "source_id", "target_id", F.col("target_id").alias("edge_seq"))


@dataclass(frozen=True)
class Motion:
    """Knobs of the motion linker."""

    tight: float = 5.0
    loose: float = 10.0
    ahead: float = 0.5
    bonus: float = 0.0
    faithful: bool = False
    most_nodes: int = 2600


def link_frame(prev: pd.DataFrame, now: pd.DataFrame, knobs: Motion, p: dict[tuple[int, int], float] | None = None) -> tuple[list[tuple[int, int]], dict[int, np.ndarray]]:
    """Links of one gap and the velocities of the later frame's nodes.

    Gates test the raw displacement; the cost is the distance to the place that half the velocity points to (or, faithful,
    motion + 0.05 raw). A tight pass commits first, a loose one takes what is left. ``prev`` has vz, vy and vx.
    """
    a, b = prev[["uz", "uy", "ux"]].to_numpy(float), now[["uz", "uy", "ux"]].to_numpy(float)
    still = {int(i): np.zeros(3) for i in now["node_id"]}
    if not len(a) or not len(b) or (knobs.faithful and max(len(a), len(b)) > knobs.most_nodes):
        return [], still
    v = prev[["vz", "vy", "vx"]].to_numpy(float)
    raw = np.linalg.norm(a[:, None] - b[None], axis=2)
    cost = np.linalg.norm((a + knobs.ahead * v)[:, None] - b[None], axis=2)
    if knobs.faithful:
        cost = cost + 0.05 * raw
    sid, tid = prev["node_id"].to_numpy(), now["node_id"].to_numpy()
    if knobs.bonus and p:
        cost = cost - knobs.bonus * np.array([[p.get((int(i), int(j)), 0.0) for j in tid] for i in sid])
    links: list[tuple[int, int]] = []
    rows, cols = np.arange(len(a)), np.arange(len(b))
    for gate in (knobs.tight, knobs.loose):
        if not len(rows) or not len(cols):
            break
        ok = raw[np.ix_(rows, cols)] <= gate
        got = [(rows[i], cols[j]) for i, j in assign.rectangle(np.where(ok, cost[np.ix_(rows, cols)], assign.FORBIDDEN)) if ok[i, j]]
        links += got
        rows, cols = np.setdiff1d(rows, [i for i, _ in got]), np.setdiff1d(cols, [j for _, j in got])
    for i, j in links:
        still[int(tid[j])] = b[j] - a[i]
    return [(int(sid[i]), int(tid[j])) for i, j in links], still


def motion(nodes: DataFrame, knobs: Motion = Motion()) -> DataFrame:
    """Two-pass linking with velocities carried along links; a missing frame starts afresh."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, prev, at = [], None, None
        for t, frame in pdf.sort_values(["t", "node_id"]).groupby("t", sort=True):
            frame = frame.assign(vz=0.0, vy=0.0, vx=0.0)
            if prev is not None and t == at + 1:
                links, v = link_frame(prev, frame, knobs)
                out += [(pdf["dataset"].iloc[0], s, e) for s, e in links]
                frame[["vz", "vy", "vx"]] = np.array([v[int(i)] for i in frame["node_id"]])
            prev, at = frame, t
        return pd.DataFrame(out, columns=["dataset", "source_id", "target_id"]).astype({"source_id": "int64", "target_id": "int64"})

    links = nodes.select("dataset", "node_id", "t", "uz", "uy", "ux").transform(spread("dataset")).groupBy("dataset").applyInPandas(run, "dataset string, source_id long, target_id long")
    return _edges(links)


def flow(arcs: list[tuple[int, int, int]], nodes: list[int], appear: int, disappear: int, divide: int | None = None) -> list[tuple[int, int]]:
    """Links of least total cost over a whole dataset: node-disjoint tracks that each pay for their ends.

    ``arcs`` are (source, target, whole cost); ``divide``: what a second child costs beyond an appearance. A node has a row
    for what leaves it and a column for what enters it; a node that is left out takes its own column. Against paying for all
    ends, a link saves both its ends' price, and so does a node that is left out, so the network is one assignment of rows to
    columns. A second child comes from a second row, which pays for its unit.
    """
    index = {x: i for i, x in enumerate(nodes)}
    n, both = len(nodes), appear + disappear
    rows: list[list[tuple[int, int]]] = [[(i, -both)] for i in range(n)]
    more: list[list[tuple[int, int]]] = [[] for _ in range(n)] if divide is not None else []
    for a, b, c in arcs:
        rows[index[a]].append((index[b], c - both))
        if divide is not None and c + divide < 0:
            more[index[a]].append((index[b], c + divide))
    column = assign.cheapest_columns(rows + more, n)
    return [(nodes[i % n], nodes[j]) for i, j in enumerate(column) if j >= 0 and (j != i)]


def min_cost_flow(nodes: DataFrame, pairs: DataFrame, boundary: float, bonus: float, divide: float | None = None) -> DataFrame:
    """Global links of each dataset: whole costs (thousandths, half to even) of d - bonus * p, ends at ``boundary`` each."""
    priced = costs.bonus_cost(pairs, bonus).select("dataset", "source_id", "target_id", F.rint(F.col("cost") * 1000).cast("long").alias("c"))
    frames = nodes.select("dataset", "t", F.col("node_id").alias("source_id"), F.lit(None).cast("long").alias("target_id"), F.lit(None).cast("long").alias("c"))
    both = frames.unionByName(priced.withColumn("t", F.lit(None).cast(dict(nodes.dtypes)["t"])))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["target_id"].isna()].sort_values(["t", "source_id"])["source_id"].astype("int64").tolist()
        arcs = pdf[pdf["target_id"].notna()].sort_values(["source_id", "target_id"])
        links = flow([(int(a), int(b), int(c)) for a, b, c in zip(arcs["source_id"], arcs["target_id"], arcs["c"], strict=True)], own, round(1000 * boundary), round(1000 * boundary), None if divide is None else round(1000 * divide))
        name = str(pdf["dataset"].iloc[0])
        return pd.DataFrame([(name, a, b) for a, b in links], columns=["dataset", "source_id", "target_id"]).astype({"dataset": object, "source_id": "int64", "target_id": "int64"})

    return _edges(both.transform(spread("dataset")).groupBy("dataset").applyInPandas(run, "dataset string, source_id long, target_id long"))


@dataclass(frozen=True)
class LinkerConfig:
    """A linker by name; a knob that the named linker doesn't read is an error."""

    name: str = "nearest"
    gate: float = 10.0
    bonus: float | None = None
    boundary: float | None = None
    divide: float | None = None
    tight: float | None = None

    READS = {"nearest": (), "assignment": ("bonus", "boundary"), "ilp": ("bonus",), "division": (), "motion": ("bonus", "tight"), "flow": ("bonus", "boundary", "divide")}

    def __post_init__(self) -> None:
        if self.name not in self.READS:
            raise ValueError(f"no linker {self.name}")
        for knob in ("bonus", "boundary", "divide", "tight"):
            if getattr(self, knob) is not None and knob not in self.READS[self.name]:
                raise ValueError(f"{self.name} doesn't read {knob}")

    @property
    def effective_bonus(self) -> float:
        """Twice the gate where unset."""
        return 2 * self.gate if self.bonus is None else self.bonus

    def build(self, nodes: DataFrame, affinity: DataFrame) -> DataFrame:
        """The edges that the linker makes."""
        pairs = affinity.filter(F.col("d") <= self.gate)
        match self.name:
            case "nearest":
                return nearest_neighbour(nodes, self.gate)
            case "assignment":
                return assignment(pairs, self.effective_bonus, self.boundary or 0.0)
            case "ilp":
                return integer_program(pairs, self.effective_bonus)
            case "division":
                return division_aware(nodes, self.gate)
            case "motion":
                return motion(nodes, Motion(tight=self.tight or self.gate / 2, loose=self.gate, bonus=self.bonus or 0.0))
            case _:
                return min_cost_flow(nodes, pairs, self.boundary or 0.0, self.effective_bonus, self.divide)
