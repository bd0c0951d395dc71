"""Division scoring: evidence around each annotated division, re-matched in its own window."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators import assign, joins, repair
from tracelace.storage import written
from tracelace.operators.groups import spread


def windows(truth_edges: DataFrame) -> DataFrame:
    """(dataset, division_id, node_id): the divider, its parents, its daughters and granddaughters."""
    e = truth_edges.select("dataset", "source_id", "target_id").distinct()
    div = e.groupBy("dataset", F.col("source_id").alias("division_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").drop("_n")
    here = div.select("dataset", "division_id", F.col("division_id").alias("node_id"))

    def step(at: DataFrame, forward: bool) -> DataFrame:
        a, b = ("source_id", "target_id") if forward else ("target_id", "source_id")
        return at.join(e.select("dataset", F.col(a).alias("node_id"), F.col(b).alias("_next")), ["dataset", "node_id"]).select("dataset", "division_id", F.col("_next").alias("node_id"))

    up, down = step(here, False), step(here, True)
    return here.union(up).union(down).union(step(down, True)).distinct()


def _invalid(kids: DataFrame, edges: DataFrame, match: DataFrame, components: DataFrame) -> DataFrame:
    """(dataset, fork_id) of the forks that the truth or the graph itself rules out.

    A branch points at the component of its child's match; without one, at that of its grandchildren's matches if they have
    one in common. A child, or a grandchild that is asked, with another parent spoils the fork.
    """
    parents = edges.groupBy("dataset", F.col("target_id").alias("node_id")).agg((F.count(F.lit(1)) > 1).alias("_shared"))
    at = match.select("dataset", F.col("pred_id").alias("node_id"), F.col("gt_id")).join(components.withColumnRenamed("node_id", "gt_id"), ["dataset", "gt_id"]).select("dataset", "node_id", "component")
    info = parents.join(at, ["dataset", "node_id"], "left")
    child = kids.join(info.withColumnsRenamed({"node_id": "child_id"}), ["dataset", "child_id"], "left")
    below = child.filter("component is null").select("dataset", "fork_id", "child_id").join(edges.withColumnsRenamed({"source_id": "child_id", "target_id": "node_id"}), ["dataset", "child_id"]).join(info, ["dataset", "node_id"], "left")
    below = below.groupBy("dataset", "fork_id", "child_id").agg(F.bool_or("_shared").alias("_bad"), F.count_distinct("component").alias("_k"), F.min("component").alias("_c"))
    seen = child.join(below, ["dataset", "fork_id", "child_id"], "left")
    branch = seen.select("dataset", "fork_id", (F.col("_shared") | F.coalesce("_bad", F.lit(False))).alias("_spoilt"), F.coalesce("component", F.when(F.col("_k") == 1, F.col("_c"))).alias("_at"))
    verdict = branch.groupBy("dataset", "fork_id").agg(F.bool_or("_spoilt").alias("_spoilt"), F.count_distinct("_at").alias("_k"))
    return verdict.filter("_spoilt or _k >= 2").select("dataset", "fork_id")


def division_counts(nodes: DataFrame, edges: DataFrame, truth: DataFrame, truth_edges: DataFrame, ruler: float = 7.0) -> DataFrame:
    """A row for each dataset with truth: div_tp, div_fp, div_fn, how misses split (nodes_missing, no_fork, fork_rejected),
    of those without a fork how many no second daughter can be proposed for, and spurious forks.

    A division is recovered by a predicted fork whose parent side matches the divider or its parents and whose children's
    lineages reach two different daughters' lineages (a daughter or its children), each fork and division used once. Raw
    edges count towards forks. A division counts forks near it only where its parent side and two daughters are detected.
    A fork is invalid if a child has another parent, or its branches point at different components of the truth. False are
    the invalid forks, those near a division and those on truth that has a child, less the recovered.
    A division without a fork is unproposable if every detection that stands for a daughter has a parent already, and has
    no_kept_child if no detection on its parent side has exactly one child. Spurious are the forks that are invalid or on
    truth that has a child, less the recovered; forks that are merely near a division aren't.
    The matching of nodes is done anew for each division's window, so annotations further away can't compete.
    """
    slim = ["dataset", "node_id", "t", "uz", "uy", "ux"]
    nodes, truth = written(nodes.select(*slim), "division-nodes"), written(truth.select(*slim), "division-truth")
    edges, truth_edges = written(edges.select("dataset", "source_id", "target_id"), "division-edges"), written(truth_edges.select("dataset", "source_id", "target_id"), "division-truth-edges")
    w = written(windows(truth_edges), "division-windows")
    gt = w.join(truth.select("dataset", "node_id", "t", "uz", "uy", "ux"), ["dataset", "node_id"])
    near = joins.gated(nodes.select("dataset", "node_id", "t", "uz", "uy", "ux"), gt, ruler)
    pairs = near.select(F.col("a_dataset").alias("dataset"), F.col("b_division_id").alias("division_id"), F.col("a_t").alias("t"), F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), "d")
    here = gt.groupBy("dataset", "division_id", "t").agg(F.count(F.lit(1)).alias("n_gt"))
    in_window = here.join(nodes.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n_pred")), ["dataset", "t"])
    match = written(assign.match_nodes(pairs, ("dataset", "division_id", "t"), in_window), "division-match")
    whole = joins.gated(nodes.select("dataset", "node_id", "t", "uz", "uy", "ux"), truth.select("dataset", "node_id", "t", "uz", "uy", "ux"), ruler)
    all_match = written(assign.match_nodes(whole.select(F.col("a_dataset").alias("dataset"), F.col("a_t").alias("t"), F.col("a_node_id").alias("source_id"), F.col("b_node_id").alias("target_id"), "d"), sizes=assign.frame_sizes(nodes, truth)), "division-match-all")

    forks = edges.groupBy("dataset", F.col("source_id").alias("fork_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("dataset", "fork_id")
    own = edges.select("dataset", "source_id", "target_id").distinct()
    kids = own.withColumnsRenamed({"source_id": "fork_id", "target_id": "child_id"}).join(forks, ["dataset", "fork_id"])
    invalid = written(_invalid(kids, own, all_match, repair.labelled(truth, truth_edges)), "division-invalid")

    ge = truth_edges.select("dataset", "source_id", "target_id").distinct()
    daughters = ge.join(w.select("dataset", "division_id").distinct(), (ge["dataset"] == w["dataset"]) & (ge["source_id"] == w["division_id"])).select(ge["dataset"], "division_id", F.col("target_id").alias("daughter"))
    grand = daughters.join(ge.withColumnsRenamed({"source_id": "daughter", "target_id": "_g"}), ["dataset", "daughter"]).select("dataset", "division_id", "daughter", F.col("_g").alias("gt_id"))
    side = daughters.select("dataset", "division_id", "daughter", F.col("daughter").alias("gt_id")).union(grand)
    divider = w.select("dataset", "division_id").distinct().withColumn("gt_id", F.col("division_id"))
    above = divider.select("dataset", "division_id", F.col("division_id").alias("target_id")).join(ge, ["dataset", "target_id"]).select("dataset", "division_id", F.col("source_id").alias("gt_id"))
    top = divider.union(above)

    upper = match.join(top, ["dataset", "division_id", "gt_id"]).select("dataset", "division_id", F.col("pred_id").alias("fork_id"))
    after = upper.join(edges.select("dataset", F.col("source_id").alias("fork_id"), F.col("target_id").alias("_n")), ["dataset", "fork_id"]).select("dataset", "division_id", F.col("_n").alias("fork_id"))
    lower = match.join(side, ["dataset", "division_id", "gt_id"]).select("dataset", "division_id", "daughter", F.col("pred_id").alias("reached"))
    daughters_met = lower.groupBy("dataset", "division_id").agg(F.count_distinct("daughter").alias("_d"))
    supported = daughters_met.filter("_d >= 2").join(upper.select("dataset", "division_id").distinct(), ["dataset", "division_id"]).drop("_d")
    considered = written(upper.union(after).distinct().join(forks, ["dataset", "fork_id"]).join(supported, ["dataset", "division_id"]), "division-forks")
    reach = kids.select("dataset", "fork_id", "child_id", F.col("child_id").alias("reached")).union(kids.join(edges.select("dataset", F.col("source_id").alias("child_id"), F.col("target_id").alias("reached")), ["dataset", "child_id"]).select("dataset", "fork_id", "child_id", "reached")).distinct()
    touch = considered.join(invalid, ["dataset", "fork_id"], "left_anti").join(reach, ["dataset", "fork_id"]).join(lower, ["dataset", "division_id", "reached"]).select("dataset", "division_id", "fork_id", "child_id", "daughter").distinct()
    links = touch.alias("a").join(touch.alias("b"), ["dataset", "division_id", "fork_id"]).filter("a.child_id < b.child_id and a.daughter != b.daughter").select("dataset", "division_id", "fork_id").distinct()

    mm = all_match.select("dataset", F.col("pred_id").alias("node_id"), "gt_id")
    has_out = ge.select("dataset", F.col("source_id").alias("gt_id")).distinct()
    evaluable = forks.join(mm.withColumnRenamed("node_id", "fork_id"), ["dataset", "fork_id"]).join(has_out, ["dataset", "gt_id"], "left_semi").select("dataset", "fork_id")
    spurious = evaluable.union(invalid).distinct().withColumn("_x", F.lit(True))
    charged = considered.select("dataset", "fork_id").union(evaluable).union(invalid).distinct().join(spurious, ["dataset", "fork_id"], "left")

    heads = match.join(daughters.withColumnRenamed("daughter", "gt_id"), ["dataset", "division_id", "gt_id"]).select("dataset", "division_id", F.col("pred_id").alias("target_id"))
    free = heads.join(own.select("dataset", "target_id").distinct(), ["dataset", "target_id"], "left_anti").select("dataset", "division_id").distinct().withColumn("_free", F.lit(True))
    single = own.groupBy("dataset", F.col("source_id").alias("fork_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("dataset", "fork_id")
    kept = upper.join(single, ["dataset", "fork_id"], "left_semi").select("dataset", "division_id").distinct().withColumn("_kept", F.lit(True))
    near_forks = considered.groupBy("dataset", "division_id").agg(F.count(F.lit(1)).alias("_f"))
    state = divider.select("dataset", "division_id").join(supported.withColumn("_s", F.lit(1)), ["dataset", "division_id"], "left").join(near_forks, ["dataset", "division_id"], "left").fillna(0, ["_s", "_f"])
    state = state.join(free, ["dataset", "division_id"], "left").join(kept, ["dataset", "division_id"], "left")
    rows = state.select("dataset", "division_id", F.lit(None).cast("long").alias("fork_id"), (F.when(F.col("_s") == 0, "nodes_missing").when(F.col("_f") == 0, "no_fork").otherwise("fork_rejected")).alias("state"), F.col("_free").isNull().alias("unproposable"), F.col("_kept").isNull().alias("no_kept_child"), F.lit(False).alias("spurious"))
    rows = rows.unionByName(links.withColumn("state", F.lit("link")), allowMissingColumns=True)
    rows = rows.unionByName(charged.select("dataset", F.lit(None).cast("long").alias("division_id"), "fork_id", F.lit("charged").alias("state"), F.coalesce("_x", F.lit(False)).alias("spurious")), allowMissingColumns=True)

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        link = pdf[pdf["state"] == "link"]
        got = assign.most_pairs(sorted((int(a), int(b)) for a, b in zip(link["division_id"], link["fork_id"], strict=True)))
        won = set(got.values())
        false = set(pdf.loc[pdf["state"] == "charged", "fork_id"].astype("int64")) - set(got)
        misses = pdf[pdf["division_id"].notna() & (pdf["state"] != "link")]
        misses = misses[~misses["division_id"].astype("int64").isin(won)]
        n = misses["state"].value_counts()
        bare = misses[misses["state"] == "no_fork"]
        extra = {k: [int(bare[k].astype(bool).sum())] for k in ("unproposable", "no_kept_child")}
        odd = set(pdf.loc[(pdf["state"] == "charged") & pdf["spurious"].eq(True), "fork_id"].astype("int64")) - set(got)
        return pd.DataFrame({"dataset": [pdf["dataset"].iloc[0]], "div_tp": [len(got)], "div_fp": [len(false)], "div_fn": [len(misses)], **{k: [int(n.get(k, 0))] for k in ("nodes_missing", "no_fork", "fork_rejected")}, **extra, "spurious": [len(odd)]})

    return rows.transform(spread("dataset")).groupBy("dataset").applyInPandas(count, "dataset string, div_tp long, div_fp long, div_fn long, nodes_missing long, no_fork long, fork_rejected long, unproposable long, no_kept_child long, spurious long")
