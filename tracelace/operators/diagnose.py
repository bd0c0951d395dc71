"""Error decomposition: fates of truth edges, charges of predicted links, signals of mislinks, agreement of trackers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.operators.joins import in_set, successors

FATES = ("CORRECT", "MISLINK_CONFLICT", "MISLINK_FREE", "SKIP", "ENDPOINT_MISSING")


def matched_truth(truth_edges: DataFrame, match: DataFrame) -> DataFrame:
    """Truth edges with the detections of their ends (pred_source, pred_target), null where an end has none."""
    m = match.filter("gt_id is not null").groupBy("dataset", "gt_id").agg(F.min("pred_id").alias("pred_id"))
    s = m.withColumnsRenamed({"gt_id": "source_id", "pred_id": "pred_source"})
    t = m.withColumnsRenamed({"gt_id": "target_id", "pred_id": "pred_target"})
    return truth_edges.join(s, ["dataset", "source_id"], "left").join(t, ["dataset", "target_id"], "left")


def fates(truth_edges: DataFrame, match: DataFrame, links: DataFrame) -> DataFrame:
    """Truth edges with ``fate``; the first that holds of: an end without detection, linked, its target has another parent
    (conflict), its source has another child (free), neither."""
    e = matched_truth(truth_edges, match)
    e = in_set(e, links.select("dataset", "source_id", "target_id"), "pred_source", "pred_target", "_hit")
    parent = links.select("dataset", F.col("target_id").alias("pred_target")).distinct().withColumn("_parent", F.lit(True))
    child = links.select("dataset", F.col("source_id").alias("pred_source")).distinct().withColumn("_child", F.lit(True))
    e = e.join(parent, ["dataset", "pred_target"], "left").join(child, ["dataset", "pred_source"], "left")
    fate = F.when(F.col("pred_source").isNull() | F.col("pred_target").isNull(), FATES[4]).when(F.col("_hit"), FATES[0]).when(F.col("_parent"), FATES[1]).when(F.col("_child"), FATES[2]).otherwise(FATES[3])
    return e.select("dataset", "source_id", "target_id", "pred_source", "pred_target", fate.alias("fate"))


def fate_counts(found: DataFrame) -> DataFrame:
    """A row for each dataset and fate, those that don't occur included."""
    every = found.select("dataset").distinct().withColumn("fate", F.explode(F.array(*[F.lit(f) for f in FATES])))
    return every.join(found.groupBy("dataset", "fate").count(), ["dataset", "fate"], "left").select("dataset", "fate", F.coalesce("count", F.lit(0)).alias("n"))


def charges(charged: DataFrame, truth_edges: DataFrame, detections: DataFrame) -> DataFrame:
    """Charged links with ``charge``: the last that holds of TRUE, TARGET_ORPHAN, SOURCE_ENDS, MISLINK, EXTRA_CHILD, SYNTHETIC.

    SOURCE_ENDS: the source's truth has no child; TARGET_ORPHAN: the target's truth has no parent; MISLINK: both ends are
    matched to ends of truth edges but not of one; EXTRA_CHILD: the source has a true link besides; SYNTHETIC: an end isn't
    among the detections.
    """
    has_child = truth_edges.select("dataset", F.col("source_id").alias("gt_source")).distinct().withColumn("_c", F.lit(True))
    has_parent = truth_edges.select("dataset", F.col("target_id").alias("gt_target")).distinct().withColumn("_p", F.lit(True))
    real_s = detections.select("dataset", F.col("node_id").alias("source_id")).withColumn("_rs", F.lit(True))
    real_t = detections.select("dataset", F.col("node_id").alias("target_id")).withColumn("_rt", F.lit(True))
    e = charged.join(has_child, ["dataset", "gt_source"], "left").join(has_parent, ["dataset", "gt_target"], "left")
    e = e.join(real_s, ["dataset", "source_id"], "left").join(real_t, ["dataset", "target_id"], "left")
    e = e.withColumn("_true", F.max("is_true").over(W.partitionBy("dataset", "source_id")))
    both = F.col("_c").isNotNull() & F.col("_p").isNotNull() & ~F.col("is_true")
    charge = (
        F.when(F.col("_rs").isNull() | F.col("_rt").isNull(), "SYNTHETIC")
        .when(~F.col("is_true") & F.col("_true"), "EXTRA_CHILD")
        .when(both, "MISLINK")
        .when(F.col("gt_source").isNotNull() & F.col("_c").isNull(), "SOURCE_ENDS")
        .when(~F.col("is_true"), "TARGET_ORPHAN")
        .otherwise("TRUE")
    )
    return e.select("dataset", "source_id", "target_id", "is_true", charge.alias("charge"))


def mislink_signal(found: DataFrame, links: DataFrame, affinity: DataFrame) -> DataFrame:
    """For missed truth edges with both ends detected: p_true, p_chosen (the source's first successor), rank of the truth
    among the source's candidates (candidates strictly above it), inverted."""
    missed = found.filter(F.col("fate").isin("MISLINK_CONFLICT", "MISLINK_FREE"))
    a = affinity.select("dataset", "source_id", "target_id", "p")
    truth = missed.join(a.withColumnsRenamed({"source_id": "pred_source", "target_id": "pred_target", "p": "p_true"}), ["dataset", "pred_source", "pred_target"], "left")
    chosen = successors(links).select("dataset", F.col("node_id").alias("pred_source"), "successor_id")
    chosen = chosen.join(a.withColumnsRenamed({"source_id": "pred_source", "target_id": "successor_id", "p": "p_chosen"}), ["dataset", "pred_source", "successor_id"], "left")
    above = truth.filter("p_true is not null").select("dataset", "pred_source", "pred_target", "p_true").join(a.withColumnRenamed("source_id", "pred_source"), ["dataset", "pred_source"])
    ranks = above.groupBy("dataset", "pred_source", "pred_target").agg(F.sum((F.col("p") > F.col("p_true")).cast("long")).alias("rank"))
    out = truth.join(chosen, ["dataset", "pred_source"], "left").join(ranks, ["dataset", "pred_source", "pred_target"], "left")
    return out.select("dataset", "source_id", "target_id", "fate", "p_true", "p_chosen", "rank", F.coalesce(F.col("p_chosen") > F.col("p_true"), F.lit(False)).alias("inverted"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """A row for each dataset: links of both, only the first, only the second, and the Jaccard of the two sets."""
    x = a.select("dataset", "source_id", "target_id").distinct().withColumn("_a", F.lit(1))
    y = b.select("dataset", "source_id", "target_id").distinct().withColumn("_b", F.lit(1))
    j = x.join(y, ["dataset", "source_id", "target_id"], "full_outer").fillna(0, ["_a", "_b"])
    out = j.groupBy("dataset").agg(F.sum(F.col("_a") * F.col("_b")).alias("n_both"), F.sum(F.col("_a") * (1 - F.col("_b"))).alias("n_only_a"), F.sum(F.col("_b") * (1 - F.col("_a"))).alias("n_only_b"))
    return out.withColumn("jaccard", F.try_divide(F.col("n_both").cast("double"), F.col("n_both") + F.col("n_only_a") + F.col("n_only_b")))


def votes(tagged: DataFrame) -> DataFrame:
    """dataset, source_id, target_id, n_trackers of links tagged with ``tracker``."""
    return tagged.groupBy("dataset", "source_id", "target_id").agg(F.count_distinct("tracker").alias("n_trackers"))


def decorrelation(tagged: DataFrame) -> DataFrame:
    """Jaccard of the links of every two trackers, by dataset: sizes and shared links, each from one aggregation."""
    t = tagged.select("dataset", "tracker", "source_id", "target_id").distinct()
    size = t.groupBy("dataset", "tracker").count()
    both = t.join(t.withColumnRenamed("tracker", "other"), ["dataset", "source_id", "target_id"]).filter("tracker < other").groupBy("dataset", "tracker", "other").agg(F.count(F.lit(1)).alias("n_both"))
    pairs = size.withColumnRenamed("count", "_n").join(size.withColumnsRenamed({"tracker": "other", "count": "_m"}), "dataset").filter("tracker < other")
    out = pairs.join(both, ["dataset", "tracker", "other"], "left").fillna(0, ["n_both"])
    return out.select("dataset", "tracker", "other", "n_both", F.try_divide(F.col("n_both").cast("double"), F.col("_n") + F.col("_m") - F.col("n_both")).alias("jaccard"))


def transfer_classes(donor: DataFrame, links: DataFrame, match: DataFrame) -> DataFrame:
    """Donor edges, translated to this tracker's nodes: unaligned, redundant, contested (an end's slot is taken) or clean."""
    m = match.filter("pred_id is not null")
    s = m.withColumnsRenamed({"gt_id": "source_id", "pred_id": "own_source"})
    t = m.withColumnsRenamed({"gt_id": "target_id", "pred_id": "own_target"})
    e = donor.select("dataset", "source_id", "target_id").join(s, ["dataset", "source_id"], "left").join(t, ["dataset", "target_id"], "left")
    e = in_set(e, links.select("dataset", "source_id", "target_id"), "own_source", "own_target", "_have")
    parent = links.select("dataset", F.col("target_id").alias("own_target")).distinct().withColumn("_p", F.lit(True))
    child = links.select("dataset", F.col("source_id").alias("own_source")).distinct().withColumn("_c", F.lit(True))
    e = e.join(parent, ["dataset", "own_target"], "left").join(child, ["dataset", "own_source"], "left")
    kind = F.when(F.col("own_source").isNull() | F.col("own_target").isNull(), "unaligned").when(F.col("_have"), "redundant").when(F.col("_p") | F.col("_c"), "contested").otherwise("clean")
    return e.select("dataset", "source_id", "target_id", kind.alias("kind"))


def ruler_loss(truth: DataFrame, truth_edges: DataFrame, nearest_detection: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """For each radius: truth points without a detection within it, and truth edges with such an end, by dataset."""
    r = F.explode(F.array(*[F.lit(float(x)) for x in radii]))
    blind = truth.select("dataset", "node_id").join(nearest_detection.select("dataset", "node_id", "d"), ["dataset", "node_id"], "left").withColumn("radius", r)
    blind = blind.withColumn("_blind", (F.col("d").isNull() | (F.col("d") > F.col("radius"))).cast("long")).select("dataset", "node_id", "radius", "_blind")
    nodes = blind.groupBy("dataset", "radius").agg(F.sum("_blind").alias("blind_nodes"))
    s = blind.withColumnsRenamed({"node_id": "source_id", "_blind": "_s"})
    t = blind.withColumnsRenamed({"node_id": "target_id", "_blind": "_t"})
    e = truth_edges.select("dataset", "source_id", "target_id").join(s, ["dataset", "source_id"]).join(t, ["dataset", "target_id", "radius"])
    return nodes.join(e.groupBy("dataset", "radius").agg(F.sum(F.greatest("_s", "_t")).alias("dead_edges"), F.count(F.lit(1)).alias("n_edges")), ["dataset", "radius"], "left")


def cue_ranks(pairs: DataFrame, truth: DataFrame, cues: dict[str, bool]) -> DataFrame:
    """How often each cue puts the true target strictly first among a source's candidates: cue, n, n_first. ``cues``: column, lower is better."""
    flagged = in_set(pairs, truth, "source_id", "target_id", "_true")
    out = None
    for cue, low in cues.items():
        v = F.col(cue) if low else -F.col(cue)
        best = F.max(F.when(F.col("_true"), v)).over(W.partitionBy("dataset", "source_id"))
        per = flagged.withColumn("_tv", best).filter("_tv is not null").groupBy("dataset", "source_id").agg(F.sum((v < F.col("_tv")).cast("long")).alias("_above"))
        part = per.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("_above") == 0).cast("long")).alias("n_first")).withColumn("cue", F.lit(cue))
        out = part if out is None else out.unionByName(part)
    return out


def mutual_best(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Pairs that reach the best p of their source and of their target, equal ones included."""
    s = F.max(p).over(W.partitionBy("dataset", "source_id"))
    t = F.max(p).over(W.partitionBy("dataset", "target_id"))
    return pairs.withColumn("_s", s).withColumn("_t", t).filter((F.col(p) >= F.col("_s")) & (F.col(p) >= F.col("_t"))).drop("_s", "_t")


def component_prune_price(labels: DataFrame, match: DataFrame, cuts: tuple[int, ...]) -> DataFrame:
    """For each cut: unmatched and matched nodes in components below that size."""
    size = labels.groupBy("dataset", "component").agg(F.count(F.lit(1)).alias("size"))
    m = match.select("dataset", F.col("pred_id").alias("node_id"), F.col("gt_id").isNotNull().cast("long").alias("_m"))
    per = labels.join(m, ["dataset", "node_id"], "left").groupBy("dataset", "component").agg(F.sum(F.coalesce("_m", F.lit(0))).alias("n_matched"))
    both = size.join(per, ["dataset", "component"]).withColumn("cut", F.explode(F.array(*[F.lit(c) for c in cuts])))
    below = F.col("size") < F.col("cut")
    return both.groupBy("cut").agg(F.sum(F.when(below, F.col("size") - F.col("n_matched")).otherwise(0)).alias("false_nodes"), F.sum(F.when(below, F.col("n_matched")).otherwise(0)).alias("true_nodes"))


def broken_shapes(fates: DataFrame, truth: DataFrame, truth_edges: DataFrame, links: DataFrame) -> DataFrame:
    """What the tracker did instead of each true edge that it lost: dataset, source_id, target_id, shape, by the first rule that holds.

    Ends that weren't detected; a dividing parent; a frame gap other than one; ends linked elsewhere; or both free.
    """
    lost = fates.filter("fate != 'CORRECT'")
    at = lambda c: truth.select("dataset", F.col("node_id").alias(c), F.col("t").alias(f"_t_{c}"))
    forks = truth_edges.groupBy("dataset", "source_id").agg((F.count(F.lit(1)) > 1).alias("_fork"))
    so = links.select("dataset", F.col("source_id").alias("pred_source")).distinct().withColumn("_so", F.lit(True))
    ti = links.select("dataset", F.col("target_id").alias("pred_target")).distinct().withColumn("_ti", F.lit(True))
    j = lost.join(forks, ["dataset", "source_id"], "left").join(at("source_id"), ["dataset", "source_id"]).join(at("target_id"), ["dataset", "target_id"])
    j = j.join(so, ["dataset", "pred_source"], "left").join(ti, ["dataset", "pred_target"], "left")
    s, t = F.col("pred_source").isNull(), F.col("pred_target").isNull()
    shape = F.when(s & t, "both_missing").when(s, "source_missing").when(t, "target_missing").when(F.col("_fork"), "division_parent").when(F.col("_t_target_id") - F.col("_t_source_id") != 1, "frame_gap")
    shape = shape.when(F.col("_so") & F.col("_ti"), "swapped").when(F.col("_so"), "source_taken").when(F.col("_ti"), "target_taken").otherwise("unlinked")
    return j.select("dataset", "source_id", "target_id", shape.alias("shape"))
