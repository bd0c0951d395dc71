"""Mixing sources to target weights by hash-threshold histograms.

Words are summed by source and hash bucket, the bucket in which a source's budget ends is found from the running sums,
and only that bucket is split by the next bits of the hash. A row is then taken by comparing its hash with its source's
threshold; rows are never sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.llm.common import WORD, hex_bits, unused
from tracelace.storage import written

#: Bits of the hash that one histogram level reads, the levels of a row's id and text, and those of its place in the table.
BITS, DEPTH, TIES = 12, 3, 2


def _hash(seed: str) -> Column:
    """36 bits of a hash of a row's id and text, and 24 bits of one of its place in the table, which only rows alike in both need."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << BITS * TIES) - 1))
    return F.shiftleft(hex_bits(F.md5(key.cast("binary")), BITS * DEPTH // 4), BITS * TIES).bitwiseOR(place)


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size (words) and hash h of every row; null texts have size 0. Written once, as each histogram level reads it."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), _hash(seed).alias("h"))


def targets(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, share: float = 1.0) -> DataFrame:
    """A row for each source: source, source_size, target.

    Sources by code point, null last, have the weights in turn. Targets are ``level * weight``, but ``most`` times the
    source's size at most: with sources in the order of size / weight, the level is the first at which a source isn't
    above its limit; that is where sharing the excess again and again ends. The windows here run over one row a source.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = by_source.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", w)
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = [F.col("_cap") / F.col("_w"), F.col("_rank")]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*order).rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    stepped = ranked.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(onward))
    stepped = stepped.withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    level = F.min_by(F.when(F.col("_open"), F.col("_level")), F.when(F.col("_open"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))).over(everything)
    return stepped.withColumn("_at", level).select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_at") * F.col("_w"))).alias("target"))


def thresholds(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` with ``full`` (how often each row is taken whole) and ``below``: rows with h < below are taken once more.

    The last, finest bucket is taken if that comes nearer to the budget. Each level's table has a row for a source and
    bucket, and is written before the next one reads it; the hot source's rows meet no more than its bucket sums. Levels
    end when no source's boundary bucket has two rows.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    at = wanted.withColumn("full", whole).withColumn("_left", F.col("target") - F.col("full") * F.col("source_size"))
    at = written(at.withColumn("_prefix", F.lit(0).cast("long")), "mix-level")
    last = DEPTH + TIES
    for depth in range(1, last + 1):
        width = BITS * (last - depth)
        level = rows.withColumn("_b", F.shiftright("h", width))
        if depth > 1:
            level = level.join(at.select(F.col("source").alias("_s"), F.col("_prefix").alias("_p")), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_b", BITS) == F.col("_p")), "left_semi")
        sums = level.groupBy("source", "_b").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        run = W.partitionBy("source").orderBy("_b").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = sums.withColumn("_upto", F.sum("_sum").over(run)).select(F.col("source").alias("_s"), "_b", "_sum", "_upto", "_n")
        met = at.select("source", "_left").join(sums, F.col("source").eqNullSafe(F.col("_s")), "left")
        over = F.col("_upto") > F.col("_left")
        ends = met.groupBy(F.col("source").alias("_s")).agg(F.min(F.when(over, F.struct("_b", (F.col("_upto") - F.col("_sum")).alias("before"), F.col("_upto").alias("after"), "_n"))).alias("_e"))
        at = at.join(ends, F.col("source").eqNullSafe(F.col("_s")), "left")
        at = at.withColumn("_stop", F.coalesce("_e._b", F.shiftleft(F.col("_prefix") + (0 if depth > 1 else 1), BITS)))
        nearer = F.col("_e").isNotNull() & (F.col("_e.after") - F.col("_left") < F.col("_left") - F.col("_e.before"))
        below = F.shiftleft(F.col("_stop") + nearer.cast("long"), width)
        left = F.col("_left") - F.coalesce(F.col("_e.before"), F.lit(0))
        at = written(at.select("source", "source_size", "target", "full", left.alias("_left"), F.col("_stop").alias("_prefix"), below.alias("below"), F.coalesce("_e._n", F.lit(0)).alias("_n")), "mix-level")
        if depth == last or (depth >= DEPTH and at.filter("_n > 1").isEmpty()):
            break
        at = at.drop("below", "_n")
    return at.select("source", "source_size", "target", "full", "below")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row: taken is size times the number of times the mix takes it.

    A null source is a source of its own. Empty or null texts have size 0 and add nothing; long ones count whole. Of rows
    alike in id and text as many are taken as the target asks, in the order of a hash of their places. Extra columns are
    left aside. An empty table gives none.
    """
    rows = written(sized(docs), "mix-sizes")
    cut = thresholds(rows, written(targets(rows, weights, most), "mix-targets")).withColumnRenamed("source", "_s")
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("_s")))
    times = F.least(F.col("full") + (F.col("h") < F.col("below")).cast("long"), F.lit(int(most)))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """``docs`` as the mix has it: each row as often as it is taken, none to ``most`` times. Texts aren't shuffled by source.

    Rows of every kind count as in ``mix``; columns of any name pass. ``docs`` should be a table as it is stored: of rows
    alike in id and text, those taken are told by their places there.
    """
    source, full, below, h, copy = (unused(docs, f"__{c}") for c in ("source", "full", "below", "h", "copy"))
    rows = written(sized(docs), "mix-sizes")
    cut = thresholds(rows, written(targets(rows, weights, most), "mix-targets")).select("source", "full", "below").toDF(source, full, below)
    joined = docs.withColumn(h, _hash("mix")).join(cut, F.col("source").cast("string").eqNullSafe(F.col(source)))
    times = F.least(F.col(full) + (F.col(h) < F.col(below)).cast("long"), F.lit(int(most))).cast("int")
    return joined.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), times)).alias(copy)).drop(copy)


SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, {BITS * DEPTH // 4}))::BIGINT AS h
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][((rk - 1) % 3 + 1)::INTEGER]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM r),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM w),
t AS (SELECT source, source_size, coalesce(least(cap, (SELECT lv FROM l WHERE lv * w <= cap ORDER BY cap / w, rk LIMIT 1) * w), cap) AS target FROM l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS ful FROM t),
g AS (SELECT d.*, f.source_size, f.target, f.ful, f.target - f.ful * f.source_size AS lef,
  sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto, size AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
x AS (SELECT *, CASE WHEN upto <= lef THEN 1 WHEN upto - own > lef THEN 0 WHEN upto - lef < lef - (upto - own) THEN 1 ELSE 0 END AS more FROM g)
SELECT doc_id, size, source_size, target, (size * least(ful::BIGINT + more, 3))::BIGINT AS taken, least(ful::BIGINT + more, 3)::BIGINT AS times FROM x"""
