"""SimHash near-dedup by meeting in the middle of a Hamming ball.

Every distinct fingerprint emits each value within half the radius of itself. Two fingerprints within the radius emit a
value in common, so dealing the values to their places brings them together; neighbours at a place are verified and
become edges, and components of the edges are the groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.llm import bpe
from tracelace.operators.components import components
from tracelace.storage import Scratch, scratch, written


def shingles(text: bytes, width: int) -> list[bytes]:
    """Shingles of ASCII-lower-cased words joined by a space; the whole sequence if it is shorter, none without words."""
    words = text.lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    joined = b" ".join(words)
    return [joined[s:e] for s, e in zip([0, *[e + 1 for e in ends[:-width]]], ends[width - 1 :], strict=True)]


def _majority(h: np.ndarray) -> int:
    """The signed number of the bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, width: int, longs: int = 1, seed: int = 42) -> list[int]:
    """The fingerprint as signed longs: a bit is set if over half of the shingles' XXH64 have it, repeats included.

    Each further long takes the majority of a bijection of the same hashes. Without words all bits are 0.
    """
    parts = shingles(text, width)
    if not parts:
        return [0] * longs
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))
    out = [_majority(h)]
    for _ in range(longs - 1):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        out.append(_majority(h ^ (h >> np.uint64(32))))
    return out


def fingerprints(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = ("doc_id",), longs: int = 1) -> DataFrame:
    """The carried columns and fp (with more than one long: f0, f1 and so on) of every row; a null text has no words and all bits 0."""
    names = ["fp"] if longs == 1 else [f"f{i}" for i in range(longs)]
    kinds = dict(docs.dtypes)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or b"", width, longs) for t in batch.column(len(carry)).cast(pa.binary()).to_pylist()]
            parts = [pa.array([f[i] for f in found], pa.int64()) for i in range(longs)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *parts], names=[*carry, *names])

    rows = docs.select(*carry, F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(of, ", ".join(f"`{c}` {kinds[c]}" for c in carry) + "".join(f", {n} long" for n in names))


def masks(reach: int, width: int = 64) -> list[int]:
    """Every signed 64-bit number with ``reach`` set bits at most among the lowest ``width``."""
    out = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in combinations(range(width), k)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) among distinct fingerprints ``fp`` that join every two within ``radius`` by a path of such edges.

    All that meet at a value are within the radius of each other, and there are few of them (65 for radius 2), however
    many documents share a fingerprint: so it is enough to link each to the next there. The radius must be even.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even")
    emitted = distinct.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in masks(radius // 2)])).alias("_at"))
    met = emitted.withColumn("a", F.lag("fp").over(W.partitionBy("_at").orderBy("fp"))).filter("a is not null")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= radius
    return met.filter(near).select("a", F.col("fp").alias("b")).distinct()


def grouped(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row: the least doc_id reachable over links, through any number of them.

    Copies share a fingerprint and count once from there on. Fingerprint 0 (no words) is linked like any other. Null ids
    belong to their group but don't name it; a group of them alone has a null component. Repeated rows stay. The groups'
    least ids are written before they are joined, so that Spark can split the join where a group is large.
    """
    rows = written(fingerprints(docs.select("doc_id", "text"), width), "fingerprints")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    edges = written(links(distinct.select("fp"), radius), "fingerprint-links")
    labels = components(edges, "a", "b").select(F.col("node").alias("fp"), "root")
    labelled = written(distinct.join(labels, "fp", "left"), "fingerprint-groups")
    roots = written(labelled.filter("root is not null").groupBy("root").agg(F.min("_least").alias("_all")), "fingerprint-roots")
    named = labelled.join(roots, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("_least")).otherwise(F.col("_all")).alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    return grouped(docs, width, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Counters of the sketch of shingles' frequencies, in blocks that are summed apart, and bits of the set of texts to verify.
COUNTERS, BLOCKS, PLACES = 1 << 20, 256, 1 << 24
#: Members of a place that are compared with each other in one piece.
PIECE = 256


def hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """The sorted set of the shingles' XXH64."""
    parts = shingles(text, width)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts)))


def _node(found: np.ndarray) -> int:
    """The signed name of a set of hashes: texts with equal sets share it."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).astype(np.int64))


def _parity(found: np.ndarray, bits: int = 512) -> list[int]:
    """Bits, each set if an odd number of hashes falls on it: no more of them differ than shingles are in one set alone."""
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _wide(found: np.ndarray) -> list[int] | None:
    """Parities in about as many bits as there are shingles, for texts whose 512 bits would be crowded."""
    return _parity(found, 1 << (len(found) - 1).bit_length()) if len(found) > 512 else None


def _differing(a: Column, b: Column) -> Column:
    """In how many bits two arrays of longs differ; one of twice the other's length is folded first. None if they can't be compared."""

    def folded(x: Column) -> Column:
        return F.transform(F.slice(x, 1, (F.size(x) / 2).cast("int")), lambda v, i: v.bitwiseXOR(F.get(x, i + (F.size(x) / 2).cast("int"))))

    left = F.when(F.size(a) == 2 * F.size(b), folded(a)).otherwise(a)
    right = F.when(F.size(b) == 2 * F.size(a), folded(b)).otherwise(b)
    return F.when(F.size(left) == F.size(right), F.aggregate(F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x))


def _frequencies(texts: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle, by the lowest bits of its hash: for the order of shingles only, in which any number will do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        held = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                np.add.at(held, (hashes(t or b"", width) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
        if held.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(held, BLOCKS)], pa.binary())], names=["block", "held"])

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("held").to_pylist())
        return pa.table({"block": group.column("block")[:1].combine_chunks(), "held": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for block, held in texts.mapInArrow(count, "block int, held binary").groupBy("block").applyInArrow(summed, "block int, held binary").collect():
        out[block] = np.frombuffer(bytes(held), np.int64)
    return out.reshape(-1)


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id and component of every row, under links between all texts whose sets of shingles have the Jaccard similarity.

    Two sets of n and m shingles that are alike share s / (1 + s) (n + m) of them at least. So in one order of all shingles,
    rare ones first, the first that they share has so many from it on in both; a text is placed at each of its shingles
    that leaves s n from it on. All pairs that can be alike meet; passages that many texts share come last in the order
    and place no text that has enough of its own. First texts whose fingerprints (of the set) meet in a ball are verified.
    What they don't join goes on: each text at a place is verified against the first one there, which joins most of a large
    group by few pairs; then all that aren't joined yet are, in pieces where a place is crowded.
    Verified are the sets themselves, and their hashes are fetched only for pairs whose parities don't rule them out.
    Texts with equal sets count once, and those without words (null, empty) are one group. Null ids and repeated rows keep
    their rows. No rows give none. Nothing is left to chance but that two shingles share 64 bits.
    """
    with scratch(docs.sparkSession) as keep:
        return written(_near_copies(docs, width, Fraction(str(similarity)), keep), "near-groups")


def _near_copies(docs: DataFrame, width: int, share: Fraction, keep: Scratch) -> DataFrame:
    spark = docs.sparkSession
    top, low = share.numerator, share.denominator
    texts = docs.select(F.col("text").cast("string").alias("_text"))
    order = spark.sparkContext.broadcast(_frequencies(texts, width))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        often = order.value
        seen: set[int] = set()
        for batch in batches:
            nodes, sizes, first, odd, wide, prints = [], [], [], [], [], []
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                found = hashes(t or b"", width)
                n, node = len(found), _node(found)
                nodes.append(node)
                sizes.append(n)
                if node in seen:
                    rows = (None, None, None, None)
                else:
                    seen.add(node)
                    rank = np.lexsort((found, often[(found & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                    rows = (found[rank[: n - -(-top * n // low) + 1]].view(np.int64) if n else found.view(np.int64), _parity(found), _wide(found), _majority(found))
                for column, value in zip((first, odd, wide, prints), rows, strict=True):
                    column.append(value)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(first, longs), pa.array(odd, longs), pa.array(wide, longs), pa.array(prints, pa.int64())], names=["doc_id", "node", "n", "first", "odd", "wide", "fp"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, node long, n int, first array<long>, odd array<long>, wide array<long>, fp long"
    rows = keep(docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(place, schema), "rows")
    # a text's copies in one task are placed once; those of other tasks meet at the same places and count once there
    posted = rows.filter("first is not null").select("node", "n", F.posexplode("first").alias("_i", "_at"))
    posted = posted.select("_at", "node", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("n") - F.col("_i")).alias("_nr"))
    here = W.partitionBy("_at")
    size, rest = F.shiftright("_nr", 32), F.col("_nr").bitwiseAND(F.lit((1 << 32) - 1))
    # of a pair at a place, the smaller text has at least 2 s / (1 + s) of its shingles from there on
    leads = F.when((top + low) * rest >= 2 * top * size, F.struct("node", "_nr"))
    crowd = posted.withColumn("_lead", F.min(leads).over(here)).withColumn("_a", F.min("node").over(here)).withColumn("_b", F.max("node").over(here)).filter("_a != _b and _lead is not null")
    shared = crowd.select("_at", "node", size.alias("n"), rest.alias("_rest"), F.col("_lead.node").alias("_l"), F.shiftright("_lead._nr", 32).alias("_ln"), F.col("_lead._nr").bitwiseAND(F.lit((1 << 32) - 1)).alias("_lrest"))
    shared = keep(shared.dropDuplicates(["_at", "node"]), "places")
    known = keep(rows.filter("first is not null").select("node", "n", "odd", "wide", "fp").dropDuplicates(["node"]), "known")
    rows = keep(rows.select("doc_id", "node"), "ids")
    keep.drop("rows")

    def can(n: Column, rest: Column, m: Column, left: Column) -> Column:
        return (top + low) * F.least(rest, left) >= top * (n + m)

    def bound(differ: Column, n: Column, m: Column) -> Column:
        return (top + low) * differ.cast("long") <= (low - top) * (n.cast("long") + m.cast("long"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct pairs (node, other) whose sets are alike."""
        mine, theirs = known.select("node", "n", "odd", "wide"), known.select(*[F.col(c).alias(f"o{c}") for c in ("node", "n", "odd", "wide")]).withColumnRenamed("onode", "other")
        near = pairs.join(mine, "node").join(theirs, "other").filter(bound(_differing(F.col("odd"), F.col("oodd")), F.col("n"), F.col("on")))
        near = keep(near.filter(F.coalesce(bound(_differing(F.col("wide"), F.col("owide")), F.col("n"), F.col("on")), F.lit(True))).select("node", "other"), f"{name}-near")
        bits = near.select(F.explode(F.array("node", "other")).alias("_b")).select(F.col("_b").bitwiseAND(F.lit(PLACES - 1)).alias("_b")).distinct()
        asked = np.zeros(PLACES // 64, np.int64)
        for at, b in bits.groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_b").bitwiseAND(F.lit(63)).cast("int")))).collect():
            asked[at] = b
        wanted = spark.sparkContext.broadcast(asked)

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bpe.forget()
            asked = wanted.value.view(np.uint8)
            seen: set[int] = set()
            for batch in batches:
                nodes, out = [], []
                for t in batch.column(0).cast(pa.binary()).to_pylist():
                    found = hashes(t or b"", width)
                    node = _node(found)
                    at = node & (PLACES - 1)
                    if asked[at >> 3] >> (at & 7) & 1 and node not in seen:
                        seen.add(node)
                        nodes.append(node)
                        out.append(found.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["node", "_set"])

        found = keep(texts.mapInArrow(sets, "node long, _set array<long>").dropDuplicates(["node"]), f"{name}-sets")
        both = F.size(F.array_intersect("_set", "_other"))
        alike = low * both.cast("long") >= top * (F.size("_set") + F.size("_other") - both).cast("long")
        out = keep(near.join(found, "node").join(found.select(F.col("node").alias("other"), F.col("_set").alias("_other")), "other").filter(alike).select("node", "other"), f"{name}-edges")
        keep.drop(f"{name}-sets")
        return out

    # sets whose fingerprints meet in a ball come first; what they join isn't compared again
    least = keep(known.groupBy("fp").agg(F.min("node").alias("_least")), "fingerprints")
    at = lambda end, name: least.select(F.col("fp").alias(end), F.col("_least").alias(name))
    balls = links(least.select("fp")).join(at("a", "node"), "a").join(at("b", "other"), "b").select("node", "other")
    balls = balls.union(known.join(least, "fp").filter("node != _least").select("node", F.col("_least").alias("other")))
    balls = verified(keep(balls, "balls"), "balls")
    joined = components(balls, "node", "other").select("node", "root")
    stars = shared.filter((F.col("node") != F.col("_l")) & can(F.col("n"), F.col("_rest"), F.col("_ln"), F.col("_lrest")))
    stars = stars.select("node", F.col("_l").alias("other")).distinct().join(joined, "node", "left").join(joined.select(F.col("node").alias("other"), F.col("root").alias("_o")), "other", "left")
    stars = stars.filter(F.coalesce("root", "node") != F.coalesce("_o", "other")).select("node", "other")
    edges = balls.union(verified(keep(stars, "stars"), "stars"))
    labels = components(edges, "node", "other").select("node", "root")
    marked = shared.select("_at", "node", "n", "_rest").join(labels, "node", "left").select("_at", "node", "n", "_rest", F.coalesce("root", "node").alias("_mark"))
    apart = marked.withColumn("_least", F.min("_mark").over(here)).withColumn("_most", F.max("_mark").over(here)).filter("_least != _most").drop("_least", "_most")
    odd = [f"_b{i}" for i in range(8)]
    apart = apart.join(known.select("node", *[F.get("odd", F.lit(i)).alias(c) for i, c in enumerate(odd)]), "node")
    dealt = apart.withColumn("_piece", F.floor((F.row_number().over(here.orderBy("node")) - 1) / PIECE)).withColumn("_last", F.max("_piece").over(here))
    dealt = keep(dealt, "pieces")
    mine = dealt.withColumn("_to", F.explode(F.sequence("_piece", "_last"))).select("_at", F.col("_piece").alias("_from"), "_to", "node", "n", "_rest", "_mark", *odd)
    theirs = dealt.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), "_piece"))).select("_at", "_from", F.col("_piece").alias("_to"), *[F.col(c).alias(f"o{c}") for c in ("node", "n", "_rest", "_mark", *odd)])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"o{c}"))) for c in odd[1:]), F.bit_count(F.col("_b0").bitwiseXOR(F.col("o_b0"))))
    met = mine.join(theirs, ["_at", "_from", "_to"]).filter((F.col("node") < F.col("onode")) & (F.col("_mark") != F.col("o_mark")) & can(F.col("n"), F.col("_rest"), F.col("on"), F.col("o_rest")))
    pairs = keep(met.filter(bound(differ, F.col("n"), F.col("on"))).select("node", F.col("onode").alias("other")).distinct(), "pairs")
    labels = components(edges.union(verified(pairs, "pairs")), "node", "other")
    return rows.join(labels, "node", "left").select("doc_id", F.coalesce("root", "node").alias("component"))


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the near copies of a document with a smaller id; rows alike in id and text stay once.

    Rows with a null id can't be named and stay. What is joined to the texts is the ids to go, which is the smaller side.
    """
    groups = near_copies(docs, width, similarity)
    least = written(groups.groupBy("component").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).filter("_n > 1"), "near-least")
    gone = groups.join(least, "component").filter("doc_id != _keep").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    again = written(groups.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("__again")), "near-repeated")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(again, kept["doc_id"] == again["__again"], "left_anti").unionByName(once)
