"""Sharding: a hierarchical weighted hash tree.

A row descends region, rack and shard by weighted draws: at each node every child draws ln(u) / weight, u being
uniform and given by the row's key and the child's path alone, and the largest draw wins. A child's draw changes
only with its own weight, so a changed weight moves rows only at the nodes above it: between the subtree whose weight
changed and its siblings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracelace.llm.common import hex_bits, let
from tracelace.storage import written

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Node:
    """A subtree. ``path`` is what the draws hash, so it must stay the same while weights change."""

    path: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None


def leaf(path: str, shard: int, weight: float = 1.0) -> Node:
    return Node(path, float(weight), (), shard)


def inner(path: str, children: Sequence[Node]) -> Node:
    return Node(path, math.fsum(c.weight for c in children), tuple(children))


def topology(shards: int, shards_per_rack: int = 4, racks_per_region: int = 2, weights: Sequence[float] | None = None) -> Node:
    """Shards 0 to ``shards`` - 1 dealt to racks and racks to regions in order.

    A shard more than a multiple of ``shards_per_rack * racks_per_region`` opens a region of its own, so that the
    regions there were keep their weights and every row that moves goes to the new shard.
    """
    weights = [1.0] * shards if weights is None else list(weights)
    if shards < 1 or len(weights) != shards or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("a tree needs a non-negative weight for each shard, and one above 0")
    per_region = shards_per_rack * racks_per_region
    regions = []
    for r in range(0, shards, per_region):
        racks = []
        for k in range(r, min(r + per_region, shards), shards_per_rack):
            path = f"{r // per_region}/{(k - r) // shards_per_rack}"
            racks.append(inner(path, [leaf(f"{path}/{s}", s, weights[s]) for s in range(k, min(k + shards_per_rack, shards))]))
        regions.append(inner(f"{r // per_region}", racks))
    return inner("", regions)


def draw(key: Column, path: Column, weight: Column) -> Column:
    """ln(u) / weight with u in (0, 1) from 52 bits of md5(key:path)."""
    u = (hex_bits(F.md5(F.concat(key, F.lit(":"), path).cast("binary")), 13).cast("double") + F.lit(0.5)) / F.lit(2.0**52)
    return F.ln(u) / weight


def chosen(key: Column, node: Node) -> Column:
    """The shard at which ``key`` arrives from ``node``: nested choices, each evaluated only where it is reached."""
    children = [c for c in node.children if c.weight > 0]
    if not children:
        return F.lit(node.shard).cast("int")
    if len(children) == 1:
        return chosen(key, children[0])
    options = F.array(*[F.struct(F.lit(c.path).alias("path"), F.lit(c.weight).alias("weight"), F.lit(i).alias("i")) for i, c in enumerate(children)])
    winner = F.array_max(F.transform(options, lambda o: F.struct(draw(key, o["path"], o["weight"]).alias("d"), (-o["i"]).alias("i"))))["i"]
    if all(c.shard is not None for c in children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in children]), F.lit(1) - winner)
    return let(winner, lambda won: _by(won, key, children))


def _by(won: Column, key: Column, children: Sequence[Node]) -> Column:
    out = F.when(won == 0, chosen(key, children[0]))
    for i, c in enumerate(children[1:], 1):
        out = out.when(won == -i, chosen(key, c))
    return out


def key_of(ident: Column) -> Column:
    """A row's key as text; a null id has the key 'null', so that such rows all go to one shard."""
    return F.coalesce(ident.cast("string"), F.lit("null"))


#: Alike rows are listed again in runs of so many.
_RUN = 1 << 16


def place(df: DataFrame, ident: str, tree: Node, grown: Node | None = None, carry: Sequence[str] = (), bucket_rows: int = 100_000) -> DataFrame:
    """Rows of ``df`` with ``shard``, ``slot`` and, given a second tree, ``grown_shard``.

    ``slot`` numbers the rows of a shard from 0 without gaps, in the order of a 52-bit hash of the key and the carried
    columns. A shard is numbered in hash ranges of about ``bucket_rows`` rows, to whose numbers the counts of earlier
    ranges are added; no task holds a whole shard. Rows alike in id and carried columns are one row with a count until
    they are numbered, so their number doesn't matter, and each gets a slot of its own. A null id is a key like any other;
    rows with equal ids share a shard. ``_order``, ``_bucket`` and the like may be names of other columns of ``df``.
    """
    n = df.count()
    shards = max(1, sum(1 for _ in _leaves(tree)))
    buckets = max(1, math.ceil(n / bucket_rows / shards))
    alike = df.groupBy(F.col(ident), *carry).agg(F.count(F.lit(1)).alias("_n"))
    key = key_of(F.col(ident))
    placed = alike.select(
        ident,
        *carry,
        "_n",
        chosen(key, tree).alias("shard"),
        (chosen(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        hex_bits(F.md5(F.concat_ws(":", F.lit("slot"), key, *[F.col(c).cast("string") for c in carry]).cast("binary")), 13).alias("_order"),
    )
    out = written(placed.withColumn("_bucket", F.floor(F.col("_order") / F.lit(2.0**52) * F.lit(buckets)).cast("int")), "shard-rows")
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = out.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all")).select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_bucket").orderBy("_order", ident, *carry).rowsBetween(W.unboundedPreceding, -1)
    numbered = out.withColumn("_row", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["shard", "_bucket"])
    runs = numbered.select(ident, *carry, "shard", "grown_shard", "_n", (F.col("_start") + F.col("_row")).alias("_first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(_RUN).cast("long"))).alias("_from"))
    each = F.explode(F.sequence("_from", F.least(F.col("_from") + _RUN, F.col("_n")) - 1))
    return runs.withColumn("_k", each).select(ident, *carry, "shard", (F.col("_first") + F.col("_k")).cast("long").alias("slot"), "grown_shard")


def _leaves(node: Node):
    if node.shard is not None:
        yield node
    for c in node.children:
        yield from _leaves(c)


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of documents: size is the UTF-8 bytes of the text (null: none) plus 1, law is 'key'. An empty table gives none."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = place(sized, "doc_id", topology(shards), topology(shards + 1), carry=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_shard(tree: Node, name: str) -> str:
    """A CTE that takes each row of d through the tree, one level of nodes at a time."""
    nodes = []

    def walk(n: Node) -> None:
        for i, c in enumerate(n.children):
            nodes.append(f"('{n.path}', '{c.path}', {c.weight!r}, {i}, {c.shard if c.shard is not None else 'NULL'})")
            walk(c)

    walk(tree)
    ctes = [f"{name}_nodes(parent, path, weight, i, shard) AS (VALUES {', '.join(nodes)})", f"{name}_0 AS (SELECT r, k, '' AS path, NULL AS shard FROM d)"]
    for level in range(len(LEVELS)):
        u = f"ln((('0x' || substr(md5(k || ':' || n.path), 1, 13))::BIGINT::DOUBLE + 0.5) / {2.0**52!r}) / n.weight"
        ctes.append(f"{name}_{level + 1} AS (SELECT r, k, arg_max(n.path, {u}) AS path, arg_max(n.shard, {u}) AS shard FROM {name}_{level} p JOIN {name}_nodes n ON n.parent = p.path GROUP BY r, k)")
    return ", ".join(ctes)


def sql(shards: int = 16) -> str:
    """DuckDB SQL for shard_documents, with crc32 spelled out over the bytes."""
    return f"""
WITH RECURSIVE bits(b, c, k) AS (
  SELECT range, range::UBIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), tab AS (SELECT list(c ORDER BY b) AS t FROM bits WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, 'null') AS k FROM documents),
summed AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(h, 1 + 2 * i, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM (SELECT r, text, hex(encode(text)) AS h FROM d), tab
),
{_sql_shard(topology(shards), 'a')}, {_sql_shard(topology(shards + 1), 'b')}
SELECT d.doc_id, (strlen(d.text) + 1)::BIGINT AS size, summed.crc AS text_crc32, 'key' AS law, a_3.shard::INTEGER AS shard,
  (row_number() OVER (PARTITION BY a_3.shard ORDER BY ('0x' || substr(md5('slot:' || d.k || ':' || (strlen(d.text) + 1) || ':' || summed.crc), 1, 13))::BIGINT, d.doc_id NULLS FIRST, strlen(d.text), summed.crc) - 1)::BIGINT AS slot,
  b_3.shard::INTEGER AS grown_shard
FROM d JOIN summed USING (r) JOIN a_3 USING (r) JOIN b_3 USING (r)"""
