"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Rows are put in one order and cut into chunks of a bounded size along it. A chunk sends the distinct hashes of its
windows, as sorted blocks, to the hash ranges they fall in; there a hash that an earlier chunk has sent too is sent back
to every later chunk. A chunk then knows which of its windows began earlier, elsewhere or within itself, and merges them
into maximal removal intervals. Texts are shuffled once (deflated), hashes once, and repeated hashes once more.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.llm.common import WORD
from tracelace.storage import written

#: Two polynomials' bases (odd, so that they have inverses modulo 2 to the 64th).
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: A chunk's bytes of text, at least and at most, and the hashes of one range. A block has fewer hashes as the input
#: grows (some 130 at 1 TB), so beyond that executors with more memory should take larger ranges.
LEAST_CHUNK, MOST_CHUNK, RANGE_HASHES = 4 << 20, 32 << 20, 4_000_000


class _Words(dict):
    """64-bit hashes of words, kept for the chunk at hand."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = xxhash.xxh64_intdigest(word, 20)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _rolled(h: np.ndarray, window: int, base: int) -> np.ndarray:
    """The sum of h(x_k) * base^(window - 1 - k) modulo 2 to the 64th for every run of ``window`` numbers, from running sums of h(x_i) * base^-i."""
    powers = np.full(len(h), pow(base, -1, 1 << 64), np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(powers), dtype=np.uint64)])
    powers[1:] = base
    return (sums[window:] - sums[:-window]) * np.multiply.accumulate(powers)[window - 1 :]


def window_hashes(words: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places (in all words end to end) where a whole window starts within one document, its hash and its 32-bit check.

    The two come from polynomials of two bases over two hashes of the words, so windows that differ share both with a
    probability of about 2^-96: among the 10^13 windows of 100 TB some 10^-3 pairs are expected.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint32)
    cache = _Words()
    h = np.fromiter(map(cache.__getitem__, chain.from_iterable(words)), np.uint64, n)
    ends = np.cumsum(sizes)
    ok = np.ones(n, bool)
    for e, s in zip(ends.tolist(), sizes.tolist(), strict=True):
        ok[max(e - s, e - window + 1) : e] = False
    starts = np.flatnonzero(ok)
    first = _rolled(h, window, _BASES[0])[starts]
    second = _rolled(_mixed(h ^ np.uint64(_BASES[1])), window, _BASES[1])[starts]
    return starts, _mixed(first), (_mixed(second) >> np.uint64(32)).astype(np.uint32)


def ordered(hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by hash and check, and for each place in it whether the one before is the same window."""
    order = np.argsort(hashes, kind="stable")
    h, c = hashes[order], checks[order]
    if ((h[1:] == h[:-1]) & (c[1:] != c[:-1])).any():
        order = np.lexsort((checks, hashes))
        h, c = hashes[order], checks[order]
    return order, np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])]) if len(h) else np.empty(0, bool)


def block(hashes: np.ndarray, checks: np.ndarray) -> bytes:
    """Sorted windows as the eight byte planes of their hashes' differences, whose upper planes are mostly zeros for Spark's compression, and the checks."""
    return np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + checks.tobytes()


def unblock(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 12
    planes = np.frombuffer(data, np.uint8, 8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), np.frombuffer(data, np.uint32, n, 8 * n)


def intervals(covered: np.ndarray) -> np.ndarray:
    """Maximal runs of True as rows (start, end), end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
    return edges.reshape(-1, 2)


#: A row's place in the order: nulls first, then the id (a whole number as it is, another kind's 64-bit hash), then the text's hash.
_ORDER = ("_set", "_key", "_hash")
_PLACE = np.dtype([("s", "i8"), ("k", "i8"), ("h", "i8")])


def chunked(docs: DataFrame, ident: str, text: str, chunk_bytes: int | None = None) -> tuple[DataFrame, int, int]:
    """(_id, _text deflated, _times and the order's columns, _chunk), the number of chunks, and the number of words.

    Ids, text hashes and sizes alone are sorted by Spark; walking along them, each task begins a chunk wherever the one at
    hand is full. So far-off ids don't matter, and rows of one id (null, too) are split by their texts' hashes. Rows alike
    in id and text that would fill a chunk by themselves are reduced to one with the number of their ``_times``.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[ident]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    held = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.col(ident).cast("long") if whole else F.xxhash64(F.col(ident).cast("string"))
    rows = docs.select(F.col(ident).alias("_id"), held.alias("_text"), F.col(ident).isNotNull().cast("long").alias("_set"), F.coalesce(key, F.lit(0)).cast("long").alias("_key"), F.xxhash64(held).alias("_hash"))
    slim = written(rows.select(*_ORDER, F.octet_length("_text").cast("long").alias("_bytes"), F.regexp_count("_text", F.lit(WORD)).cast("long").alias("_words")), "window-sizes")
    total, words = (x or 0 for x in slim.agg(F.sum("_bytes"), F.sum("_words")).first())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = chunk_bytes or min(max(total // (4 * parts), LEAST_CHUNK), MOST_CHUNK)
    often = written(slim.groupBy(*_ORDER).agg(F.sum("_bytes").alias("_all"), F.count(F.lit(1)).alias("_times")).filter((F.col("_all") > size) & (F.col("_times") > 1)).drop("_all"), "window-often")
    hot = often.count()
    if hot:  # at most total / size of them
        once = rows.join(often, list(_ORDER), "left_semi").dropDuplicates(["_id", "_text"]).join(often, list(_ORDER))
        rows = rows.join(often, list(_ORDER), "left_anti").withColumn("_times", F.lit(1).cast("long")).unionByName(once)
        slim = slim.join(often, list(_ORDER), "left_anti").unionByName(slim.join(often, list(_ORDER), "left_semi").dropDuplicates(list(_ORDER)))
    else:
        rows = rows.withColumn("_times", F.lit(1).cast("long"))

    def cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled, last = None, None
        for batch in batches:
            at: list[int] = []
            places = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            for i, (place, more) in enumerate(zip(places, batch.column(3).to_pylist(), strict=True)):
                if filled is None or (filled and filled + more > size and place != last):
                    at.append(i)
                    filled = 0
                filled, last = filled + more, place
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in batch.columns[:3]], names=list(_ORDER))

    sorted_rows = slim.repartitionByRange(max(1, min(parts, total // size)), *_ORDER).sortWithinPartitions(*_ORDER)
    found = sorted_rows.mapInArrow(cuts, "_set long, _key long, _hash long").toArrow()  # a row a chunk
    bounds = np.sort(np.array(list(zip(*(found.column(c).to_pylist() for c in _ORDER), strict=True)), _PLACE), order=["s", "k", "h"])
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = np.empty(batch.num_rows, _PLACE)
            for name, column in zip(_PLACE.names, _ORDER, strict=True):
                places[name] = batch.column(column).to_numpy(zero_copy_only=False)
            chunk = np.searchsorted(shared.value, places, side="right") - 1
            packed = pa.array([zlib.compress(t, 1) for t in batch.column("_text").cast(pa.binary()).to_pylist()], pa.binary())
            columns = [packed if c == "_text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.maximum(chunk, 0).astype(np.int32))], names=[*batch.schema.names, "_chunk"])

    schema = ", ".join(f"{c} {'binary' if c == '_text' else k}" for c, k in rows.dtypes)
    return rows.mapInArrow(deal, schema + ", _chunk int"), max(1, len(bounds)), words


def deduplicated(docs: DataFrame, window: int = 20, ident: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """The id, n_words, removed (array of struct(start, end), in words, end exclusive) and kept_text of every row.

    A word goes if a window that covers it has words that also start earlier: in a smaller id, or earlier in the same
    document. Null ids come before all others, and ids that aren't whole numbers follow a hash of theirs; rows of one id
    are in the order of their texts' hashes, and rows alike in both are one document, listed as often as it was. A null or
    empty text has no words, a text of any length is read whole, extra columns are left aside, no rows give none. Windows
    are judged on the input.
    """
    rows, chunks, most = chunked(docs, ident, text, chunk_bytes)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(parts if most < parts * RANGE_HASHES else math.ceil(most / RANGE_HASHES), 4 * chunks + 4))
    bounds = np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64)
    id_type = rows.schema["_id"].dataType

    def send(table: pa.Table) -> pa.Table:
        words = [zlib.decompress(t).split() for t in table.column("_text").to_pylist()]
        _, hashes, checks = window_hashes(words, window)
        order, again = ordered(hashes, checks)
        hashes, checks = hashes[order][~again], checks[order][~again]
        cuts = [0, *np.searchsorted(hashes, bounds).tolist(), len(hashes)]
        full = [r for r in range(ranges) if cuts[r + 1] > cuts[r]]
        chunk = table.column("_chunk")[0].as_py()
        blocks = [block(hashes[cuts[r] : cuts[r + 1]], checks[cuts[r] : cuts[r + 1]]) for r in full]
        return pa.table({"_range": pa.array(full, pa.int32()), "_from": pa.array([chunk] * len(full), pa.int32()), "_block": pa.array(blocks, pa.binary())})

    def compare(table: pa.Table) -> pa.Table:
        sent = sorted(zip(table.column("_from").to_pylist(), table.column("_block").to_pylist(), strict=True))
        parts_of = [unblock(b) for _, b in sent]
        owner = np.repeat(np.arange(len(sent), dtype=np.int32), [len(h) for h, _ in parts_of])
        hashes, checks = np.concatenate([h for h, _ in parts_of]), np.concatenate([c for _, c in parts_of])
        order, again = ordered(hashes, checks)
        later = np.sort(order[again])
        cuts = np.searchsorted(owner[later], np.arange(len(sent) + 1))
        out = [(sent[i][0], block(hashes[at], checks[at])) for i in range(len(sent)) if len(at := later[cuts[i] : cuts[i + 1]])]
        return pa.table({"_chunk": pa.array([c for c, _ in out], pa.int32()), "_block": pa.array([b for _, b in out], pa.binary())})

    def cut(texts: pa.Table, repeats: pa.Table) -> Iterator[pa.RecordBatch]:
        raw = [zlib.decompress(t) for t in texts.column("_text").to_pylist()]
        ids, times = texts.column("_id").combine_chunks(), texts.column("_times").to_pylist()
        places = list(zip(*(texts.column(c).to_pylist() for c in _ORDER), raw, strict=True))
        order = sorted(range(len(raw)), key=places.__getitem__)
        same = [k > 0 and places[order[k - 1]] == places[i] for k, i in enumerate(order)]
        words = [[] if s else raw[i].split() for i, s in zip(order, same, strict=True)]
        starts, hashes, checks = window_hashes(words, window)
        by_hash, again = ordered(hashes, checks)
        gone = np.zeros(len(hashes), bool)
        gone[by_hash[again]] = True
        if repeats.num_rows and len(hashes):
            known = [unblock(b) for b in repeats.column("_block").to_pylist()]
            both = np.concatenate([*(h for h, _ in known), hashes]), np.concatenate([*(c for _, c in known), checks])
            n = len(both[0]) - len(hashes)
            mixed, repeated = ordered(*both)
            # a window stands after a known one if one of its run comes before all own ones
            run = np.cumsum(~repeated) - 1
            from_known = np.zeros(run[-1] + 1, bool)
            from_known[run[mixed < n]] = True
            own = mixed >= n
            gone[mixed[own] - n] |= from_known[run[own]]
        sizes = [len(w) for w in words]
        steps = np.zeros(sum(sizes) + 1, np.int32)
        np.add.at(steps, starts[gone], 1)
        np.add.at(steps, starts[gone] + window, -1)
        covered = np.cumsum(steps[:-1]) > 0
        out: list[tuple] = []
        at, held = 0, 0
        for k, i in enumerate(order):
            if same[k]:
                found = last
            else:
                own_words = covered[at : at + sizes[k]]
                at += sizes[k]
                removed = intervals(own_words).tolist() if own_words.any() else []
                kept, end = [], 0
                for a, b in removed:
                    kept += words[k][end:a]
                    end = b
                last = found = (sizes[k], removed, b" ".join(kept + words[k][end:]))
            out.append((i, times[i], *found))
            held += len(found[2])
            if held > 8 << 20:
                yield batch_of(ids, out)
                out, held = [], 0
        yield batch_of(ids, out)

    pair = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        columns = [
            ids.take(pa.array([x[0] for x in rows], pa.int64())),
            pa.array([x[1] for x in rows], pa.int64()),
            pa.array([x[2] for x in rows], pa.int64()),
            pa.array([[{"start": a, "end": b} for a, b in x[3]] for x in rows], pa.list_(pair)),
            pa.array([x[4] for x in rows], pa.binary()).cast(pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["_id", "_times", "n_words", "removed", "kept_text"])

    def cut_table(texts: pa.Table, repeats: pa.Table) -> pa.Table:
        return pa.Table.from_batches(cut(texts, repeats))

    # a task has four groups or so, however many there are
    rows = rows.repartition(max(parts, math.ceil(chunks / 4)), "_chunk")
    sent = rows.groupBy("_chunk").applyInArrow(send, "_range int, _from int, _block binary").repartition(max(parts, math.ceil(ranges / 4)), "_range")
    repeats = sent.groupBy("_range").applyInArrow(compare, "_chunk int, _block binary")
    schema = f"_id {id_type.simpleString()}, _times long, n_words long, removed array<struct<start:int,end:int>>, kept_text string"
    out = rows.groupBy("_chunk").cogroup(repeats.groupBy("_chunk")).applyInArrow(cut_table, schema)
    out = out.select("_id", "n_words", "removed", "kept_text", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_k"))
    return out.select(F.col("_id").alias(ident), "n_words", "removed", "kept_text")


def digest(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and removed of every row, under the rules of ``deduplicated``."""
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return deduplicated(docs, window).select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"), "removed")
