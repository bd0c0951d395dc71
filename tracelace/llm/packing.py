"""Best-fit packing, certified by bounds.

Items are dealt to partitions by a hash. Each partition is packed by best-fit decreasing, and dual-feasible functions
give a number of bins that no packing of it can go below. Where the two meet, the partition is done; the items of the
other partitions are dealt anew and packed again, and the new packing is taken where it needs fewer bins.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.llm import bpe
from tracelace.storage import written

#: A worker keeps the ids of at most so many words, none of them longer than LONGEST bytes: some 120 MB.
MOST, LONGEST = 600_000, 64
#: Texts taken from a batch at a time, and words encoded in one string.
AT_ONCE, JOINED = 1024, 512


class Encoder:
    """Token ids of texts whose tokenizer drops white space and letter case, word by word through a cache, in one worker."""

    def __init__(self, tokenizer_path: str, most: int = MOST):
        self.tokenizer = bpe.load(tokenizer_path)
        self.cache: dict[bytes, bytes] = {}
        self.most = most

    def _look(self, words: set[bytes]) -> None:
        """Ids of new words. A word that ends in stops is its stem's ids and the stops' own: the tokenizer cuts between an ASCII letter and a stop."""
        cache = self.cache
        new: set[bytes] = set()
        made: list[tuple[bytes, bytes, bytes]] = []
        for w in words:
            low = w if b"<|" in w else w.lower()
            stem = low.rstrip(b".,!?")
            if stem != low and not stem[-1:].isalnum():
                stem = low
            if stem == w:
                new.add(w)
                continue
            stops = low[len(stem) :]
            made.append((w, stem, stops))
            if stem not in cache:
                new.add(stem)
            if stops not in cache:
                new.add(stops)
        each = list(new)
        cache.update(zip(each, bpe.encode_each(self.tokenizer, each, at_once=JOINED), strict=True))
        for w, stem, stops in made:
            cache[w] = cache[stem] + cache[stops]

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        cache = self.cache
        for i in range(0, len(texts), 128):
            if len(cache) > self.most:
                cache.clear()
            cut = [t.split() for t in texts[i : i + 128]]
            got = [list(map(cache.get, c)) for c in cut]
            holes: list[tuple[int, int]] = []
            for d, g in enumerate(got):
                at = -1
                for _ in range(g.count(None)):
                    at = g.index(None, at + 1)
                    holes.append((d, at))
            missed = {cut[d][at] for d, at in holes}
            self._look(missed)
            for d, at in holes:
                got[d][at] = cache[cut[d][at]]
            yield from map(b"".join, got)
            if any(len(w) > LONGEST for w in missed):
                for w in [w for w in cache if len(w) > LONGEST]:
                    del cache[w]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, most: int = MOST) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32: each document's ids and ``end_id``, cut only where longer than ``capacity``.

    A null or empty text is the end id alone, so every row gives one piece at least; null ids and repeated rows have pieces
    of their own; long texts are encoded whole; extra columns are left aside; no rows give none. ``most``: the words that a
    worker keeps, which changes the speed and memory only.
    """
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.of_worker(("ids", tokenizer_path, most), lambda: Encoder(tokenizer_path, most))
        for whole in batches:
            for batch in (whole.slice(i, AT_ONCE) for i in range(0, whole.num_rows, AT_ONCE)):
                texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
                rows: list[tuple[int, int, int, int, int]] = []
                for i, ids in enumerate(encoder.of(texts)):
                    ids += end
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((i, p, at // 4, len(part) // 4, zlib.crc32(part)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return rows.mapInArrow(encode, f"doc_id {dict(rows.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing of sizes in falling order: each item's bin and offset, and the number of bins.

    Open bins stand in stacks by the room that is left; one integer has a bit for each stack that isn't empty, so the
    tightest bin for an item is the lowest bit at or above its size.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    mask, n = 0, 0
    for i, size in enumerate(sizes.tolist()):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            at = stacks[room].pop()
            if not stacks[room]:
                mask &= ~(1 << room)
        else:
            at, room, n = n, capacity, n + 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            stacks[left].append(at)
            mask |= 1 << left
    return bins, offsets, n


def lower_bound(sizes: np.ndarray, capacity: int, ks: int = 64) -> int:
    """No packing has fewer bins: the best of two families of dual-feasible functions.

    For a threshold t, sizes above capacity - t count as whole bins and those below t as nothing; for k, sizes are
    rounded down to multiples of 1 / k of a bin unless (k + 1) times the size is a multiple of a bin.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.concatenate([[0], np.cumsum(count * x)]), np.concatenate([[0], np.cumsum(count)])
    t = np.arange(1, capacity // 2 + 1)
    middle = mass[capacity - t + 1] - mass[t]
    whole = number[capacity + 1] - number[capacity - t + 1]
    best = max(-(-int(mass[-1]) // capacity), int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, ks + 1):
        scaled = (k + 1) * x
        even = scaled % capacity == 0
        # in units of 1 / (k * capacity) of a bin
        units = np.where(even, k * x, scaled // capacity * capacity)
        best = max(best, -(-int((units * count).sum()) // (k * capacity)))
    return best


def pack(items: DataFrame, capacity: int = 4096, size: str = "length", order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32"), part_items: int = 50_000) -> DataFrame:
    """``items`` with sequence_id and offset: no sequence holds more than ``capacity``.

    ``items`` is read more than once and must be a written table. A partition has about ``part_items`` items, whatever the
    input: they are dealt by a hash of ``order`` and of their places in the table, so that items alike are spread.
    Partitions with a gap between their packing and its bound exchange items and are packed anew, again and again, until
    that saves no sequence. No items, no rows.
    """
    n = items.count()
    columns = items.columns
    schema = ", ".join(f"`{c}` {k}" for c, k in items.dtypes)

    def run(rows: DataFrame, number: int, parts: int) -> DataFrame:
        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([size, *order], ascending=[False] + [True] * len(order), kind="stable", na_position="first")
            sizes = pdf[size].to_numpy(np.int64)
            bins, offsets, used = best_fit(sizes, capacity)
            part = int(pdf["_part"].iloc[0])
            pdf["sequence_id"] = (number << 52) + (part << 26) + bins
            pdf["offset"] = offsets
            pdf["_gap"] = used > lower_bound(sizes, capacity)
            return pdf[[*columns, "sequence_id", "offset", "_gap"]]

        dealt = rows.select(*columns, F.pmod(F.xxhash64(F.lit(number), F.monotonically_increasing_id(), *order), F.lit(parts)).alias("_part"))
        return dealt.groupBy("_part").applyInPandas(fit, f"{schema}, sequence_id long, offset long, _gap boolean")

    done = written(run(items, 0, max(1, math.ceil(n / part_items))), "packed")
    number = 0
    while True:
        open_rows = done.filter("_gap")
        left = open_rows.agg(F.count(F.lit(1)), F.countDistinct("sequence_id")).first()
        if left is None or left[0] == 0:
            break
        number += 1
        again = written(run(open_rows, number, max(1, math.ceil(left[0] / part_items))), "packed-again")
        fewer = again.agg(F.countDistinct("sequence_id")).first()
        if fewer is None or fewer[0] >= left[1]:
            break
        done = done.filter("not _gap").unionByName(again)
    return done.drop("_gap")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, most: int = MOST) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document, under the rules of ``pieces`` and ``pack``."""
    return pack(written(pieces(docs, tokenizer_path, capacity, most=most), "pieces"), capacity)
