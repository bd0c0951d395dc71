"""Token counts by a map-side two-tier lookup.

A text is cut where white space follows other characters; no pre-token of a byte-level BPE crosses such a place, so the
counts of the runs (white space, then other characters) add up to the text's. The lengths of frequent runs are broadcast
as one compact table; what misses it is encoded by the tokenizer, many runs at a time, and kept in the worker's cache.
No run is ever shuffled, and the tables change nothing but the speed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.llm import bpe

#: White space beyond ASCII that the pre-tokenizer knows, as UTF-8 and as characters.
_WIDE_BYTES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE = "\t-\r \x85\xa0  -     　"
_RUN = re.compile(rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_WIDE_RUN = re.compile(f"[{_WIDE}]*[^{_WIDE}]+|[{_WIDE}]+")
#: Longer runs aren't kept, so that a cache of so many entries has a size that is known.
LONGEST, MOST = 48, 400_000


def runs(text: bytes) -> list[bytes]:
    """The runs of a text, whose concatenation it is."""
    if _WIDE_BYTES.search(text):
        return [x.encode() for x in _WIDE_RUN.findall(text.decode("utf-8", "replace"))]
    return _RUN.findall(text)


def packed(lengths: list[tuple[bytes, int]]) -> tuple[bytes, bytes, bytes]:
    """A table as three byte strings: the keys end to end, their sizes and their token counts (both below 256)."""
    kept = [(k, n) for k, n in lengths if len(k) <= LONGEST and n < 256]
    return b"".join(k for k, _ in kept), bytes(len(k) for k, _ in kept), bytes(n for _, n in kept)


def unpacked(table: tuple[bytes, bytes, bytes]) -> dict[bytes, int]:
    keys, sizes, counts = table
    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return {keys[a:b]: n for a, b, n in zip([0, *ends], ends, counts, strict=False)}


class Counts:
    """Token counts of texts, in one worker."""

    def __init__(self, tokenizer_path: str, table: tuple[bytes, bytes, bytes] = (b"", b"", b"")):
        self.tokenizer = bpe.load(tokenizer_path)
        self.first = unpacked(table)
        self.cache = dict(self.first)

    def encode(self, keys: list[bytes]) -> list[int]:
        return [len(ids) // 4 for ids in bpe.encode_each(self.tokenizer, keys)]

    def of(self, texts: list[bytes]) -> list[int]:
        out = []
        for i in range(0, len(texts), 256):
            cut = [runs(t) for t in texts[i : i + 256]]
            if len(self.cache) > MOST:
                self.cache = dict(self.first)
            missed = list(set().union(*cut).difference(self.cache))
            found = dict(zip(missed, self.encode(missed), strict=True))
            if found:
                self.cache.update(found)
            out += [sum(map(self.cache.__getitem__, c)) for c in cut]
            for k in found:
                if len(k) > LONGEST:
                    del self.cache[k]
        return out


def frequent(docs: DataFrame, text: str, tokenizer_path: str, sample_rows: int = 2_000, entries: int = 32_768) -> tuple[bytes, bytes, bytes]:
    """The commonest runs of a sample of about ``sample_rows`` rows with their lengths: at most ``entries`` of LONGEST bytes.

    The rows are drawn by a hash of the text. Each task counts its own and sends its commonest runs to the driver, at most
    ``entries`` a drawn row's task; no run is shuffled. A table of another sample gives the same counts, at another speed.
    """
    n = docs.count()
    step = max(1, n // sample_rows)
    drawn = docs.filter(F.col(text).isNotNull() & (F.pmod(F.xxhash64(text), F.lit(step)) == 0)).select(F.col(text).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                total.update(x for x in runs(t) if len(x) <= LONGEST)
                if len(total) > 4 * entries:
                    total = Counter(dict(total.most_common(2 * entries)))
        top = total.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], names=["k", "c"])

    met = drawn.mapInArrow(count, "k binary, c long").toArrow()
    total: Counter = Counter()
    for k, c in zip(met.column("k").to_pylist(), met.column("c").to_pylist(), strict=True):
        total[k] += c
    keys = [k for k, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:entries]]
    return packed(list(zip(keys, Counts(tokenizer_path).encode(keys), strict=True)))


def count_tokens(docs: DataFrame, tokenizer_path: str, ident: str = "doc_id", text: str = "text", limit: int = 512, table: tuple[bytes, bytes, bytes] | None = None) -> DataFrame:
    """The id, n_bytes, n_tokens and over_limit of every row; a null text is empty and has no tokens.

    Special strings inside texts count as the tokenizer's default has it. Rows are read in Arrow batches as they come: any
    number of repeated rows, null ids or clashing columns changes nothing. ``table``: of ``frequent``; by default made here.
    The cache of what the table lacks lives as long as its worker and serves all the tasks that run there.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frequent(docs, text, tokenizer_path) if table is None else table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.of_worker(("counts", tokenizer_path), lambda: Counts(tokenizer_path, shared.value))
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = np.array(counts.of(texts), np.int64)
            size = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=names)

    rows = docs.select(F.col(ident), F.col(text).cast("string").alias("_text"))
    names = [ident, "n_bytes", "n_tokens", "over_limit"]
    kind = dict(rows.dtypes)[ident]
    return rows.mapInArrow(count, f"`{ident}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
