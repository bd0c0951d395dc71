"""Language identification by prediction by partial matching.

For each language a byte context tree of variable order is counted once and then frozen. A byte's probability is its
share in the longest context that has it; each longer context that is known without it costs an escape (its distinct
bytes against its count). A text's exact code length under each language's tree is the sum over all its bytes, and the
shortest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelace.storage import written

#: Bytes before a text's first are taken to be these; contexts are up to three bytes long.
_START = b"\n\n\n"
ORDER = len(_START)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts end to end the number made of its three predecessors and itself; and where texts start."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    x = np.frombuffer(_START + _START.join(texts), np.uint8).astype(np.uint32)
    codes = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    if len(texts) > 1:
        ends = np.cumsum(sizes + ORDER)[:-1] - ORDER
        keep = np.ones(len(codes), bool)
        for k in range(ORDER):
            keep[ends + k] = False
        codes = codes[keep]
    return codes, starts


@dataclass
class Tree:
    """Frozen code lengths: for each depth (4 to 1) the known grams, their bits by language, the known contexts and the bits of an escape."""

    languages: list[str]
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def of(languages: list[str], codes: np.ndarray, counts: np.ndarray) -> "Tree":
        """From distinct grams of four bytes and their counts (a column for each language); shorter ones are their sums."""
        below: np.ndarray | None = None
        levels = []
        for depth in range(1, ORDER + 2):
            short = codes & np.uint32((1 << 8 * depth) - 1) if depth < 4 else codes
            known, inverse = np.unique(short, return_inverse=True)
            n = np.zeros((len(known), len(languages)))
            np.add.at(n, inverse, counts)
            contexts, of = np.unique(known >> np.uint32(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(languages))), np.zeros((len(contexts), len(languages)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(n / (total + distinct)[of])
            lower = np.full(n.shape, 8.0) if below is None else below[np.searchsorted(levels[-1][0], known & np.uint32((1 << 8 * (depth - 1)) - 1))]
            bits = np.where(n > 0, own, escape[of] + lower)
            levels.append((known, bits.astype(np.float32), contexts, escape.astype(np.float32)))
            below = bits
        return Tree(languages, levels[::-1])

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of each gram's last byte, by language."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        todo = np.arange(len(codes))
        for known, bits, contexts, escape in self.levels:
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            met = known[at] == codes
            if met.all():
                out[todo] += bits[at]
                return out
            out[todo[met]] += bits[at[met]]
            todo, codes = todo[~met], codes[~met]
            context = codes >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            met = contexts[at] == context
            out[todo[met]] += escape[at[met]]
            depth = len(self.levels) - next(i for i, lv in enumerate(self.levels) if lv[0] is known)
            codes = codes & np.uint32((1 << 8 * (depth - 1)) - 1)
        out[todo] += 8.0
        return out

    def lengths(self, texts: list[bytes], block: int = 8 << 20) -> np.ndarray:
        """The code length of each text (none of them empty) under each language, in bits."""
        codes, starts = grams(texts)
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, block // max(1, len(self.languages)))
        for a in range(0, len(codes), step):
            first = int(np.searchsorted(starts, a, side="right")) - 1
            last = int(np.searchsorted(starts, min(a + step, len(codes)), side="left"))
            out[first:last] += np.add.reduceat(self.bits(codes[a : a + step]), np.maximum(starts[first:last] - a, 0), axis=0, dtype=np.float64)
        return out


def held_out(ident: Column) -> Column:
    """crc32 of the id as text modulo 4 is 2; a null id isn't."""
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


#: Bytes of text a language is learned from: all it has, or else a sample of its rows by a hash, of about so many.
SAMPLE_BYTES = 256 << 20
#: Bytes of one block of trees, which is what is broadcast at once: a language alone is a block, however large its tree.
BLOCK_BYTES = 64 << 20


def counted(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(l, g, n): how often each language has each gram of four bytes, over the rows with a text and a language.

    Every text read is counted whole and no gram or language is left out. ``sample_bytes`` bounds what a language is
    learned from; a language that has more is sampled by a hash of the text at the rate that gives about so many. Each
    task counts the grams of what it reads, and the tasks' counts are summed by language and gram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in parts])
            known, inverse = np.unique(codes, return_inverse=True)
            return known, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(known)).astype(np.int64)

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                parts = held.setdefault(name, [])
                some: list[bytes] = []
                size = 0
                for i, t in enumerate(texts):
                    some.append(t)
                    size += len(t)
                    if size > 4 << 20 or i + 1 == len(texts):
                        parts.append(np.unique(grams(some)[0], return_counts=True))
                        some, size = [], 0
                if len(parts) > 8:
                    held[name] = [merged(parts)]
        for name, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n)], names=["l", "g", "n"])

    rows = labelled.filter(F.col(text).isNotNull() & (F.octet_length(text) > 0) & F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("_l"), F.col(text).cast("string").alias("_t"))
    large = written(rows.groupBy("_l").agg(F.sum(F.octet_length("_t").cast("long")).alias("_all")).filter(F.col("_all") > sample_bytes), "languages-sampled")
    if not large.isEmpty():
        rate = F.lit(float(sample_bytes)) / F.col("_all")
        drawn = F.pmod(F.xxhash64("_t", F.lit("sample")), F.lit(1 << 30)) < rate * (1 << 30)
        rows = rows.join(large.withColumnRenamed("_l", "_sampled"), F.col("_l") == F.col("_sampled"), "left").filter(F.col("_all").isNull() | drawn).select("_l", "_t")
    return rows.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))


def blocks_of(sizes: dict[str, int], block_bytes: int = BLOCK_BYTES) -> list[list[str]]:
    """Languages by name in blocks whose tree (a float for each of their grams and languages) keeps to the bound."""
    out: list[list[str]] = []
    held = 0
    for name in sorted(sizes):
        if out and (held + sizes[name]) * (len(out[-1]) + 1) * 8 <= block_bytes:
            out[-1].append(name)
            held += sizes[name]
        else:
            out.append([name])
            held = sizes[name]
    return out


def tree_of(counts: DataFrame, languages: list[str]) -> Tree:
    """The languages' tree from their counts."""
    kept = counts.filter(F.col("l").isin(languages)).toArrow()
    codes, inverse = np.unique(kept.column("g").to_numpy().astype(np.uint32), return_inverse=True)
    held = np.zeros((len(codes), len(languages)))
    at = {x: i for i, x in enumerate(languages)}
    held[inverse, np.array([at[x] for x in kept.column("l").to_pylist()], np.int64)] = kept.column("n").to_numpy()
    return Tree.of(languages, codes, held)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_bytes: int = SAMPLE_BYTES, block_bytes: int = BLOCK_BYTES) -> Iterator[Tree]:
    """The trees of all languages, a block of them at a time; none where no row has a text and a language.

    Null and empty texts and null languages teach nothing, repeated rows count as often as they are there, extra columns
    are left aside. See ``counted`` for the bound on what is read.
    """
    counts = written(counted(labelled, text, lang, sample_bytes), "language-grams")
    sizes = {r.l: r.n for r in counts.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    for languages in blocks_of(sizes, block_bytes):
        yield tree_of(counts, languages)


def predict(docs: DataFrame, trees: Iterator[Tree], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, held_out, lang_pred and score of every row.

    ``score`` is the language's share of the probability that all languages give the text, each counting alike; equal
    code lengths go to the first language by name. A null text, one without a letter, and every text where nothing was
    learned are 'und' with score 0. Long texts are scored whole; null ids, repeated rows and columns of any name pass.
    Each block of trees is one pass, which carries the shortest length so far, its language and the sum of the shares;
    between passes the rows are written.
    """
    kind = dict(docs.dtypes)[ident]
    schema = f"_id {kind}, _text string, _best double, _name string, _sum double"
    rows = docs.select(F.col(ident).alias("_id"), F.col(text).cast("string").alias("_text"), F.lit(None).cast("double").alias("_best"), F.lit(None).cast("string").alias("_name"), F.lit(0.0).alias("_sum"))
    for k, tree in enumerate(trees):
        rows = (written(rows, "languages-scored") if k else rows).mapInArrow(_pass(docs, tree), schema)
    known = F.col("_name").isNotNull()
    return rows.select(F.col("_id").alias(ident), held_out(F.col("_id")).alias("held_out"), F.coalesce("_name", F.lit("und")).alias("lang_pred"), F.when(known, 1 / F.col("_sum")).otherwise(F.lit(0.0)).alias("score"))


def _pass(docs: DataFrame, tree: Tree):
    shared = docs.sparkSession.sparkContext.broadcast((tree.languages, tree.levels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(*shared.value)
        for batch in batches:
            texts, best, names, sums = (batch.column(i).to_pylist() for i in (1, 2, 3, 4))
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            some: list[int] = []
            size = 0
            for k, i in enumerate(known):
                some.append(i)
                size += len(texts[i])
                if size > 4 << 20 or k + 1 == len(known):
                    bits = tree.lengths([texts[j].encode("utf-8", "replace") for j in some])
                    for j, own in zip(some, bits, strict=True):
                        b = int(own.argmin())
                        least = own[b] if best[j] is None or own[b] < best[j] else best[j]
                        old = 0.0 if best[j] is None else sums[j] * 2.0 ** max(least - best[j], -1000)
                        sums[j] = float(old + np.exp2(np.maximum(least - own, -1000)).sum())
                        if best[j] is None or own[b] < best[j]:
                            best[j], names[j] = float(own[b]), tree.languages[b]
                    some, size = [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.float64()), pa.array(names, pa.string()), pa.array(sums, pa.float64())], names=["_id", "_text", "_best", "_name", "_sum"])

    return score


def digest(docs: DataFrame) -> DataFrame:
    """Learned from what isn't held out (rows with a null id aren't learned from), predicted for every row; see ``predict``."""
    return predict(docs, learn(docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))))
