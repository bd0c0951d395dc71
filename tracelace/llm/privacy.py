"""Sanitisation of personal data by what terms tell about protected entities.

Entities are found by fixed rules. Around each of their places a window of terms is its context; over the corpus, pointwise
mutual information says how strongly a term reveals an entity, against the information that the entity has itself. A term
that reveals too much is generalised to its stem if the stem doesn't, and else removed, wherever it stands in a context of
that entity.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelace.llm.common import unused
from tracelace.storage import written

#: The base kinds, then the method's, in the order in which equal starts are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "generalised", "removed")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "[REMOVED]"}
#: The rules' expressions, written so that no text makes them read a character more than a few times.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]+")
#: A term: a run of letters and digits of ASCII and of whatever lies beyond.
TERM = re.compile(r"[^\x00-/:-@\[-`{-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Disclosure:
    """A term reveals an entity if their mutual information reaches ``share`` of the entity's own information."""

    #: Terms of a context on either side.
    window: int = 5
    #: Different contexts that must bear a pair out; copies of one text are one context.
    contexts: int = 3
    share: float = 0.5
    #: Code points that a generalised term keeps.
    stem: int = 3
    #: Terms to be counted are broadcast up to this number; beyond it all terms' counts are joined.
    broadcast_terms: int = 100_000


def luhn(digits: str) -> bool:
    """Whether the check digit of a card's number is right."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """A match starts where the run of local characters before an @ starts, or where the match before has ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        before = text[done:at][::-1]
        local = _LOCAL.match(before).end()
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def entities(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the base kinds, by start and then kind."""
    if not _ANY.search(text):
        return []
    out = [(s, 0, e, text[s:e].translate(_LOWER)) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), ".".join(parts)))
    for kind, rule in ((2, _CARD), (3, _PHONE)):
        for m in rule.finditer(text):
            digits = _DIGITS.sub("", m.group())
            if (14 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else 10 <= len(digits) <= 15:
                out.append((m.start(), kind, m.end(), digits))
    return sorted(out)


def general(term: str, stem: int) -> str | None:
    """The stem that stands for all terms with it; None if the term is no longer than that."""
    return term[:stem] + "*" if len(term) > stem else None


def contexts(text: str, found: list[tuple[int, int, int, str]], knobs: Disclosure) -> list[tuple[str, int, list[tuple[str, int, int]]]]:
    """For each entity's place: the entity with its kind, the hash of its context, and the context's terms with their places.

    Terms that touch an entity are none; a context goes over them.
    """
    ends = list(accumulate((e for _, _, e, _ in found), max))
    starts = [s for s, *_ in found]
    terms = []
    for m in TERM.finditer(text):
        k = bisect_left(starts, m.end()) - 1  # the last entity that starts before the term ends
        if k < 0 or ends[k] <= m.start():
            terms.append((m.group().translate(_LOWER), m.start(), m.end()))
    at = [s for _, s, _ in terms]
    out = []
    for s, kind, e, value in found:
        i, j = bisect_left(at, s), bisect_left(at, e)
        near = terms[max(0, i - knobs.window) : i] + terms[j : j + knobs.window]
        out.append((f"{BASE[kind]}:{value}", xxhash.xxh64_intdigest("\x1f".join(t for t, _, _ in near)) - (1 << 63), near))
    return out


def seen(around: list[tuple[str, int, list[tuple[str, int, int]]]], knobs: Disclosure) -> list[tuple[str, str, int]]:
    """(entity, term or stem, context) of one document: each pair once, with its least context."""
    least: dict[tuple[str, str], int] = {}
    for entity, context, near in around:
        for term in {t for t, _, _ in near} | {g for t, _, _ in near if (g := general(t, knobs.stem))}:
            key = (entity, term)
            least[key] = min(context, least.get(key, context))
    return [(c, t, h) for (c, t), h in least.items()]


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_PAIR = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), T.StructField("context", T.LongType())]))
_MARK = T.ArrayType(T.StructType([T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_STEPS = (("spans", _SPAN), ("pairs", _PAIR), ("marks", _MARK), ("entities", T.ArrayType(T.StringType())))


def scanned(docs: DataFrame, text: str, names: dict[str, str], knobs: Disclosure) -> DataFrame:
    """``docs`` with the base spans, the pairs, the terms' places and the entities of each row under ``names``."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(names[n], t) for n, t in _STEPS]])
    arrow = [pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64())])), pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, pairs, marks, values = [], [], [], []
            for t in batch.column(at).to_pylist():
                found = entities(t) if t else []
                around = contexts(t, found, knobs) if found else []
                spans.append([{"start": s, "kind": k, "end": e} for s, k, e, _ in found])
                pairs.append([{"entity": c, "term": x, "context": h} for c, x, h in seen(around, knobs)])
                marks.append([{"entity": c, "term": x, "start": s, "end": e} for c, x, s, e in sorted({(c, *n) for c, _, near in around for n in near})])
                values.append(sorted({c for c, _, _ in around}))
            made = [pa.array(v, k) for v, k in zip((spans, pairs, marks, values), arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[f.name for f in schema.fields])

    return docs.mapInArrow(scan, schema)


def term_counts(docs: DataFrame, text: str, stem: int, wanted: frozenset[str] | None = None) -> DataFrame:
    """term and n: the documents that hold a term, or a term of a stem; of those ``wanted``, or of all. Tasks count their own first."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, total = shared.value, Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                terms = set(TERM.findall((t or "").translate(_LOWER)))
                terms |= {x[:stem] + "*" for x in terms if len(x) > stem}
                total.update(terms if keep is None else terms & keep)
                if len(total) > 500_000:
                    yield flush()
                    total.clear()
        yield flush()

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def verdicts(found: DataFrame, names: dict[str, str], docs: DataFrame, text: str, knobs: Disclosure) -> DataFrame:
    """entity, term and kind: the pairs whose term reveals the entity, and whether the term is generalised or removed.

    PMI = log2(n_ct n / (n_c n_t)) with the numbers of documents that hold the pair in a context, the entity and the term
    anywhere, and all; the entity's own information is log2(n / n_c). Pairs need ``contexts`` different contexts. Counts of
    pairs and terms are partial aggregates; no entity's documents are gathered.
    """
    n = found.count()
    pairs = found.select(F.explode(names["pairs"]).alias("_p")).select("_p.*").groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("k").alias("n_ct"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= knobs.contexts)
    own = found.select(F.explode(names["entities"]).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    pairs = written(pairs.join(own, "entity"), "disclosure-pairs")
    vocabulary = pairs.select("term").distinct()
    if vocabulary.count() <= knobs.broadcast_terms:
        counts = term_counts(docs, text, knobs.stem, frozenset(r["term"] for r in vocabulary.toLocalIterator()))
    else:
        counts = term_counts(docs, text, knobs.stem).join(vocabulary, "term", "left_semi")
    pmi = F.log2(F.col("n_ct") * F.lit(float(n)) / (F.col("n_c") * F.col("n")))
    own_bits = F.log2(F.lit(float(max(n, 1))) / F.col("n_c"))
    revealing = written(pairs.join(counts, "term").filter((own_bits > 0) & (pmi >= knobs.share * own_bits - 1e-9)).select("entity", "term"), "disclosure")
    stem = F.when(F.length("term") > knobs.stem, F.concat(F.substring("term", 1, knobs.stem), F.lit("*")))
    stems = revealing.select(F.col("entity").alias("_e"), F.col("term").alias("_g"))
    terms = revealing.filter(~F.col("term").endswith("*")).withColumn("_stem", stem)
    kind = F.when(F.col("_stem").isNull() | F.col("_g").isNotNull(), F.lit(KINDS.index("removed"))).otherwise(F.lit(KINDS.index("generalised")))
    return terms.join(stems, (F.col("entity") == F.col("_e")) & (F.col("_stem") == F.col("_g")), "left").select("entity", "term", kind.alias("kind"))


def sanitised_spans(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], text: str = "text", knobs: Disclosure = Disclosure(), salts: int = 16) -> tuple[DataFrame, str]:
    """The columns that ``keep`` leaves of ``docs`` (with its text, if it does) and an array of (start, kind, end), base kinds and the method's, and that array's name.

    Rows alike are rows of their own. What is shuffled is terms and spans, never texts: each row has a number in the
    written scan, by which its spans come back. The places of a pair are dealt by salts, as one pair may be in a third of
    all rows.
    """
    names = {n: unused(docs, f"__{n}") for n in ("spans", "pairs", "marks", "entities", "row")}
    source = docs.withColumn(text, F.col(text).cast("string"))
    found = keep(scanned(source, text, names, knobs)).withColumn(names["row"], F.monotonically_increasing_id())
    found = written(found, "private-scan")
    told = verdicts(found, names, docs, text, knobs)
    told = told.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marks = found.select(F.col(names["row"]).alias("_row"), F.explode(names["marks"]).alias("_m")).select("_row", "_m.*", F.pmod(F.col("_row"), F.lit(salts)).cast("int").alias("_salt"))
    added = marks.join(told, ["entity", "term", "_salt"]).groupBy("_row", "start", "end").agg(F.max("kind").alias("kind"))
    added = added.groupBy("_row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("_added"))
    rows = found.drop(names["pairs"], names["marks"], names["entities"])
    joined = rows.join(added, F.col(names["row"]) == F.col("_row"), "left")
    both = F.array_sort(F.concat(F.col(names["spans"]), F.coalesce(F.col("_added"), F.array().cast(_SPAN))))
    return joined.withColumn(names["spans"], both).drop("_row", "_added", names["row"]), names["spans"]


def listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def digest(docs: DataFrame, knobs: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans' list and the list of all spans, for every row.

    Null and empty texts have no spans; very long ones are read whole; repeated rows and null ids stay and count each;
    spans of equal start are listed by kind; extra columns are left aside; no rows give none.
    """
    rows, spans = sanitised_spans(docs.select("doc_id", "text"), lambda df: df.drop("text"), knobs=knobs)
    of = lambda i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    base = F.filter(spans, lambda s: s["kind"] < len(BASE))
    return rows.select("doc_id", *[of(i).alias(f"n_{k}") for i, k in enumerate(BASE)], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col(spans)).alias("spans"))


def rewritten(text: str, spans: list[tuple[int, int, int]], stem: int) -> str:
    """The text with its spans replaced: entities and removed terms by marks, generalised terms by stems; overlapping spans as the first of them."""
    out, done = [], 0
    for start, kind, end in spans:
        if start >= done:
            out.append(text[done:start])
            name = KINDS[kind]
            out.append(text[start : start + stem] + "*" if name == "generalised" else MARKS[name])
        done = max(done, end)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, knobs: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with entities marked, and revealing terms generalised or removed, in ``text``.

    Null and empty texts, repeated rows, null ids and extra columns of any name stay as they are; no rows give none.
    """
    rows, spans = sanitised_spans(docs, lambda df: df, knobs=knobs)
    at, to, stem = rows.columns.index("text"), rows.columns.index(spans), knobs.stem
    keep = [i for i in range(len(rows.columns)) if i != to]
    schema = T.StructType([rows.schema.fields[i] for i in keep])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else rewritten(t, [(x["start"], x["kind"], x["end"]) for x in s], stem) for t, s in zip(batch.column(at).to_pylist(), batch.column(to).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in keep], names=[f.name for f in schema.fields])

    return rows.mapInArrow(apply, schema).select(*docs.columns)
