"""Secret scans over a trigram inverted index.

Each rule's Boolean trigram query is derived from its expression. The index has a posting (trigram, doc_id) for each of
the trigrams that the rules' queries mention; a rule's candidates are the documents whose postings satisfy its query, and
only they are read by the rule. Rules without mandatory trigrams read every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelace.llm import trigrams
from tracelace.llm.common import let, unused
from tracelace.storage import written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if ``group`` of it has ``least`` characters; others are found and dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, then the kinds that the operator adds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{24,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + ADDED
#: What is redacted: a private key through its END line, or else through its lines of base64; scans name its BEGIN line.
KEY = Rule("private_key", ADDED[0].pattern + r"(?:\s*Proc-Type:[^\n]*\n)?(?:\s*DEK-Info:[^\n]*\n)?(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----|[A-Za-z0-9+/=\r\n\\]*)")
REDACTED = (*BASE, KEY, *ADDED[1:])


def postings(docs: DataFrame, vocabulary: Sequence[str]) -> DataFrame:
    """(trigram, doc_id) for every trigram of ``vocabulary`` (its place there) that a document's lower-cased text holds.

    One pass over a text cuts it into those of its overlapping trigrams that the vocabulary has.
    """
    if not vocabulary:
        return docs.select("doc_id", F.lit(0).alias("trigram")).filter("false")
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(f"(?={trigrams.trie(vocabulary)})"), F.lit(1)))
    held = docs.filter(F.col("text").isNotNull()).select("doc_id", F.explode(found).alias("trigram"))
    return held.select("doc_id", (F.array_position(F.array(*map(F.lit, vocabulary)), F.col("trigram")) - 1).cast("int").alias("trigram"))


def _met(query: tuple, bits: Column, at: dict[str, int]) -> Column:
    """A query over the bits of the trigrams that a document has postings for."""
    if query == trigrams.ALL:
        return F.lit(True)
    if query[0] == "tri":
        return F.getbit(bits[at[query[1]] // 63], F.lit(at[query[1]] % 63)) == 1
    parts = [_met(q, bits, at) for q in query[1]]
    out = parts[0]
    for x in parts[1:]:
        out = (out & x) if query[0] == "and" else (out | x)
    return out


def candidates(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """(doc_id, rules): the indexes of the rules whose trigram query a document's postings satisfy, where there are any.

    Postings are intersected by one aggregation by document into bit sets. Rows that share an id, null included, share
    their candidates, which is never fewer than their own.
    """
    queries = [trigrams.query_of(r.pattern) for r in rules]
    vocabulary = sorted({t for q in queries for t in trigrams.trigrams_of(q)})
    at = {t: i for i, t in enumerate(vocabulary)}
    words = range(0, max(1, len(vocabulary)), 63)
    sets = [F.bit_or(F.when(F.col("trigram").between(w, w + 62), F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("trigram") - w).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_b{w}") for w in words]
    merged = postings(docs, vocabulary).groupBy("doc_id").agg(*sets).select("doc_id", F.array(*[f"_b{w}" for w in words]).alias("_bits"))
    met = [F.when(_met(q, F.col("_bits"), at), F.lit(i)) for i, q in enumerate(queries) if q != trigrams.ALL]
    return merged.select("doc_id", F.array_compact(F.array(*met)).alias("rules")).filter(F.size("rules") > 0)


#: Matches of one text that are folded together; blocks are folded in turn, so the work stays in proportion to the matches.
_BLOCK = 256


def matches(text: Column, rule: Rule) -> Column:
    """The rule's leftmost non-overlapping matches as structs (start, end), in code points, end exclusive.

    The text between the matches comes from a split by the same expression; the starts are running sums of lengths.
    """
    pattern = rule.pattern
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def located(ms: Column, sizes: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        zipped = F.arrays_zip(F.transform(ms, lambda m: F.length(m)).alias("len"), F.slice(gaps, 1, F.size(ms)).alias("gap"), sizes.alias("n"))
        steps = F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), (z["gap"] + z["len"]).alias("step"), z["len"].alias("len"), z["n"].alias("n")))
        return let(steps, lambda x: F.when(F.size(x) <= _BLOCK, spans(x, F.lit(0))).otherwise(blocks(x)))

    def spans(steps: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

        def step(acc: Column, z: Column) -> Column:
            span = F.struct((acc["at"] + z["gap"]).alias("start"), (acc["at"] + z["step"]).alias("end"))
            return F.struct((acc["at"] + z["step"]).alias("at"), F.when(z["n"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(steps, zero, step)["out"]

    def blocks(steps: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(_BLOCK)), lambda i: F.slice(steps, i, _BLOCK))
        long = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda n, z: n + z["step"]))
        starts = F.aggregate(long, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(cut, F.slice(starts, 1, F.size(cut)), spans))

    none = F.array().cast("array<struct<start:int,end:int>>")
    sizes = lambda ms: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else ms, lambda m: F.length(m))
    return let(found, lambda ms: F.when(F.size(ms) == 0, none).otherwise(located(ms, sizes(ms))))


def _tagged(spans: Column, rule: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rule).alias("rule"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, into: str = "spans") -> DataFrame:
    """``docs`` with ``into``: array of (start, kind, end), ordered by start and then by the rules' order.

    Every row stays; a null text has no spans. The candidates' side holds ids alone and is broadcast only if Spark finds
    it small; else both sides are dealt by id. Extra columns pass through; one named as ``into`` is replaced.
    """
    key, met = unused(docs, "__candidate"), unused(docs, "__rules")
    found = written(candidates(docs, rules), "secret-candidates").toDF(key, met)
    none = F.array().cast("array<struct<start:int,end:int>>")
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[key]), "left")
    text = F.coalesce(docs["text"], F.lit(""))
    parts = []
    for i, r in enumerate(rules):
        spans = matches(text, r)
        if trigrams.query_of(r.pattern) != trigrams.ALL:
            spans = F.when(F.array_contains(found[met], i), spans).otherwise(none)
        parts.append(_tagged(spans, i))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(F.array_sort(F.concat(*parts)), lambda s: F.struct(s["start"].alias("start"), F.get(kinds, s["rule"]).alias("kind"), s["end"].alias("end")))
    return joined.select(*[docs[c] for c in docs.columns if c != into], spans.alias(into))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, sha256 of the base spans' list and the list of all spans, for every row.

    Null and empty texts have no spans; very long ones are scanned whole; repeated rows and null ids stay; extra columns
    are left aside; no rows give none.
    """
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return scan(docs.select("doc_id", "text")).select("doc_id", *[of(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each span of ``text`` (overlapping ones as one) replaced by ``mark``; other texts are unchanged.

    Null and empty texts, repeated rows, null ids and extra columns of any name stay as they are; no rows give none.
    """
    text = F.col("text")

    def cut(spans: Column) -> Column:
        """The parts between the spans, joined by the mark."""
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("parts"))

        def step(acc: Column, s: Column) -> Column:
            part = F.array(F.struct(acc["at"].alias("start"), s["start"].alias("end")))
            more = s["start"] >= acc["at"]
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(more, F.concat(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"))

        def joined(r: Column) -> Column:
            parts = F.concat(r["parts"], F.array(F.struct(r["at"].alias("start"), F.length(text).alias("end"))))
            return F.array_join(F.transform(parts, lambda p: F.substring(text, p["start"] + 1, p["end"] - p["start"])), mark)

        return let(F.aggregate(spans, zero, step), joined)

    into = unused(docs, "__spans")
    found = scan(docs, REDACTED, into)
    return found.withColumn("text", F.when(F.size(into) == 0, text).otherwise(cut(F.col(into)))).select(*docs.columns)


def _sql_spans(i: int, rule: Rule) -> str:
    pattern = rule.pattern
    if pattern.startswith("(?i)"):  # spelled out, as RE2 folds two letters beyond ASCII to k and s
        head, _, tail = pattern[4:].partition("""["']?""")
        pattern = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head) + """["']?""" + tail
    quoted = "'" + pattern.replace("'", "''") + "'"
    return f"""
m{i} AS (SELECT doc_id, regexp_extract_all(text, {quoted}) AS ms, regexp_extract_all(text, {quoted}, {rule.group}) AS gs, regexp_split_to_array(text, {quoted}) AS ps FROM d),
s{i} AS (SELECT doc_id, {i} AS rule, '{rule.kind}' AS kind, list_sum(list_transform(ps[1:j], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(ms[1:j - 1], lambda x: length(x))), 0)::BIGINT AS st, length(ms[j]) AS n
  FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS j FROM m{i}) WHERE length(gs[j]) >= {rule.least})"""


SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_sql_spans(i, r) for i, r in enumerate(RULES))
    + ", a AS ("
    + " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(RULES)))
    + f"""),
l AS (SELECT doc_id, string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, rule) AS spans,
  string_agg(kind || ':' || st || ':' || (st + n), ',' ORDER BY st, rule) FILTER (WHERE rule < {len(BASE)}) AS base,
  {", ".join(f"count(*) FILTER (WHERE rule = {i}) AS n_{r.kind}" for i, r in enumerate(BASE))} FROM a GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN l USING (doc_id)"""
)
