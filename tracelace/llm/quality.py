"""Quality rules with host verdicts.

Rules are columns of one row. Each rule's failures are summed by host; the host's rate is shrunk by a beta prior that is
fitted to all hosts' rates of that rule; a host is rejected for a rule if the rate lies above the hosts' mean by a margin
beyond doubt; and the verdicts are joined back to the documents. A document stays unless it fails the base rules, or fails a rule for which its
host is rejected: one that fails no rule stays wherever it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelace.llm.common import let, unused, words_of
from tracelace.storage import written


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are in percent."""

    least_words: int = 10
    repeat_share: int = 20
    symbol_share: int = 3
    dup_lines: int = 3
    #: A host is rejected for a rule if its shrunken rate, less ``doubt`` deviations of the posterior, is above the prior's mean by this share of it.
    margin: float = 0.25
    doubt: float = 1.645


#: The rules in the order of their bits; the first two are the base rules, which reject a document anywhere.
NAMES = ("words", "repeats", "symbols", "lines")


def repeat_words(words: Column, window: int = 5) -> Column:
    """Words covered by a window of words that is found twice or more in the array, first finds included.

    Windows are compared as text. Only where a window repeats are their starts ordered, by text and then by place; a
    start is repeated if a neighbour in that order has its text.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.concat_ws(" ", *[F.element_at(words, i + k) for k in range(window)]))

    def covered(g: Column) -> Column:
        ordered = F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        starts = let(ordered, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["g"].eqNullSafe(x["g"])) | (F.get(s, j + 1)["g"].eqNullSafe(x["g"]))), lambda x: x["i"])))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
        folded = F.aggregate(starts, zero, lambda acc, i: F.struct((acc["n"] + F.least(F.lit(window), i - acc["last"])).alias("n"), i.alias("last")))
        return folded["n"]

    counted = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g)))
    return F.when(F.size(words) < window + 1, F.lit(0)).otherwise(counted).cast("long")


def features(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text as a struct; null is as empty text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    return let(words_of(text), of)


def fails(x, rules: Rules = Rules()) -> dict[str, Column]:
    """Each rule's failure by name; ``x`` gives the features by name."""
    return {
        "words": x["n_words"] < rules.least_words,
        "repeats": 100 * x["n_repeat_words"] > rules.repeat_share * x["n_words"],
        "symbols": 100 * x["n_symbols"] > rules.symbol_share * x["word_chars"],
        "lines": x["n_dup_lines"] > rules.dup_lines,
    }


def failed_bits(x, rules: Rules = Rules()) -> Column:
    """The failed rules as bits of one whole number."""
    return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(fails(x, rules).values())), F.lit(0))


def rated(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """doc_id, host, the features and ``failed`` (the failed rules' bits) of every row."""
    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), features(F.col("text")).alias("f")).select("doc_id", "host", "f.*")
    return rows.withColumn("failed", failed_bits({c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}, rules))


def host_verdicts(rows: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """host, rule (its bit), n, failed, rate (shrunken) and rejected, for every host and rule; a null host is a host.

    A rule's prior is fitted by moments in which hosts weigh as they are large: m is the failures' share of all rows, and the
    hosts' rates vary around it by m (1 - m) (K - 1) at least, which is what sampling alone gives. What is beyond that is the
    correlation r of two rows of one host, and a + b = 1 / r - 1. Where there is none, hosts don't differ: all have the rate
    m and none is rejected. ``rows`` has host and failed. The sums by host are partial aggregates, and the priors are one row
    a rule.
    """
    bits = [F.count_if(F.col("failed").bitwiseAND(F.lit(1 << i)) != 0).alias(f"_f{i}") for i in range(len(NAMES))]
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *bits)
    pairs = F.array(*[F.struct(F.lit(1 << i).alias("rule"), F.col(f"_f{i}").alias("failed")) for i in range(len(NAMES))])
    hosts = hosts.select("host", "n", F.explode(pairs).alias("_p")).select("host", "n", "_p.*")
    n, failed = F.col("n").cast("double"), F.col("failed").cast("double")
    sums = hosts.groupBy("rule").agg(F.sum(n).alias("_n"), F.sum(failed).alias("_f"), F.sum(n * n).alias("_q"), F.sum(failed * failed / n).alias("_s"), F.count(F.lit(1)).alias("_k"))
    m, k = F.col("_f") / F.col("_n"), F.col("_k") - 1
    even = m * (1 - m)
    spread = even * (F.col("_n") - F.col("_q") / F.col("_n") - k)
    alike = F.when(spread > 0, (F.col("_s") - F.col("_n") * m * m - even * k) / spread)
    strength = F.when(alike > 0, F.greatest(1 / alike - 1, F.lit(0.0)))
    prior = sums.select("rule", m.alias("_m"), strength.alias("_w"))
    total = n + F.col("_w")
    rate = (failed + F.col("_m") * F.col("_w")) / total
    sure = rate - F.lit(rules.doubt) * F.sqrt(rate * (1 - rate) / (total + 1))
    rejected = F.coalesce(sure > (1 + rules.margin) * F.col("_m"), F.lit(False))
    return hosts.join(F.broadcast(prior), "rule").select("host", "rule", "n", "failed", F.coalesce(rate, F.col("_m")).alias("rate"), rejected.alias("rejected"))


def _rejected(rows: DataFrame, rules: Rules) -> DataFrame:
    """__host and __rules: the bits of the rules for which a host is rejected, where there are any."""
    return host_verdicts(rows, rules).filter("rejected").groupBy(F.col("host").alias("__host")).agg(F.bit_or("rule").alias("__rules"))


def _kept(failed: Column, host_rules: Column) -> Column:
    return failed.bitwiseAND(host_rules.bitwiseOR(F.lit(3))) == 0


def judge(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """doc_id, host, the features, failed, base_failed, host_rules (bits of the rules that its host is rejected for) and kept for every row.

    The features are computed once and written; the join carries them without the texts, and only rejected hosts are its
    other side. Null and empty texts have no words and fail; very long ones are read whole; null ids and repeated rows are
    judged like others; extra columns are left aside; no rows, no verdicts.
    """
    rows = written(rated(docs, rules, host), "quality")
    joined = rows.join(_rejected(rows, rules), F.col("host").eqNullSafe(F.col("__host")), "left").withColumn("host_rules", F.coalesce("__rules", F.lit(0))).drop("__host", "__rules")
    return joined.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(3)) != 0).withColumn("kept", _kept(F.col("failed"), F.col("host_rules")))


def keep(docs: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns, as ``judge`` has it.

    The rows are written once with the failed rules' bits, from which the hosts' sums are read without the texts; texts
    aren't shuffled. Rejected hosts are few or many: their side is broadcast only if Spark finds it small.
    """
    failed, name, bits = unused(docs, "__failed"), unused(docs, "__host"), unused(docs, "__rules")
    marked = written(docs.withColumn(failed, let(features(F.col("text")), lambda x: failed_bits(x, rules))), "quality-marked")
    hosts = written(_rejected(marked.select(F.col(host).cast("string").alias("host"), F.col(failed).alias("failed")), rules), "quality-hosts").toDF(name, bits)
    joined = marked.join(hosts, F.col(host).cast("string").eqNullSafe(F.col(name)), "left")
    return joined.filter(_kept(F.col(failed), F.coalesce(bits, F.lit(0)))).select(*[marked[c] for c in docs.columns])


R = Rules()
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p WHERE g IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
f AS (SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < {R.least_words} OR 100 * n_repeat_words > {R.repeat_share} * n_words AS base_failed,
  [n_words < {R.least_words}, 100 * n_repeat_words > {R.repeat_share} * n_words, 100 * n_symbols > {R.symbol_share} * word_chars, n_dup_lines > {R.dup_lines}] AS fs FROM f),
u AS (SELECT source, unnest([1, 2, 3, 4]) AS rule, unnest(fs) AS bad FROM b),
h AS (SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE bad) AS failed FROM u GROUP BY ALL),
a AS (SELECT rule, sum(n::DOUBLE) AS n, sum(failed::DOUBLE) AS f, sum(n::DOUBLE * n) AS q, sum(failed::DOUBLE * failed / n) AS s, count(*) - 1 AS k FROM h GROUP BY rule),
m AS (SELECT rule, f / n AS m, CASE WHEN f / n * (1 - f / n) * (n - q / n - k) > 0 THEN (s - n * (f / n) * (f / n) - f / n * (1 - f / n) * k) / (f / n * (1 - f / n) * (n - q / n - k)) END AS alike FROM a),
s AS (SELECT rule, m, CASE WHEN alike > 0 THEN greatest(1 / alike - 1, 0) END AS w FROM m),
q AS (SELECT source, rule, m, (failed + m * w) / (n + w) AS rate, n + w AS total FROM h JOIN s USING (rule)),
r AS (SELECT source, sum(CASE WHEN rate - {R.doubt} * sqrt(rate * (1 - rate) / (total + 1)) > (1 + {R.margin}) * m THEN 1 << (rule - 1) ELSE 0 END)::INTEGER AS host_rules FROM q GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rules,
  NOT base_failed AND NOT (fs[3] AND host_rules & 4 <> 0) AND NOT (fs[4] AND host_rules & 8 <> 0) AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source"""
