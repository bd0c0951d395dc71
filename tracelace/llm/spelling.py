"""Spelling variants by parities of letters.

A word's mask has a bit for each letter that it holds an odd number of times, in three bands. One inserted, deleted or
replaced letter flips two bits at most, so two words that are one edit apart agree in a band. Words meet where a band, a
length and one half of the word are equal, and what meets is verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelace.llm.common import let
from tracelace.operators.components import forest_roots
from tracelace.storage import written

#: Letters of a run, and the least code points of a word.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST = 7
#: A letter of code point c has bit c div 3 (modulo 62) of band c mod 3.
BANDS, BITS = 3, 62


def lowered(run: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(run, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def misspelt(doc_id: Column, run: Column, every: int = 31) -> Column:
    """The run less one code point if ``every`` divides the crc32 of ``<doc_id>:<run>``; a null id is written as nothing."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, least_n: int = 2) -> DataFrame:
    """word and n: words of seven code points and more that occur ``least_n`` times or more, repeated rows counted.

    A run of fewer than seven letters can't give a word, so such runs aren't even cut out. Counts are partial aggregates.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"))
    words = runs.select("doc_id", lowered(F.col("run")).alias("run")).select(misspelt(F.col("doc_id"), F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def masks(word: Column) -> Column:
    """The parity masks of the word's letters, one whole number a band."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (F.floor(c / BANDS) % BITS).cast("int"))
    band = lambda cs, k: F.aggregate(F.filter(cs, lambda c: c % BANDS == k), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(bit(c)))
    codes = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c))
    return let(codes, lambda cs: F.array(*[band(cs, k) for k in range(BANDS)]))


def places(words: DataFrame) -> DataFrame:
    """word, n, its masks, and a row for each place where it can meet a word one edit away: key, band, size and side.

    At size L meet words of L and of L - 1 code points. Of two such words one edit apart, either the first L div 2 code
    points agree or the last L - L div 2 do, as the edit lies in one half; a key is the hash of the band's number and mask,
    the size, the side and that half.
    """
    sides = []
    for band in range(BANDS):
        for more in (0, 1):
            size = F.length("word") + more
            half = F.floor(size / 2).cast("int")
            for side, part in (("first", F.substring(F.col("word"), F.lit(1), half)), ("last", F.substring(F.col("word"), half + 1 - more, F.length("word")))):
                sides.append(F.struct(F.xxhash64(F.lit(band), F.get("masks", F.lit(band)), size, F.lit(side), part).alias("key"), F.lit(band).alias("band"), size.alias("size"), F.lit(side == "last").alias("last")))
    return words.select("word", "n", "masks", F.explode(F.array(*sides)).alias("_p")).select("word", "n", "masks", "_p.*")


def near_words(words: DataFrame) -> DataFrame:
    """a, na, b, nb: pairs of words (a before b) exactly one inserted, deleted or replaced code point apart, each once.

    A pair is taken at the first place that it meets at alone: the least equal band, the first halves where these agree.
    The join is dealt by the key's hash and its output is what is verified; no place's words are ever gathered.
    """
    at = places(words.withColumn("masks", masks(F.col("word"))))
    a, b = at.alias("a"), at.alias("b")
    x, y = F.col("a.word"), F.col("b.word")
    first_equal = F.array_position(F.zip_with("a.masks", "b.masks", lambda p, q: p == q), F.lit(True)) - 1
    half = F.floor(F.col("a.size") / 2).cast("int")
    same = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.last") == F.col("b.last")) & (F.col("a.size") == F.col("b.size"))
    here = (F.greatest(F.length(x), F.length(y)) == F.col("a.size")) & (x < y) & (F.abs(F.length(x) - F.length(y)) <= 1)
    once = (~F.col("a.last") | (F.substring(x, F.lit(1), half) != F.substring(y, F.lit(1), half))) & (F.levenshtein(x, y, 1) == 1) & (first_equal == F.col("a.band"))
    return a.join(b, same & here & once).select(x.alias("a"), F.col("a.n").alias("na"), y.alias("b"), F.col("b.n").alias("nb"))


def variants(words: DataFrame, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of ``words`` (word, n; each word once).

    A word's form is its near word of largest n (ties: the smallest) if that n is ``times`` its own or more. Forms are
    rarer than their words at every step, so they make trees, whose roots come from pointer doubling.
    """
    pairs = near_words(words)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("m")))
    near = pairs.select(F.explode(ways).alias("_w")).select("_w.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("_best"))
    chosen = (-F.col("_best.m")) >= times * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", F.when(chosen, F.col("_best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("_best.m")).cast("long").alias("form_n")
    )
    out = written(out, "spelling-forms")
    roots = forest_roots(out.filter("form IS NOT NULL"), "form", "word")
    named = out.join(roots.select(F.col("node").alias("word"), "root"), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    """The variants of all words of the texts.

    Null and empty texts have no words; very long texts and runs are read whole; repeated rows count each time; a null id is
    written as nothing before the colon; ties take the smaller word; extra columns are left aside; no rows give none.
    """
    return variants(written(vocabulary(docs.select("doc_id", "text")), "spelling-words"))


#: Words one edit apart share what is left when a code point goes: at the same place, or the whole shorter word.
SQL = f"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) t(i))),
u AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS (SELECT id, run, count(*) AS k FROM u WHERE length(run) >= {LEAST} GROUP BY ALL),
x AS (SELECT run, k, hex(encode(id || ':' || run)) AS hx FROM o),
h AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc FROM x, bits),
m AS (SELECT CASE WHEN crc % 31 = 0 THEN substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM d),
p AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM g a JOIN g b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT g.word, w.word, w.n FROM g JOIN w ON g.rest = w.word UNION SELECT w.word, g.word, g.n FROM g JOIN w ON g.rest = w.word),
q AS (SELECT word, count(*) AS n_near, max(m) AS best FROM (SELECT DISTINCT word, other, m FROM p) GROUP BY word),
c AS (SELECT q.word, q.n_near, q.best, min(p.other) AS other FROM q JOIN p ON p.word = q.word AND p.m = q.best GROUP BY ALL),
f AS (SELECT w.word, CASE WHEN best >= 10 * n THEN other END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best >= 10 * n THEN best END::BIGINT AS form_n FROM w LEFT JOIN c USING (word)),
r AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.next)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word WHERE r.next IS NULL"""
