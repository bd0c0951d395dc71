"""Spelling variants against a plain version over all pairs."""

import zlib
from collections import Counter
from itertools import combinations

import duckdb
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import table
from tracelace.llm import spelling

UPPER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [] for w in n}
    for a, b in combinations(n, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)


def got(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def variants_of(*words):
    """Texts in which words are ten times as frequent as their neighbours, in a chain, with ties and accents."""
    return " ".join(w for w, k in words for _ in range(k))


MADE = [
    (1, variants_of(("schreiben", 400), ("schreibn", 30), ("schreib", 2), ("schreiven", 3))),
    (2, variants_of(("création", 40), ("creation", 40), ("crxation", 4), ("crxxtion", 2), ("CREATION", 2), ("CRÉATION", 2))),
    (2, variants_of(("création", 40), ("creation", 40), ("crxation", 4), ("crxxtion", 2))),
    (None, variants_of(("aaaaaaa", 30), ("aaaaaaaa", 3), ("aaaaaaaaa", 2), ("baaaaaa", 3), ("aaaaaab", 3), ("short", 9))),
    (7, "x" * 3000 + " " + "x" * 2999 + "y " + "x" * 3000 + " " + "x" * 2999 + "y"),
    (8, None),
    (9, ""),
]


def test_dirty_rows_equal_all_pairs(spark, dirty):
    rows = [(r.doc_id, r.text) for r in dirty.collect()]
    assert got(spelling.digest(dirty)) == plain(rows)


def test_chains_ties_and_accents_equal_all_pairs(spark):
    docs = table(spark, [(i, t, None, None) for i, t in MADE])
    found = got(spelling.digest(docs))
    assert found == plain(MADE)
    assert {"schreib"} <= {w for w, form, root, *_ in found if root == "schreiben" and form != "schreiben"}


def test_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted((w, f or "", r, n, k, -1 if m is None else m) for w, f, r, n, k, m in con.execute(f"select word, form, root, n, n_near, form_n from ({spelling.SQL})").fetchall())
    assert got(spelling.digest(spark.read.parquet(f"{sf}/documents.parquet"))) == want and want


def test_no_rows(spark, nothing):
    assert spelling.digest(nothing).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert spelling.digest(nothing).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("abcàé", min_size=7, max_size=12), st.integers(0, 12), st.sampled_from("abcxéÿ"), st.sampled_from(["insert", "delete", "replace"]))
def test_one_edit_flips_two_bits_and_spares_a_half(word, at, letter, kind):
    at = min(at, len(word) - 1)
    other = word[:at] + ("" if kind == "delete" else letter) + (word[at:] if kind == "insert" else word[at + 1 :])

    def bands(w):
        out = [0, 0, 0]
        for c in map(ord, w):
            out[c % 3] ^= 1 << (c // 3 % 62)
        return out

    flips = [(x ^ y).bit_count() for x, y in zip(bands(word), bands(other), strict=True)]
    assert sum(flips) <= 2 and 0 in flips
    size = max(len(word), len(other))
    half = size // 2
    assert word[:half] == other[:half] or word[len(word) - (size - half) :] == other[len(other) - (size - half) :]
