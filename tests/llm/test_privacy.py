"""Sanitisation against a plain version: the contract's expressions, and counts over all pairs of the corpus."""

import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import table
from tracelace.llm import privacy

RULES = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_entities(text):
    out = []
    for k, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
                if not 14 <= len(digits) <= 19 or sum(d // 10 + d % 10 for d in doubled) % 10:
                    continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            value = {"email": m.group().lower(), "ip": ".".join(str(int(p)) for p in m.group().split(".")) if kind == "ip" else ""}.get(kind, digits)
            out.append((m.start(), k, m.end(), f"{kind}:{value}"))
    return sorted(out)


def lower(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


def plain(rows, window=5, least=3, share=0.5, stem=3):
    """The digest's rows by place in ``rows``."""
    docs = []
    for _, text in rows:
        text = text or ""
        found = plain_entities(text)
        covered = {i for s, _, e, _ in found for i in range(s, e)}
        terms = [(lower(m.group()), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2f:-@\[-`{-\x7f]+", text)]
        free = [t for t in terms if not covered & set(range(t[1], t[2]))]
        around = []
        for s, _, e, value in found:
            before, after = [t for t in free if t[1] < s][-window:], [t for t in free if t[1] >= e][:window]
            around.append((value, before + after))
        docs.append((found, around, {t for t, *_ in terms} | {t[:stem] + "*" for t, *_ in terms if len(t) > stem}))
    n = len(docs)
    holders, bearers, contexts = defaultdict(int), defaultdict(int), defaultdict(set)
    for _, around, _ in docs:
        for value in {v for v, _ in around}:
            holders[value] += 1
        mine = defaultdict(set)
        for value, near in around:
            context = privacy.xxhash.xxh64_intdigest("\x1f".join(t for t, _, _ in near))
            for t, _, _ in near:
                for term in (t, *([t[:stem] + "*"] if len(t) > stem else [])):
                    mine[value, term].add(context)
        for pair, cs in mine.items():
            bearers[pair] += 1
            contexts[pair].add(min(cs))

    def reveals(value, term):
        pair = (value, term)
        if len(contexts[pair]) < least or holders[value] == n:
            return False
        n_t = sum(term in held for _, _, held in docs)
        return math.log2(bearers[pair] * n / (holders[value] * n_t)) >= share * math.log2(n / holders[value]) - 1e-9

    out = []
    for (doc_id, _), (found, around, _) in zip(rows, docs, strict=True):
        added = {}
        for value, near in around:
            for t, s, e in near:
                if reveals(value, t):
                    removed = len(t) <= stem or reveals(value, t[:stem] + "*")
                    added[s, e] = max(added.get((s, e), 4), 5 if removed else 4)
        names = ("email", "ip", "card", "phone", "generalised", "removed")
        write = lambda spans: ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans))
        base = [(s, k, e) for s, k, e, _ in found]
        counts = [sum(k == i for _, k, _ in base) for i in range(4)]
        out.append((doc_id, *counts, hashlib.sha256(write(base).encode()).hexdigest(), write(base + [(s, k, e) for (s, e), k in added.items()])))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in df.collect()), key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    common = [f"word{i}x" for i in range(40)]
    people = [("Ann@mail.example.com", ["zorblat", "quux"]), ("10.0.0.7", ["zorro", "zorbas"]), ("4111 1111 1111 1111", ["Ключ", "ab"]), ("+1 (743) 555-3824", ["zorblat"])]
    rows = []
    for i in range(n):
        words = rng.choices(common, k=30)
        if i % 3 == 0:
            value, tells = people[i % len(people)]
            at = rng.randrange(10, 20)
            words[at:at] = [*tells, value, rng.choice(["ann@MAIL.example.com", "x"])]
        if i % 17 == 0:
            words.append("zorgon")
        rows.append((i, " ".join(words)))
    rows += [rows[0]] * 9 + [(None, rows[3][1]), (7, None), (8, ""), (5, "mail a@b.c@d.e " * 300), (6, "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4 +123 +1-2-3-4-5-6-7-8-9-0 é@x.y x@y 4111-1111-1111-1111 5")]
    return rows


def test_equals_the_plain_version(spark):
    rows = corpus(1)
    docs = table(spark, [(i, t, None, None) for i, t in rows]).repartition(4)
    found = got(privacy.digest(docs))
    assert found == plain(rows)
    assert any("removed" in r[-1] for r in found) and any("generalised" in r[-1] for r in found)


def test_counts_by_join_equal_counts_by_broadcast(spark):
    docs = table(spark, [(i, t, None, None) for i, t in corpus(2)]).repartition(3)
    assert got(privacy.digest(docs)) == got(privacy.digest(docs, privacy.Disclosure(broadcast_terms=0)))


def test_dirty_rows(spark, dirty, nothing):
    assert got(privacy.digest(dirty)) == plain([(r.doc_id, r.text) for r in dirty.collect()])
    assert privacy.digest(nothing).count() == 0 and privacy.sanitise(nothing).columns == nothing.columns
    kept = privacy.sanitise(dirty)
    assert kept.columns == dirty.columns and sorted(map(str, kept.collect())) == sorted(map(str, dirty.collect()))


def test_sanitised_texts(spark):
    rows = corpus(1)
    docs = table(spark, [(i, t, None, None) for i, t in rows])
    texts = [r.text or "" for r in privacy.sanitise(docs).collect()]
    assert len(texts) == len(rows)
    joined = " ".join(texts)
    assert "Ann@mail" not in joined and "4111 1111" not in joined and "quux" not in joined and "[REMOVED]" in joined and "[EMAIL]" in joined
    assert "word1x" in joined and "zorgon" in joined


@settings(max_examples=600, deadline=None)
@given(st.text("a0@.1+- (25é", max_size=40))
def test_rules_equal_their_expressions(text):
    assert [x[:3] for x in privacy.entities(text)] == [x[:3] for x in plain_entities(text)]


def test_long_runs_are_read_in_proportion():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "a@b." * 75_000, "+1" + "(" * 300_000, "1 " * 150_000, "@" * 300_000):
        privacy.entities(text)
