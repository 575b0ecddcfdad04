import re
from collections import Counter

import duckdb
import pytest

from pointloom.llm import source_audit
from pointloom.llm.source_audit import PARTS, SALTS, dense_shares, divergence, kept_terms, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, term string, p long"


def brute(rows, least, top):
    counts, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        counts.update((lang, source, t) for t in terms)
        docs.update({(lang, t) for t in terms})
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]

        def shares(of):
            c = {t: sum(counts[lang, s, t] for s in of) for t in kept}
            return {t: 1 + PARTS * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        q = shares(sources)
        by = {s: shares([s]) for s in sources}
        for s in sources:
            p = by[s]
            far = [(o, sum((p[t] - by[o][t]) ** 2 // (p[t] + by[o][t]) for t in kept)) for o in sources if o != s]
            own = [(t, (p[t] - q[t]) ** 2 // (p[t] + q[t])) for t in kept if counts[lang, s, t] and p[t] > q[t]]
            for part, items, most in (("pair", far, len(far)), ("term", own, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, t, v, k + 1) for k, (t, v) in enumerate(items[:most])]
    return sorted(out)


ROWS = [
    (1, "The cat, the DOG. Élan élan x1y", "en", "a"),
    (2, "the cat cat cat sat", "en", "b"),
    (2, "the cat cat cat sat", "en", "b"),
    (3, None, "en", "c"),
    (4, "1 2 3 ...", "en", None),
    (5, "le chat et le chien", "fr", "a"),
    (6, "sans lang", None, None),
    (None, "the 𝒳𝒳 dog İ" + " word" * 20000, "en", "a"),
    (7, "dog " * 50, "en", "d"),
    (8, "", "de", "a"),
    (9, "", "de", "b"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 5) for r in rows], SCHEMA)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("least", [1, 2])
def test_brute_force(spark, least):
    """Null columns, empty and long texts, repeated rows, a language without kept terms, further columns."""
    assert collected(divergence(frame(spark, ROWS), least=least, top=3)) == brute(ROWS, least, 3)


def test_ties_and_ranks(spark):
    rows = [(k, "b a" if k % 2 else "c d", "en", f"s{k % 4}") for k in range(8)]
    assert collected(divergence(frame(spark, rows), least=1, top=1)) == brute(rows, 1, 1)


def test_empty_table(spark):
    assert divergence(frame(spark, [])).count() == 0


def test_sql(spark):
    rows = [(k, " ".join(f"w{k % m}x word{chr(97 + k % m)}" for m in (2, 3, 5)), "en", f"s{k % 3}") for k in range(40)]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert collected(divergence(docs)) == sorted(con.sql(source_audit.sql()).fetchall())


def test_large_counts_stay_exact(spark):
    groups = spark.createDataFrame([("en", "a"), ("en", "b")], "lang string, source string")
    big = 3_000_000_000_000_000
    counts = spark.createDataFrame([("en", "a", "x", big, 99), ("en", "b", "y", 7, 99)], "lang string, source string, term string, n long, docs long")
    rows = {(r.source, r.term): (r.p, r.q) for r in dense_shares(groups, counts, kept_terms(counts, 10)).collect()}
    assert rows["a", "x"] == (1 + PARTS * (big + 2) // (big + 4), 1 + PARTS * (big + 2) // (big + 7 + 4))
    assert rows["a", "y"][0] == 1 + PARTS * 2 // (big + 4)
    assert len(rows) == 4


def test_plan_is_relational(spark):
    plan = term_counts(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert SALTS > 1
