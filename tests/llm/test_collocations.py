import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def pieces(text):
    low = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, least, longest, top):
    f, n = counted(rows, longest)
    out = []
    for lang in n:
        long = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= least}
        found = []
        for p, a in long.items():
            if any(100 * b >= 100 * a for q, b in long.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))):
                continue
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
        out += [(lang, k + 1, *x[3:]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out)


TEXT = "New York is not new york. The new York\ttimes, the new york times; a a a a a a a a\nthe new\x0byork times! 𝒳 É é É é"
ROWS = [
    *[(TEXT, "en")] * 3,
    (TEXT.replace("york", "hope"), "en"),
    (None, "en"),
    ("", None),
    (" \t.,;", "xx"),
    ("only words of no language no language no language", None),
    (("tick tock " * 3000 + ".") * 4 + "end", "de"),
    ("z" * 5000 + " b", "en"),
]


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "clash", 1) for k, r in enumerate(rows)], SCHEMA)


def collected(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("shard", [40, 12 << 20])
def test_brute_force(spark, shard):
    """Null, empty and long texts, repeated rows, ties, other columns; a shard of one text and of all."""
    assert collected(c.collocations(frame(spark, ROWS), least=3, shard=shard)) == brute(ROWS, 3, 5, c.TOP)


def test_limit_of_a_language(spark):
    assert collected(c.collocations(frame(spark, ROWS), least=2, top=3)) == brute(ROWS, 2, 5, 3)


def test_empty_table(spark):
    assert c.collocations(frame(spark, [])).count() == 0


def test_sql(spark):
    rng = np.random.default_rng(1)
    rows = [(" ".join(f"w{x}" + "." * (x % 7 == 0) for x in rng.zipf(1.5, 300).tolist() if x < 40), "en" if k % 2 else None) for k in range(40)]
    docs = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(c.sql()).fetchall())
    assert want and collected(c.collocations(docs)) == want == brute(rows, 100, 5, c.TOP)


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame(
        [("en", "a", 1, 3 * 10**12), ("en", "b", 1, 2 * 10**12), ("en", "a b", 2, 10**12)], "lang string, phrase string, size int, f long"
    )
    row = c.scored(phrases, spark.createDataFrame([("en", 10**16)], "lang string, n long")).first()
    assert row.score == 1000 * 10**12 * 10**16 // (6 * 10**24)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .\t,é", max_size=40), max_size=6), st.integers(1, 30))
def test_bitmaps_count_like_a_scan(texts, limit):
    """Shift, AND and popcount give the counts of a plain scan, however the text is cut and the stack sliced."""
    f: Counter = Counter()
    for part in c._parts([t.encode() for t in texts], limit):
        words, place = c.pieces_words(part)
        words = words.dictionary_encode()
        known = words.dictionary.to_pylist()
        if known:
            old, c.STEP = c.STEP, 3
            try:
                for chain, n in c.shard_phrases(words.indices.to_numpy(), place, len(known), np.zeros(len(known), np.uint64), 2, 4, None):
                    f.update({tuple(known[x].decode() for x in row): int(k) for row, k in zip(chain, n)})
            finally:
                c.STEP = old
    want, _ = counted([(t, "") for t in texts], 4)
    assert f == {p: n for (_, p), n in want.items() if len(p) > 1}


def test_filter_only_adds(spark):
    """A filter of few bits lets too much through, and nothing less."""
    phrases = spark.createDataFrame([("en", f"w{k}") for k in range(50)], "lang string, phrase string")
    found = c.filter_of(phrases, 1, bits=128)
    assert found.holds(c._hashes("en", pa.array([f"w{k}".encode() for k in range(50)]))).all()
    many = c.filter_of(phrases, 1)
    assert not many.holds(c._hashes("en", pa.array([f"v{k}".encode() for k in range(1000)]))).any()
