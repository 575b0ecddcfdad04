import hashlib
import re

from pointloom.llm import decontaminate
from pointloom.llm.decontaminate import contamination, drop_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_near(docs, bench, span=20):
    """Items by document whose three rarest words stand near the rarest, without those that match exactly."""
    from collections import Counter

    items = [(str(i), words(t)) for i, t in dict.fromkeys(bench) if i is not None and words(t)]
    counts = Counter(w for _, t in docs for w in words(t))
    out = {}
    for doc_id, text in docs:
        w, n_near = words(text), 0
        for _, item in items:
            rare = sorted(set(item), key=lambda x: (counts[x], x.encode()))[:3]
            size = min(10, len(item))
            exact = any(w[p : p + size] == item[s : s + size] for s in range(len(item) - size + 1) for p in range(len(w) - size + 1))
            at = [[p for p, x in enumerate(w) if x == r] for r in rare]
            n_near += len(rare) == 3 and not exact and any(all(any(abs(p - o) <= span for o in other) for other in at[1:]) for p in at[0])
        out[doc_id] = n_near
    return out


def brute(docs, bench):
    items = {(str(i), tuple(w)) for i, t in bench if i is not None and (w := words(t))}
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for name, item in items:
            n = min(10, len(item))
            for s in range(len(item) - n + 1):
                for p in range(len(w) - n + 1):
                    if tuple(w[p : p + n]) == item[s : s + n]:
                        hit |= set(range(p, p + n))
                        names.add(name)
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=str)


LONG = " ".join(f"w{k} é{k}" for k in range(20))
BENCH = [(1, LONG), (2, "just four small words"), (3, ""), (4, None), (None, "the the the"), (11, "a b " * 8), (1, LONG)]
DOCS = [
    (1, "x " + LONG.upper().replace("É", "É") + " y"),
    (2, "Just, FOUR-small\nwords! just four small words just four small"),
    (3, None),
    (4, ""),
    (5, "z " * 5000 + " ".join(LONG.split()[5:17]) + " q" * 5000),
    (6, "a b " * 40),
    (6, "a b " * 40),
    (None, "just four small words"),
    (7, " ".join(LONG.split()[:9])),
    (8, " ".join(reversed(LONG.split()[:8]))),
]


def table(spark, docs, extra=""):
    return spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, matches string, n_words int")


def rows(df):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def test_equals_brute_force_with_nulls_ties_and_clashing_columns(spark):
    docs = [(i, t.replace("É", "é") if t else t) for i, t in DOCS]
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert rows(contamination(table(spark, docs), bench)) == brute(docs, BENCH)


def test_blocks_give_the_same_rows(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    whole = rows(contamination(table(spark, DOCS), bench))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 10)
    assert rows(contamination(table(spark, DOCS), bench)) == whole


def test_empty_tables(spark):
    docs, bench = table(spark, DOCS), spark.createDataFrame([], "item_id long, text string")
    assert all(not r[-1] and r[1] == len(words(dict(DOCS)[r[0]])) for r in rows(contamination(docs, bench)) if r[0] != 6)
    assert contamination(docs.limit(0), spark.createDataFrame(BENCH, "item_id long, text string")).count() == 0


def test_proximity_and_filter(spark):
    bench = spark.createDataFrame([*BENCH, (20, "alpha beta gamma delta")], "item_id long, text string")
    docs = [*DOCS, (9, "gamma x alpha y beta z delta"), (10, "gamma alpha " + "x " * 50 + "beta delta")]
    near = {r.doc_id: r.n_near_items for r in contamination(table(spark, docs), bench).collect()}
    assert (near[9], near[10], near[3]) == (1, 0, 0)
    left = drop_contaminated(table(spark, docs), bench)
    assert left.columns == ["doc_id", "text", "matches", "n_words"]
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 7, 8, 9, 10]  # document 1 has É where the item has é


def test_common_words_only(spark):
    """All windows consist of the most frequent word; candidates are cut into pieces."""
    docs = [(k, "the " * 3000) for k in range(3)]
    got = rows(contamination(table(spark, docs), spark.createDataFrame([(9, "the " * 30)], "item_id long, text string")))
    assert [r[1:4] for r in got] == [(3000, 3000, 1)] * 3


def test_proximity_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"t{k}" for k in range(40)] + ["aaa", "bbb", "ccc"]
    bench = [(k, " ".join(rng.sample(vocabulary, 6))) for k in range(30)] + [(99, "aaa bbb ccc")]
    docs = [(k, " ".join(rng.choices(vocabulary[:40], k=rng.randint(0, 120)))) for k in range(60)]
    docs += [(100, "ccc bbb " + "x " * 500 + "ccc aaa"), (101, "aaa " + "x " * 19 + "bbb ccc"), (102, "bbb aaa ccc")]
    got = {r.doc_id: r.n_near_items for r in contamination(table(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == brute_near(docs, bench)
    assert (got[100], got[102]) == (0, 1)


def test_query_equals_sql(spark):
    import duckdb

    from pointloom.llm.queries import ORACLE_SQL, QUERIES

    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    want = con.sql(ORACLE_SQL["op9_decontaminate"])
    got = QUERIES["op9_decontaminate"](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r) for r in got.select(want.columns).collect()) == sorted(want.fetchall())
