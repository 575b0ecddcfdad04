import numpy as np
import xxhash
from pyspark.sql import functions as F

from pointloom.llm import simhash
from pointloom.llm.simhash import EXACT_4, Search, classes, components, keep_one, links


def fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    runs = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 4:
                    label[i] = label[j] = min(label[i], label[j])
    ids = {}
    for (doc_id, _), x in zip(rows, label):
        ids[x] = min((v for v in (ids.get(x), doc_id) if v is not None), default=None)
    return sorted(((d, f"{p:016x}", ids[x]) for (d, _), p, x in zip(rows, prints, label)), key=str)


LONG = " ".join(f"Word{k % 37}é{k}" for k in range(400))
ROWS = [
    (5, LONG),
    (2, LONG.replace("Word3é3 ", "changed ")),
    (9, LONG + "\tend\x0bof\x0ctext"),
    (1, LONG),
    (None, LONG),
    (3, None),
    (4, ""),
    (6, " \n\t "),
    (7, "one two"),
    (7, "one two"),
    (8, "ONE two three four five"),
    (None, "alone with nothing near it at all"),
    (10, "x " * 3000),
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, fp string, root int")


def test_equals_brute_force(spark):
    got = sorted((tuple(r) for r in classes(table(spark, ROWS)).collect()), key=str)
    assert got == brute(ROWS)


def test_trie_join_finds_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    values = set(base.tolist())
    for x in base.tolist():
        for _ in range(15):
            values.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)))
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(k, [v]) for k, v in enumerate(signed)], "node long, fp array<bigint>")
    label = np.arange(len(values))
    near = np.array([[(a ^ b).bit_count() <= 4 for b in values] for a in values])
    for _ in range(30):
        label = np.array([label[near[k]].min() for k in range(len(values))])
    for search in (EXACT_4, Search(subtree=40), Search(subtree=200, crowd=60)):  # one group; several levels; block pairs
        got = {r.node: r.root for r in components(links(fps, search)).collect()}
        assert [got.get(k, k) for k in range(len(values))] == label.tolist()


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components(chain).collect()} == {0}


def test_empty_table(spark):
    assert classes(table(spark, ROWS).limit(0)).count() == 0


def test_keep_one_leaves_one_of_each_group_and_the_columns(spark):
    rng = np.random.default_rng(2)
    clean = [(100 + k, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 200))) for k in range(20)]
    words = clean[0][1].split()
    copies = [(50 + k, " ".join(w if j != 40 * k else "edited" for j, w in enumerate(words))) for k in range(4)]
    docs = table(spark, [*clean, *copies, copies[0], (None, words and clean[1][1])])
    left = keep_one(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([50, *(i for i, _ in clean[1:])])


def test_keep_one_decides_by_the_shingle_sets(spark):
    rng = np.random.default_rng(3)
    rows, gone = [], set()
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 10**9, 104)]
        size = 84 if k % 2 else 83  # 80 or 79 of 100 shingles
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:size]))]
        gone |= {2 * k + 1} if k % 2 else set()
    long = [f"v{x}" for x in rng.integers(0, 10**9, 1000)]
    line = [f"line{x}" for x in range(8)]
    rows += [(1000, " ".join(long)), (1001, " ".join(long[:500] + line * 31 + long[500:]))]
    left = {r.doc_id for r in keep_one(table(spark, rows)).collect()}
    assert left == {i for i, _ in rows} - gone - {1001}


def test_keep_one_equals_all_pairs_in_a_large_group(spark, monkeypatch):
    """Many near copies of one text with edits of their own: those that no chain of similar texts reaches all stay."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    base = [f"b{x}" for x in rng.integers(0, 10**9, 150)]
    texts = []
    for k in range(150):
        at = set(rng.integers(0, 150, rng.integers(0, 7)).tolist())
        texts.append([f"e{k}x{j}" if j in at else w for j, w in enumerate(base)])
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    left = keep_one(table(spark, [(k, " ".join(t)) for k, t in enumerate(texts)]))
    assert sorted(r.doc_id for r in left.collect()) == sorted(set(label))
