import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pointloom.llm import language_model
from pointloom.llm.language_model import ADD, CLASSES, CONTEXT, WIDTH, Classes, Inside, LogBilinear, score_texts, train


def rows():
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "x" * 200]
    out = [(k, " ".join(rng.choice(words, int(rng.integers(1, 40)))) + ("\n\tRare%d" % (k // 2))) for k in range(60)]
    return [*out, (100, None), (101, ""), (None, "w1 w2 never-seen-word"), (3, out[3][1]), (102, "w1 " * 4000)]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def brute(data):
    out = lambda i, m: zlib.crc32(b"" if i is None else str(i).encode()) % m == 0
    counts, n = Counter(), 0
    for i, t in data:
        if not out(i, 10):
            counts.update([*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    found = []
    for i, t in data:
        seq = [*tokens(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq)
        found.append((i, out(i, 10), len(seq), sum(counts[w] > 0 for w in seq), n, base))
    return sorted(found, key=str)


def table(spark, data):
    return spark.createDataFrame([(*r, 1.0, "r") for r in data], "doc_id long, text string, score double, row string")


@pytest.mark.parametrize("head", [1 << 18, 10])
def test_base_equals_brute_force(spark, monkeypatch, head):
    monkeypatch.setattr(language_model, "HEAD", head)
    monkeypatch.setattr(language_model, "FLUSH", 7)
    got = sorted((tuple(r)[:6] for r in score_texts(table(spark, rows())).collect()), key=str)
    want = brute(rows())
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])


def test_scores_do_not_depend_on_the_size_of_the_head(spark, monkeypatch):
    """Rarer tokens meet their counts in a join instead of the head; the words that are classes or leaves are the same."""
    monkeypatch.setattr(language_model, "WORDS", 5)
    monkeypatch.setattr(language_model, "GROWTH", 1)
    whole = {(r.doc_id, r.n_tokens): r.score for r in score_texts(table(spark, rows())).collect()}
    monkeypatch.setattr(language_model, "HEAD", 40)
    small = {(r.doc_id, r.n_tokens): r.score for r in score_texts(table(spark, rows())).collect()}
    assert whole.keys() == small.keys() and all(abs(whole[k] - small[k]) < 1e-3 * abs(whole[k]) for k in whole)


def kinds(leaf_count, sizes=None):
    """Classes of so many leaves (one, unless told) with these counts; no token of them is known."""
    sizes = np.ones(CLASSES, int) if sizes is None else sizes
    first = np.concatenate([[0], np.cumsum(sizes)])
    return Classes({}, {}, first, np.repeat(np.arange(CLASSES), sizes), np.asarray(leaf_count, float), leaf_count[first[:-1]], np.ones(CLASSES))


def chain(rng, n):
    """Classes of which each depends on the one three places before it."""
    jump = rng.dirichlet(np.full(40, 0.05), 40)
    line = [0] * CONTEXT
    for _ in range(n):
        line.append(int(rng.choice(40, p=jump[line[-3]])))
    return np.array(line)


def test_log_probabilities_are_normalised_and_learn_from_three_places(spark):
    rng = np.random.default_rng(1)
    line = chain(rng, 60_000)
    places = np.arange(CONTEXT, len(line))
    classes = kinds(np.bincount(line[places], minlength=CLASSES))
    unigram = classes.unigram()
    rows_ = [(bytearray(line.astype("<u2").tobytes()), bytearray(places.astype("<u4").tobytes()))]
    frame = spark.createDataFrame(rows_ * 6, "line binary, places binary").coalesce(1)
    model, _ = train(frame, classes)
    some = places[:50]
    total = np.zeros(50)
    for t in range(CLASSES):
        other = line.copy()
        for k, p in enumerate(some):
            total[k] += 10 ** model.log10(np.concatenate([line[p - CONTEXT : p], [t]]), np.array([CONTEXT]))[0]
    assert np.allclose(total, 1, atol=1e-4)
    got, base = model.log10(line, places).mean(), np.log10(unigram[line[places]]).mean()
    assert got > base + 0.2
    assert np.allclose(LogBilinear(model.flat).log10(line, places[::7]), model.log10(line, places)[::7])


def test_gradient_of_the_objective(monkeypatch):
    """A step moves along the gradient of the noise-contrastive objective, found by differences."""
    rng = np.random.default_rng(2)
    line, unigram = rng.integers(0, 6, 40), np.full(CLASSES, 1 / CLASSES)
    places, noise_rng = np.arange(CONTEXT, 40), np.random.default_rng(9)
    model = LogBilinear(rng.normal(0, 0.3, len(LogBilinear.begin(unigram).flat)))
    noise = np.minimum(np.searchsorted(np.cumsum(unigram) / unigram.sum(), np.random.default_rng(9).random(language_model.NOISE)), CLASSES - 1)

    def objective(flat):
        m = LogBilinear(flat)
        hidden = sum(p[line[places - 1 - i]] for i, p in enumerate(m.contexts())).astype(float)
        shift = np.log(language_model.NOISE * unigram)
        score = hidden @ m.q.T.astype(float) + m.b - shift
        good = -np.log1p(np.exp(-score[np.arange(len(places)), line[places]])).mean()
        return good - np.log1p(np.exp(score[:, noise])).sum() / len(places)

    state = [0, 0.0, 0.0]
    before = model.flat.copy()
    list(model.improve(line, places, unigram, noise_rng, 1e-9, state))
    g = state[1] / 0.1
    for k in rng.choice(np.nonzero(np.abs(g) > 1e-3)[0], 12, replace=False):
        up, down = before.astype(float), before.astype(float)
        up[k] += 1e-2
        down[k] -= 1e-2
        assert (objective(up) - objective(down)) / 2e-2 == pytest.approx(g[k], rel=0.05, abs=2e-4)


def leafy(rng):
    sizes = np.ones(CLASSES, int)
    sizes[[1, 5]] = 7, 3
    classes = kinds(rng.integers(1, 50, sizes.sum()), sizes)
    inside = Inside(classes, rng.normal(0, 0.4, sizes.sum() * (WIDTH + 1)))
    return classes, inside


def test_leaves_of_each_class_are_normalised():
    rng = np.random.default_rng(3)
    classes, inside = leafy(rng)
    hidden, n = rng.normal(size=(4, WIDTH)).astype(np.float32), len(classes.of_leaf)
    for k in range(4):
        sums = np.bincount(classes.of_leaf, np.exp(inside.log(hidden, np.full(n, k), np.arange(n))))
        assert np.allclose(sums, 1, atol=1e-5)
    fresh = Inside(classes)  # as it begins: by the counts
    want = (classes.leaf_count + ADD) / np.bincount(classes.of_leaf, classes.leaf_count + ADD)[classes.of_leaf]
    assert np.allclose(np.exp(fresh.log(hidden, np.zeros(n, int), np.arange(n))), want, atol=1e-5)


def test_leaves_learn_what_their_context_says():
    """Two contexts, each with leaves of its own in class 1; the noise of an example comes from its class."""
    rng = np.random.default_rng(4)
    classes, _ = leafy(rng)
    inside, hidden = Inside(classes), np.eye(WIDTH, dtype=np.float32)[rng.integers(0, 2, 40_000)]
    leaf = 1 + np.where(hidden[:, 0] > 0, rng.integers(0, 3, 40_000), 3 + rng.integers(0, 4, 40_000))
    for at in range(0, 40_000, 1000):
        inside.learn(hidden[at : at + 1000], leaf[at : at + 1000], rng, 0.1)
    for _ in range(20):
        inside.learn(hidden, leaf, rng, 0.1)
    found = np.exp(inside.log(np.eye(WIDTH, dtype=np.float32)[:2], np.repeat([0, 1], 7), np.tile(np.arange(1, 8), 2))).reshape(2, 7)
    assert found[0, :3].sum() > 0.9 and found[1, 3:].sum() > 0.9
    begun = Inside(classes)
    assert np.array_equal(inside.b[8:12], begun.b[8:12])  # leaves of other classes were no noise


def test_copies_are_summed_whatever_their_number(spark, monkeypatch):
    monkeypatch.setattr(language_model, "FAN", 3)
    rows_ = [(t, p, t + 1, bytearray(np.full(4, t * 10.0 + p).tobytes())) for t in range(10) for p in range(2)]
    n, flat = language_model._summed(spark.createDataFrame(rows_, "task long, piece long, n long, part binary"))
    assert n == 55 and flat.tolist() == [450.0] * 4 + [460.0] * 4


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = [r for r in score_texts(docs).collect() if r.held_out and r.n_tokens > 50]
    tokens_ = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens_ > sum(r.base_score for r in got) / tokens_ + 0.1


def test_empty_and_untrained(spark):
    assert score_texts(table(spark, rows()).limit(0)).count() == 0
    lone = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    row = score_texts(table(spark, [(lone, "a b")])).collect()[0]
    assert (row.n_known, row.train_tokens) == (0, 0) and row.base_score == pytest.approx(0.0)
    assert CLASSES > 2


def test_a_context_is_scored_once_a_class(monkeypatch):
    """Of leaves of one class in equal contexts the denominator is found once, and the values are those of each alone."""
    first = np.concatenate([[0, 1], 4 + np.arange(CLASSES - 1)])  # class 1 has three leaves
    of_leaf = np.repeat(np.arange(CLASSES), np.diff(first))
    classes = Classes({}, {}, first, of_leaf, np.ones(len(of_leaf)), np.ones(CLASSES), np.ones(CLASSES))
    inside = Inside(classes)
    rng = np.random.default_rng(6)
    inside.flat[:] = rng.normal(size=len(inside.flat))
    hidden = rng.normal(size=(2, WIDTH)).astype(np.float32)
    row, leaf = np.repeat([0, 1], 50), 1 + np.arange(100) % 3
    asked, shares = [], language_model.log_shares
    monkeypatch.setattr(language_model, "log_shares", lambda h, *a: asked.append(len(h)) or shares(h, *a))
    got = inside.log(hidden, row, leaf)
    score = hidden @ inside.q[1:4].T + inside.b[1:4]
    assert np.allclose(got, score[row, leaf - 1] - np.log(np.exp(score).sum(1))[row], atol=1e-5)
    assert asked == [2]
