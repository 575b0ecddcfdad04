"""LM scoring: a log-bilinear model trained with noise-contrastive estimation beside an add-0.1 unigram base.

Token counts are summed over all training documents with Spark. The most frequent tokens (a fixed number, so that they
may be broadcast) are looked up in the tasks; rarer ones meet their counts in a join. The model has two levels: it
predicts a token's class from the classes of the three tokens before it, then the token among the leaves of its class.
The commonest words are classes of their own; the others are classed by how they end. The number of words that are
leaves grows with the corpus, as the square root of its vocabulary; each class has one leaf more for all its other
tokens, over which their counts spread its probability.

The training texts are kept as lines of leaves. Every task walks over its lines in batches and improves its own copy
of the parameters against noise that it draws; after each round the tasks' copies are averaged by what they saw. In
scoring, products of the context and target matrices are normalised over all classes, and over the leaves of a class.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fold_texts, fresh, held_out, map_texts, one_thread, saved, space_words

#: Tokens that are broadcast with their counts, at most, and the longest of them in bytes.
HEAD, HEAD_BYTES = 1 << 18, 64
#: Classes: 0 is the end (and what stands before a text), 1 all other tokens, then the commonest words, then the
#: commonest endings of the other tokens (their last two bytes).
WORDS, ENDINGS = 78, 112
CLASSES = 2 + WORDS + ENDINGS
#: Words that are leaves: so many for each square root of the number of distinct tokens, at most ``LEAVES`` (with the
#: classes, they are numbered by 16 bits); all further words share the last leaf of their class.
GROWTH, LEAVES = 4, (1 << 16) - CLASSES
#: Tokens of context; width of the vectors.
CONTEXT, WIDTH = 3, 16
#: Examples of a batch, noise classes drawn for it; rounds, each over its part of all lines; rate of the first round.
BATCH, NOISE, ROUNDS, RATE = 1024, 32, 4, 0.01
#: The same for leaves: examples, noise leaves for each of them, rate.
LEAF_BATCH, LEAF_NOISE, LEAF_RATE = 8192, 2, 0.03
#: Contexts that are scored at once, so that their scores stay in the cache.
CONTEXTS = 512
#: Numbers of a piece in which a copy of the parameters is passed on; copies that are summed at once.
PIECE, FAN = 8192, 256
#: Distinct tokens that a task counts before it passes them on.
FLUSH = 200_000
FOLDS = 10
ADD = 0.1


def token_counts(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """token, c: how often each token stands in the training texts."""
    train = fresh(docs.columns, "train__")
    rows = docs.withColumn(train, held_out(F.col(f"`{id_col}`"), FOLDS) != 0)

    def start():
        counts: Counter[bytes] = Counter()

        def flush():
            tokens = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([tokens, pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
            counts.clear()

        def add(texts, flags):
            for text, learn in zip(texts, flags.to_pylist(), strict=True):
                if learn:
                    counts.update(space_words(text))
            if len(counts) > FLUSH:
                yield from flush()

        return add, flush

    found = fold_texts(rows.where(train), text_col, "token string, c long", start, extra=[train])
    return found.groupBy("token").agg(F.sum("c").alias("c"))


def _head(counts: DataFrame) -> list[tuple[str, int]]:
    """The most frequent tokens, at most ``HEAD``: all with at least the smallest count that leaves so few."""
    short = counts.where(F.octet_length("token") <= HEAD_BYTES)
    steps = sorted({int(np.ceil(1.25**k)) for k in range(140)})
    sizes = short.agg(*[F.count_if(F.col("c") >= t).alias(f"n{k}") for k, t in enumerate(steps)]).first()
    least = next((t for t, n in zip(steps, sizes, strict=True) if n <= HEAD), None)
    rows = [] if least is None else short.where(F.col("c") >= least).collect()
    return sorted(((r.token, r.c) for r in rows), key=lambda x: (-x[1], x[0]))


@dataclass
class Classes:
    """Leaves of tokens, numbered class by class; the first leaf of a class stands for all its tokens without one.

    ``words`` and ``endings`` give a leaf. ``count`` and ``distinct``: training tokens of each class that have no leaf of
    their own, and how many different ones. ``leaf_count``: training tokens of each leaf.
    """

    words: dict[bytes, int]
    endings: dict[bytes, int]
    first: np.ndarray
    of_leaf: np.ndarray
    leaf_count: np.ndarray
    count: np.ndarray
    distinct: np.ndarray

    def of(self, tokens: list[bytes]) -> np.ndarray:
        found = np.fromiter(map(self.words.get, tokens, repeat(0)), np.int64, len(tokens))
        others, ending = np.nonzero(found == 0)[0].tolist(), self.endings.get  # leaf 0 is the end, of no token
        found[others] = [ending(tokens[k][-2:], 1) for k in others]
        return found

    def unigram(self) -> np.ndarray:
        """Shares of the classes."""
        sums = np.add.reduceat(self.leaf_count, self.first[:-1]) + ADD
        return sums / sums.sum()


def find_classes(counts: DataFrame, words: list[tuple[bytes, int]], leaves: list[tuple[bytes, int]], ends: int) -> Classes:
    """Classes from the token counts: ``words``, then the endings that most of the other tokens have. ``leaves``: words
    with a leaf of their own in the class of their ending."""
    rest = counts.where(~F.col("token").isin([w.decode() for w, _ in words])) if words else counts
    ending = F.col("token").cast("binary")
    ending = F.substring(ending, F.greatest(F.length(ending) - 1, F.lit(1)), F.lit(2))
    sums = rest.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    found = sorted(((bytes(r.e), r.c, r.v) for r in sums.collect()), key=lambda x: (-x[1], x[0]))  # of two bytes: 2**16
    count, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    count[0], distinct[0] = ends, ends > 0
    count[2 : 2 + len(words)], distinct[2 : 2 + len(words)] = [c for _, c in words], 1
    endings = {e: 2 + WORDS + k for k, (e, _, _) in enumerate(found[:ENDINGS])}
    for e, c, v in found:
        k = endings.get(e, 1)
        count[k], distinct[k] = count[k] + c, distinct[k] + v
    # a leaf for each class, and after it those of its words
    mine = np.array([endings.get(w[-2:], 1) for w, _ in leaves], np.int64)
    sizes = np.bincount(mine, minlength=CLASSES)
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    order = np.argsort(mine, kind="stable")
    leaf = np.empty(len(leaves), np.int64)
    leaf[order] = np.arange(len(leaves)) + mine[order] + 1
    own = np.array([c for _, c in leaves], float)
    count, distinct = count - np.bincount(mine, own, CLASSES), distinct - sizes
    leaf_count = np.zeros(first[-1])
    leaf_count[first[:-1]], leaf_count[leaf] = count, own
    named = {w: int(first[k + 2]) for k, (w, _) in enumerate(words)} | {w: int(k) for (w, _), k in zip(leaves, leaf, strict=True)}
    of_leaf = np.repeat(np.arange(CLASSES), sizes + 1)
    return Classes(named, {e: int(first[k]) for e, k in endings.items()}, first, of_leaf, leaf_count, count, distinct)


def _line(texts: list[list[bytes]], classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """Leaves of all texts, each after ``CONTEXT`` begins and before its end; the places that are to be predicted."""
    parts, places, at = [], [], 0
    begin, end = np.zeros(CONTEXT, np.int64), np.zeros(1, np.int64)
    for tokens in texts:
        parts += [begin, classes.of(tokens), end]
        places.append(np.arange(at + CONTEXT, at + CONTEXT + len(tokens) + 1))
        at += CONTEXT + len(tokens) + 1
    return np.concatenate(parts), np.concatenate(places)


def class_lines(docs: DataFrame, classes: Classes, *, id_col: str, text_col: str) -> DataFrame:
    """line, places (little-endian 16- and 32-bit integers) of the training texts, some of them a row."""
    shared = docs.sparkSession.sparkContext.broadcast(classes)
    train = fresh(docs.columns, "train__")
    rows = docs.withColumn(train, held_out(F.col(f"`{id_col}`"), FOLDS) != 0).where(train)

    def start():
        def add(texts, _):
            line, places = _line([space_words(t) for t in texts], shared.value)
            blobs = [pa.array([x], pa.binary()) for x in (line.astype("<u2").tobytes(), places.astype("<u4").tobytes())]
            yield pa.RecordBatch.from_arrays(blobs, names=["line", "places"])

        return add, lambda: None

    return fold_texts(rows, text_col, "line binary, places binary", start, extra=[train])


def log_shares(hidden: np.ndarray, q: np.ndarray, b: np.ndarray, row: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log probabilities of targets in the contexts ``hidden[row]``, normalised over all rows of ``q``."""
    score = hidden @ q.T
    score += b
    if np.sqrt((hidden**2).sum(1).max(initial=0) * (q**2).sum(1).max()) + b.max() > 79:
        np.minimum(score, np.float32(80), out=score)  # its sum of exponentials is finite
    found = score[row, target]
    np.exp(score, out=score)
    return found - np.log(score.sum(1))[row]


class LogBilinear:
    """score(t after c1, c2, c3) = (sum of r[ci] M[i]) . q[t] + b[t]; the parameters are one flat array."""

    def __init__(self, flat: np.ndarray):
        sizes = [(CLASSES, WIDTH), (CLASSES, WIDTH), (CONTEXT, WIDTH, WIDTH), (CLASSES,)]
        cuts = np.cumsum([int(np.prod(x)) for x in sizes])[:-1]
        self.flat = np.array(flat, np.float32)
        self.r, self.q, self.m, self.b = (v.reshape(x) for v, x in zip(np.split(self.flat, cuts), sizes, strict=True))

    @classmethod
    def begin(cls, unigram: np.ndarray, seed: int = 11) -> LogBilinear:
        rng = np.random.default_rng(seed)
        near = np.stack([np.eye(WIDTH) / (1 + i) for i in range(CONTEXT)])
        return cls(np.concatenate([rng.normal(0, 0.1, 2 * CLASSES * WIDTH), near.ravel(), np.log(unigram)]))

    def contexts(self) -> list[np.ndarray]:
        return [self.r @ self.m[i] for i in range(CONTEXT)]

    def log10(self, line: np.ndarray, places: np.ndarray, inside: Inside | None = None, leaves: np.ndarray | None = None) -> np.ndarray:
        """Normalised log10 probabilities of the classes at the places, or with ``inside`` of the leaves there."""
        key = np.zeros(len(places), np.int64)
        for i in range(CONTEXT):
            key = key * CLASSES + line[places - 1 - i]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.diff(key, prepend=-1) != 0
        keys, starts, of_key = key[new], np.append(np.nonzero(new)[0], len(key)), np.cumsum(new) - 1
        parts, target, out = self.contexts(), line[places[order]], np.zeros(len(places))
        hidden = sum(parts[CONTEXT - 1 - i][keys // CLASSES**i % CLASSES] for i in range(CONTEXT))
        for lo in range(0, len(keys), CONTEXTS):
            hi = min(lo + CONTEXTS, len(keys))
            begin, end = starts[lo], starts[hi]
            out[order[begin:end]] = log_shares(hidden[lo:hi], self.q, self.b, of_key[begin:end] - lo, target[begin:end])
        if inside:
            out[order] += inside.log(hidden, of_key, leaves[places[order]])
        return out / np.log(10)

    def improve(self, line: np.ndarray, places: np.ndarray, unigram: np.ndarray, rng: np.random.Generator, rate: float, state: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """One walk over the places in batches: Adam steps of the noise-contrastive objective. Yields each batch's
        places and what their contexts were, before the step."""
        spread = np.arange(WIDTH)
        log_noise = np.log(NOISE * unigram).astype(np.float32)
        cdf = np.cumsum(unigram) / unigram.sum()

        def added(index, rows):
            at = (index[:, None] * WIDTH + spread).ravel()
            return np.bincount(at, rows.ravel(), CLASSES * WIDTH).reshape(CLASSES, WIDTH)

        for lo in range(0, len(places), BATCH):
            at = places[lo : lo + BATCH]
            before, target = [line[at - 1 - i] for i in range(CONTEXT)], line[at]
            noise = np.minimum(np.searchsorted(cdf, rng.random(NOISE)), CLASSES - 1)
            parts = self.contexts()
            hidden = sum(parts[i][before[i]] for i in range(CONTEXT))
            qt, qn = self.q[target], self.q[noise]
            # the probability that the target is no noise, and that the noise is none
            real = 1 / (1 + np.exp(-np.clip((hidden * qt).sum(1) + self.b[target] - log_noise[target], -30, 30)))
            fake = 1 / (1 + np.exp(-np.clip(hidden @ qn.T + self.b[noise] - log_noise[noise], -30, 30)))
            up, down = (1 - real) / len(at), -fake / len(at)
            back = up[:, None] * qt + down @ qn
            g_q = added(target, up[:, None] * hidden) + added(noise, down.T @ hidden)
            g_b = np.bincount(target, up, CLASSES) + np.bincount(noise, down.sum(0), CLASSES)
            g_parts = [added(before[i], back) for i in range(CONTEXT)]
            g_m = np.stack([self.r.T @ g for g in g_parts])
            g_r = sum(g @ self.m[i].T for i, g in enumerate(g_parts))
            g = np.concatenate([g_r.ravel(), g_q.ravel(), g_m.ravel(), g_b])
            state[0] += 1
            state[1] = 0.9 * state[1] + 0.1 * g
            state[2] = 0.99 * state[2] + 0.01 * g * g
            step = (state[1] / (1 - 0.9 ** state[0])) / (np.sqrt(state[2] / (1 - 0.99 ** state[0])) + 1e-7)
            self.flat += (rate * step).astype(np.float32)
            yield at, hidden


class Inside:
    """Leaves of a class: score(leaf in a context) = hidden . q[leaf] + b[leaf], with the context as the classes see it."""

    def __init__(self, classes: Classes, flat: np.ndarray | None = None):
        self.classes, n = classes, len(classes.of_leaf)
        share = classes.leaf_count + ADD
        self.share = share / np.add.reduceat(share, classes.first[:-1])[classes.of_leaf]
        self.flat = np.concatenate([np.zeros(n * WIDTH), np.log(self.share)]).astype(np.float32) if flat is None else np.array(flat, np.float32)
        self.q, self.b = self.flat[: n * WIDTH].reshape(n, WIDTH), self.flat[n * WIDTH :]
        self.state, self.waiting, self.waits = [0, 0.0, 0.0], [], 0

    def log(self, hidden: np.ndarray, row: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Normalised log probabilities of leaves within their classes, in the contexts ``hidden[row]``."""
        out, of = np.zeros(len(leaf)), self.classes.of_leaf[leaf]
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(CLASSES + 1))
        for c in np.nonzero((np.diff(ends) > 0) & (np.diff(self.classes.first) > 1))[0]:
            lo, hi = self.classes.first[c], self.classes.first[c + 1]
            step = max(1, (1 << 18) // (hi - lo))
            for at in range(ends[c], ends[c + 1], step):
                some = order[at : min(at + step, ends[c + 1])]
                new = np.diff(row[some], prepend=-1) != 0  # equal contexts stand together
                out[some] = log_shares(hidden[row[some[new]]], self.q[lo:hi], self.b[lo:hi], np.cumsum(new) - 1, leaf[some] - lo)
        return out

    def learn(self, hidden: np.ndarray, leaf: np.ndarray, rng: np.random.Generator, rate: float, *, last: bool = False) -> None:
        """Examples wait until there are enough of them for a step."""
        of = self.classes.of_leaf[leaf]
        several = np.diff(self.classes.first)[of] > 1
        self.waiting.append((hidden[several], leaf[several]))
        self.waits += int(several.sum())
        if self.waits and (last or self.waits >= LEAF_BATCH):
            self.step(*(np.concatenate(x) for x in zip(*self.waiting, strict=True)), rng, rate)
            self.waiting, self.waits = [], 0

    def step(self, hidden: np.ndarray, leaf: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """An Adam step of the noise-contrastive objective; the noise comes from the class of each example, by counts."""
        cdf = np.cumsum(self.share)
        of, n = self.classes.of_leaf[leaf], len(leaf)
        noise = np.searchsorted(cdf, of[:, None] + rng.random((n, LEAF_NOISE)))  # each class has a share of 1
        noise = np.clip(noise, self.classes.first[of][:, None], self.classes.first[of + 1][:, None] - 1)
        shift = np.log(LEAF_NOISE * self.share).astype(np.float32)
        tried = np.concatenate([leaf[:, None], noise], axis=1)
        score = np.einsum("nw,nkw->nk", hidden, self.q[tried]) + self.b[tried] - shift[tried]
        up = -1 / (1 + np.exp(-np.clip(score, -30, 30))) / n
        up[:, 0] += 1 / n
        at, many = tried.ravel(), len(self.b)
        g_q = [np.bincount(at, (up * hidden[:, [w]]).ravel(), many) for w in range(WIDTH)]
        g = np.concatenate([np.stack(g_q, axis=1).ravel(), np.bincount(at, up.ravel(), many)]).astype(np.float32)
        state = self.state
        state[0] += 1
        state[1] = np.float32(0.9) * state[1] + np.float32(0.1) * g
        state[2] = np.float32(0.99) * state[2] + np.float32(0.01) * g * g
        down = np.sqrt(state[2] / np.float32(1 - 0.99 ** state[0])) + np.float32(1e-7)
        self.flat += np.float32(rate / (1 - 0.9 ** state[0])) * state[1] / down


def _summed(copies: DataFrame) -> tuple[int, np.ndarray]:
    """What all tasks saw, and the weighted sum of their copies: piece by piece, first of up to ``FAN`` tasks, then of all."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in table.column("part").to_pylist())
        first = table.slice(0, 1)
        return pa.table([first.column("task"), first.column("piece"), pa.array([sum(table.column("n").to_pylist())]), pa.array([total.tobytes()], pa.binary())], names=table.column_names)

    groups = copies.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "piece").applyInArrow(add, copies.schema)
    rows = sorted(groups.groupBy("piece").applyInArrow(add, copies.schema).collect(), key=lambda r: r.piece)
    return (rows[0].n, np.concatenate([np.frombuffer(r.part, "<f8") for r in rows])) if rows else (0, np.zeros(0))


def train(lines: DataFrame, classes: Classes, *, rounds: int = ROUNDS, seed: int = 11) -> tuple[LogBilinear, Inside]:
    """``ROUNDS`` rounds over ``lines`` (line, places), each over its own part of every line."""
    spark, unigram = lines.sparkSession, classes.unigram()
    model, inside = LogBilinear.begin(unigram, seed), Inside(classes)
    for n in range(rounds):
        shared = spark.sparkContext.broadcast((model.flat, inside.flat, classes, unigram))
        left = 1 - n / (rounds + 1)

        def walk(batches, shared=shared, n=n, left=left):
            from pyspark import TaskContext

            one_thread()
            flat, inner, kinds, noise = shared.value
            mine, own, seen, state = LogBilinear(flat), Inside(kinds, inner), 0, [0, 0.0, 0.0]
            task = TaskContext.get().partitionId()
            rng = np.random.default_rng([seed, n, task])
            for batch in batches:
                for line, places in zip(batch.column("line").to_pylist(), batch.column("places").to_pylist(), strict=True):
                    leaves, places = np.frombuffer(line, "<u2").astype(np.int64), np.frombuffer(places, "<u4").astype(np.int64)
                    part = places[len(places) * n // rounds : len(places) * (n + 1) // rounds]
                    for at, hidden in mine.improve(kinds.of_leaf[leaves], part, noise, rng, RATE * left, state):
                        own.learn(hidden, leaves[at], rng, LEAF_RATE * left)
                    seen += len(part)
            if seen:
                own.learn(np.zeros((0, WIDTH), np.float32), np.zeros(0, np.int64), rng, LEAF_RATE * left, last=True)
                total = seen * np.concatenate([mine.flat, own.flat]).astype(np.float64)
                for k, at in enumerate(range(0, len(total), PIECE)):
                    part = [pa.array([task]), pa.array([k]), pa.array([seen]), pa.array([total[at : at + PIECE].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(part, names=["task", "piece", "n", "part"])

        total, flat = _summed(lines.mapInArrow(walk, "task long, piece long, n long, part binary"))
        shared.unpersist()
        if total:
            one, two = np.split(flat / total, [len(model.flat)])
            model, inside = LogBilinear(one), Inside(classes, two)
    return model, inside


@dataclass
class Scorer:
    """What a task needs: the head's numbers by token, logs of their counts, classes, and the model."""

    number: dict[bytes, int]
    log_count: np.ndarray
    classes: Classes
    model: LogBilinear
    inside: Inside
    base_all: float  # log10 of the base's denominator
    shared: np.ndarray  # of a leaf: whether several tokens share it
    among: np.ndarray  # of a leaf: log10 of the denominator of the tokens that share it; 0 for a leaf of one token
    base_end: float  # log10 of the end's probability in the base
    end_known: int


def fit(docs: DataFrame, counts: DataFrame, *, id_col: str, text_col: str) -> tuple[Scorer, int]:
    """The scorer and the number of training tokens; ``counts`` as of ``token_counts``, written."""
    ends = docs.where(held_out(F.col(f"`{id_col}`"), FOLDS) != 0).count()
    sums = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = sums.n + ends, sums.v + (ends > 0)
    words = [(t.encode(), c) for t, c in _head(counts)]
    leaves = min(LEAVES, int(np.ceil(GROWTH * np.sqrt(sums.v))))
    classes = find_classes(counts, words[:WORDS], words[WORDS : WORDS + leaves], ends)
    lines = saved(class_lines(docs, classes, id_col=id_col, text_col=text_col), "lines")
    of = classes.of_leaf
    shared = np.isin(np.arange(len(of)), classes.first[:-1]) & ((of == 1) | (of >= 2 + WORDS))
    among = np.where(shared, np.log10(np.maximum(classes.count[of] + ADD * (classes.distinct[of] + 1), ADD)), 0.0)
    base_all = float(np.log10(n + ADD * (v + 1)))
    scorer = Scorer(
        {w: k for k, (w, _) in enumerate(words)},
        np.log10(np.array([c for _, c in words] + [0.0]) + ADD),  # the last: a token that is not in the head
        classes,
        *train(lines, classes),
        base_all,
        shared,
        among,
        float(np.log10(ends + ADD)) - base_all,
        int(ends > 0),
    )
    return scorer, int(n)


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from documents whose crc32(id) modulo 10 is not 0. Null and empty texts are one end token. Without training
    documents all tokens are unknown, and the model is as it began.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = saved(token_counts(rows, id_col="id", text_col="text"), "tokens")
    scorer, train_tokens = fit(rows, counts, id_col="id", text_col="text")
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def start():
        one_thread()
        s = shared.value
        get, rare = s.number.get, len(s.number)
        leaf_of = np.append(s.classes.of(list(s.number)), 0)  # numbers are in order

        def work(texts):
            out = [[], [], [], []]
            tail, tail_n, ends, lines = [], [], [0], []
            for text in texts:
                words = space_words(text)
                at = np.fromiter(map(get, words, repeat(rare)), np.int64, len(words))
                logs, unknown = s.log_count[at], at == rare
                line, others = leaf_of[at], np.nonzero(unknown)[0].tolist()
                few = [words[k] for k in others]
                line[unknown] = s.classes.of(few)
                out[0].append(len(words) + 1)
                out[1].append(len(words) - int(unknown.sum()) + s.end_known)
                out[2].append(float(logs.sum()) - len(words) * s.base_all + s.base_end)
                out[3].append(float(logs[s.shared[line]].sum() - s.among[line].sum()))
                lines.append(line)
                rest = Counter(few)
                tail += rest
                tail_n += rest.values()
                ends.append(len(tail))
            if lines:
                zeros, end = np.zeros(CONTEXT, np.int64), np.zeros(1, np.int64)
                line = np.concatenate([x for y in lines for x in (zeros, y, end)])
                sizes = np.array([len(y) + 1 for y in lines])
                places = np.arange(sizes.sum()) + CONTEXT * (1 + np.repeat(np.arange(len(sizes)), sizes))
                of_text = np.add.reduceat(s.model.log10(s.classes.of_leaf[line], places, s.inside, line), np.cumsum(sizes) - sizes)
                out[3] = (np.array(out[3]) + of_text).tolist()
            pairs = pa.StructArray.from_arrays(
                [pa.array(tail, pa.binary()).cast(pa.string()), pa.array(tail_n, pa.int64())], names=["token", "n"]
            )
            tails = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            return [*(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)), tails]

        return work

    fields = [("n_tokens", "long"), ("n_known", "long"), ("base_score", "double"), ("score", "double"), ("tail", "array<struct<token:string,n:bigint>>")]
    scored = map_texts(rows, ["id"], "text", fields, start)
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # rare tokens counted as unknown so far: those of the training texts get what their counts add
    tail = scored.select("row", F.inline("tail")).join(counts, "token")
    more = tail.groupBy("row").agg(
        F.sum("n").alias("known"), F.sum(F.col("n") * (F.log10(F.col("c") + ADD) - F.log10(F.lit(ADD)))).alias("gain")
    )
    found = scored.drop("tail").join(saved(more, "gains"), "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return found.select(
        F.col("id").alias(id_col),
        (held_out(F.col("id"), FOLDS) == 0).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )
