"""Quality classifier: Random Fourier features over document statistics, ridge by summed normal equations, isotonic.

One pass over the texts computes a short vector of statistics for each document. Cosines of random projections of the
standardised vector approximate a Gaussian kernel; each partition adds up its part of the normal equations, fold by
fold, and the sums are solved on the driver (their size depends on the features only). Out-of-fold scores, counted in
narrow bins, are made probabilities by isotonic regression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fresh, held_out, map_texts, saved

#: Labelled rows that are fitted at most, chosen by a hash of the id: the documented bound of the fit.
TRAIN_ROWS = 200_000
#: Random features; width of the kernel in standard deviations of a statistic, over the root of their number.
FEATURES, WIDTH = 256, 1.0
RIDGE = 1e-3
#: Bins of out-of-fold scores; partitions of the labelled rows; folds, of which fold 0 is never learned from.
BINS, PARTS, FOLDS = 2048, 8, 5

STATISTICS = (
    "log_words", "log_lines", "word_length", "distinct_words", "distinct_pairs", "stutter", "top_word", "repeated_lines",
    "symbols", "bars", "shouts", "capitals", "digits", "stops", "commas", "foreign", "line_words", "unended_lines",
    "worst_line", "short_words",
)
_SYMBOL = re.compile(rb"[#*$%&|<>]|[!?]{2,}")


def _classes() -> np.ndarray:
    """Byte classes as 0/1 columns: symbols, bars, capitals, small letters, digits, stops, commas, foreign, marks."""
    sets = [b"#*$%&<>", b"|", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".", b",;:", b"", b"!?"]
    out = np.zeros((256, len(sets)))
    for k, chars in enumerate(sets):
        out[list(chars), k] = 1
    out[128:, 7] = 1
    return out


_CLASS = _classes()


def statistics(text: bytes) -> list[float]:
    """The statistics of one text; all are finite, also for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    symbols, bars, capitals, small, digits, stops, commas, foreign, marks = (
        np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS
    )
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    sizes = [x.count(b" ") + 1 for x in lines]
    worst = max(len(_SYMBOL.findall(x)) / s for x, s in zip(lines, sizes, strict=True))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = max(1, n - 1)
    chars = sum(map(len, words))
    return [
        np.log1p(n),
        np.log1p(len(lines)),
        np.log1p(chars / n),
        len(counts) / n,
        len(set(zip(words, words[1:]))) / pairs,  # noqa: B905
        sum(map(eq, words, words[1:])) / pairs,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        np.log1p(symbols / n),
        np.log1p(bars / n),
        np.log1p(marks / n),
        capitals / max(1.0, capitals + small),
        np.log1p(digits / n),
        np.log1p(stops / n),
        np.log1p(commas / n),
        foreign / chars,
        np.log1p(n / len(lines)),
        sum(x.rstrip()[-1:] not in b'.!?"' for x in lines) / len(lines),
        np.log1p(worst),
        sum(1 for w in counts if len(w) <= 3) / len(counts),
    ]


def with_statistics(docs: DataFrame, *, keep: list[str], text_col: str = "text", name: str = "stats") -> DataFrame:
    """Columns ``keep`` and the statistics of each text (array of doubles)."""

    def start():
        def work(texts):
            flat = np.array([statistics(t) for t in texts]).ravel()
            ends = np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]

        return work

    return map_texts(docs, keep, text_col, [(name, "array<double>")], start)


class Kernel:
    """Standardisation and random features; the last feature is the constant."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, np.inf)
        self.direction = rng.normal(size=(len(mean), FEATURES)) / (WIDTH * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) * self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.direction + self.phase), np.ones((len(z), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _normal_equations(rows: DataFrame, kernel: Kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums by fold of features' products, features times labels, and rows; each partition sends one row a fold."""
    size = FEATURES + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS)
        for batch in batches:
            x, y = kernel.features(_matrix(batch.column("stats"))), batch.column("y").to_numpy()
            fold = batch.column("fold").to_numpy()
            for f in range(1, FOLDS):
                mine = x[fold == f]
                a[f] += mine.T @ mine
                b[f] += mine.T @ y[fold == f]
                n[f] += len(mine)
        sums = [pa.array(range(1, FOLDS), pa.int32()), pa.array([v.ravel() for v in a[1:]]), pa.array(list(b[1:])), pa.array(n[1:])]
        yield pa.RecordBatch.from_arrays(sums, names=["fold", "a", "b", "n"])

    a, b, n = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size)), np.zeros(FOLDS)
    for r in rows.repartition(PARTS, "id").mapInArrow(run, "fold int, a array<double>, b array<double>, n double").toLocalIterator():
        a[r.fold] += np.array(r.a).reshape(size, size)
        b[r.fold] += r.b
        n[r.fold] += r.n
    return a, b, n


def _ridge(a: np.ndarray, b: np.ndarray, n: float) -> np.ndarray:
    penalty = np.full(len(b), RIDGE * max(n, 1.0))
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), b) if n else np.zeros(len(b))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the best non-decreasing fit (pool adjacent violators); x is sorted."""
    blocks: list[list[float]] = []  # weight, sum of x, sum of y
    for k in range(len(x)):
        blocks.append([weight[k], weight[k] * x[k], weight[k] * y[k]])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    table = np.array(blocks).reshape(-1, 3)
    return table[:, 1] / table[:, 0], table[:, 2] / table[:, 0]


class Model:
    """Scores (0 to 1) from statistics: the share of label 1 at that ridge score."""

    def __init__(self, kernel: Kernel, weights: np.ndarray, at: np.ndarray, value: np.ndarray):
        self.kernel, self.weights, self.at, self.value = kernel, weights, at, value

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.kernel.features(stats) @ self.weights
        if not len(self.at):
            return np.full(len(raw), 0.5)
        return np.clip(np.interp(raw, self.at, self.value), 0, 1)


def fit(labelled: DataFrame) -> Model:
    """Fits rows of (id, fold, stats, y): at most ``TRAIN_ROWS`` of them, none of fold 0."""
    rows = labelled.where("fold > 0")
    share = TRAIN_ROWS / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = saved(rows, "labelled")
    each = [F.col("stats")[k] for k in range(len(STATISTICS))]
    moments = rows.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    moments = np.array([0.0 if v is None else v for v in moments])
    kernel = Kernel(moments[: len(each)], moments[len(each) :])
    a, b, n = _normal_equations(rows, kernel)
    weights = _ridge(a.sum(0), b.sum(0), n.sum())
    others = np.stack([_ridge(a.sum(0) - a[f], b.sum(0) - b[f], n.sum() - n[f]) for f in range(FOLDS)])

    def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = kernel.features(_matrix(batch.column("stats"))), batch.column("fold").to_numpy()
            raw = np.clip((x * others[fold]).sum(1), -0.5, 1.5)
            yield pa.RecordBatch.from_arrays([pa.array(np.round((raw + 0.5) / 2 * BINS).astype(np.int64)), batch.column("y")], names=["bin", "y"])

    bins = rows.mapInArrow(out_of_fold, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"))
    table = sorted((r.bin, r.y, r.n) for r in bins.collect())  # BINS + 1 rows at most
    x, y, w = np.array(table, float).reshape(-1, 3).T
    return Model(kernel, weights, *isotonic(2 * x / BINS - 0.5, y, w))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """Per document: held_out, score, predicted (1 from 0.3).

    Learns from labelled documents whose crc32(id) modulo 5 is not 0. Of several labels of one id the largest counts;
    null labels and ids are not learned from. Null and empty texts are scored by their (zero) statistics. Without any
    label all scores are 0.5.
    """
    id_, name = F.col(f"`{id_col}`"), fresh([id_col], "stats")
    stats = saved(with_statistics(docs.select(id_col, text_col), keep=[id_col], text_col=text_col, name=name), "stats")
    truth = labels.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    rows = stats.select(id_.alias("id"), F.col(name).alias("stats")).join(truth, "id").where("y is not null")
    model = fit(rows.select("id", held_out(F.col("id"), FOLDS).cast("long").alias("fold"), "stats", "y"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(shared.value.score(_matrix(batch.column(name))))], names=[id_col, "score"])

    scored = stats.mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(id_col, (held_out(id_, FOLDS) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
