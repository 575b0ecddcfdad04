import zlib

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import quality_model
from pointloom.llm.quality_model import STATISTICS, isotonic, score_quality, statistics

SF = "/root/testdata/sf0.01"


def test_statistics_are_finite():
    for text in (b"", b" \n", b"x", "é\nü".encode(), b"| " * 50, b"\x00" * 10, b"a" * 10**6):
        got = statistics(text)
        assert len(got) == len(STATISTICS) and np.isfinite(got).all()


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    x, w = np.arange(30.0), rng.integers(1, 5, 30).astype(float)
    y = np.clip(x / 30 + rng.normal(0, 0.4, 30), 0, 1)
    at, value = isotonic(x, y, w)
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()
    best = [max(min(np.average(y[i : j + 1], weights=w[i : j + 1]) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]
    assert np.allclose(sorted(set(np.round(best, 9))), sorted(set(np.round(value, 9))))


def test_held_out_accuracy_and_defined_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(None, "no id"), (-1, None), (-2, "")], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text", F.lit(1).alias("score")).unionByName(odd.withColumn("score", F.lit(1)))
    got = {r.doc_id: r for r in score_quality(all_docs, labels).collect()}
    assert len(got) == 1003 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert got[-1].score == got[-2].score
    truth = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([r.predicted == q for r, q in truth]) > 0.95


def test_labels_of_the_held_out_are_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    same = [sorted((r.doc_id, r.score) for r in score_quality(docs, x).collect()) for x in (labels, turned)]
    assert np.allclose(*[[s for _, s in x] for x in same])


def test_no_labels_and_no_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(docs, labels).collect()} == {0.5}
    assert score_quality(docs.limit(0), labels).count() == 0


def test_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(quality_model, "TRAIN_ROWS", 100)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert score_quality(docs, labels).count() == docs.count()
