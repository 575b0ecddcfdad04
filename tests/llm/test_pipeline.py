"""The pipeline against a plain version of its decisions on a small fixture."""

import re

import numpy as np
import pytest

import corpus_pipeline

RNG = np.random.default_rng(4)
VOCABULARY = [f"word{k}" for k in range(3000)]


def prose(n):
    words = RNG.choice(VOCABULARY, n).tolist()
    return "\n".join(" ".join(words[k : k + 12]) + "." for k in range(0, n, 12))


ITEM = " ".join(f"bench{k}" for k in range(15))
CLEAN = [(k, prose(120)) for k in range(20)]
HEX = "0123456789abcdef" * 2
ROWS = [
    *CLEAN,
    (100, CLEAN[3][1]),
    (101, CLEAN[4][1].replace(".\n", " extra.\n", 2)),
    (102, prose(60) + "\n" + ITEM + ".\n" + prose(60)),
    (103, prose(100) + f'\ntoken = "{HEX}".'),
    (104, "too short"),
    (105, None),
    (106, "again " * 100),
    (107, "\n".join(" | ".join(f"nav{k}{j}" for k in range(9)) for j in range(9))),
]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs = [(i, t, "en", "src0", len(t or "")) for i, t in ROWS]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{path}/documents.parquet"
    )
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_run_equals_the_plain_version(spark, sf_dir):
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(out) == [*range(20), 103]
    for i, text in CLEAN:
        assert out[i].text == text
    assert out[103].text == re.sub(r'token = "[0-9a-f]+', "[SECRET]", dict(ROWS)[103])
    assert all(r.n_pieces == len(r.piece_ids) // 4 > 0 for r in out.values())


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_duplicates", "decontamination", "secret_scan", "sentencepiece",
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_stages_take_nulls_repeats_and_clashing_columns(spark, sf_dir):
    """Null and repeated ids, null and empty texts, and columns named like those the stages make on the way."""
    names = ["row__", "fp__", "component__", "digest__", "hit__", "base__", "spans__", "words__", "lines__", "text__", "piece_ids", "n_pieces", "q__n_words"]
    texts = [CLEAN[0][1], CLEAN[0][1], CLEAN[1][1], None, "", " ", prose(3000), CLEAN[2][1] + "\n" + ITEM + "."]
    rows = [(k if k > 1 else None, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)] + [(2, CLEAN[1][1], *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    left = {n: [tuple(r)[:2] for r in stage(spark, docs, sf_dir).collect()] for n, stage in corpus_pipeline.STAGES}
    assert len(left["quality_rules"]) == 6 and len(left["secret_scan"]) == len(left["sentencepiece"]) == 9
    assert sorted(map(str, (i for i, _ in left["near_duplicates"]))) == ["2", "3", "6", "7", "None"]
    assert len(left["decontamination"]) == 8
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        kept = {tuple(r)[2:] for r in out.select(docs.columns).collect()}
        assert kept <= {r[2:] for r in rows}, name


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
