import zlib

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm.pieces import PieceModel, decode_pieces, default_model, encode_pieces, encoded_digest, tokenized

TEXTS = [
    "plain words  and   runs    of spaces ",
    " leading",
    "",
    None,
    "\n\t lines\r\n\x0b and ▁ marks ▁▁x",
    "日本語 𝒳 é ﷽ ​",
    "x" * 5000,
    "same same same",
    "same same same",
    "   ",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k != 8 else None, t, "i", 1) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int")


def brute(m: PieceModel, word: str) -> float:
    """Best score by trying every piece at every position."""
    score = {m.pieces[i]: s for i, s in zip(m.ids, m.scores, strict=True)}
    best = [0.0] + [-np.inf] * len(word)
    for end in range(1, len(word) + 1):
        if ord(word[end - 1]) not in m.single:
            best[end] = best[end - 1] + m.spelled
        for start in range(max(0, end - m.longest), end):
            best[end] = max(best[end], best[start] + score.get(word[start:end], -np.inf))
    return best[-1]


def test_viterbi_is_optimal():
    m = PieceModel(default_model())
    value = dict(zip(m.ids.tolist(), m.scores.tolist(), strict=True))
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list(" aeinorstuéß語▁"), n)) for n in (1, 2, 5, 9, 17) for _ in range(40)]
    for word in words:
        ids = m.viterbi([word])[0]
        assert b"".join(m.text[i] for i in ids).decode() == word
        plain = [i for i in ids if i in value]
        spelled = len(word) - sum(len(m.pieces[i]) for i in plain)
        assert sum(value[i] for i in plain) + spelled * m.spelled == pytest.approx(brute(m, word), rel=1e-5)


def test_equal_length_batches_agree_with_single_words():
    m = PieceModel(default_model())
    words = [" there", " thing", " Thing", " thier", " xqzjk"]
    same = [w for w in words if len(w) == 6]
    assert m.viterbi(same) == [m.viterbi([w])[0] for w in same]


def test_round_trip_and_digest(spark, docs):
    back = decode_pieces(encode_pieces(docs, keep=["doc_id", "n_pieces"], name="b"), keep=["doc_id", "n_pieces"], ids_col="b")
    assert sorted((r.text for r in back.collect())) == sorted(t or "" for t in TEXTS)
    rows = encoded_digest(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.round_trip for r in rows)
    ids = {r.doc_id: bytes(r.b) for r in encode_pieces(docs, keep=["doc_id"], name="b").collect()}
    for r in rows:
        assert (r.n_pieces, r.ids_crc32) == (len(ids[r.doc_id]) // 4, zlib.crc32(ids[r.doc_id]))


def test_small_cache_gives_the_same_ids(monkeypatch):
    m = PieceModel(default_model())
    whole = m.encode(pa.array(TEXTS)).to_pylist()
    m.known.size = 1
    assert [m.encode(pa.array([t], pa.string()))[0].as_py() for t in TEXTS] == whole


def field(number: int, value) -> bytes:
    """A field of a protocol buffer: text, message, integer or float."""
    import struct

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    data = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(data)) + data


def varint(n: int) -> bytes:
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


@pytest.mark.parametrize("crossing", [False, True])
def test_ids_of_a_unigram_file_are_the_librarys(tmp_path, crossing):
    from sentencepiece import SentencePieceProcessor

    rng = np.random.default_rng(8)
    letters = list("abcdeé▁語")
    plain = {"".join(rng.choice(letters[:7], rng.integers(1, 5))) for _ in range(300)} | set(letters[:7]) | {"▁▁", "▁" * 4, "▁a", "▁ab"}
    plain = sorted(p for p in plain if crossing or "▁" not in p.lstrip("▁"))
    pieces_ = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256))]
    pieces_ += [(p, float(s), 1) for p, s in zip(plain, -rng.uniform(1, 12, len(plain)))]
    data = b"".join(field(1, field(1, p) + field(2, s) + field(3, t)) for p, s, t in pieces_)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, "identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(data)
    m, sp = PieceModel(path), SentencePieceProcessor(model_file=path)
    assert m.whole == crossing
    texts = ["".join(rng.choice(list("abcdeé語𝒳  "), rng.integers(1, 40))) for _ in range(300)] + ["", " ", "   a  b   "]
    got = [np.frombuffer(x, "<u4").tolist() for x in m.encode(pa.array(texts)).to_pylist()]
    want = [sp.encode(t) for t in texts]
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 3  # ties, as of "a" + "aa" and "aa" + "a"
    assert all(sorted(g) == sorted(w) for g, w in zip(got, want, strict=True))
    assert [m.decode(np.array(x, "<u4").tobytes()) for x in got] == texts


def test_pipeline_columns_and_empty_table(docs):
    out = tokenized(docs)
    assert out.columns == ["doc_id", "text", "ids", "n_pieces", "piece_ids", "_n_pieces"]
    assert encoded_digest(docs.limit(0)).count() == 0


def test_digest_takes_one_worker_a_task(docs, capsys):
    """Encoding and decoding in two steps keeps two Python workers with a model each for a task."""
    encoded_digest(docs).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1
