import zlib

import numpy as np
import pyarrow as pa
import pytest

from pointloom.llm import token_files
from pointloom.llm.range_coder import BLOCK, pack, unpack
from pointloom.llm.token_files import default_tokenizer, read_token_files, write_token_files, written_and_read

TEXTS = [
    (5, "Plain words, it's  UPPER é 42 <|endoftext|> \t tabs\r\n日本語 ﷽"),
    (3, None),
    (9, ""),
    (-4, "# hash is id two #"),
    (7, "long " * 20000),
    (7, "long " * 20000),
    (None, "no id"),
    (2, "  "),
    (11, "Σίσυφος ΣΑΣ ́ x y z"),
]


def rows(spark, data=TEXTS):
    return spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, first int, shard int")


def brute():
    from tokenizers import Tokenizer

    t, start, out = Tokenizer.from_file(default_tokenizer()), 0, []
    for doc_id, text in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, BLOCK - 1, BLOCK, BLOCK + 1, 30000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for most in (1, 2, 256, 257, 49408, 1 << 18):
        ids = rng.integers(0, most, n)
        ids[rng.random(n) < 0.3] = most - 1
        assert np.array_equal(unpack(pack(ids)), ids)


def document_ids(most):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()[:most]
    found = Tokenizer.from_file(default_tokenizer()).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    return np.concatenate([[*e.ids, 2] for e in found])


@pytest.mark.parametrize("most", [300, 1000])
def test_text_takes_fewer_bytes_than_zlib_and_than_order_0(most):
    ids = document_ids(most)
    size = len(pack(ids))
    share = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert size < 0.95 * len(zlib.compress(ids.astype("<u2").tobytes(), 9))
    assert size < 0.95 * -(share * np.log2(share)).sum() * len(ids) / 8


def test_blocks_are_independent():
    ids = np.random.default_rng(1).integers(0, 1000, 10 * BLOCK)
    data = bytearray(pack(ids))
    data[len(data) * 6 // 10] ^= 64  # in the words of some block
    with pytest.raises(ValueError, match="checksum"):
        unpack(bytes(data))
    wrong = np.nonzero(unpack(bytes(data), check=False) != ids)[0] // BLOCK
    assert len(np.unique(wrong)) == 1


def test_a_long_document_is_packed_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 4000)
    write_token_files(rows(spark), f"file://{tmp_path}/e")
    parts = spark.read.parquet(f"file://{tmp_path}/e").select("ids").collect()
    sizes = [len(unpack(bytes(p))) for r in parts for p in r.ids]
    assert max(sizes) <= 6000 and sum(sizes) > 40000


def test_damage_is_found():
    data = bytearray(pack(np.arange(20000) % 1000))
    data[-50] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        unpack(bytes(data))
    with pytest.raises(ValueError):
        unpack(b"XXXX" + bytes(data[4:]))
    with pytest.raises(ValueError, match="range"):
        pack(np.array([1 << 18]))


def test_equals_the_library_in_order_of_id(spark, tmp_path):
    got = written_and_read(rows(spark), f"file://{tmp_path}/a")
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == brute()


def test_small_groups_and_caches_give_the_same(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    monkeypatch.setattr(token_files, "CACHE", 2)
    monkeypatch.setattr(token_files, "CHUNK", 30)
    got = written_and_read(rows(spark).coalesce(1), f"file://{tmp_path}/b")
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[1]) == brute()


def test_words_and_parts_are_the_librarys(spark):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(default_tokenizer()), token_files._Encoder(default_tokenizer())
    assert e.by_word
    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    for lo in range(0, len(texts), 100):
        want = t.encode_batch_fast(texts[lo : lo + 100], add_special_tokens=False)
        ids, sizes = e.encode(pa.array(texts[lo : lo + 100]), 2)
        assert ids.tolist() == [i for x in want for i in [*x.ids, 2]] and sizes.tolist() == [len(x.ids) + 1 for x in want]


def test_other_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got, _ = token_files._Encoder(path).encode(pa.array(["two words", " a  b\n"]), 7)
    want = [Tokenizer.from_file(path).encode(x, add_special_tokens=False).ids for x in ("two words", " a  b\n")]
    assert got.tolist() == [i for x in want for i in [*x, 7]]


def test_files_give_back_the_ids(spark, tmp_path):
    write_token_files(rows(spark), f"file://{tmp_path}/c")
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in read_token_files(spark, f"file://{tmp_path}/c").collect()}
    assert ids[9] == ids[3] == [2] and len(ids[7]) == 20001


def test_empty_table(spark, tmp_path):
    assert written_and_read(rows(spark).limit(0), f"file://{tmp_path}/d").count() == 0
