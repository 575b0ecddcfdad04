"""SentencePiece encoding and decoding: batched Viterbi over the piece scores of a model file.

A text is cut before each run of spaces; a model with a piece that crosses such a cut encodes whole texts. Words of
equal length advance together: at every position the hashes of the substrings that end there probe the sorted piece
keys, and a maximum over the lengths stores score and backpointer. A character that is no piece may be spelled in byte
pieces. Equal words are encoded once; a task keeps the words of late in a bounded cache.

The scores of a unigram model file are log-probabilities, and the ids are those of the sentencepiece library. Those of a
BPE file are merge ranks; Zipf's law makes them log-probabilities here, so that the ids of such a file are the likeliest
segmentation, not the merge order's. Texts are taken as they are: a file's normalisation rules are not applied.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import Generations, fresh, slices, spread, strings

MARK = "▁"
#: Words in a generation of a task's cache; two generations are kept. Text bytes that are encoded at once.
CACHE, CHUNK = 1 << 18, 1 << 20
#: By how much spelling a character scores below the least piece.
SPELLED = 10.0
_RUNS = re.compile(r" +[^ ]*")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """Pieces, their scores and byte ids of a model file, and the Viterbi over them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i).replace(MARK, " ") for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        self.longest = max(len(self.pieces[i]) for i in plain)
        keys = np.array([self._hash(self.pieces[i]) for i in plain], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one key")
        scores = np.array([sp.get_score(i) for i in plain])
        if scores.min() < -1000:  # ranks
            scores = -np.log(2 + np.minimum(-scores, n))
        self.scores = scores[order].astype(np.float32)  # as the library adds them up
        self.spelled = self.scores.min() - np.float32(SPELLED)
        self.filter = np.zeros(1 << 20, bool)  # of the keys' leading bits
        self.filter[self.keys >> np.uint64(44)] = True
        self.single = np.unique([ord(self.pieces[i]) for i in plain if len(self.pieces[i]) == 1]).astype(np.uint64)
        self.whole = any(" " in self.pieces[i].lstrip(" ") for i in plain)
        size = max(len(self.pieces[i]) for i in plain)
        self.chars = np.zeros((len(plain), size), np.uint32)
        for row, i in enumerate(self.ids):
            self.chars[row, : len(self.pieces[i])] = [ord(c) for c in self.pieces[i]]
        self.text = {i: self.pieces[i].encode() for i in plain} | {int(b): bytes([k]) for k, b in enumerate(self.byte_ids)}
        self.known = Generations(CACHE)

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h ^ ord(c)) * int(_FACTOR) & (1 << 64) - 1
            h ^= h >> 29
        return h

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Best ids of words of one length; of equal scores the longest last piece."""
        n, size = len(words), len(words[0])
        chars = np.array([list(map(ord, w)) for w in words], np.uint64).reshape(n, size)
        best = np.full((size + 1, n), -np.inf, np.float32)
        best[0] = 0
        back = np.zeros((size + 1, n), np.int64)
        piece = np.full((size + 1, n), -1, np.int64)
        hashes = np.zeros((0, n), np.uint64)  # of the substrings that end here, the longest first
        spells = ~np.isin(chars, self.single)
        for end in range(1, size + 1):
            grown = np.concatenate([hashes[-(self.longest - 1) :] if self.longest > 1 else hashes[:0], np.zeros((1, n), np.uint64)])
            grown = (grown ^ chars[:, end - 1]) * _FACTOR
            hashes = grown ^ grown >> np.uint64(29)
            first, flat = end - len(hashes), hashes.ravel()
            rows = np.nonzero(self.filter[flat >> np.uint64(44)])[0]
            at = np.minimum(np.searchsorted(self.keys, flat[rows]), len(self.keys) - 1)
            hit = self.keys[at] == flat[rows]
            rows, at = rows[hit], at[hit]
            start, word = rows // n + first, rows % n
            length, ok = end - start, np.ones(len(rows), bool)
            for k in range(int(length.max()) if len(rows) else 0):  # a key that matches is confirmed by its characters
                live = np.nonzero(k < length)[0]
                ok[live] &= chars[word[live], start[live] + k] == self.chars[at[live], k]
            score, number = np.full(hashes.size, -np.inf, np.float32), np.zeros(hashes.size, np.int64)
            score[rows[ok]] = self.scores[at[ok]] + best[start[ok], word[ok]]
            number[rows[ok]] = self.ids[at[ok]]
            score, each = score.reshape(hashes.shape), np.arange(n)
            pick = np.argmax(score, axis=0)
            best[end], back[end] = score[pick, each], pick + first
            piece[end] = np.where(np.isfinite(best[end]), number.reshape(hashes.shape)[pick, each], -1)
            spelled = np.where(spells[:, end - 1], best[end - 1] + self.spelled, np.float32(-np.inf))
            byte = spelled > best[end]
            best[end], back[end], piece[end] = (
                np.where(byte, spelled, best[end]),
                np.where(byte, end - 1, back[end]),
                np.where(byte, -1, piece[end]),
            )
        out: list[list[int]] = []
        back_of, piece_of = back.T.tolist(), piece.T.tolist()
        for w in range(n):
            ids, at = [], size
            while at:
                if piece_of[w][at] < 0:
                    ids += self.byte_ids[list(words[w][at - 1].encode())][::-1].tolist()
                else:
                    ids.append(piece_of[w][at])
                at = back_of[w][at]
            out.append(ids[::-1])
        return out

    def _learn(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for size, same in by_length.items():
            step = max(1, (1 << 18) // max(1, size))
            for lo in range(0, len(same), step):
                part = same[lo : lo + step]
                for w, ids in zip(part, self.viterbi(part), strict=True):
                    self.known.now[w] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> pa.Array:
        """Little-endian 32-bit ids of each text (binary); an empty text has none."""
        texts = strings(texts)
        # a space stands before each text; where runs of spaces are single ones, the words are what lies between
        plain = pc.and_(pc.not_equal(texts, ""), pc.invert(pc.or_(pc.match_substring(texts, "  "), pc.starts_with(texts, " "))))
        plain = plain.to_numpy(zero_copy_only=False) & (not self.whole)
        lists = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        others = [_cut(t, self.whole) for t in texts.filter(pa.array(~plain)).to_pylist()]
        n = np.concatenate([pc.list_value_length(lists).to_numpy(), np.array(list(map(len, others)), np.int64)]).astype(np.int64)
        # the others' words without their first space, like those of the plain texts
        line = pa.concat_arrays([lists.flatten(), pa.array([w[1:] for words in others for w in words], pa.string())]).dictionary_encode()
        words = [" " + w for w in line.dictionary.to_pylist()]
        self.known.turn()
        get = self.known.now.get
        self._learn(self.known.missing({w for w in words if get(w) is None}))
        ids, ends = spread(list(map(get, words)), line.indices.to_numpy())
        bounds = np.concatenate([[0], np.append(0, ends)[np.cumsum(n)]]).astype(np.int32) * 4
        made = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4"))])
        order = np.argsort(~plain, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return made.take(pa.array(place))

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids; ids without text and broken UTF-8 become the replacement mark."""
        parts = self.text
        data = b"".join([parts.get(i, "\ufffd".encode()) for i in np.frombuffer(ids, "<u4").tolist()])
        return data[1:].decode("utf-8", "replace") if data.startswith(b" ") else data.decode("utf-8", "replace")


def _cut(text: str, whole: bool) -> list[str]:
    """Words of the text with a space before it: each begins with all spaces before it; the last may be spaces alone."""
    if not text:
        return []
    return [" " + text] if whole else _RUNS.findall(" " + text)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(
    docs: DataFrame, *, keep: list[str], text_col: str = "text", name: str = "ids", model_file: str | None = None
) -> DataFrame:
    """Columns ``keep`` and the ids of each text as little-endian 32-bit integers (binary); null is the empty text."""
    path = model_file or default_model()
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(name, T.BinaryType())])
    text = text_col if text_col in keep else fresh(keep, "text__")
    own = [] if text_col in keep else [F.col(f"`{text_col}`").alias(text)]

    def run(batches):
        codec = model(path)
        for part in slices(batches, text, CHUNK):
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], codec.encode(part.column(text))], names=schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], *own).mapInArrow(run, schema)


def decode_pieces(
    encoded: DataFrame, *, keep: list[str], ids_col: str = "ids", name: str = "text", model_file: str | None = None
) -> DataFrame:
    """Columns ``keep`` and the text of the ids."""
    path = model_file or default_model()
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField(name, T.StringType())])

    def run(batches):
        codec = model(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = pa.array([codec.decode(x or b"") for x in part.column(ids_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], texts], names=schema.names)

    chosen = dict.fromkeys([*keep, ids_col])
    return encoded.select(*[F.col(f"`{c}`") for c in chosen]).mapInArrow(run, schema)


def encoded_digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_pieces, ids_crc32 (of the little-endian 32-bit ids), and whether decoding gives the text back.

    A null text is the empty one, which has no pieces.
    """
    path = default_model()
    rows = docs.select(F.col(f"`{id_col}`"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash__"), F.col(f"`{text_col}`").alias("text__"))
    schema = T.StructType([rows.schema[id_col], rows.schema["hash__"], T.StructField("ids__", T.BinaryType()), T.StructField("back__", T.StringType())])

    def run(batches):
        # one worker a task for both ways: each holds the model
        codec = model(path)
        for part in slices(batches, "text__", CHUNK):
            ids = codec.encode(part.column("text__"))
            back = pa.array([codec.decode(x) for x in ids.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(id_col), part.column("hash__"), ids, back], names=schema.names)

    both = rows.mapInArrow(run, schema)
    return both.select(
        id_col,
        (F.octet_length("ids__") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids__").alias("ids_crc32"),
        F.length("back__").cast("long").alias("decoded_chars"),
        (F.xxhash64("back__") == F.col("hash__")).alias("round_trip"),
    )


def tokenized(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """All columns of the documents and ``piece_ids`` (binary) and ``n_pieces`` of each text; null and empty texts have
    no pieces. Columns of these names get an underscore more."""
    name = fresh(docs.columns, "piece_ids")
    found = encode_pieces(docs, keep=docs.columns, text_col=text_col, name=name)
    return found.withColumn(fresh(found.columns, "n_pieces"), (F.octet_length(name) / 4).cast("long"))
