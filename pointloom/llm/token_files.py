"""Token ids in compressed binary files: an adaptive mixing range coder over independently reset, checksummed blocks.

Documents are put in id order by a range exchange; each partition becomes a shard. A shard's ids, documents one after
the other, are cut into groups, which the coder of ``range_coder`` packs. Spark writes the groups as rows of Parquet
files, so that any file system it knows will do and a lost task leaves no half file.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import Generations, fresh, slices, spread, strings
from pointloom.llm.range_coder import pack, unpack

#: Ids after which a group is written; a longer document's ids are packed in parts of about as many.
GROUP = 1 << 22
#: Text bytes that are encoded at once.
CHUNK = 4 << 20
#: Parts of words in a generation of a task's cache of encoded parts; two generations are kept.
CACHE = 1 << 19
#: Parts that are encoded as one text.
_TOGETHER = 256
#: Fixed value: the pattern by which the word-end tokenizer cuts a text. A run of letters is one part, and so is a run of
#: other characters but digits and white space; an apostrophe may begin a part of its own.
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class _Encoder:
    """Ids of whole texts by the tokenizers library.

    Where the tokenizer's pattern is ``_PARTS``, no token crosses a space, nor the border between letters and marks at
    a word's end: equal words and parts are then encoded once. Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole = json.loads(self.tokenizer.to_str())
        cuts = [x.get("pattern", {}).get("Regex") for x in (whole["pre_tokenizer"] or {}).get("pretokenizers", [])]
        suffix = whole["model"].get("end_of_word_suffix")
        self.by_word = _PARTS in cuts and bool(suffix)
        if self.by_word:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.known = Generations(CACHE)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _of_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of runs of letters and runs of marks: many are one text, and each ends where a token ends a word."""
        out: list[bytes] = []
        groups = [parts[lo : lo + _TOGETHER] for lo in range(0, len(parts), _TOGETHER)]
        for group, joined in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            cut = 4 * np.nonzero(self.ends[np.frombuffer(joined, "<u4")])[0] + 4
            whole = len(cut) == len(group) and cut[-1] == len(joined)
            out += [joined[a:b] for a, b in zip([0, *cut.tolist()], cut.tolist(), strict=False)] if whole else self._ids(group)
        return out

    def _parts_of(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Letters and the marks after them of each word; a word that is not like this, and nothing."""
        core = pc.utf8_rtrim(words, characters=_MARKS)
        letters = pc.utf8_is_alpha(core)
        cut = pc.or_(letters, pc.and_(pc.equal(core, ""), pc.not_equal(words, "")))
        ends, size = (np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 :][: len(words)], pc.binary_length(words).to_numpy())
        n = (size - pc.binary_length(core).to_numpy()) * cut.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(words)), n)
        at = (ends - n)[owner] + np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at]
        bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds), pa.py_buffer(data))
        return pc.if_else(cut, pc.ascii_lower(core), words), marks

    def _table(self, parts: pa.Array) -> list[bytes]:
        """Ids of distinct parts and words."""
        names = parts.to_pylist()
        self.known.turn()
        get = self.known.now.get
        new = self.known.missing({x for x in names if get(x) is None})
        kinds = pa.array(new, pa.string())
        plain = pc.or_(pc.utf8_is_alpha(kinds), pc.equal(pc.utf8_rtrim(kinds, characters=_MARKS), "")).to_pylist()
        for made, mine in ((self._of_parts, [x for x, p in zip(new, plain, strict=True) if p and x]), (self._ids, [x for x, p in zip(new, plain, strict=True) if not p or not x])):
            self.known.now.update(zip(mine, made(mine), strict=True))
        return list(map(get, names))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id after it, and how many ids each has."""
        if not self.by_word:
            lists = [np.append(np.frombuffer(x, "<u4"), np.uint32(end_id)) for x in self._ids(texts.to_pylist())]
            return np.concatenate([np.zeros(0, np.uint32), *lists]), np.array(list(map(len, lists)), np.int64)
        words = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        n = pc.list_value_length(words).to_numpy().astype(np.int64)
        line = words.flatten().dictionary_encode()
        distinct = line.dictionary
        both = pa.concat_arrays([x.cast(pa.string()) for x in self._parts_of(distinct)]).dictionary_encode()
        table = [*self._table(both.dictionary), np.array([end_id], "<u4").tobytes()]
        pair = both.indices.to_numpy().reshape(2, -1)
        # the parts in order: two for each word, one for the end of each text
        of_word, text = line.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
        place = 2 * np.arange(len(of_word)) + text
        order = np.full(2 * len(of_word) + len(n), len(table) - 1, np.int64)
        order[place], order[place + 1] = pair[0][of_word], pair[1][of_word]
        ids, ends = spread(table, order)
        last = ends[2 * np.cumsum(n) + np.arange(len(n))]
        return ids, np.diff(last, prepend=0)


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_token_files(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_file: str | None = None,
    end_id: int = 2,
) -> None:
    """Writes the ids of all documents, each followed by ``end_id``, in ascending order of id (no id comes first).

    A null text has only the end id. Rows of one id are ordered by a hash of their texts. Columns of the files: shard
    (in order of id), first (the shard's ids before the group), doc_ids, sizes (ids of each document), ids (the
    group's bytes, in several parts if a document is longer than ``GROUP``). A task holds a group's ids or one
    document's, and the coder's state of one part.
    """
    tokenizer = tokenizer_file or default_tokenizer()
    text, key = fresh([id_col], "text__"), fresh([id_col], "hash__")
    rows = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").alias(text)).withColumn(key, F.xxhash64(text))
    rows = rows.repartitionByRange(id_col, key).sortWithinPartitions(id_col, key).select(id_col, text)
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("doc_ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("sizes", T.ArrayType(T.LongType())),
            T.StructField("ids", T.ArrayType(T.BinaryType())),
        ]
    )

    def run(batches):
        from pyspark import TaskContext

        shard, first, encoder = TaskContext.get().partitionId(), 0, _encoder(tokenizer)
        names, ids, sizes, held = [], [], [], 0

        def group():
            line, n = np.concatenate(ids), np.concatenate(sizes)
            ids.clear(), sizes.clear()
            data = [pack(part) for part in np.array_split(line, max(1, round(len(line) / GROUP)))]
            columns = [
                pa.array([shard], pa.int32()),
                pa.array([first], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.concat_arrays(names)),
                pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), pa.array(n, pa.int64())),
                pa.array([data], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=schema.names), int(n.sum())

        for part in slices(batches, text, CHUNK):
            made, n = encoder.encode(strings(part.column(text)), end_id)
            ids.append(made), sizes.append(n), names.append(part.column(id_col))
            held += len(made)
            if held >= GROUP:
                batch, n = group()
                yield batch
                first, names, held = first + n, [], 0
        if ids:
            yield group()[0]

    rows.mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard, first (the shard's ids before the document), doc_id and ids (little-endian 32-bit) of every document."""
    files = spark.read.parquet(path)
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("first", T.LongType()),
            T.StructField("doc_id", files.schema["doc_ids"].dataType.elementType),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, names, sizes, data = (batch.column(c)[k] for c in ("shard", "first", "doc_ids", "sizes", "ids"))
                raw = np.concatenate([unpack(part).astype("<u4") for part in data.as_py()])
                sizes = np.array(sizes.as_py(), np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                for lo in range(0, len(sizes), 1024):
                    a, b = starts[lo : lo + 1024].tolist(), ends[lo : lo + 1024].tolist()
                    columns = [
                        pa.array([shard.as_py()] * len(a), pa.int32()),
                        pa.array(starts[lo : lo + 1024] + first.as_py(), pa.int64()),
                        names.values.slice(lo, len(a)),
                        pa.array([raw[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return files.mapInArrow(run, schema)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard and ids of all shards before it; as many rows as there are files."""
    sizes = spark.read.parquet(path).select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    rows = sorted((r["shard"], r["n"]) for r in sizes.groupBy("shard").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for shard, n in rows:
        starts.append((shard, total))
        total += n
    return spark.createDataFrame(starts, "shard int, before long")


def written_and_read(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document, from the files at ``path`` that this writes: start, n_tokens, ids_crc32."""
    write_token_files(docs, path, id_col=id_col, text_col=text_col)
    spark = docs.sparkSession
    found = read_token_files(spark, path).select(
        F.col("doc_id").alias(id_col),
        "shard",
        "first",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    starts = shard_starts(spark, path)
    return found.join(starts, "shard").select(id_col, (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
