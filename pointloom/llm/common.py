"""Small helpers shared by the text operators: shared-folder tables, Arrow batch mapping, free names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A–Z to a–z; every ASCII byte that is neither a digit nor a letter to a space; bytes of other characters stay.
_WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
#: Java pattern of the characters that separate space-delimited words.
SPACES = r"[\x20\x09-\x0D]+"


def alnum_words(text: bytes) -> list[bytes]:
    """Lower-cased (A–Z only) words of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Lower-cased (A–Z only) words between ASCII white space."""
    return text.lower().split()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``). A session on one machine may go without and gets a
    temporary one; on a cluster its absence is an error, as executors would write to their own disks."""
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    path = path or spark.conf.get("pointloom.shared.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pointloom-")
        spark.conf.set("pointloom.shared.dir", path)
    return path


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pointloom-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes what ``saved`` wrote; for tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, or with underscores added until no taken column is called so (case does not count)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def one_thread() -> None:
    """Keeps the matrix products of this Python worker on one core: tasks share a machine, and BLAS threads of many
    workers wait for each other. Does nothing where numpy's BLAS is not OpenBLAS or cannot be found."""
    if not os.path.exists("/proc/self/maps"):
        return
    with open("/proc/self/maps") as maps:
        paths = {line.split()[-1] for line in maps if "openblas" in line}
    for path in paths:
        lib = ctypes.CDLL(path)
        names = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")
        found = next((n for n in names if hasattr(lib, n)), None)
        if found:
            getattr(lib, found)(1)


class Generations:
    """A dictionary that forgets: when it is full it becomes the older one, from which what is still used is kept."""

    def __init__(self, size: int):
        self.size, self.now, self.older = size, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.size:
            self.now, self.older = {}, self.now

    def missing(self, keys: set) -> list:
        """The keys that neither generation has, sorted; those of the older one move to the new one."""
        kept = keys.intersection(self.older)
        self.now.update({k: self.older[k] for k in kept})
        return sorted(keys - kept)


def spread(table: Sequence[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit integers of the table's entries in this order, one after the other, and where each entry ends."""
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
    first, count = (np.cumsum(sizes) - sizes)[order], sizes[order]
    ends = np.cumsum(count)
    place = np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
    return np.frombuffer(b"".join(table), "<u4")[place], ends


def strings(texts: pa.Array) -> pa.Array:
    """Null as the empty text, broken UTF-8 as replacement marks."""
    texts = texts.cast(pa.string()).fill_null("")
    try:
        texts.validate(full=True)
    except pa.ArrowInvalid:
        texts = pa.array([t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())
    return texts


def lower_az(text: Column) -> Column:
    """Only A–Z lower-cased."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if t is None else t for t in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts sum to about ``limit`` bytes (one text at least)."""
    import pyarrow.compute  # noqa: F401

    for batch in batches:
        at, n = 0, batch.num_rows
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        while at < n:
            end, total = at, 0
            while end < n and (end == at or total + sizes[end] <= limit):
                total += sizes[end]
                end += 1
            yield batch.slice(at, end - at)
            at = end


def text_chunks(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The same slices, with their texts."""
    for part in slices(batches, column, limit):
        yield part, byte_texts(part.column(column))


def _text_as(text_col: str, name: str, keep: Sequence[str]) -> list[Column]:
    return [] if text_col in keep else [F.col(f"`{text_col}`").alias(name)]


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text_col: str,
    fields: Sequence[tuple[str, str]],
    start: Callable[[], Callable[..., list[pa.Array]]],
    *,
    extra: Sequence[str] = (),
    chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Rows of ``keep`` with ``fields`` (name, Spark type) computed from each text.

    ``start()`` runs once a task and returns the function for a chunk: it gets the texts as UTF-8 bytes, then
    the ``extra`` columns as Arrow arrays, and returns one Arrow array a field. Memory follows ``chunk_bytes`` and
    the longest text, not the partition.
    """
    schema = T.StructType([df.schema[c] for c in keep])
    for name, kind in fields:
        schema = schema.add(name, T.DataType.fromDDL(kind))
    text = text_col if text_col in keep else fresh([*keep, *extra], "text__")
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, *extra])], *_text_as(text_col, text, keep))
    names, kept, others = [f.name for f in schema], list(keep), list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        work = start()
        for part, texts in text_chunks(batches, text, chunk_bytes):
            new = work(texts, *[part.column(c) for c in others])
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *new], names=names)

    return source.mapInArrow(run, schema)


def fold_texts(
    df: DataFrame,
    text_col: str,
    schema: str,
    start: Callable[[], tuple[Callable[..., Iterator[pa.RecordBatch] | None], Callable[[], Iterator[pa.RecordBatch]]]],
    *,
    extra: Sequence[str] = (),
    chunk_bytes: int = 1 << 20,
) -> DataFrame:
    """Rows that a task's running summary emits: ``start()`` gives (add, finish); either may yield batches."""
    text = fresh(extra, "text__")
    source = df.select(*[F.col(f"`{c}`") for c in extra], F.col(f"`{text_col}`").alias(text))
    others = list(extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        add, finish = start()
        for part, texts in text_chunks(batches, text, chunk_bytes):
            yield from add(texts, *[part.column(c) for c in others]) or ()
        yield from finish() or ()

    return source.mapInArrow(run, schema)
