"""Typed arrays as binary columns: tiles of a raster, and stores of tables column by column."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.order import numbered

#: Element types by name, little-endian.
KINDS = {"u1": "<u1", "u2": "<u2", "i4": "<i4", "i8": "<i8", "f4": "<f4", "f8": "<f8"}
#: Layout of a store that this module writes and reads; most labels of a text column; rows of a chunk.
VERSION, MOST_LABELS, CHUNK_ROWS = 1, 65536, 65536

# --- tiles ------------------------------------------------------------------------------------------------------


def pack_tiles(pixels: DataFrame, width: int, height: int, lanes: Sequence[str], *, tile: int = 64, kind: str = "f4") -> DataFrame:
    """ty, tx, width, height, depth, lanes, kind, data: pixels (y, x and the lanes) as tiles of interleaved little-endian
    numbers, row by row. Tiles at the right and lower edge are smaller; pixels that are missing count 0, as do nulls."""
    size = lambda at, n: F.least(F.lit(n) - F.col(at) * tile, F.lit(tile)).cast("int")
    p = pixels.where((F.col("x") < width) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("y") >= 0))
    p = p.select(F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), (F.col("y") % tile).alias("y"), (F.col("x") % tile).alias("x"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in lanes])
    g = p.groupBy("ty", "tx").agg(F.collect_list(F.struct("y", "x", F.array(*lanes).alias("v"))).alias("at"))
    g = g.select("ty", "tx", size("tx", width).alias("width"), size("ty", height).alias("height"), "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for row in batch.to_pylist():
                out = np.zeros((row["height"], row["width"], len(lanes)), KINDS[kind])
                y, x, v = ([a[c] for a in row["at"]] for c in "yxv")
                out[y, x] = v
                data.append(out.tobytes())
            n = len(data)
            head = [batch.column(c) for c in ("ty", "tx", "width", "height")]
            rest = [pa.array(np.full(n, 1), pa.int32()), pa.array(np.full(n, len(lanes)), pa.int32()), pa.array([kind] * n, pa.string()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays([*head, *rest], names=["ty", "tx", "width", "height", "depth", "lanes", "kind", "data"])

    return g.mapInArrow(run, "ty int, tx int, width int, height int, depth int, lanes int, kind string, data binary")


def lane_of(data: bytes, width: int, height: int, depth: int, lanes: int, kind: str, channel: int) -> np.ndarray:
    """One lane of a tile as numbers, row by row. Only planes are fields: raises for a volume, for a channel that is not
    there, and for data of another length than the tile's size tells."""
    if depth != 1:
        raise ValueError(f"a tile of depth {depth} is no plane")
    if not 0 <= channel < lanes:
        raise ValueError(f"channel {channel} is not in 0 to {lanes - 1}")
    wanted = width * height * lanes * np.dtype(KINDS[kind]).itemsize
    if len(data) != wanted:
        raise ValueError(f"{len(data)} bytes where {width} x {height} x {lanes} {kind} are {wanted}")
    return np.frombuffer(data, KINDS[kind])[channel::lanes].astype(np.float64)


def tile_field(tiles: DataFrame, channel: int, *, tile: int = 64) -> DataFrame:
    """y, x, v: the field of one lane of packed tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                v = lane_of(t["data"], t["width"], t["height"], t["depth"], t["lanes"], t["kind"], channel)
                y, x = np.divmod(np.arange(len(v)), t["width"])
                yield pa.RecordBatch.from_arrays([pa.array((y + t["ty"] * tile).astype(np.int32)), pa.array((x + t["tx"] * tile).astype(np.int32)), pa.array(v)], names=["y", "x", "v"])

    return tiles.mapInArrow(run, "y int, x int, v double")


# --- stores -----------------------------------------------------------------------------------------------------

_SPARK = {"u1": "smallint", "u2": "int", "i4": "int", "i8": "long", "f4": "float", "f8": "double"}
_ARROW = {"u1": pa.int16(), "u2": pa.int32(), "i4": pa.int32(), "i8": pa.int64(), "f4": pa.float32(), "f8": pa.float64()}
_OF_TYPE = {"tinyint": "i4", "smallint": "i4", "int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}


def write_store(tables: dict[str, tuple[DataFrame, Sequence[str]]], path: str, *, chunk_rows: int = CHUNK_ROWS) -> None:
    """Writes tables (each with the columns that order its rows) as a store at ``path``.

    A column is a folder of chunks of typed numbers; a text column is codes and a list of labels, ``MOST_LABELS`` of them
    at most (null is a label of its own). Numbers must not be null. A description of all tables lies beside.
    """
    described, spark = [], next(iter(tables.values()))[0].sparkSession
    for name, (df, order) in tables.items():
        columns, coded = [], df
        for field, kind in df.dtypes:
            if kind == "string":
                labels = df.select(field).distinct().limit(MOST_LABELS + 1).collect()
                if len(labels) > MOST_LABELS:
                    raise ValueError(f"column '{field}' has more than {MOST_LABELS} labels")
                values = sorted((r[0] for r in labels), key=lambda v: (v is None, v or ""))
                codes = df.sparkSession.createDataFrame([(v, k) for k, v in enumerate(values)], "label__ string, code__ int")
                coded = coded.join(F.broadcast(codes), F.col(f"`{field}`").eqNullSafe(F.col("label__"))).withColumn(f"code_{field}", F.col("code__")).drop("label__", "code__")
                columns.append({"field": field, "kind": "u1" if len(values) < 256 else "u2" if len(values) < MOST_LABELS else "i4", "values": values})
            elif kind in _OF_TYPE:
                columns.append({"field": field, "kind": _OF_TYPE[kind]})
            else:
                raise ValueError(f"column '{field}' is {kind}, neither a number nor text")
        source = {c["field"]: f"code_{c['field']}" if "values" in c else c["field"] for c in columns}
        placed = numbered(coded, list(order), name="at__").withColumn("chunk", F.floor(F.col("at__") / chunk_rows))

        packed = _packer([(c["field"], KINDS[c["kind"]], source[c["field"]]) for c in columns])
        chunks = placed.select("chunk", "at__", *[f"`{s}`" for s in source.values()]).groupBy("chunk").applyInPandas(packed, "field string, chunk long, n long, data binary")
        chunks.write.partitionBy("field").parquet(f"{path}/tables/{name}")
        described.append({"name": name, "rows": df.count(), "chunk_rows": chunk_rows, "columns": columns})
    text = json.dumps({"version": VERSION, "datasources": described})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{path}/about")


def _packer(columns: list[tuple[str, str, str]]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at__")
        rows = [(field, int(pdf["chunk"].iloc[0]), len(pdf), pdf[source].to_numpy().astype(kind).tobytes()) for field, kind, source in columns]
        return pd.DataFrame(rows, columns=["field", "chunk", "n", "data"])

    return pack


@dataclass(frozen=True)
class Store:
    """An open store: what it holds was read, columns are read when asked for, and only those."""

    spark: SparkSession
    path: str
    about: dict

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        rows = spark.read.text(f"{path}/about").collect()
        about = json.loads(rows[0][0]) if rows else {}
        if "datasources" not in about:
            raise ValueError(f"{path} is no store")
        if about.get("version") != VERSION:
            raise ValueError(f"store version {about.get('version')}, expected {VERSION}")
        return cls(spark, path, about)

    def names(self) -> list[str]:
        return [d["name"] for d in self.about["datasources"]]

    def datasource(self, name: str) -> dict:
        for d in self.about["datasources"]:
            if d["name"] == name:
                return d
        raise KeyError(f"no table '{name}', there are {', '.join(self.names())}")

    def column(self, name: str, field: str) -> dict:
        for c in self.datasource(name)["columns"]:
            if c["field"] == field:
                return c
        raise KeyError(f"table '{name}' has no column '{field}'")

    def _read(self, name: str, fields: Sequence[str], kinds: dict[str, str]) -> DataFrame:
        stored = [self.column(name, f)["kind"] for f in fields]
        rows_of_chunk = self.datasource(name)["chunk_rows"]
        chunks = self.spark.read.schema("chunk long, n long, data binary, field string").parquet(f"{self.path}/tables/{name}").where(F.col("field").isin(*fields))
        wide = chunks.groupBy("chunk", "n").agg(*[F.max(F.when(F.col("field") == f, F.col("data"))).alias(f"d{k}") for k, f in enumerate(fields)])
        names = ["row", *[f"c{k}" for k in range(len(fields))]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for chunk in batch.to_pylist():
                    data = [np.frombuffer(chunk[f"d{k}"], KINDS[kind]) for k, kind in enumerate(stored)]
                    if any(len(d) != chunk["n"] for d in data):
                        raise ValueError(f"a chunk of {chunk['n']} rows has columns of {[len(d) for d in data]}")
                    row = np.arange(chunk["n"]) + chunk["chunk"] * rows_of_chunk
                    yield pa.RecordBatch.from_arrays([pa.array(row), *[pa.array(d).cast(_ARROW[k]) for d, k in zip(data, stored, strict=True)]], names=names)

        schema = ", ".join(f"{n} {t}" for n, t in zip(names, ["long", *[_SPARK[k] for k in stored]], strict=True))
        rows = wide.mapInArrow(run, schema)
        return rows.select("row", *[(F.col(n).cast(kinds[f]) if f in kinds else F.col(n)).alias(f) for n, f in zip(names[1:], fields, strict=True)])

    def read(self, name: str, fields: Sequence[str]) -> DataFrame:
        """row and the columns as stored: numbers, and codes of text columns."""
        return self._read(name, fields, {})

    def read_f64(self, name: str, fields: Sequence[str]) -> DataFrame:
        """row and the columns as doubles, whatever they are stored as."""
        return self._read(name, fields, dict.fromkeys(fields, "double"))

    def read_categorical(self, name: str, field: str) -> tuple[DataFrame, list[str | None]]:
        """(row and codes, labels) of a text column; raises for a column without labels."""
        column = self.column(name, field)
        if "values" not in column:
            raise ValueError(f"column '{field}' of '{name}' has no labels")
        return self._read(name, [field], {field: "int"}), column["values"]

    def read_text(self, name: str, field: str) -> DataFrame:
        """row and the labels of a text column themselves."""
        codes, labels = self.read_categorical(name, field)
        named = self.spark.createDataFrame([(k, v) for k, v in enumerate(labels)], "code__ int, label__ string")
        return codes.join(F.broadcast(named), F.col(field) == F.col("code__")).select("row", F.col("label__").alias(field))
