"""Near-duplicate embeddings: Euclidean p-stable hashing, then exact cosines.

Unit vectors at a cosine of 0.95 or more lie within sqrt(2 - 2 * 0.95) of each other. A table's key is a tuple of
quantised random projections, floor((a . v + b) / width), which near vectors share more often than far ones; vectors
that share the key of any table are compared exactly. Projections a key and tables follow from the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fresh, saved
from pointloom.llm.simhash import _unite, components

#: Least cosine of a link; width of a quantised step; chance that a pair of just that cosine shares no table's key; mates
#: that a vector without near ones has in a bucket, about; rows of a block of a bucket.
LEAST, WIDTH, MISS, MATES, BLOCK_ROWS = 0.95, 2.0, 0.005, 0.125, 2048
SEED = 7


def chance(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection is the same for points this far apart (Datar et al. 2004)."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


@dataclass(frozen=True)
class Tables:
    """``tables`` keys of ``projections`` quantised projections each."""

    tables: int
    projections: int

    @classmethod
    def of(cls, n: int, least: float = LEAST) -> Tables:
        """Enough projections that unrelated vectors (orthogonal, about) seldom meet, and tables that find links."""
        k = max(4, ceil(log(max(n, 2) / MATES) / -log(chance(sqrt(2)))))
        return cls(ceil(log(MISS) / log(1 - chance(sqrt(2 - 2 * least)) ** k)), k)

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A 32-bit key for each row and table. Equal tuples have equal keys; what else collides is compared in vain."""
        d = unit.shape[1]
        rng = np.random.default_rng([SEED, d])
        a = rng.standard_normal((d, self.tables * self.projections))
        b = rng.uniform(0, WIDTH, self.tables * self.projections)
        mix = rng.integers(1 << 62, size=(self.tables, self.projections), dtype=np.int64) * 2 + 1
        steps = np.floor((unit @ a + b) / WIDTH).astype(np.int64).reshape(len(unit), self.tables, self.projections)
        return ((steps * mix).sum(axis=2) >> 32).astype(np.int32)


def unit_rows(column: pa.Array) -> list[np.ndarray]:
    """Unit vectors in double precision; scaled before squaring, so that no length overflows."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.value_lengths().to_numpy().cumsum()
    rows = np.split(flat, ends[:-1])
    rows = [r / np.abs(r).max() for r in rows]
    return [r / np.sqrt(r @ r) for r in rows]


def distinct_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """node, vector, copies and least (smallest id): each vector that has a direction, once."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull()).where(~odd & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy(v.alias("vector")).agg(F.count("*").alias("copies"), F.min(F.col(f"`{id_col}`")).alias("least"))
    return rows.withColumn("node", F.monotonically_increasing_id())


def with_keys(nodes: DataFrame, tables: Tables) -> DataFrame:
    """node, copies, vector and keys (one 32-bit integer a table)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                units = unit_rows(part.column("vector"))
                keys = np.zeros((len(units), tables.tables), np.int32)
                sizes = np.array([len(u) for u in units])
                for d in np.unique(sizes).tolist():
                    keys[sizes == d] = tables.keys(np.stack([u for u in units if len(u) == d])) ^ d
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(units) + 1) * tables.tables, pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("copies"), part.column("vector"), lists], names=["node", "copies", "vector", "keys"])

    kind = nodes.schema["vector"].dataType.simpleString()
    return nodes.select("node", "copies", "vector").mapInArrow(run, f"node long, copies long, vector {kind}, keys array<int>")


def block_links(
    node: np.ndarray, copies: np.ndarray, units: list[np.ndarray], keys: np.ndarray, cut: int, table: int, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the rows of a bucket, or across ``cut`` if it is not 0: (partners of each row, with their copies; a
    spanning forest as two lists of nodes). A pair counts in the first table whose key it shares."""
    n = len(node)
    found, parent = np.zeros(n, np.int64), np.arange(n)
    sizes = np.array([len(u) for u in units])
    for d in np.unique(sizes).tolist():
        of = np.flatnonzero(sizes == d)
        unit = np.stack([units[k] for k in of.tolist()])
        left, right = (of < cut, of >= cut) if cut else (np.ones(len(of), bool),) * 2
        rows, others = np.flatnonzero(left), np.flatnonzero(right)
        for at in range(0, len(rows), 256):
            i, j = np.nonzero(unit[rows[at : at + 256]] @ unit[others].T >= least)
            i, j = of[rows[at + i]], of[others[j]]
            first = i < j
            i, j = i[first], j[first]
            for done in range(0, len(i), 1 << 14):
                a, b = i[done : done + (1 << 14)], j[done : done + (1 << 14)]
                new = ~(keys[a, :table] == keys[b, :table]).any(axis=1)
                a, b = a[new], b[new]
                found += np.bincount(a, copies[b], n).astype(np.int64) + np.bincount(b, copies[a], n).astype(np.int64)
                _unite(parent, a, b)
    _unite(parent, np.arange(n), parent.copy())
    linked = np.flatnonzero(parent != np.arange(n))
    return found, node[linked], node[parent[linked]]


def links(hashed: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v, links): with v, an edge of a spanning forest; without, partners of u found in one bucket.

    Buckets of one member go before vectors travel. A bucket of more than ``BLOCK_ROWS`` rows is dealt into blocks by a
    hash of the node and every pair of blocks is a group of its own, so that all pairs of the bucket are compared and no
    group is larger than two blocks.
    """
    rows = hashed.select("node", F.posexplode("keys").alias("turn", "key"))
    shared = rows.groupBy("turn", "key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("rows")).where("rows > 1")
    rows = rows.join(shared.drop("rows"), ["turn", "key"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("node", "turn", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own")
    group = ["turn", "key", "low", "high"]
    rows = rows.join(hashed, "node").repartition(*group).sortWithinPartitions(*group, "own", "node")

    def work(table: pa.Table) -> pa.RecordBatch:
        """All groups of a table of whole groups."""
        cols = {c: table.column(c).to_numpy() for c in ("node", "copies", "own", *group)}
        units = unit_rows(table.column("vector").combine_chunks())
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(units), -1)
        marks = np.stack([cols[c].astype(np.int64) for c in group])
        edge = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), len(units)]
        out = [(np.zeros(0, np.int64),) * 3]
        for a, b in zip(edge, edge[1:], strict=False):
            low, high = cols["low"][a], cols["high"][a]
            cut = int((cols["own"][a:b] == low).sum()) if low != high else 0
            if low != high and cut in (0, b - a):
                continue
            found, u, v = block_links(cols["node"][a:b], cols["copies"][a:b], units[a:b], keys[a:b], cut, int(cols["turn"][a]), least)
            some = np.flatnonzero(found)
            out += [(cols["node"][a:b][some], np.full(len(some), -1), found[some]), (u, v, np.zeros(len(u), np.int64))]
        u, v, n = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, mask=v < 0), pa.array(n)], names=["u", "v", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            marks = np.stack([held.column(c).to_numpy().astype(np.int64) for c in group])
            last = np.flatnonzero((marks != marks[:, -1:]).any(axis=0))
            whole = int(last[-1]) + 1 if len(last) else 0  # the last group may go on
            if whole:
                yield work(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield work(held)

    return rows.select("node", "copies", "vector", "keys", "own", *group).mapInArrow(run, "u long, v long, links long")


def embedding_classes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST
) -> DataFrame:
    """Per row: the id, n_links, component_id and kept (whether the id is its component's).

    Equal vectors are compared once and count as often as they occur. Vectors that are null, empty, all zero, or hold a
    null or non-finite component link with nothing, as do vectors of different lengths. Rows without an id take part; a
    component of only such rows has a null id, and such rows are not kept. Repeated ids are rows of their own, kept or
    not alike. An empty table gives no rows; other columns are not read.
    """
    source = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`").alias(fresh([id_col], "vector")))
    vector = source.columns[1]
    nodes = saved(distinct_vectors(source, id_col, vector), "vectors")
    hashed = saved(with_keys(nodes, Tables.of(nodes.count(), least)), "keys")
    found = saved(links(hashed, least), "links")
    counted = found.where("v IS NULL").groupBy("u").agg(F.sum("links").alias("partners"))
    roots = components(found.where("v IS NOT NULL").select("u", "v"))
    rooted = nodes.join(roots, "node", "left").join(counted, F.col("node") == F.col("u"), "left")
    rooted = rooted.select("vector", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("partners", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rooted = saved(rooted, "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_vector = rooted.join(ids, "root").select(F.col("vector").alias("vector__"), "n_links", "component_id", F.lit(True).alias("linked__"))
    own = F.col(f"`{id_col}`")
    all_rows = source.join(of_vector, F.col(f"`{vector}`") == F.col("vector__"), "left")
    component = F.when(F.col("linked__"), F.col("component_id")).otherwise(own)
    return all_rows.select(
        own,
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == own, F.lit(False)).alias("kept"),
    )
