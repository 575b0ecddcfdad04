"""Benchmark decontamination with a distributed positional inverted index.

The index is built once and stored: every task cuts the documents it reads into segments and writes, for each segment,
the postings (positions) of all its terms. A query window (ten consecutive item words) is looked up in a segment from
its rarest term by corpus frequency: that term's list, shifted by its offset in the window, holds the candidate starts;
it is intersected with the shifted lists of the next rarer terms, and what is left is confirmed word by word. Proximity
matches join the lists of an item's three rarest terms. A document lies in one segment, so that lists meet within a
task and documents never move; term frequencies are added up over the segments' lists.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointloom.llm.common import alnum_words, byte_texts, fresh, saved, text_chunks

#: Benchmark bytes that are looked up at once (they are broadcast), about; a larger benchmark is matched in turns.
BLOCK_BYTES = 4 << 20
#: Text bytes of a segment; a longer document is a segment of its own.
SEGMENT_BYTES = 1 << 20
#: Shifted lists that are intersected before the candidates are confirmed.
LISTS = 3
MATCHES = "array<struct<item:string,start:int,end:int>>"


class _Queries:
    """Windows of one block of benchmark items over a dense vocabulary."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocab = {w: i for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.items = [name for name, _ in items]
        self.words = [np.array([self.vocab[w] for w in words], np.int32) for _, words in items]
        spans = [(k, s, min(window, len(x))) for k, x in enumerate(self.words) for s in range(max(1, len(x) - window + 1))]
        self.item = np.array([k for k, _, _ in spans], np.int32)
        self.length = np.array([n for _, _, n in spans], np.int32)
        self.terms = np.full((len(spans), window), -1, np.int32)
        for row, (k, s, n) in zip(self.terms, spans, strict=True):
            row[:n] = self.words[k][s : s + n]

    def order(self, frequency: np.ndarray) -> None:
        """Offsets of each window's terms from the rarest to the commonest, and the windows that start at a term."""
        weight = np.where(self.terms >= 0, frequency[self.terms], np.iinfo(np.int64).max)
        self.offsets = np.argsort(weight, axis=1, kind="stable").astype(np.int32)
        first = self.terms[np.arange(len(self.terms)), self.offsets[:, 0]]
        self.by_first = np.argsort(first, kind="stable").astype(np.int64)
        self.n_first = np.bincount(first, minlength=len(self.vocab))
        self.at_first = np.concatenate([[0], np.cumsum(self.n_first)])
        rare = [x[np.argsort(frequency[x], kind="stable")] for x in (np.unique(w) for w in self.words)]
        self.near = np.array([[k, *x[:3]] for k, x in enumerate(rare) if len(x) >= 3], np.int64).reshape(-1, 4)


def _ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): owners (0, 0, 2, 2, 2) and places within the owner (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _postings(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Terms of some texts, the bounds of their lists, all lists one after the other, and each text's words.

    Positions count on over the texts, with one empty position between two.
    """
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, n = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = alnum_words(text)
        n[k] = len(words)
        parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
    ids = np.concatenate(parts)
    at = np.arange(len(ids)) + np.repeat(np.arange(len(texts)), n)
    order = np.argsort(ids, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=len(number)))])
    return list(number), bounds, at[order], n


class _Segment:
    """The lists of a segment's terms that a block of queries knows, sorted by term and position."""

    def __init__(self, terms: list[bytes], bounds: np.ndarray, positions: np.ndarray, n: np.ndarray, q: _Queries):
        get = q.vocab.get
        known = np.fromiter((get(t, -1) for t in terms), np.int64, len(terms))
        mine = np.nonzero(known >= 0)[0]
        mine = mine[np.argsort(known[mine])]
        self.first = np.cumsum(n + 1) - n - 1
        self.n, self.size = n, int((n + 1).sum()) + 1
        counts = np.diff(bounds)[mine]
        owner, place = _ragged(counts)
        self.at = positions[bounds[mine][owner] + place]
        self.keys = known[mine][owner] * self.size + self.at
        self.lists = np.zeros(len(q.vocab) + 1, np.int64)
        self.lists[known[mine] + 1] = counts
        self.lists = np.cumsum(self.lists)
        self.ids = np.full(self.size, -1, np.int32)  # the term at each position, for confirming
        self.ids[self.at] = known[mine][owner]

    def has(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each position is in the term's list."""
        key = term.astype(np.int64) * self.size + at
        k = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(k, len(self.keys) - 1)] == key

    def nearest(self, term: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last position of the term's list up to ``at`` and the first one after; far away where there is none."""
        k = np.searchsorted(self.keys, term.astype(np.int64) * self.size + at, "right")
        low, high = self.lists[term], self.lists[term + 1]
        far = -(self.size << 2)
        before = np.where(k > low, self.at[np.maximum(k - 1, 0)], far)
        return before, np.where(k < high, self.at[np.minimum(k, len(self.at) - 1)], -far)


def _exact(s: _Segment, q: _Queries, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(start position, window) of all occurrences."""
    terms = np.nonzero((np.diff(s.lists) > 0) & (q.n_first > 0))[0]
    owner, place = _ragged(np.diff(s.lists)[terms])
    term, posting = terms[owner], s.at[s.lists[terms][owner] + place]
    starts, windows = [], []
    work = np.cumsum(q.n_first[term])
    total, done = int(work[-1]) if len(work) else 0, 0
    for cut in np.unique(np.searchsorted(work, np.arange(piece, total + piece, piece), "right")) if total else ():
        t, at, done = term[done:cut], posting[done:cut], cut
        owner, place = _ragged(q.n_first[t])
        w = q.by_first[q.at_first[t][owner] + place]
        start = at[owner] - q.offsets[w, 0]
        ok = (start >= 0) & (start + q.length[w] < s.size)
        start, w = start[ok], w[ok]
        for rank in range(1, q.terms.shape[1]):
            if not len(w):
                break
            k = q.offsets[w, rank]
            if rank < LISTS:
                ok = s.has(q.terms[w, k], start + k)
            else:
                ok = s.ids[np.minimum(start + k, s.size - 1)] == q.terms[w, k]
            ok |= rank >= q.length[w]
            start, w = start[ok], w[ok]
        starts.append(start)
        windows.append(w)
    return (np.concatenate(starts), np.concatenate(windows)) if starts else (np.zeros(0, np.int64),) * 2


def _near(s: _Segment, doc_of: np.ndarray, q: _Queries, span: int) -> np.ndarray:
    """(document, item) pairs in which the item's three rarest terms stand within ``span`` words of the rarest."""
    if not len(q.near) or not len(s.at):
        return np.zeros((0, 2), np.int64)
    rarest = q.near[:, 1]
    owner, place = _ragged(np.diff(s.lists)[rarest])
    at = s.at[s.lists[rarest[owner]] + place]
    ok = np.ones(len(at), bool)
    for column in (2, 3):
        hit = np.zeros(len(at), bool)
        for other in s.nearest(q.near[owner, column], at):
            hit |= (np.abs(other - at) <= span) & (doc_of[np.clip(other, 0, s.size - 1)] == doc_of[at])
        ok &= hit
    return np.unique(np.stack([doc_of[at[ok]], q.near[owner[ok], 0]], 1), axis=0)


def _match(s: _Segment, q: _Queries, span: int) -> tuple[list[np.ndarray], np.ndarray]:
    doc_of = np.append(np.repeat(np.arange(len(s.n)), s.n + 1), -1)
    start, window = _exact(s, q)
    doc, item, end = doc_of[start], q.item[window].astype(np.int64), start + q.length[window]
    order = np.lexsort((start, item, doc))
    doc, item, start, end = doc[order], item[order], start[order], end[order]
    new = np.ones(len(doc), bool)  # overlapping or touching occurrences of an item are one match
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])
    last = np.concatenate([np.nonzero(new)[0][1:], [len(new)]]) - 1 if len(new) else np.zeros(0, np.int64)
    doc, item, start, end = doc[new], item[new], start[new], end[last]
    near = _near(s, doc_of, q, span)
    if len(near):  # an exact match is no proximity match as well
        exact = set(zip(doc.tolist(), item.tolist(), strict=True))
        near = np.array([p for p in near.tolist() if tuple(p) not in exact], np.int64).reshape(-1, 2)
    return [doc, item, start - s.first[doc], end - s.first[doc]], near


def index_documents(docs: DataFrame, *, keep: list[str], text_col: str = "text") -> DataFrame:
    """The stored index: one row a segment.

    docs: columns ``keep`` of its documents; n: their words; terms, bounds and positions: the postings (bounds and
    positions as little-endian 32-bit integers). A null text has no words.
    """
    kept = T.StructType([T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)])
    text = f"k{len(keep)}"
    source = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").alias(text))
    names = ["docs", "n", "terms", "bounds", "positions"]
    schema = T.StructType(
        [T.StructField("docs", T.ArrayType(kept)), T.StructField("n", T.ArrayType(T.LongType()))]
        + [T.StructField("terms", T.ArrayType(T.BinaryType())), *(T.StructField(x, T.BinaryType()) for x in names[3:])]
    )

    def run(batches):
        import pyarrow.compute  # noqa: F401

        for part, texts in text_chunks(batches, text, SEGMENT_BYTES):
            terms, bounds, positions, n = _postings(texts)
            columns = [part.column(f.name) for f in kept]
            rows = pa.StructArray.from_arrays(columns, names=kept.names) if columns else pa.nulls(len(texts), pa.struct([]))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (rows, pa.array(n), pa.array(terms, pa.binary()))]
            blobs = [pa.array([v.astype("<i4").tobytes()], pa.binary()) for v in (bounds, positions)]
            yield pa.RecordBatch.from_arrays([*lists, *blobs], names=names)

    return saved(source.mapInArrow(run, schema).withColumn("segment", F.monotonically_increasing_id()), "index")


def _blocks(bench: DataFrame, item_col: str, text_col: str):
    """The benchmark's items with words, one block of about ``BLOCK_BYTES`` after the other; an item is in one block."""
    rows = bench.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t"))
    rows = rows.where("i is not null and t is not null").dropDuplicates()
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    turns = max(1, -(-size // BLOCK_BYTES))
    for k in range(turns):
        block = rows.where(F.pmod(F.xxhash64("i"), F.lit(turns)) == k).collect()
        yield [(r.i, words) for r in sorted(block) if (words := alnum_words(r.t.encode()))]


def term_frequency(index: DataFrame, vocab: dict[bytes, int]) -> np.ndarray:
    """How often each term of ``vocab`` stands in all documents: the lengths of its lists, added up."""
    shared = index.sparkSession.sparkContext.broadcast(vocab)

    def run(batches):
        get, total = shared.value.get, np.zeros(len(shared.value) + 1, np.int64)
        for batch in batches:
            for terms, bounds in zip(batch.column("terms"), batch.column("bounds").to_pylist(), strict=True):
                known = np.fromiter((get(t, -1) for t in byte_texts(terms.values)), np.int64, len(terms))
                np.add.at(total, known, np.diff(np.frombuffer(bounds, "<i4")))
        got = np.nonzero(total[:-1])[0]
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got])], names=["term", "n"])

    counts = index.select("terms", "bounds").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(vocab), np.int64)
    for row in counts.toLocalIterator():  # as many rows as the block has terms
        out[row.term] = row.n
    return out


def _look_up(index: DataFrame, q: _Queries, span: int) -> DataFrame:
    """segment, docs (their kept columns), n, matches and near items (arrays with one element a document)."""
    shared = index.sparkSession.sparkContext.broadcast(q)
    schema = T.StructType([index.schema["segment"], index.schema["docs"], index.schema["n"]])
    schema = schema.add("matches", T.DataType.fromDDL(f"array<{MATCHES}>")).add("near", T.ArrayType(T.ArrayType(T.StringType())))

    def run(batches):
        q = shared.value
        name = np.array([*q.items, None], object)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                terms, n, bounds, positions = (row.column(c)[0] for c in ("terms", "n", "bounds", "positions"))
                bounds, positions = (np.frombuffer(v.as_py(), "<i4").astype(np.int64) for v in (bounds, positions))
                s = _Segment(byte_texts(terms.values), bounds, positions, n.values.to_numpy(), q)
                (doc, item, a, b), near = _match(s, q, span)
                found = pa.StructArray.from_arrays(
                    [pa.array(name[item], pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())],
                    names=["item", "start", "end"],
                )
                out = []
                for owner, values in ((doc, found), (near[:, 0], pa.array(name[near[:, 1]], pa.string()))):
                    ends = np.searchsorted(owner, np.arange(len(n) + 1)).astype(np.int32)
                    each = pa.ListArray.from_arrays(pa.array(ends), values)
                    out.append(pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), each))
                yield pa.RecordBatch.from_arrays([*(row.column(c) for c in ("segment", "docs", "n")), *out], names=schema.names)

    return index.mapInArrow(run, schema)


def find_passages(
    docs: DataFrame,
    bench: DataFrame,
    *,
    keep: list[str],
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    near_span: int = 20,
    names: tuple[str, str, str] = ("n_words", "matches", "near_items"),
) -> DataFrame:
    """Columns ``keep`` of every document, its number of words, exact matches and proximity matches.

    A match is a run of words covered by occurrences of an item's windows (``window`` consecutive words; a shorter
    item is one window): item, start and end as word numbers, end exclusive. A proximity match is an item without an
    exact match whose three rarest terms (ties: the smaller word) stand within ``near_span`` words of an occurrence of
    the rarest. Null and empty texts have no words; items without id or words are never matched; repeated items count
    once.
    """
    index = index_documents(docs, keep=keep, text_col=text_col)
    first, more = None, None
    for block in _blocks(bench, item_col, item_text_col):  # one, unless the benchmark outgrows BLOCK_BYTES
        q = _Queries(block, window)
        q.order(term_frequency(index, q.vocab))
        found = _look_up(index, q, near_span)
        if first is None:
            first = found
            continue
        rows = found.select("segment", F.posexplode(F.arrays_zip("matches", "near")).alias("k", "x"))
        rows = rows.where("size(x.matches) > 0 or size(x.near) > 0").select("segment", "k", "x.matches", "x.near")
        rows = saved(rows, "matches")
        more = rows if more is None else more.unionByName(rows)
    out = first.select("segment", F.posexplode(F.arrays_zip("docs", "n", "matches", "near")).alias("k", "x")).select("segment", "k", "x.*")
    if more is not None:
        rest = more.groupBy("segment", "k").agg(F.flatten(F.collect_list("matches")).alias("m"), F.flatten(F.collect_list("near")).alias("p"))
        out = out.join(rest, ["segment", "k"], "left").withColumns(
            {
                "matches": F.when(F.col("m").isNull(), F.col("matches")).otherwise(F.concat("matches", "m")),
                "near": F.when(F.col("p").isNull(), F.col("near")).otherwise(F.concat("near", "p")),
            }
        )
    kept = [F.col(f"docs.k{i}").alias(c) for i, c in enumerate(keep)]
    return out.select(*kept, F.col("n").alias(names[0]), F.col("matches").alias(names[1]), F.col("near").alias(names[2]))


def covered(matches: str | F.Column) -> F.Column:
    """Number of words inside any of the matches."""
    rows = F.sort_array(F.transform(matches, lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(
        rows,
        zero,
        lambda acc, m: F.struct(
            (acc["n"] + F.greatest(m["e"] - F.greatest(m["s"], acc["to"]), F.lit(0))).alias("n"),
            F.greatest(m["e"], acc["to"]).alias("to"),
        ),
        lambda acc: acc["n"].cast("long"),
    )


def contamination(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside matches), n_items, items_sha256, contaminated, n_near_items."""
    found = find_passages(docs.select(id_col, text_col), bench, keep=[id_col], text_col=text_col)
    items = F.sort_array(F.array_distinct(F.col("matches.item")))
    hit = found.withColumn("n_hit", covered("matches")).withColumn("items", items)
    return hit.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Documents without any exact benchmark passage, columns unchanged; a null or empty text has none.

    Passages are a matter of the text alone, so that documents meet the contaminated ones in an anti-join on two
    digests of the text; only digests are indexed beside the postings.
    """
    digest = F.struct(F.xxhash64(f"`{text_col}`").alias("a"), F.xxhash64(F.lit(1), F.col(f"`{text_col}`")).alias("b"))
    key, hit = (fresh(docs.columns, x) for x in ("digest__", "hit__"))
    rows = docs.withColumn(key, digest)
    found = find_passages(rows, bench, keep=[key], text_col=text_col, names=("n", "matches", "near"))
    bad = found.where("size(matches) > 0").select(F.col(key).alias(hit)).distinct()
    left = rows.join(bad, F.col(key) == F.col(hit), "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of ``contamination``; ids are taken to be unique.
SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {docs}),
bw AS (SELECT row_number() OVER () AS b, item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {bench} WHERE item_id IS NOT NULL AND text IS NOT NULL),
wins AS (SELECT DISTINCT b, item, least(10, len(w)) AS n, array_to_string(w[s+1:s+10], ' ') AS t
         FROM (SELECT b, item, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM bw WHERE len(w) > 0)),
word AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS x, unnest(range(len(w))) AS p FROM dw),
pos AS (SELECT doc_id, n_words, p, list_value(x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o,
          lead(x, 5) OVER o, lead(x, 6) OVER o, lead(x, 7) OVER o, lead(x, 8) OVER o, lead(x, 9) OVER o) AS l
        FROM word WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
cand AS (SELECT doc_id, p, n, array_to_string(l[1:n], ' ') AS t FROM pos, (SELECT DISTINCT n FROM wins) WHERE p + n <= n_words),
hit AS (SELECT DISTINCT doc_id, p, n, item, b FROM cand JOIN wins USING (n, t)),
cover AS (SELECT doc_id, count(DISTINCT p + k) AS n_hit FROM hit, range(10) r(k) WHERE k < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id),
freq AS (SELECT x, count(*) AS c FROM word GROUP BY x),
bx AS (SELECT DISTINCT b, unnest(w) AS x FROM bw),
rare AS (SELECT b, x, row_number() OVER (PARTITION BY b ORDER BY coalesce(c, 0), x) AS r FROM bx LEFT JOIN freq USING (x)),
three AS (SELECT b, max(x) FILTER (r = 1) AS x1, max(x) FILTER (r = 2) AS x2, max(x) FILTER (r = 3) AS x3 FROM rare WHERE r <= 3
          GROUP BY b HAVING count(*) = 3),
rp AS (SELECT doc_id, x, p FROM word WHERE x IN (SELECT x FROM rare WHERE r <= 3)),
n2 AS (SELECT DISTINCT b, x3, u.doc_id, u.p FROM three JOIN rp u ON u.x = x1 JOIN rp v ON v.doc_id = u.doc_id AND v.x = x2
       AND abs(v.p - u.p) <= 20),
n3 AS (SELECT DISTINCT n2.b, n2.doc_id FROM n2 JOIN rp v ON v.doc_id = n2.doc_id AND v.x = x3 AND abs(v.p - n2.p) <= 20),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT b, doc_id FROM n3 EXCEPT SELECT b, doc_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near_items
FROM dw LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN near USING (doc_id)
"""


def sql(docs: str = "documents", bench: str = "benchmark") -> str:
    return SQL.format(docs=docs, bench=bench)
