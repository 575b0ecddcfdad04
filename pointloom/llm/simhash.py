"""SimHash near-duplicates: fingerprints, binary trie self-joins within a Hamming budget, connected components.

Fingerprints at most four of 64 bits apart differ in at most one bit in one of three runs of 21 bits. A trie is laid
over the bits beginning at each run and joined with itself: with the run's share of the budget while in the run, with
all of it below. The top levels of a trie are Spark groups, one for each pair of subtrees whose roots are within the
budget; a group walks its node pairs together, adds up differing bits and drops a pair as soon as the budget is
exceeded. It returns a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pointloom.llm.common import discard, fresh, map_texts, saved, space_words

SEED = 42


@dataclass(frozen=True)
class Search:
    """How fingerprints are compared: ``words`` of 64 bits each, linked at ``budget`` differing bits or fewer.

    ``turns`` tries begin ``run`` bits apart; within its first ``run`` bits a trie admits ``run_budget`` differences.
    With ``turns * (run_budget + 1) > budget`` no link is missed. ``subtree``: distinct fingerprints under one subtree
    root, about; it sets how many top levels are laid out as groups. ``crowd``: most members of one group; what would be
    more is dealt out as pairs of blocks.
    """

    words: int = 1
    budget: int = 4
    turns: int = 3
    run: int = 21
    run_budget: int = 1
    subtree: int = 4096
    crowd: int = 1 << 16


#: All links at four of 64 bits.
EXACT_4 = Search()
#: Candidates for a similarity of 0.8: such texts differ in 39 of 256 bits on average, with a deviation of 6, and texts
#: without relation in 128. Fourteen runs of 18 bits admit two differences each: of pairs that differ in 15 % of their
#: bits, one in 7,000 agrees in no run.
SIMILAR = Search(words=4, budget=60, turns=14, run=18, run_budget=2, subtree=1 << 18, crowd=1 << 19)
#: Least share of common shingles (numerator, denominator) of texts that are near copies.
LEAST_SIMILARITY = (4, 5)
#: Text bytes and rows of a block of a group of similar fingerprints, whose texts are compared block against block.
BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1024
#: Most rows of two numbers (64 MB) that are sent to all executors to pick texts; more are joined by a shuffle.
SMALL_ROWS = 4_000_000


def _mixed(h: np.ndarray, words: int) -> np.ndarray:
    """The hashes and, for further words, independent 64-bit mixes of them: one row a hash."""
    out = [h]
    for k in range(1, words):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ z >> np.uint64(31))
    return np.stack(out, axis=1)


def _column_sums(bits: np.ndarray) -> np.ndarray:
    """Sums of 0/1 bytes down the columns; 255 rows at a time fit a byte."""
    whole = len(bits) // 255 * 255
    parts = bits[:whole].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8)
    return parts.sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """64-bit hashes of the word runs of a text, in order; the whole text if it is shorter, none without words."""
    words = space_words(text)
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist() if len(words) >= shingle else [len(line)]
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def fingerprints_of(
    texts: list[bytes], shingle: int = 4, words_out: int = 1, piece: int = 1 << 15, *, distinct: bool = False
) -> np.ndarray:
    """A row of int64 words (the unsigned bits reinterpreted) for each text; 0 for texts without words.

    ``distinct``: repeated shingles vote once, and two more words hold a digest of the set of shingles.
    """
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    votes = np.zeros((len(texts), 64 * words_out), np.int64)
    digests = np.zeros((len(texts), 2), np.int64)
    firsts: list[int] = []  # text of each run of hashes not yet added up
    sizes: list[int] = []

    def add_up() -> None:
        if hashes:
            mixed = _mixed(np.array(hashes, np.uint64), words_out).astype(">u8")
            bits = np.unpackbits(mixed.view(np.uint8).reshape(len(hashes), -1), axis=1)
            ends = np.cumsum(sizes).tolist()
            sums = [_column_sums(bits[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
            np.add.at(votes, firsts, sums)
            hashes.clear(), firsts.clear(), sizes.clear()

    for k, text in enumerate(texts):
        found = shingle_hashes(text, shingle)
        if distinct and found:
            found = sorted(set(found))
            digests[k] = np.frombuffer(xxhash.xxh128_digest(np.array(found, np.uint64).tobytes()), np.int64)
        counts[k] = len(found)
        for lo in range(0, len(found), piece):
            run = found[lo : lo + piece]
            hashes += run
            firsts.append(k)
            sizes.append(len(run))
            if len(hashes) >= piece:
                add_up()
    add_up()
    prints = np.packbits(2 * votes > counts[:, None], axis=1).view(">u8").astype(np.uint64).view(np.int64)
    return np.concatenate([prints, digests], axis=1) if distinct else prints


def with_fingerprint(
    docs: DataFrame,
    *,
    keep: list[str],
    text_col: str = "text",
    name: str = "fp",
    shingle: int = 4,
    words: int = 1,
    distinct: bool = False,
) -> DataFrame:
    """Columns ``keep`` and the fingerprint of each text (array of ``words`` longs, and two if ``distinct``)."""
    width = words + 2 * distinct

    def start():
        def work(texts):
            flat = fingerprints_of(texts, shingle, words, distinct=distinct).ravel()
            return [pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), pa.array(flat))]

        return work

    return map_texts(docs, keep, text_col, [(name, "array<bigint>")], start)


def _children(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, shift: int, bits: int) -> np.ndarray:
    """Bounds of the children of the nodes ``values[lo:hi]``: one row a node, ``2**bits + 1`` columns."""
    prefix = values[lo] >> np.uint64(shift + bits) << np.uint64(shift + bits)
    edges = prefix[:, None] | (np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift))[None, :]
    inner = np.clip(np.searchsorted(values, edges[:, 1:].ravel()).reshape(len(lo), -1), lo[:, None], hi[:, None])
    return np.concatenate([lo[:, None], inner, hi[:, None]], axis=1)


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j, pair by pair; ``parent`` points to each set's smallest member."""
    while len(i):
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(
    values: np.ndarray,
    left: np.ndarray,
    right: np.ndarray | None,
    depth: int,
    search: Search = EXACT_4,
    whole: np.ndarray | None = None,
    *,
    step: int = 2,
    leaf: int = 64,
    block: int = 1 << 14,
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest (member, smaller member) of the links between two subtrees, or within one.

    ``values`` are the sorted leading words of both subtrees, whose roots lie at ``depth`` bits, ``whole`` the
    fingerprints if they are longer; ``left`` and ``right`` are the bounds of each subtree. The pairs of a block are
    expanded before the next block's, so the frontier in memory is a block and its children a level.
    """
    parent = np.arange(len(values))
    lo, hi = left
    lo2, hi2 = left if right is None else right
    roots = int(np.bitwise_count((values[lo] ^ values[lo2]) >> np.uint64(64 - depth))) if depth and hi > lo and hi2 > lo2 else 0
    pairs = np.array([[lo, hi, lo2, hi2, roots]], np.int64)
    stack = [(depth, pairs)] if hi > lo and hi2 > lo2 else []
    combos = np.bitwise_count(np.arange(1 << step)[:, None] ^ np.arange(1 << step)[None, :]).astype(np.int64)
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > block:
            stack.append((depth, pairs[block:]))
            pairs = pairs[:block]
        done = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= leaf) | (depth >= 64)
        _compare(values[:, None] if whole is None else whole, pairs[done], parent, search.budget)
        pairs = pairs[~done]
        if not len(pairs):
            continue
        shift = 64 - depth - step
        a = _children(values, pairs[:, 0], pairs[:, 1], shift, step)
        b = _children(values, pairs[:, 2], pairs[:, 3], shift, step)
        limit = search.run_budget if depth + step <= search.run else search.budget
        bits = pairs[:, 4, None, None] + combos
        ok = (np.diff(a)[:, :, None] > 0) & (np.diff(b)[:, None, :] > 0) & (bits <= limit)
        same = (pairs[:, 0] == pairs[:, 2])[:, None, None]  # a subtree with itself: each pair of children once
        ok &= ~same | (np.arange(1 << step)[:, None] <= np.arange(1 << step)[None, :])
        k, x, y = np.nonzero(ok)
        stack.append((depth + step, np.stack([a[k, x], a[k, x + 1], b[k, y], b[k, y + 1], bits[k, x, y]], axis=1)))
    _unite(parent, np.arange(len(values)), parent.copy())
    linked = np.nonzero(parent != np.arange(len(values)))[0]
    return linked, parent[linked]


def _compare(values, pairs, parent, budget, piece: int = 1 << 20) -> None:
    """Compares all fingerprints under each pair of nodes and unites those within the budget."""
    na, nb = pairs[:, 1] - pairs[:, 0], pairs[:, 3] - pairs[:, 2]
    work = np.cumsum(na * nb)
    done = 0
    for cut in np.unique(np.searchsorted(work, np.arange(piece, work[-1] + piece, piece), "right")) if len(work) else ():
        p, n, m = pairs[done:cut], (na * nb)[done:cut], nb[done:cut]
        done = cut
        owner = np.repeat(np.arange(len(p)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        i, j = p[owner, 0] + place // m[owner], p[owner, 2] + place % m[owner]
        apart = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int64) for w in values.T)
        ok = (apart <= budget) & (i != j)
        _unite(parent, i[ok], j[ok])


def _dealt(rows: DataFrame, keys: list[str], crowd: int) -> DataFrame:
    """Rows with the block pair (left, right) of their group; only groups of more than ``crowd`` rows have blocks.

    A crowded group's rows are dealt into blocks by node, and each goes to all pairs that its block is in: all pairs of
    rows meet, in several groups of about two ``crowd`` halves. The crowded groups are fewer than rows / ``crowd``.
    """
    crowded = rows.groupBy(*keys).count().where(F.col("count") > crowd)
    crowded = saved(crowded.select(*keys, F.ceil(2 * F.col("count") / crowd).cast("int").alias("blocks")), "crowded")
    if crowded.isEmpty():
        return rows.withColumns({"left": F.lit(0), "right": F.lit(0)})
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = rows.join(crowded, keys, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    both = rows.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})
    return both.drop("blocks", "own", "other")


def _grouped(rows: DataFrame, keys: list[str]) -> GroupedData:
    """Groups that are dealt out by all keys, also where a join before dealt the rows out by some of them."""
    return rows.repartition(*keys).groupBy(*keys)


def links(fps: DataFrame, search: Search = EXACT_4) -> DataFrame:
    """Links (u, v) of nodes that connect what the search links.

    ``fps``: node (long) and fp (array of longs), each fingerprint once. Each group of the top levels' subtree pairs
    yields at most one link for each of its members.
    """
    depth = min(search.run - 1, max(0, ceil(log2(max(1, fps.count()) / search.subtree))))
    masks = [sum(1 << x for x in at) for k in range(search.run_budget + 1) for at in combinations(range(depth), k)]
    turns = []
    for k in range(search.turns):
        word, bit = divmod(k * search.run % (64 * search.words), 64)
        x = F.col("fp")[word]
        if bit:
            x = F.shiftleft(x, bit).bitwiseOR(F.shiftrightunsigned(F.col("fp")[(word + 1) % search.words], 64 - bit))
        turns.append(F.struct(F.lit(k).alias("turn"), x.alias("x")))
    long = [F.slice("fp", 1, search.words).alias("fp")] if search.words > 1 else []
    root = F.shiftrightunsigned("x", 64 - depth) if depth else F.lit(0).cast("long")
    # a pair of subtrees is named by its smaller root and the bits between both; each member goes to all of its pairs
    rows = fps.select("node", *long, F.inline(F.array(*turns))).withColumn("root", root)
    rows = rows.withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
    low = F.least("root", F.col("root").bitwiseXOR(F.col("mask"))).alias("low")

    def walk(key, pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["x"].to_numpy().view(np.uint64)
        order = np.argsort(values, kind="stable")
        values, node = values[order], pdf["node"].to_numpy()[order]
        whole = np.stack(pdf["fp"].to_numpy()[order]).view(np.uint64) if search.words > 1 and len(pdf) else None
        cut, n = len(values), len(values)
        if key[2]:  # two subtrees
            cut = int(np.searchsorted(values >> np.uint64(64 - depth), np.uint64(int(key[1])), "right"))
        u, v = trie_links(values, (0, cut), (cut, n) if key[2] else None, depth, search, whole)
        return pd.DataFrame({"u": node[u], "v": node[v]})

    keys = ["turn", "low", "mask"]
    rows = _dealt(rows.select("turn", low, "mask", "x", "node", *(["fp"] if long else [])), keys, search.crowd)
    return _grouped(rows, [*keys, "left", "right"]).applyInPandas(walk, "u long, v long")


def components(pairs: DataFrame, *, most: int = 60) -> DataFrame:
    """(node, root) of the nodes in a link (u, v): alternating large-star and small-star rounds.

    Every round is written to the shared folder and the next one reads it, so that lost executors cost one round; a
    round's tables go when the next one's edges are written. The root is a component's smallest node, which has no row.
    """
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = saved(pairs.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = saved(large.where("u <> v").distinct(), "large")
        fewer = saved(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(fewer, "u").select("u", "v", "m")
        new = saved(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(fewer.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "edges",
        )
        discard(edges, least, large, fewer)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
    raise RuntimeError(f"components did not settle in {most} rounds")


def near_duplicates(
    docs: DataFrame,
    *,
    keep: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 4,
    search: Search = EXACT_4,
    names: tuple[str, str] = ("fp", "component_id"),
) -> DataFrame:
    """Columns ``keep`` of every row, its fingerprint (array of longs) and the smallest id its near-duplicates reach.

    Texts without words (null, empty, white space) have fingerprint 0 and are linked like any other. Rows without an id
    take part; a component of only such rows has a null id. Copies collapse to one fingerprint before anything is
    compared.
    """
    fp, component = names
    kept = list(dict.fromkeys([*keep, id_col]))
    marked = with_fingerprint(docs, keep=kept, text_col=text_col, name=fp, shingle=shingle, words=search.words)
    marked = saved(marked, "fp")
    of_fp = _classes_of(marked, fp, id_col, search, component)
    return marked.join(of_fp, fp).select(*[F.col(f"`{c}`") for c in keep], fp, component)


def _classes_of(marked: DataFrame, fp: str, id_col: str, search: Search, component: str) -> DataFrame:
    """(fp, component): the smallest id that the rows reachable from a fingerprint have."""
    fps = marked.groupBy(F.col(fp).alias("fp")).agg(F.min(F.col(f"`{id_col}`")).alias("least"))
    fps = saved(fps.withColumn("node", F.monotonically_increasing_id()), "fps")
    roots = components(links(fps, search))
    rooted = fps.join(roots, "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    rooted = saved(rooted, "rooted")
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("id")), "ids")
    return saved(rooted.join(ids, "root").select(F.col("fp").alias(fp), F.col("id").alias(component)), "classes")


def _shares_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets share ``LEAST_SIMILARITY`` of their union or more; empty sets are equal."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if LEAST_SIMILARITY[1] * len(few) < LEAST_SIMILARITY[0] * len(many):
        return False
    at = np.minimum(np.searchsorted(many, few), max(len(many) - 1, 0))
    both = int((many[at] == few).sum()) if len(few) else 0
    return LEAST_SIMILARITY[1] * both >= LEAST_SIMILARITY[0] * (len(a) + len(b) - both)


def _confirmed(fps: np.ndarray, sets: list[np.ndarray], cut: int, budget: int) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs across ``cut`` (among all rows if it is 0), the nearest fingerprints first."""
    n, found = len(fps), []
    near: list[np.ndarray] = []
    for lo in range(0, cut or n, 256):
        rows = np.arange(lo, min(lo + 256, cut or n))
        others = np.arange(cut, n)
        apart = sum(np.bitwise_count(fps[rows, k][:, None] ^ fps[others, k][None, :]).astype(np.int64) for k in range(fps.shape[1]))
        i, j = np.nonzero(apart <= budget)
        keep = rows[i] < others[j]
        near.append(np.stack([apart[i, j][keep], rows[i[keep]], others[j[keep]]], 1))
    pairs = np.concatenate([np.zeros((0, 3), np.int64), *near])
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in pairs[np.argsort(pairs[:, 0], kind="stable")][:, 1:].tolist():
        a, b = root(i), root(j)
        if a != b and _shares_enough(sets[i], sets[j]):
            parent[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def confirmed(groups: DataFrame, texts: DataFrame, shingle: int, search: Search) -> DataFrame:
    """Links (u, v) that connect all nodes whose fingerprints are within the budget and whose texts share
    ``LEAST_SIMILARITY`` of their distinct shingles or more.

    ``groups``: node, fp and root, the group that holds all nodes within the budget; ``texts``: node, text. A large
    group is dealt into blocks of ``BLOCK_BYTES`` and ``BLOCK_ROWS``, about, and each pair of blocks is one task's.
    """
    rows = groups.join(texts, "node").withColumn("size", F.octet_length("text"))
    sizes = rows.groupBy("root").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).where("rows > 1")
    blocks = F.ceil(F.greatest(F.col("bytes") / BLOCK_BYTES, F.col("rows") / BLOCK_ROWS)).cast("int")
    rows = rows.join(sizes.select("root", F.greatest(blocks, F.lit(1)).alias("blocks")), "root")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"left": F.least("own", "other"), "right": F.greatest("own", "other")})

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["own", "node"])
        cut = int((pdf["own"] == key[1]).sum()) if key[1] != key[2] else 0
        node = pdf["node"].to_numpy()
        if key[1] != key[2] and cut in (0, len(pdf)):
            return pd.DataFrame({"u": node[:0], "v": node[:0]})
        sets = [np.unique(np.array(shingle_hashes(t.encode(), shingle), np.uint64)) for t in pdf["text"]]
        fps = np.stack(pdf["fp"].to_numpy()).view(np.uint64)[:, : search.words]
        pairs = np.array(_confirmed(fps, sets, cut, search.budget), np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": node[pairs[:, 0]], "v": node[pairs[:, 1]]})

    chosen = rows.select("root", "left", "right", "own", "node", "fp", "text")
    return _grouped(chosen, ["root", "left", "right"]).applyInPandas(compare, "u long, v long")


def _similar_classes(
    marked: DataFrame, fp: str, row: str, text_col: str, shingle: int, search: Search, component: str
) -> DataFrame:
    """(fp, component): the smallest row that is reached from a fingerprint by confirmed links.

    Fingerprints within the budget of each other fall into groups; within these the texts are compared.
    """
    fps = marked.groupBy(F.col(f"`{fp}`").alias("fp")).agg(F.min(F.col(f"`{row}`")).alias("least"))
    fps = saved(fps.withColumn("node", F.monotonically_increasing_id()), "fps")
    near = components(links(fps, search))
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    groups = saved(fps.join(near, "node"), "groups")
    source = marked.select(F.col(f"`{row}`").alias("least"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    wanted = groups.select("node", "least")
    if groups.count() <= SMALL_ROWS:  # the texts of documents without a like one stay where they are
        wanted = F.broadcast(wanted)
    texts = source.join(wanted, "least").select("node", "text")
    sure = saved(confirmed(groups.select("node", "fp", "root"), texts, shingle, search), "sure")
    rooted = fps.join(components(sure), "node", "left").select("fp", "least", F.coalesce("root", "node").alias("root"))
    rooted = saved(rooted, "rooted")
    ids = saved(rooted.groupBy("root").agg(F.min("least").alias("id")), "ids")
    return saved(rooted.join(ids, "root").select(F.col("fp").alias(fp), F.col("id").alias(component)), "classes")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: fingerprint (16 hex digits) and component_id."""
    found = near_duplicates(docs.select(id_col, text_col), keep=[id_col], id_col=id_col, text_col=text_col)
    return found.select(id_col, F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, search: Search = SIMILAR
) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id (no id comes last), columns unchanged.

    Near-duplicates share ``LEAST_SIMILARITY`` of their distinct shingles or more, or are linked by such texts. All rows
    without words are copies of one another. Of rows with the same id any one stays.
    """
    row, fp, component = (fresh(docs.columns, x) for x in ("row__", "fp__", "component__"))
    marked = with_fingerprint(
        docs, keep=docs.columns, text_col=text_col, name=fp, shingle=shingle, words=search.words, distinct=True
    )
    marked = saved(marked.withColumn(row, F.monotonically_increasing_id()), "rows")
    of_fp = _similar_classes(marked, fp, row, text_col, shingle, search, component)
    rank = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(row).alias("row"))
    best = saved(marked.select(fp, rank.alias("rank")).groupBy(fp).agg(F.min("rank").alias("rank")), "best")
    best = saved(best.join(of_fp, fp).groupBy(component).agg(F.min("rank").alias("rank")), "kept")
    best = best.select(F.col("rank.row").alias(row))
    return marked.join(best, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
