"""Phrase collocations: word runs that stand together more often than their parts would.

Each shard of text is held as compressed position bitmaps, one a word (vertical bitmaps as in SPAM): only blocks of
sixteen positions in which the word stands are stored. A phrase's bitmap marks the places of its last word; shifted by
one place and ANDed with a word's bitmap it is the bitmap of the longer phrase, whose popcount is its frequency in the
shard. Pieces are a place apart, so no phrase runs over their ends. Phrases are extended depth first, a slice of phrases
at a time. Popcounts are summed over shards.

A phrase is frequent only if its words and pairs are; both are counted first, and what a shard extends is pruned by a
Bloom filter of them. The filter has a fixed size, whatever the corpus: it can only let too much through, and what it
lets through is counted exactly and dropped by its sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import fold_texts, saved

#: Occurrences that a phrase needs, its longest length, and phrases reported a language.
LEAST, LONGEST, TOP = 100, 5, 2000
#: Bits of a filter (8 MB as bytes); its size does not depend on the input.
FILTER_BITS = 1 << 26
#: Text bytes of a shard, about; positions of a block of a bitmap; bitmap blocks that one depth-first step extends.
SHARD_BYTES, BLOCK, STEP = 6 << 20, 16, 1 << 17

#: 0: part of a word; 1: space or tab between words; 2: end of a piece.
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def pieces_words(text: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """The words of a text and their places; a place is left free between the words of different pieces."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    stops = np.flatnonzero(kind == 2)
    apart = np.diff(np.searchsorted(stops, starts), prepend=0) > 0
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])])
    return words, np.arange(len(starts)) + np.cumsum(apart)


def _parts(texts: list[bytes], limit: int) -> Iterator[bytes]:
    """Joined texts of about ``limit`` bytes; a longer text is cut where a piece ends."""
    held, size = [], 0
    for text in texts:
        while len(text) > limit:
            ends = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8)] == 2)
            near = int(np.searchsorted(ends, limit))
            if near == len(ends):
                break
            yield text[: ends[near]]
            text = text[ends[near] :]
        held.append(text)
        size += len(text)
        if size >= limit:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def _readable(words: pa.Array) -> pa.Array:
    """Words as strings; broken UTF-8 gets replacement marks."""
    try:
        return words.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([w.decode("utf-8", "replace") for w in words.to_pylist()], pa.string())


def _hashes(lang: str, words: pa.Array) -> np.ndarray:
    seed = xxhash.xxh64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    z = first * np.uint64(0x9E3779B97F4A7C15) + second
    z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ z >> np.uint64(32)


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % np.uint64(bits)).astype(np.int64), ((hashes >> np.uint64(20)) * np.uint64(31) % np.uint64(bits)).astype(np.int64)


class Filter:
    """Bloom filter with two bits a member."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _slots(hashes, 8 * len(self.table))
        return ((self.table[a >> 3] >> (a & 7) & 1) & (self.table[b >> 3] >> (b & 7) & 1)).astype(bool)


def filter_of(phrases: DataFrame, length: int, bits: int = FILTER_BITS) -> Filter:
    """The filter of (lang, phrase) rows of one or two words. Set bits are gathered in Spark as numbers of 64; at most
    ``bits`` / 64 of these reach the driver, whatever the number of phrases."""

    def run(batches):
        for batch in batches:
            out = [np.zeros(0, np.int64)]
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = _hashes(lang, pa.array([w.encode() for w in phrase.split(" ")]))
                out += _slots(hashes if length == 1 else _pair_hashes(hashes[:1], hashes[1:]), bits)
            slot = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(1, slot & 63))], names=["slot", "bit"])

    rows = phrases.select("lang", "phrase").mapInArrow(run, "slot long, bit long")
    found = rows.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, "<i8")
    table[found.column("slot").to_numpy()] = found.column("bits").to_numpy()
    return Filter(table.view(np.uint8))


class Bitmaps:
    """Compressed position bitmaps of the words of a shard: (block, mask) entries of each word, also by block."""

    def __init__(self, word: np.ndarray, place: np.ndarray):
        key = word * (place.max(initial=0) // BLOCK + 1) + place // BLOCK
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        bit = np.left_shift(1, place % BLOCK)[order]
        self.mask = np.bitwise_or.reduceat(bit, first) if len(first) else bit
        self.word, self.block = word[order][first], (place // BLOCK)[order][first]
        by = np.argsort(self.block, kind="stable")
        self.by_word, self.by_mask = self.word[by], self.mask[by]
        self.start = np.searchsorted(self.block[by], np.arange(place.max(initial=0) // BLOCK + 3))


def extended(maps: Bitmaps, phrase: np.ndarray, block: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """(phrase, word, block, mask) entries of the bitmaps of all phrases one word longer: shift, then AND with words."""
    mask = mask << 1
    carry = mask >> BLOCK
    over = carry > 0
    mask = mask & ((1 << BLOCK) - 1)
    here = mask > 0
    phrase, block = np.concatenate([phrase[here], phrase[over]]), np.concatenate([block[here], block[over] + 1])
    mask = np.concatenate([mask[here], carry[over]])
    count = maps.start[block + 1] - maps.start[block]
    row = np.repeat(np.arange(len(block)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + maps.start[block][row]
    both = mask[row] & maps.by_mask[at]
    met = np.flatnonzero(both)
    row, at = row[met], at[met]
    return phrase[row], maps.by_word[at], block[row], both[met]


def shard_phrases(
    words: np.ndarray, place: np.ndarray, n_words: int, hashes: np.ndarray, least: int, most: int, pairs: Filter | None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, popcounts) of all phrases of ``least`` to ``most`` words whose pairs pass the filter, by length."""
    maps = Bitmaps(words, place)
    chain = np.arange(n_words)[:, None]
    stack = [(chain, maps.word, maps.block, maps.mask)]
    while stack:
        chain, phrase, block, mask = stack.pop()
        if len(phrase) > STEP:  # the phrases after the first ``STEP`` blocks wait
            later = max(int(np.searchsorted(phrase, phrase[STEP])), int(np.searchsorted(phrase, phrase[0], "right")))
            if later < len(phrase):
                stack.append((chain, phrase[later:], block[later:], mask[later:]))
                phrase, block, mask = phrase[:later], block[:later], mask[:later]
        phrase, word, block, mask = extended(maps, phrase, block, mask)
        if pairs is not None:
            sure = pairs.holds(_pair_hashes(hashes[chain[phrase, -1]], hashes[word]))
            phrase, word, block, mask = phrase[sure], word[sure], block[sure], mask[sure]
        code = phrase * n_words + word
        order = np.argsort(code, kind="stable")
        code, block, mask = code[order], block[order], mask[order]
        new = np.diff(code, prepend=-1) != 0
        first = np.flatnonzero(new)
        if not len(first):
            continue
        longer = np.concatenate([chain[code[first] // n_words], (code[first] % n_words)[:, None]], axis=1)
        if longer.shape[1] >= least:
            yield longer, np.add.reduceat(np.bitwise_count(mask).astype(np.int64), first)
        if longer.shape[1] < most:
            stack.append((longer, np.cumsum(new) - 1, block, mask))


def _counted(docs: DataFrame, text_col: str, lang_col: str, least: int, most: int, words: Filter | None, pairs: Filter | None, shard: int) -> DataFrame:
    """(lang, phrase, f): occurrences of the phrases of ``least`` to ``most`` words that the filters let through."""
    schema = "lang string, phrase string, f long"
    context = docs.sparkSession.sparkContext
    sent = context.broadcast([None if x is None else x.table for x in (words, pairs)])

    def batch(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.repeat(lang, len(counts)), phrases, pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])

    def start():
        of_words, of_pairs = (None if x is None else Filter(x) for x in sent.value)

        def add(texts, langs):
            groups: dict[str, list[bytes]] = {}
            for text, lang in zip(texts, langs.to_pylist(), strict=True):
                groups.setdefault("und" if lang is None else lang, []).append(text)
            for lang, group in groups.items():
                for part in _parts(group, shard):
                    found, place = pieces_words(part)
                    found = found.dictionary_encode()
                    ids, known = found.indices.to_numpy(), found.dictionary
                    if most == 1:
                        if len(known):
                            yield batch(lang, _readable(known), np.bincount(ids, minlength=len(known)))
                        continue
                    hashes = _hashes(lang, known)
                    ok = np.flatnonzero(of_words.holds(hashes))
                    number = np.full(len(known), -1)
                    number[ok] = np.arange(len(ok))
                    ids = number[ids]
                    kept = ids >= 0
                    known, hashes = _readable(known.take(pa.array(ok))), hashes[ok]
                    for chain, f in shard_phrases(ids[kept], place[kept], len(ok), hashes, least, most, of_pairs) if len(ok) else ():
                        yield batch(lang, pc.binary_join_element_wise(*[known.take(pa.array(c)) for c in chain.T], " "), f)

        return add, lambda: iter(())

    rows = fold_texts(docs, text_col, schema, start, extra=[lang_col], chunk_bytes=shard)
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, shard: int = SHARD_BYTES
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of the phrases of 1 to ``longest`` words with ``least`` occurrences or more, and (lang, n),
    all word occurrences of each language. Both lie in the shared folder."""
    words = saved(_counted(docs, text_col, lang_col, 1, 1, None, None, shard), "words")
    totals = saved(words.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    found = words.where(F.col("f") >= least)
    tables = [found.withColumn("size", F.lit(1))]
    if longest > 1:
        known = filter_of(found, 1)
        pairs = saved(_counted(docs, text_col, lang_col, 2, 2, known, None, shard).where(F.col("f") >= least), "pairs")
        tables.append(pairs.withColumn("size", F.lit(2)))
        if longest > 2:
            longer = _counted(docs, text_col, lang_col, 3, longest, known, filter_of(pairs, 2), shard).where(F.col("f") >= least)
            longer = saved(longer.withColumn("size", F.size(F.split("phrase", " "))), "phrases")
            tables.append(longer)
    union = tables[0].select("lang", "phrase", "size", "f")
    for table in tables[1:]:
        union = union.unionByName(table.select("lang", "phrase", "size", "f"))
    return union, totals


def _run(words: str, begin: Column | int, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(words, begin, length))


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n and score of the phrases of two words or more: the cut with the lowest score counts."""
    cuts = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = cuts.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", _run("words", F.lit(1), F.col("k")).alias("first"), _run("words", F.col("k") + 1, F.col("size")).alias("rest"))
    of = phrases.select("lang", F.col("phrase").alias("part"), F.col("f").alias("count"))
    cuts = cuts.join(of.select("lang", F.col("part").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cuts = cuts.join(of.select("lang", F.col("part").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    exact = "CAST(CAST(a AS DECIMAL(18,0)) * CAST(n AS DECIMAL(18,0)) AS DECIMAL(34,0)) * 1000"
    cuts = cuts.withColumn("score", F.expr(f"({exact}) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def absorbed(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, most): the largest count of a longer phrase that holds a phrase of two words or more."""
    words = phrases.where("size > 2").withColumn("words", F.split("phrase", " "))
    words = words.withColumn("length", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    words = words.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)))
    return words.groupBy("lang", _run("words", F.col("begin"), F.col("length")).alias("phrase")).agg(F.max("f").alias("most"))


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int = TOP,
    shard: int = SHARD_BYTES,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``top`` collocations of each language.

    A null text has no words, a null lang is ``und``; repeated documents count again; ties of score go by a, then by the
    phrase's bytes; a very long text is cut where pieces end; an empty table gives no rows; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, text_col=text_col, lang_col=lang_col, least=least, longest=longest, shard=shard)
    kept = scored(phrases, totals).join(absorbed(phrases), ["lang", "phrase"], "left")
    kept = kept.where("most IS NULL OR CAST(most AS DECIMAL(18,0)) * 100 < CAST(a AS DECIMAL(18,0)) * 100")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return kept.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """The same rows in DuckDB's SQL."""
    sizes = range(2, LONGEST + 1)
    grams = " UNION ALL ".join(
        f"SELECT lang, list_aggregate(w[i:i + {k - 1}], 'string_agg', ' ') AS phrase, {k} AS size FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM p WHERE len(w) >= {k})"
        for k in (1, *sizes)
    )
    return rf"""
    WITH s AS (SELECT coalesce(lang, 'und') AS lang,
                      unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
               FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM s),
    g AS ({grams}),
    c AS (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    t AS (SELECT lang, sum(f) AS n FROM c WHERE size = 1 GROUP BY ALL),
    x AS (SELECT *, string_split(phrase, ' ') AS w FROM c WHERE f >= {LEAST}),
    k AS (SELECT lang, phrase, w, f AS a, size, unnest(range(1, size)) AS k FROM x WHERE size > 1),
    u AS (SELECT k.lang, k.phrase, k.a, k.k, l.f AS l, r.f AS r, t.n, (1000 * k.a * t.n) // (l.f * r.f) AS score
          FROM k JOIN c l ON l.lang = k.lang AND l.phrase = list_aggregate(k.w[1:k.k], 'string_agg', ' ')
                 JOIN c r ON r.lang = k.lang AND r.phrase = list_aggregate(k.w[k.k + 1:k.size], 'string_agg', ' ') JOIN t ON t.lang = k.lang),
    b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, w, f, size, len, unnest(range(1, size - len + 2)) AS begin FROM (SELECT *, unnest(range(2, size)) AS len FROM x WHERE size > 2)),
    m AS (SELECT lang, list_aggregate(w[begin:begin + len - 1], 'string_agg', ' ') AS phrase, max(f) AS most FROM i GROUP BY ALL),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank
          FROM b LEFT JOIN m USING (lang, phrase) WHERE m.most IS NULL OR 100 * m.most < 100 * b.a)
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {TOP}
    """
