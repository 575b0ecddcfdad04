"""Source divergence audit: which terms set a source apart from its language, and how far sources lie from each other.

Plain relations: matches are exploded and counted, the groups of a language cross its kept vocabulary so that absent
terms count zero, and a join of that table with itself on language and term compares the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pointloom.llm.common import lower_az, saved

#: A term: letters and all characters beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a language that hold a kept term, at least; parts that shares are counted in; terms reported of a source.
LEAST_DOCUMENTS, PARTS, TOP_TERMS = 10, 1_000_000_000, 10
#: Shares of a language's vocabulary that meet its groups apart from each other, so that no language is one task's.
SALTS = 512


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with the term).

    Each document gives two lists, all of its terms and each of them once, and one grouping counts both. Repeated
    documents count again. Null text, lang and source are empty ones.
    """
    terms = F.regexp_extract_all(lower_az(_text(text_col)), F.lit(TERM), F.lit(0))
    rows = docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source"), terms.alias("terms"))
    every = F.struct(F.lit(0).cast("long").alias("once"), F.col("terms").alias("list"))
    each = F.struct(F.lit(1).cast("long").alias("once"), F.array_distinct("terms").alias("list"))
    rows = rows.select("lang", "source", F.inline(F.array(every, each))).select("lang", "source", "once", F.explode("list").alias("term"))
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").alias("docs"))


def kept_terms(counts: DataFrame, least: int) -> DataFrame:
    """lang, term and total (occurrences in the language) of the terms that enough documents of the language hold."""
    terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
    return terms.where(F.col("docs") >= least).select("lang", "term", "total")


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(PARTS * (count + 2) / (total + 2 * size)), in exact decimals."""
    return F.expr(
        f"1 + (CAST({count} + 2 AS DECIMAL(20,0)) * CAST({PARTS} AS DECIMAL(10,0))) div CAST({total} + 2 * {size} AS DECIMAL(20,0))"
    )


def _apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most PARTS + 1, so that the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def dense_shares(groups: DataFrame, counts: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, term, n, p (the group's share) and q (the language's) of every group and each kept term.

    ``groups``: lang and source of all groups. A language's vocabulary is dealt out by a hash of the term, and its groups
    go to each part of it, so the crossing is an equi-join whose parts are of one size.
    """
    kept = counts.join(terms, ["lang", "term"]).select("lang", "source", "term", "n")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("size"), F.sum("total").alias("lang_total"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    # where a language keeps no term there is nothing to cross
    groups = groups.join(of_lang, "lang").join(of_group, ["lang", "source"], "left").fillna(0, ["group_total"])
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = terms.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int"))
    dense = salted.join(groups, ["lang", "salt"]).join(kept, ["lang", "source", "term"], "left").fillna(0, ["n"])
    return dense.select("lang", "source", "term", "n", _share("n", "group_total", "size").alias("p"), _share("total", "lang_total", "size").alias("q"))


def divergence(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part ``pair``: the distance of a source to each other source of the language, summed over the kept terms (0 if none
    is kept). Part ``term``: the terms that a source has more often than its language, the ``top`` farthest. Ties go by
    the item's bytes. Null text, lang and source are empty ones; a source without terms counts zero of each; an empty
    table gives no rows; other columns are not read. Very long texts are exploded like any other, row by row.
    """
    counts = saved(term_counts(docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "terms")
    terms = saved(kept_terms(counts, least), "vocabulary")
    groups = saved(docs.select(_text(lang_col).alias("lang"), _text(source_col).alias("source")).distinct(), "groups")
    dense = saved(dense_shares(groups, counts, terms), "shares")

    sides = dense.select("lang", "term", "source", "p")
    left, right = sides.withColumnRenamed("source", "a"), sides.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"))
    sums = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(_apart("p", "q")).alias("value"))
    pairs = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").fillna(0, ["value"])
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]
    both = pairs.select("lang", F.inline(F.array(*ways)), "value")

    own = dense.where("n > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    both = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    own = own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return both.unionByName(own.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def sql() -> str:
    """The same rows in DuckDB's SQL."""
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS list
               FROM documents),
    w AS (SELECT i, lang, source, unnest(list) AS term FROM d),
    c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT i) AS docs FROM w GROUP BY ALL),
    v AS (SELECT lang, term, sum(n) AS total FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCUMENTS}),
    l AS (SELECT lang, count(*) AS size, sum(total) AS lang_total FROM v GROUP BY ALL),
    k AS (SELECT c.* FROM c JOIN v USING (lang, term)),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS group_total FROM g LEFT JOIN k USING (lang, source) GROUP BY ALL),
    s AS (SELECT t.lang, t.source, v.term, coalesce(k.n, 0) AS n,
                 1 + ({PARTS}::HUGEINT * (coalesce(k.n, 0) + 2)) // (t.group_total + 2 * l.size) AS p,
                 1 + ({PARTS}::HUGEINT * (v.total + 2)) // (l.lang_total + 2 * l.size) AS q
          FROM t JOIN v USING (lang) JOIN l USING (lang) LEFT JOIN k ON k.lang = t.lang AND k.source = t.source AND k.term = v.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
    own AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM s WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
          FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
    """
