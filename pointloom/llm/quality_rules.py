"""Line-first quality rules: judge every line, remove failing lines, reject documents that lose too much text.

All of it is Spark SQL expressions over one document, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import SPACES, fresh

#: A document with fewer words fails, as does one with more than this percentage of words in repeated windows.
LEAST_WORDS = 20
MOST_REPEATED = 30
#: Words of a window that counts as repeated when it stands twice in a text.
WINDOW = 8
#: A line fails the punctuation rule if it has more than one mark for so many words, or at least so many words and
#: neither a sign at its end that ends or carries on a sentence nor anything else that explains its end (``_explained``).
WORDS_PER_MARK = 5
LEAST_UNENDED = 4
#: A heading has no more words.
MOST_HEADING = 10
#: A line of so many words or more fails the same rule if over half of them repeat the word before.
LEAST_STUTTER = 8
#: A line fails the navigation rule with at least so many separators, if there is one for every four words.
LEAST_SEPARATORS = 3
#: Rejected if the removed lines hold more than this percentage of the text.
MOST_LOST = 50
SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>]|[!?]{2,}"
ENDS = ".!?…:;,\"'”’»)]}([{-–—。！？、，"
#: A line of nothing but ASCII white space parts blocks of lines.
BLANK = r"[\x20\x09\x0B-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: The mark before a list item or heading is none of the line's marks.
ITEM = r"^[\x20\x09]*(?:[-+*•‣–]|#{1,6}|[0-9]{1,3}[.)]|[A-Za-z][.)])[\x20\x09]+"
#: Program text, whose signs are no symbols unless three stand together; indented lines may end anywhere.
CODE = (
    r"\x20(?:[-+*/%&|^<>=!:]?=|=>|->|&&|\|\||\+)\x20|[;{}][\x20\x09\x0D]*\z"
    r"|^[\x20\x09]*(?:#include\x20|#define\x20|from\x20[A-Za-z0-9_.]+\x20import\x20)"
)
TRIPLE = r"[#*$%&|<>]{3}"
INDENTED = r"^(?:\x20\x20|\x09)"
GOES_ON = r"^[\x20\x09]*\p{Ll}"
HEADING = r"^[\x20\x09]*[\p{Lu}0-9]"
SEPARATORS = r"[|»›•·]"
#: Lines that are nothing but one of these (English, German, Spanish, French) fail the navigation rule.
_NAVIGATION = (
    "home|menu|search|log ?in|sign (in|up)|next|previous|back to top|skip to content|read more|click here|share this",
    "startseite|menü|suche|anmelden|registrieren|weiter|zurück|nach oben|zum inhalt springen|mehr lesen|weiterlesen|teilen",
    "inicio|menú|buscar|iniciar sesión|registrarse|siguiente|anterior|volver arriba|saltar al contenido|leer más|compartir",
    "accueil|rechercher|connexion|se connecter|s'inscrire|suivant|précédent|haut de page|aller au contenu|lire la suite|partager",
)
NAVIGATION = rf"^\s*({'|'.join(_NAVIGATION)})\W*$"
#: Lines that hold one of these fail the boilerplate rule.
BOILERPLATE = "|".join(
    (
        "(enable|requires?) javascript|(uses?|accept) cookies|cookie (policy|settings)|terms of (use|service)|privacy policy|lorem ipsum",
        "javascript aktivieren|verwendet cookies|cookies akzeptieren|cookie-(richtlinie|einstellungen)|nutzungsbedingungen|datenschutzerklärung",
        "(activ|habilit)(ar|e|a) javascript|utiliza(mos)? cookies|aceptar (las )?cookies|política de (cookies|privacidad)|términos de uso|aviso legal",
        "activer javascript|utilis(e|ons) des cookies|accepter les cookies|politique de (confidentialité|cookies)|conditions d'utilisation|mentions légales",
    )
)

#: One of these stands in each boilerplate phrase.
_BOILERPLATE_WORDS = (
    "javascript", "cookie", "terms of", "privacy policy", "lorem ipsum", "nutzungsbedingungen", "datenschutz",
    "política de", "términos de", "aviso legal", "politique de", "conditions d", "mentions légales",
)


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also inside the lambdas of ``use``."""
    return F.transform(F.array(value), lambda v: use(v))[0]


def word_array(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def line_array(text: Column) -> Column:
    r"""The ``\n``-split lines that have a word; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _count(text: Column, pattern: str) -> Column:
    """Characters of a one-character pattern."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` (a power of two) words that stand in the text twice or more, the first one
    included."""

    def covered(at: Column) -> Column:
        """Words under windows at sorted starts."""
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
        step = lambda acc, s: F.struct(
            (acc["n"] + (s + window - F.greatest(s, acc["to"]))).alias("n"), (s + window).alias("to")
        )
        return F.aggregate(at, zero, step, lambda acc: acc["n"])

    def twice(rows: Column) -> Column:
        """Starts of the rows (key, start), sorted by key, whose key a neighbour shares."""
        same = lambda x, i: (
            ((i > 0) & F.get(rows, i - 1)["k"].eqNullSafe(x["k"])) | F.get(rows, i + 1)["k"].eqNullSafe(x["k"])
        )
        return F.transform(F.filter(rows, same), lambda x: x["s"])

    def from_hashes(hashes: Column) -> Column:
        rows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("k"), i.alias("s"))))
        by_hash = _bound(rows, twice)
        texts = F.transform(
            by_hash, lambda s: F.struct(F.array_join(F.slice(words, s + 1, window), " ").alias("k"), s.alias("s"))
        )
        at = F.sort_array(_bound(F.sort_array(texts), twice))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(covered(at))

    # each word is hashed once; windows of 2, 4 and 8 words are hashed from those of half the size
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    for size in [1 << k for k in range(window.bit_length() - 1)]:
        hashed = _bound(hashed, lambda h, size=size: F.zip_with(h, F.slice(h, size + 1, F.size(words)), lambda a, b: F.xxhash64(a, b)))
    hashed = F.slice(hashed, 1, F.size(words) - window + 1)
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(_bound(hashed, from_hashes))


def has_boilerplate(text: Column) -> Column:
    """Whether a boilerplate phrase stands in the text; a plain search for one word of each comes first."""
    held = lambda low: reduce(or_, [low.contains(w) for w in _BOILERPLATE_WORDS]) & low.rlike(BOILERPLATE)
    return _bound(F.lower(text), held)


def line_rows(text: Column) -> Column:
    r"""All ``\n``-split lines in order as (l, e): the line and whether its block of lines ends with a sign of ``ENDS``."""
    blocks = F.split(text, rf"\n(?={BLANK}*(?:\n|\z))")
    rows = lambda b, e: F.transform(F.split(b, "\n"), lambda x: F.struct(x.alias("l"), e.alias("e")))
    return F.flatten(F.transform(blocks, lambda b: _bound(_ended(b), lambda e: rows(b, e))))


def _ended(text: Column) -> Column:
    return F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1)).isin(*ENDS)


def _explained(rows: Column, i: Column, n_words: Column) -> Column:
    """Whether a line without a sign at its end may have none: its block ends with one (wrapped prose, verse), the next
    line goes on in lower case, it is a list item, program text or indented, or it stands alone above a block that ends with a sign (a heading)."""
    row, following, after = (F.get(rows, i + k) for k in range(3))
    first = (i == 0) | ~F.get(rows, i - 1)["l"].rlike(WORD)
    heads = (n_words <= MOST_HEADING) & row["l"].rlike(HEADING) & first & ~following["l"].rlike(WORD) & after["l"].rlike(WORD) & after["e"]
    goes_on = following["l"].rlike(GOES_ON)
    return row["e"] | F.coalesce(goes_on, F.lit(False)) | row["l"].rlike(f"{ITEM}|{CODE}|{INDENTED}") | F.coalesce(heads, F.lit(False))


def line_fails(rows: Column, i: Column, boilerplate: Column) -> Column:
    """True for line ``i`` of ``line_rows`` if the punctuation, navigation or boilerplate rule removes it; a blank line stays.

    ``boilerplate``: whether the line's text holds any boilerplate, so that most texts are searched once for it.
    """
    line = F.get(rows, i)["l"]

    def fails(words: Column) -> Column:
        n_words = F.size(words)
        marked = lambda x: F.regexp_count(x, F.lit(MARKS)) * WORDS_PER_MARK > n_words
        separators = _count(line, SEPARATORS)
        again = F.size(F.filter(words, lambda w, k: (k > 0) & (w == F.get(words, k - 1))))
        return (
            (marked(line) & marked(F.regexp_replace(line, ITEM, "")) & (~line.rlike(CODE) | line.rlike(TRIPLE)))
            | ((n_words >= LEAST_UNENDED) & ~_ended(line) & ~_explained(rows, i, n_words))
            | ((n_words >= LEAST_STUTTER) & (again * 2 > n_words))
            | ((separators >= LEAST_SEPARATORS) & (separators * 4 >= n_words))
            | F.lower(line).rlike(NAVIGATION)
            | (boilerplate & has_boilerplate(line))
        )

    return line.rlike(WORD) & _bound(F.split(F.trim(line), SPACES), fails)


def cleaned(text: Column) -> Column:
    r"""The text without the ``\n``-split lines that fail; unchanged if none does, null if it is null."""
    left = lambda rows: F.filter(rows, lambda x, i: ~line_fails(rows, i, F.lit(True)))
    return F.array_join(F.transform(_bound(line_rows(text), left), lambda x: x["l"]), "\n")


def measures(docs: DataFrame, *, keep: Sequence[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` and the figures and verdicts of each text; ``prefix`` names them apart from other columns.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars and line_chars (characters of
    removed and of all lines with a word), kept. A null text has no words and fails as too short.
    """
    names = [fresh([*docs.columns, "kept"], x) for x in ("words__", "lines__", "text__")]
    words, lines, text = names
    rows = fresh([*docs.columns, "kept"], "rows__")
    out = {x: prefix + x for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "line_chars", "kept")}
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    df = df.withColumns({words: word_array(F.col(text)), lines: line_array(F.col(text)), rows: line_rows(F.col(text))})
    zero = F.lit(0).cast("long")
    # both bound, so that they are not worked out again for each line, also where a filter takes in what they stand for
    lost = _bound(
        F.struct(F.col(rows).alias("r"), has_boilerplate(F.col(text)).alias("b")),
        lambda v: F.aggregate(
            F.transform(v["r"], lambda x, i: F.when(line_fails(v["r"], i, v["b"]), F.length(x["l"])).otherwise(0)), zero, lambda a, n: a + n
        ),
    )
    df = df.select(
        *[F.col(f"`{c}`") for c in keep],
        F.size(words).cast("long").alias(out["n_words"]),
        F.length(F.array_join(words, "")).cast("long").alias(out["word_chars"]),
        _count(F.col(text), SYMBOLS).alias(out["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(out["n_dup_lines"]),
        _bound(F.col(words), lambda w: repeated_words(w)).alias(out["n_repeat_words"]),
        lost.alias(out["lost_chars"]),
        F.aggregate(lines, zero, lambda a, x: a + F.length(x)).alias(out["line_chars"]),
    )
    n, repeats = F.col(out["n_words"]), F.col(out["n_repeat_words"])
    df = df.withColumn(out["base_failed"], (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n))
    clean = 100 * F.col(out["lost_chars"]) <= MOST_LOST * F.col(out["line_chars"])
    return df.withColumn(out["kept"], ~F.col(out["base_failed"]) & clean)


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered result: id, the base figures, base_failed and kept. A null or empty text has no words and fails."""
    found = measures(docs.select(id_col, text_col), keep=[id_col], text_col=text_col)
    return found.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_good(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, without their failing lines; the other columns are unchanged.

    Null and empty texts have too few words and go.
    """
    prefix = fresh([c[: len("q__")] for c in docs.columns], "q__")
    found = measures(docs, keep=docs.columns, text_col=text_col, prefix=prefix)
    text = F.col(f"`{text_col}`")
    left = F.when(F.col(prefix + "lost_chars") > 0, cleaned(text)).otherwise(text)
    # no filter: it would move below the figures and work them out once more
    one = F.when(F.col(prefix + "kept"), F.array(left)).otherwise(F.array().cast("array<string>"))
    name = fresh([*docs.columns, *found.columns], "left__")
    kept = found.select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.explode(one).alias(name))
    return kept.select(*[F.col(name).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


#: DuckDB SQL of ``judged`` over ``{docs}``; doc_id is taken to be unique.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
word AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
eight AS (SELECT doc_id, n, p, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS win
          FROM word),
wins AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM eight WHERE p + 7 <= n),
twice AS (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM wins WHERE n > 1),
cover AS (SELECT doc_id, sum(least(8, coalesce(q - p, 8))) AS n_repeat_words FROM twice GROUP BY doc_id),
every AS (SELECT doc_id, l, i, regexp_matches(l, '{word}') AS has, regexp_matches(l, '{ended}') AS fin
          FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d))),
block AS (SELECT *, sum((NOT has)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM every),
flow AS (SELECT *, coalesce(max(i) FILTER (has AND fin) OVER (PARTITION BY doc_id, b) = max(i) FILTER (has) OVER (PARTITION BY doc_id, b), false) AS e FROM block),
lines AS (SELECT *, lead(l) OVER t AS following, coalesce(lag(has) OVER t, false) OR lead(has) OVER t AS near_has, lead(has AND e, 2) OVER t AS after_ends
          FROM flow WINDOW t AS (PARTITION BY doc_id ORDER BY i)),
marks AS (SELECT doc_id, l, length(l) AS n, len(ws) AS nw,
            len(list_filter(ws, lambda x, k: k > 1 AND x = ws[k - 1])) AS again,
            least(len(regexp_extract_all(l, '{marks}')), len(regexp_extract_all(regexp_replace(l, '{item}', ''), '{marks}'))) AS nm,
            regexp_matches(l, '{code}') AND NOT regexp_matches(l, '{triple}') AS code,
            length(l) - length(regexp_replace(l, '[|»›•·]', '', 'g')) AS ns,
            NOT fin AND NOT e AND NOT coalesce(regexp_matches(following, '{goes_on}'), false) AND NOT regexp_matches(l, '{item}|{code}|{indented}') AS unended,
            regexp_matches(l, '{heading}') AND coalesce(NOT near_has AND after_ends, false) AS heads,
            regexp_matches(lower(l), '{navigation}') OR regexp_matches(lower(l), '{boilerplate}') AS chrome
          FROM (SELECT *, regexp_split_to_array(trim(l, ' '), '[\x20\x09-\x0D]+') AS ws FROM lines WHERE has)),
loss AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, sum(n) AS line_chars,
            coalesce(sum(n) FILTER ((nm * 5 > nw AND NOT code) OR (nw >= 4 AND unended AND NOT (heads AND nw <= {most_heading}))
              OR (nw >= {stutter} AND again * 2 > nw) OR (ns >= 3 AND ns * 4 >= nw) OR chrome), 0) AS lost_chars
         FROM marks GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
            (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
            coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
            coalesce(100 * lost_chars <= 50 * line_chars, true) AS clean
      FROM w LEFT JOIN cover USING (doc_id) LEFT JOIN loss USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND clean AS kept
FROM f
"""


def sql(docs: str = "documents") -> str:
    signs = "".join("\\" + c if c in r"[]-^" else c for c in ENDS)
    patterns = {
        "word": WORD, "ended": rf"[{signs}][\x20\x09-\x0D]*\z", "marks": MARKS, "item": ITEM, "code": CODE, "triple": TRIPLE, "indented": INDENTED,
        "goes_on": GOES_ON, "heading": HEADING, "navigation": NAVIGATION, "boilerplate": BOILERPLATE,
    }
    return SQL.format(docs=docs, most_heading=MOST_HEADING, stutter=LEAST_STUTTER, **{k: x.replace("'", "''") for k, x in patterns.items()})
