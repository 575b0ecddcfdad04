"""Secret scans: plain patterns, and credentials in parts that are linked when complementary parts stand close by.

Everything is Spark SQL expressions over one document; nothing is shuffled. The scope of a link is a paragraph (text
without a blank line). The begins and ends of a document's parts (access identifiers, secrets, endpoints) and its blank
lines are sorted by position and joined by interval in two sweeps, forwards and backwards: a sort-merge join that keeps
the last end of each role within the scope, so that no pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import fresh

#: Most code points between parts of one credential.
REACH = 200
#: Spans found in one text are gathered in blocks of this many.
_BLOCK = 256
_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
_SIGN = "[A-Za-z0-9+/_.=!-]"
#: What tells a weak secret from a word: a letter with a digit or exclamation mark, quotes, or a password after a bare "=".
_EVIDENCE = (
    rf"""(?:(?=[A-Za-z+/_.=-]*[0-9!])(?=[0-9+/_.=!-]*[A-Za-z])|(?<=["'])(?={_SIGN}+["'])|(?<=(?:pwd|pass|PWD|PASS)=))"""
)
SPAN = "array<struct<s:int,e:int,k:int>>"


@dataclass(frozen=True)
class Kind:
    """A pattern; ``least``: characters of its group 2 that a match needs; ``role``: the part of a credential it is.

    ``weak``: reported only with a complement close by; ``whole``: holds complementary parts itself."""

    name: str
    pattern: str
    role: str
    least: int = 0
    weak: bool = False
    whole: bool = False


KINDS = (
    Kind("assign", rf"((?i:password|passwd|secret|token|api_?key)){_VALUE}([A-Za-z0-9+/_.=-]+)", "secret", least=6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", "identifier"),
    Kind("hex", r"[0-9a-f]{24,}", "secret"),
    Kind(
        "link_id",
        rf"(?<![A-Za-z])((?i:user_?name|user_?id|user|login|account|client_?id|access_?key_?id)){_VALUE}([A-Za-z0-9._@-]{{2,}}[A-Za-z0-9_@-])",
        "identifier",
        weak=True,
    ),
    Kind("link_secret", rf"(?<![A-Za-z])((?i:pwd|pass|private_?key|credentials?|auth)){_VALUE}({_EVIDENCE}{_SIGN}{{5,}}[A-Za-z0-9+/_=!-])", "secret", weak=True),
    Kind(
        "link_key",
        # neither in nor at the begin of a URL, nor a path, nor a name of many words: random letters change their case often
        r"(?<![A-Za-z0-9+/=._%~?&#@-])(?!//)(?!/?(?:[A-Za-z]+/){3})(?!(?:[A-Za-z0-9+]*/){4})"
        r"(?=(?:[A-Z0-9]*+[a-z+/]++){4})(?=(?:[A-Za-z+/]*+[0-9]++){2})(?=[0-9+/a-z]*[A-Z])"
        r"[A-Za-z0-9+/]{40,}+={0,2}+(?![:.])",
        "secret",
        weak=True,
    ),
    Kind("link_url", r"(?<=://)[^\x20\x09-\x0D\x22\x27<>/:@?#]+:[^\x20\x09-\x0D\x22\x27<>/@]+(?=@[A-Za-z0-9])", "secret", whole=True),
    Kind("endpoint", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\x20\x09-\x0D\x22\x27<>]+", "endpoint"),
)
#: What a weak part of a role needs close by: one of these roles.
COMPLEMENTS = {"secret": ("identifier", "endpoint"), "identifier": ("secret",)}
BASE = ("assign", "access", "hex")
#: What lies between two scopes.
BLANK_LINE = r"\n[\x20\x09\x0D]*\n"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), lambda v: use(v))[0]


def _none() -> Column:
    return F.array().cast(SPAN)


def _spans(text: Column, number: int, kind: Kind) -> Column:
    """The kind's spans (start, end exclusive, kind number) in code points, leftmost and without overlap, in order."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(2)) if kind.least else found
    sizes = F.zip_with(
        F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(value, F.length).alias("v")),
        F.split(text, kind.pattern),
        # one gap more than matches: the last has no match
        lambda m, gap: F.struct(F.length(gap).alias("gap"), m["n"].alias("n"), m["v"].alias("v")),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("done"), _none().alias("now"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.coalesce(m["n"], F.lit(0))
        span = F.array(F.struct(start.alias("s"), end.alias("e"), F.lit(number).alias("k")))
        now = F.when(m["v"] >= kind.least, F.concat(acc["now"], span)).otherwise(acc["now"])
        full = F.size(acc["now"]) >= _BLOCK
        return F.struct(
            end.alias("at"),
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.slice(now, _BLOCK + 1, F.greatest(F.size(now) - _BLOCK, F.lit(0)))).otherwise(now).alias("now"),
        )

    whole = F.aggregate(sizes, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))
    hint = text.contains("=") | text.contains(":") if _VALUE in kind.pattern or "://" in kind.pattern else F.lit(True)
    return F.when(hint & text.rlike(kind.pattern), whole).otherwise(_none())


def _events(parts: Column, breaks: Column, backwards: bool) -> Column:
    """Ends (0), scope ends (1) and begins (2) of the parts as seen by a sweep, sorted by place."""
    first, last = ("e", "s") if backwards else ("s", "e")
    at = lambda x, side: -x[side] if backwards else x[side]
    event = lambda place, what, x: F.struct(place.alias("p"), F.lit(what).alias("w"), x.alias("x"))
    ends = F.transform(parts, lambda x: event(at(x, last), 0, x))
    begins = F.transform(parts, lambda x: event(at(x, first), 2, x))
    return F.sort_array(F.concat(ends, F.transform(breaks, lambda x: event(at(x, first), 1, x)), begins))


def _sweep(events: Column, backwards: bool) -> Column:
    """The weak parts, as spans, before whose begin a complement ends in the same scope, at most ``REACH`` away.

    Backwards, places are negative and begin and end change sides. A part that overlaps another is no complement of it.
    """
    far = F.lit(-(1 << 30))
    roles = ("identifier", "secret", "endpoint")
    names = {r: [k for k, x in enumerate(KINDS) if x.role == r] for r in roles}
    weak = {r: [k for k, x in enumerate(KINDS) if x.role == r and x.weak] for r in COMPLEMENTS}
    zero = F.struct(*[far.alias(r) for r in roles], F.array().cast(f"array<{SPAN}>").alias("done"), _none().alias("now"))

    def step(acc: Column, e: Column) -> Column:
        x = e["x"]
        linked = F.lit(False)
        for role, others in COMPLEMENTS.items():
            near = F.lit(False)
            for other in others:
                near |= e["p"] - acc[other] <= REACH
            linked |= x["k"].isin(weak[role]) & near
        linked &= e["w"] == 2
        new = lambda r: F.when(e["w"] == 1, far).when((e["w"] == 0) & x["k"].isin(names[r]), e["p"]).otherwise(acc[r])
        full = F.size(acc["now"]) >= _BLOCK
        now = F.when(full, _none()).otherwise(acc["now"])
        return F.struct(
            *[new(r).alias(r) for r in roles],
            F.when(full, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"),
            F.when(linked, F.concat(now, F.array(x))).otherwise(now).alias("now"),
        )

    return F.aggregate(events, zero, step, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["now"]))))


def _linked(parts: Column, text: Column) -> Column:
    weak = [k for k, x in enumerate(KINDS) if x.weak]
    breaks = _spans(text, len(KINDS), Kind("blank", BLANK_LINE, "scope"))
    both = F.array_union(*[_sweep(_events(parts, breaks, back), back) for back in (False, True)])
    return F.when(F.exists(parts, lambda x: x["k"].isin(weak)) & (F.size(parts) > 1), both).otherwise(_none())


def find_secrets(
    docs: DataFrame, *, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("base", "spans")
) -> DataFrame:
    """Columns ``keep`` and two arrays of spans (s, e, k): the plain kinds', and those with the linked weak parts.

    Spans are in code points, the end exclusive, k the number in ``KINDS``, sorted by start, then kind. A null text is
    empty. Weak parts (user names, short passwords, random keys) are in ``spans`` only with a complementary part at
    most ``REACH`` code points away in the same paragraph that does not overlap them; endpoints are parts, never secrets.
    User and password within a URL are all three parts in one place.
    """
    taken = [*docs.columns, *names]
    text, parts = fresh(taken, "text__"), fresh(taken, "parts__")
    base, spans = names
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(text))
    plain = [k for k, x in enumerate(KINDS) if x.name in BASE]
    df = df.withColumn(parts, F.concat(*[_spans(F.col(text), k, x) for k, x in enumerate(KINDS)]))
    df = df.withColumn(base, F.sort_array(F.filter(parts, lambda x: x["k"].isin(plain))))
    whole = F.filter(parts, lambda x: x["k"].isin([k for k, x in enumerate(KINDS) if x.whole]))
    return df.select(
        *[F.col(f"`{c}`") for c in keep], base, F.sort_array(F.concat(base, whole, _once(F.col(parts), lambda p: _linked(p, F.col(text))))).alias(spans)
    )


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(x.name) for x in KINDS])
    rows = F.sort_array(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.array_join(
        F.transform(rows, lambda x: F.concat_ws(":", F.get(name, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ","
    )


def _n(spans: Column, kind: str) -> Column:
    number = [x.name for x in KINDS].index(kind)
    return F.size(F.filter(spans, lambda x: x["k"] == number)).cast("long")


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_assign, n_access, n_hex, base_sha256 and the spans as text. A null or empty text has none."""
    found = find_secrets(docs.select(id_col, text_col), keep=[id_col], text_col=text_col)
    base = F.col("base")
    return found.select(
        id_col,
        *[_n(base, k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


def redacted(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """All documents, each run of overlapping spans replaced by ``mark``; other columns and clean texts (null and
    empty ones too) unchanged."""
    names = tuple(fresh(docs.columns, x) for x in ("base__", "spans__"))
    found = find_secrets(docs, keep=docs.columns, text_col=text_col, names=names)
    text = F.col(f"`{text_col}`")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], gap, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    clean = F.when(F.size(names[1]) == 0, text).otherwise(F.aggregate(names[1], zero, step, rest))
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
