import re
from collections import Counter

import duckdb
import pytest

from pointloom.llm.quality_rules import judged, keep_good, sql

LINE = "Plain words make up this line and it ends well. "
ROWS = [
    (1, LINE * 3),
    (2, (LINE + "\n") * 4),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\x0c\r "),
    (6, "\n".join(f"a{k} b{k} c{k} d{k} e{k} f{k}." for k in range(10))),
    (7, "\n".join(f"w{k}!! x{k}!! y{k}*** z{k}###" for k in range(10))),
    (8, " | ".join(f"item{k}" for k in range(40))),
    (9, "Sign in\n" + "\n".join(f"good{k} line{k} with{k} words{k}." for k in range(9))),
    (10, "same " * 5000),
    (11, " ".join(f"u{k}" for k in range(30)) + " " + " ".join(f"u{k}" for k in range(9))),
    (12, "é ü " * 4 + "\u0085 " + " ".join(f"n{k}" for k in range(30)) + "."),
    (14, " ".join(f"n{k}" for k in range(30))),
    (15, "Dies ist ein Satz. " * 2 + " ".join(f"n{k}" for k in range(30)) + ".\nWeiterlesen\nMentions légales et autres"),
    (16, "Please accept cookies " + " ".join(f"long{k}" for k in range(150)) + "."),
    (17, "Please accept cookies " + " ".join(f"short{k}" for k in range(18)) + "."),
    (13, "x" * 100000),
    (21, "\n".join(["They walked along the old road in the", "morning while the others slept in their", "tents and nobody said a word until they", "came back."] * 1) + " " + " ".join(f"m{k}" for k in range(9)) + "."),
    (18, "menu of all our pages\nproducts and services for you\nContact us by phone today\nCompany news and press releases\nMore from us this week"),
    (19, "# A Heading of Many Words\n\n* first item of the list\n* second item of the list\n\n1. third item of the list\n \n\tindented text has no end"),
    (22, "It begins well enough.\n" + "one one one one one two two two two two three three three\n" * 2 + "And it ends as well.\nx = 1 a*** b c d e\nx = y && z"),
    (20, "A Title Above Some Text\n\nIt goes on here\nand there, as texts do.\r\n\r\nNo Title Above The Void\n\n\nIt has no end at all\n"),
]


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    marks = len(re.findall(r"[#*$%&|<>]", text))
    return (len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), len(hit), failed)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [*ROWS, ROWS[0], (None, LINE * 3)]
    return spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, n_words int, kept string")


def test_base_figures_equal_brute_force(docs):
    texts = dict(ROWS) | {None: LINE * 3}
    got = judged(docs).collect()
    assert len(got) == len(ROWS) + 2
    for r in got:
        assert tuple(r)[1:7] == base(texts[r.doc_id]), r.doc_id


def test_line_rules(docs):
    kept = {r.doc_id: r.kept for r in judged(docs).collect()}
    assert kept[6] and kept[9] and kept[12] and kept[15] and not kept[7] and not kept[8] and not kept[11]
    assert not kept[18] and not kept[22]
    assert not kept[14] and not kept[16] and not kept[17]  # no end of a sentence; boilerplate in lines of any length


def test_filter_keeps_columns(docs):
    left = keep_good(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in judged(docs).collect() if r.kept}


def test_no_filter_works_the_lines_out_again(docs, capsys):
    """A filter on the verdict would move below the columns it needs, and split the text once for each line."""
    keep_good(docs).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    assert "Filter" not in plan and "Generate" in plan


def test_no_python_and_no_shuffle(docs, capsys):
    judged(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_equals_sql(spark, docs):
    frame = docs.dropDuplicates(["doc_id"]).where("doc_id is not null")
    con = duckdb.connect()
    con.register("documents", frame.select("doc_id", "text").toPandas())
    out = con.sql(sql()).fetchall()
    assert sorted(out) == sorted(tuple(r) for r in judged(frame).collect())


def test_empty_table(docs):
    assert judged(docs.limit(0)).count() == 0


def test_failing_lines_are_removed(spark):
    good = [f"good{k} line{k} with{k} words{k}." for k in range(9)]
    mixed = ["Sign in", *good[:4], "", "home | menu | search | help", *good[4:], "We use cookies", ""]
    plain = "\n" + "\n \n".join(good) + "\r\n\n"
    docs = spark.createDataFrame([(1, "\n".join(mixed), "a"), (2, plain, "b")], "doc_id long, text string, source string")
    left = {r.doc_id: r.text for r in keep_good(docs).collect()}
    assert left == {1: "\n".join([*good[:4], "", *good[4:], ""]), 2: plain}


WRAPPED = """The committee met on the first day of the
month and talked about the new bridge across
the river, which had been planned for
several years without any result."""
VERSE = """We wandered down the silver shore
And heard the water's hollow call
A song that none had sung before
And none remembered after all."""
CODE = """def total(rows, price):
    found = [r for r in rows if r]
    if not found and price < 3:
        return price or None
    amount = price + len(found) * price
    return amount"""
LISTS = """How To Bake A Plain Bread

Mix the flour with water and wait an hour.

- two cups of plain flour
- one cup of warm water
* a spoon of salt or less

1. knead the dough for ten minutes
2. bake it until it is brown"""


@pytest.mark.parametrize("text", [WRAPPED, VERSE, CODE, LISTS, WRAPPED.replace("\n", "\r\n"), f"{WRAPPED}\n\n{VERSE}\n\n{CODE}\n"])
def test_good_lines_without_a_stop_stay(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.text for r in keep_good(docs).collect()] == [text]


def test_menus_still_go(spark):
    menu = "Products and services for you\nContact us by phone today\nCompany news and press releases"
    docs = spark.createDataFrame([(1, f"{menu}\n\n{WRAPPED}"), (2, f"{menu}\n\n\n{menu}\nMore pages of ours to see")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in keep_good(docs).collect()] == [(1, f"\n{WRAPPED}")]
