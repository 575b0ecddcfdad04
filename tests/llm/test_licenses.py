import re

import pytest

from pointloom.llm.licenses import PHRASES, TEMPLATES, scan_licenses

ROWS = [
    (1, "Released under the MIT License. mit-license, MIT\nlicense cc by cc by"),
    (2, None),
    (3, ""),
    (4, "GNU General Public License é GNU general public\tlicense apache license"),
    (5, "intro words " * 9 + TEMPLATES[7][1].upper() + " and an outro " * 20),
    (6, "permit license mitlicense ccby cc é by MİT license"),
    (7, "mit " * 3000 + "license"),
    (8, "x " * 100 + TEMPLATES[0][1] + " y" * 100),
    (9, "permission granted hereby charge of free any person software"),
    (10, "nothing to see in these plain words"),
    (11, "Licensed under CC BY-NC 4.0."),
]


def base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    spots = [i for i, _ in at]
    return (len(words), len(at), min(spots, default=None), max(spots, default=None), ",".join(sorted({x for _, x in at})))


@pytest.fixture(scope="module")
def got(spark):
    rows = [*ROWS, ROWS[0], (None, ROWS[0][1])]
    docs = spark.createDataFrame([(*r, 3, "w") for r in rows], "doc_id long, text string, n_words int, words string")
    return scan_licenses(docs)


def test_base_equals_brute_force(got):
    texts = dict(ROWS) | {None: ROWS[0][1]}
    rows = got.collect()
    assert len(rows) == len(ROWS) + 2
    for r in rows:
        assert tuple(r)[1:6] == base(texts[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_index_finds_templates_and_verifies_phrases(got):
    labels = {r.doc_id: r.labels for r in got.collect()}
    assert labels[5] == "bsd" and labels[8] == "mit" and labels[9] == labels[10] == "" and labels[11] == "cc-by,cc-by-nc"


def test_native(got, capsys):
    got.explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_notice_of_a_file_is_found(spark):
    plain = [(k, f"plain{k} text of the work") for k in range(20)]
    docs = spark.createDataFrame([*plain, (100, " . ".join(n for _, n, _ in TEMPLATES))], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in scan_licenses(docs).collect()}
    assert labels[100] == ",".join(sorted({x for x, _, _ in TEMPLATES}))


PRECISE = [
    ("Licensed under the Creative Commons Attribution-ShareAlike license.", "cc-by-sa"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("Text under a Creative Commons Attribution 4.0 International License; pictures licensed under the Creative Commons Attribution ShareAlike license.", "cc-by,cc-by-sa"),
    ("// SPDX-License-Identifier: BSD-3-Clause", "bsd"),
    ("# SPDX-License-Identifier: MIT", "mit"),
    ("/* SPDX-License-Identifier: GPL-2.0-only */ then /* SPDX-License-Identifier: MIT */", "gpl,mit"),
    ("made available under the terms of the Eclipse Public License v2.0", "epl"),
    ("The committee may grant a license to use the hall without a fee, and all members have rights to it.", ""),
    ("A public license of this kind is free; the terms of the agreement are under review.", ""),
    ("Permission was granted free of charge to visitors.", ""),
]


def test_one_label_a_place(spark):
    plain = [(100 + k, f"plain{k} text of the work in use") for k in range(20)]
    docs = spark.createDataFrame([*plain, *[(k, t) for k, (t, _) in enumerate(PRECISE)]], "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in scan_licenses(docs).collect()}
    assert [labels[k] for k in range(len(PRECISE))] == [x for _, x in PRECISE]
