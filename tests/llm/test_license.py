"""Licence scans against ungated rules and a plain count of the base phrases."""

import re

import pytest

from swatchbook.llm import license_rules, license_scan, queries
from swatchbook.llm.license_rules import HINT, NAME, VERSIONED, Rule

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner(license_rules.rules())


def kept(scanner, text):
    words = license_scan.words_of(text.encode())
    return [scanner.rules[n].label for _, _, n, gone in scanner.scan(words) if not gone]


@pytest.mark.parametrize(
    "text, labels",
    [
        ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["cc-by-nc-4.0"]),
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the Apache License, Version 2.0.", ["apache-2.0"]),
        ("// SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2.0-or-later"]),
        ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
        ("the GNU Lesser General Public License v2.1", ["lgpl-2.1"]),
        ("GNU Library General Public Licence", ["lgpl"]),
        ("http://www.apache.org/licenses/LICENSE-2.0", ["apache-2.0"]),
        ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
        ("Creative Commons Attribution-ShareAlike 4.0 International", ["cc-by-sa-4.0"]),
        ("dual licensed: MIT License or Apache License 2.0", ["mit", "apache-2.0"]),
        ("Apache License 2.01 beta", ["apache"]),
        ("mit freundlichen Grüßen, die Lizenz liegt bei", []),
        ("Copyright (c) 2020 Somebody. ALL RIGHTS RESERVED", ["copyright", "reserved"]),
    ],
)
def test_labels(scanner, text, labels):
    assert kept(scanner, text) == labels


def test_hundreds_of_rules_and_all_gated(scanner):
    assert len(scanner.rules) > 300 and not scanner.always
    assert len({r.name for r in scanner.rules}) == len(scanner.rules)
    assert [r.priority for r in scanner.rules] == sorted(r.priority for r in scanner.rules)


def test_keywords_lose_no_match(scanner, sample):
    ungated = license_scan.Scanner([Rule(r.name, r.label, r.priority, r.pattern, (), r.base) for r in scanner.rules])
    extra = [
        "isc license, zlib/libpng license, 3-clause BSD; 0BSD, WTFPL v2; creative commons zero 1.0 universal; cc0",
        "PSF license 2, Python Software Foundation Licence; NCSA open source license; open data commons attribution license",
        "neither the name of the Foo Group nor the names of its contributors may be used to endorse or promote; © 2019 me",
        "may not be copied in any form without prior written permission; fair use exception; cecill 2.1; mulan PSL v2",
    ]
    texts = [r.text or "" for r in sample.select("text").collect()] + extra
    for text in texts:
        words = license_scan.words_of(text.encode())
        assert scanner.places(words) == ungated.places(words)
    assert all(kept(scanner, t) for t in extra)


def test_suppression():
    one = frozenset(("b",)),
    rules = [
        Rule("exact", "exact", VERSIONED, "b c", one),
        Rule("long", "long", NAME, "a b c d", one),
        Rule("inside", "inside", NAME, "a b", one),
        Rule("across", "across", NAME, "d e", (frozenset("d"),)),
        Rule("hint", "hint", HINT, "e f g", (frozenset("g"),)),
        Rule("same", "same", HINT, "b c", one),
    ]
    scanner = license_scan.Scanner(rules)
    shown = {rules[n].label: gone for _, _, n, gone in scanner.scan([*b"a b c d e f g".split()])}
    # "inside" lies in "long", "same" in "exact"; "exact" wins over "long" around it; "across" over "hint" across it.
    assert shown == {"exact": False, "long": True, "inside": True, "across": False, "hint": True, "same": True}


def plain(doc_id, text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for i in range(len(words)) for p, label in PHRASES.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return doc_id, len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def rows_of(spark, folder, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n_words", "'x' AS detections", "2 AS _id", "'y' AS labels")
    df.write.parquet(f"{folder}/documents.parquet")
    return queries.op12_license_rules(spark, str(folder))


def test_query_equals_the_plain_version(spark, sample, tmp_path):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    rows += [(None, None), (7, ""), (7, "  ...  "), (8, "CC_BY cc\xa0by cc-by ccby CC BY"), (9, "Äll rights reserved; all\nrights\treserved"), (None, "cc by")]
    rows += [(10, "GENERAL PUBLIC LICENSE " * 4000), (11, "cc by " * 3)] * 2
    got = rows_of(spark, tmp_path, rows).collect()
    base = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]
    assert sorted(map(repr, base)) == sorted(repr(plain(*r)) for r in rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        names = r.labels.split(",") if r.labels else []
        assert names == sorted(set(names)) and set(filter(None, r.base_labels.split(","))) <= set(names)


def test_score_and_labels(spark, tmp_path):
    (row,) = rows_of(spark, tmp_path, [(1, "GNU General Public License, version 3. All rights reserved.")]).collect()
    assert (row.labels, row.base_labels) == ("gpl,gpl-3.0,reserved", "gpl,reserved")
    assert row.score == pytest.approx(1 - 0.05 * 0.3 * 0.3)


def test_empty_table(spark, tmp_path):
    assert rows_of(spark, tmp_path, []).collect() == []
