import re

import duckdb
import pytest
from odd_rows import TEXTS, no_documents, odd_documents
from pyspark.sql import functions as F

from lumenbar.llm import license_rules
from lumenbar.llm.license_rules import BASE, RULES, WIDTH, Rule
from lumenbar.llm.licenses import license_scan, oracle

PLANTED = [
    "Permission is hereby granted, free of charge, to any person obtaining a copy. MIT License",
    "Licensed under the GNU Lesser General Public License, version 2.1, or the MIT-License; mit license",
    "SPDX-License-Identifier: Apache-2.0 and the apache license. Apache License, Version 2.0!",
    "GNU General Public License v3 GNU General Public License GPLv2 only; General Public Licence",
    "released under CC BY-NC-SA 4.0, dual licensed, all rights reserved. CC-BY-4.0",
    "general public\nlicense\tmit  license mitlicense mit licenses émit license",
    "Redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation; either version 2 of the License",
    "mit Mit MIT license license apache",
    "3-clause BSD, new BSD license, the modified BSD licence; BSD 2-Clause",
]
LONG = "mit license apache license version 2 0 gnu general public license " * 8_000


def plain_scan(text, rules=RULES):
    """All pairs of detections of one text compared."""
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    found = []
    for i, w in enumerate(words):
        for r in rules:
            if w in r.anchors:
                match = re.match(f"(?:{r.pattern}) ", " ".join(words[i:]) + " ")
                if match:
                    found.append((i, i + match.group().count(" ") - 1, r))
    kept = [
        (s, e, r) for s, e, r in found
        if not any(
            a <= s and b >= e and (q.level > r.level or q.level == r.level and b - a > e - s)
            for a, b, q in found
        )
    ]
    base = [(s, r.label) for s, _, r in found if r.base]
    places, named = [s for s, _ in base], {b for _, b in base}
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted(named)), ",".join(sorted(named | {r.label for _, _, r in kept})),
        max((r.score for _, _, r in kept), default=0.0),
    )


def scanned(df):
    return [tuple(r)[1:] for r in df.orderBy("doc_id").collect()]


def test_rules_are_bounded_and_start_with_their_words():
    assert len(RULES) > 300 and len({r.pattern for r in RULES}) > 280
    for r in RULES:
        assert not re.search(r"[*+{]", r.pattern) and r.pattern.count(" ") < WIDTH
        # a match starts with one of the anchors and holds the keyword as a word
        assert all(re.match(f"({'|'.join(r.anchors)})", a) for a in r.anchors)
        assert any(r.pattern.startswith(a) or r.pattern.startswith("(") for a in r.anchors)
        assert re.search(rf"(^|[ (|]){r.key}($|[ )(|])", r.pattern), r
    assert {r.pattern: r.label for r in RULES if r.base} == BASE


def test_every_name_is_found_alone_and_granted(spark):
    names = [line.split("|", 2) for line in license_rules.NAMES.strip().splitlines()]
    tags = [f"x SPDX-License-Identifier: {s.strip().replace(' ', '-')}" for _, s, _ in names]
    docs = spark.createDataFrame(list(enumerate(tags)), "doc_id long, text string")
    got = [r.labels.split(",") for r in license_scan(docs).orderBy("doc_id").collect()]
    assert all(label.strip() in found for (label, _, _), found in zip(names, got))


def test_planted_texts_equal_comparing_all_pairs(spark):
    texts = [*PLANTED, None, "", *[t for _, t, _ in TEXTS], " ".join(PLANTED) * 3]
    docs = odd_documents(spark, [(i, t, None) for i, t in enumerate(texts)])
    assert scanned(license_scan(docs)) == [plain_scan(t) for t in texts]
    # repeated and NULL ids: one row per row
    assert license_scan(odd_documents(spark)).count() == len(TEXTS)


def test_equal_places_of_one_level_stay_and_levels_decide(spark):
    rules = [
        Rule(("a",), "a", "a b", "short", 2, 0.2),
        Rule(("a",), "a", "a b c", "long", 2, 0.3),
        Rule(("a",), "a", "a b c", "same", 2, 0.4),
        Rule(("b",), "b", "b c d", "over", 2, 0.5),
        Rule(("b",), "b", "b", "high", 3, 0.1),
    ]
    texts = ["a b c d", "a b", "x b c d", "c d a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = scanned(license_scan(docs, rules=rules))
    assert got == [plain_scan(t, rules) for t in texts]
    assert [g[5] for g in got] == ["high,long,over,same", "high,short", "high,over", ""]


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_tables_equal_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = license_scan(spark.read.parquet(f"{folder}/documents.parquet"))
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == sorted(con.execute(oracle()).fetchall(), key=str)
    assert found.columns == [c[0] for c in con.description]


def test_very_many_detections_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    row = license_scan(docs).first()
    assert (row.n_base, row.first_word, row.last_word) == (24_000, 0, 11 * 8_000 - 3)
    assert row.labels == "apache,apache-2.0,gpl,mit"
    assert license_scan(no_documents(spark)).where(F.col("n_words") >= 0).count() == 0
