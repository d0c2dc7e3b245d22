"""The licence scan against every rule at every place and pairwise suppression."""

import random
import re
from collections import Counter
from re import _parser as parser

import pytest
from sievework.llm import queries as Q
from sievework.llm.license_rules import BASE, CONFIDENCE, RULES
from sievework.llm.licenses import BASE_TIER, detections, scan_licenses

from .conftest import rows

NOTICES = {
    "Released under the MIT License.": "mit",
    "# SPDX-License-Identifier: Apache-2.0": "apache-2",
    "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.": "apache-2",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "You may use the GNU General Public License here.": "gpl",
    "GNU Lesser General Public License v2.1 or later": "lgpl-2.1",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "available under CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
    "this font software is licensed under the SIL Open Font License, Version 1.1": "ofl-1.1",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Neither the name of the Foo Bar Company nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
    "dual: under the MIT license; under the MIT license, or the BSD-3-Clause license": "bsd-3-clause,mit",
    "see https://www.apache.org/licenses/LICENSE-2.0.txt": "apache-2",
    "the committee under the mitten license, apache license versions, ccby nc, version 2 of nothing": "apache",
    "submit licenses; permit license; a commit under review": "",
    "der mit lizenz über straße, under the mit licenseé": "",
}


def extra():
    text = list(NOTICES)
    return [(500 + i, t) for i, t in enumerate(text)] + [(900, "\n".join(text)), (901, " ".join(text) * 40), (500, text[0]), (500, text[0]), (None, text[0]), (None, text[2]), (902, "under the mit license " * 900)]


def scan(text):
    """Every place, by definition; no keywords."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    joined, found = "".join(f" {w}  "[:-1] for w in words), []
    joined = "".join(f" {w} " for w in words)
    for i, (tier, label, _, pattern) in enumerate([(BASE_TIER, n, None, p) for p, n in BASE] + RULES):
        for m in re.finditer(" " + pattern.replace(" ?", "( )?").replace(" ", "  ") + " ", joined):
            start = joined[:m.start()].count(" ") // 2
            found.append((start, -(start + m[0].count(" ") // 2), tier, i, label))
    found.sort()
    return words, found


def want(doc_id, text):
    words, found = scan(text)
    kept = [x for n, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:n])]
    base = [x for x in found if x[3] < len(BASE)]
    join = lambda places: ",".join(sorted({x[4] for x in places}))
    return (doc_id, len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), join(base), join(base + kept),
            max((CONFIDENCE[x[2]] for x in found), default=0.0))


def example(tree, r):
    """A text that a pattern matches."""
    out = ""
    for kind, x in tree:
        if kind == parser.LITERAL:
            out += chr(x)
        elif kind == parser.IN:
            out += r.choice([chr(v if k == parser.LITERAL else v[0]) for k, v in x])
        elif kind == parser.NOT_LITERAL:
            out += "x"
        elif kind == parser.MAX_REPEAT:
            out += "".join(example(x[2], r) for _ in range(r.randint(x[0], min(x[1], x[0] + 2))))
        elif kind == parser.SUBPATTERN:
            out += example(x[-1], r)
        else:
            assert kind == parser.BRANCH
            out += example(r.choice(x[1]), r)
    return out


def test_rules():
    assert len(RULES) > 250 and all(r[0] in CONFIDENCE for r in RULES)
    for text, labels in NOTICES.items():
        assert want(0, text)[6] == labels, text
    r = random.Random(1)
    for _, _, keyword, pattern in RULES:  # whatever a pattern matches holds its keyword
        for _ in range(60):
            made = example(parser.parse(pattern), r)
            assert keyword.replace("_", " ") in made, (keyword, made)


def test_scan_licenses(spark, docs, none):
    table = docs.select("doc_id", "text", "keep").unionByName(spark.createDataFrame([(d, t, "x") for d, t in extra()], "doc_id long, text string, keep string"))
    got = scan_licenses(table)
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert Counter(map(tuple, got.collect())) == Counter(want(d, t) for d, t in [(x[0], x[1]) for x in rows()] + extra())
    assert scan_licenses(none).count() == 0 and detections(none).count() == 0


def test_detections(spark):
    table = spark.createDataFrame(extra()[:14], "doc_id long, text string")
    got = Counter((r.doc_id, r.start, -r.end, r.tier, r.rule, r.label) for r in detections(table).collect())
    assert got == Counter((d, *x) for d, t in extra()[:14] for x in scan(t)[1])


@pytest.mark.parametrize("name", ["op12_license_scan"])
def test_query(spark, docs, tmp_path, name):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(map(tuple, Q.queries()[name](spark, str(tmp_path)).collect())) == Counter(want(x[0], x[1]) for x in rows())
