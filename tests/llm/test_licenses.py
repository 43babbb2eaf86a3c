import re
from re import _parser

import pytest
from pyspark.sql import functions as F

from lodewatch.llm import licenses
from lodewatch.llm.license_rules import AFTER, BEFORE, rules
from tests.compare import connect, differences

RULES = rules()


def example(tree):
    """A shortest string that a pattern meets; gaps hold nothing."""
    out = ""
    for op, value in tree:
        op = str(op)
        if op == "LITERAL":
            out += chr(value)
        elif op == "NOT_LITERAL":
            out += "x"
        elif op == "IN":
            out += chr(next(v if str(k) == "LITERAL" else v[0] for k, v in value))
        elif op == "BRANCH":
            out += example(value[1][0])
        elif op == "SUBPATTERN":
            out += example(value[3])
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            out += example(value[2]) * value[0]
        else:
            raise ValueError(op)
    return out


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text):
    """The scan over a whole word list, every pair of detections compared."""
    words = words_of(text)
    met = []
    for i, w in enumerate(words):
        near = " " + " ".join([*words[max(0, i - BEFORE) : i], "@" + w, *words[i + 1 : i + AFTER]]) + " "
        for r in RULES:
            if r.anchor == w and (m := re.search(r.pattern, near)):
                first = i - (m[0].split("@")[0].count(" ") - 1)
                met.append((first, first + m[0].count(" ") - 2, r))
    rank = lambda d: (d[0], -d[1], -d[2].priority, d[2].number)
    inside = lambda s, t: t[0] <= s[0] and t[1] >= s[1] and t[2].priority >= s[2].priority and rank(t) < rank(s)
    found = sorted(met, key=rank)
    return len(words), [(f, e, r.number, r.base or not any(inside((f, e, r), t) for t in found)) for f, e, r in found]


TEXTS = [
    None, "", "   ", "no word of it", "Released under the MIT License.", "der Text mit License", "mit " * 50,
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "CC BY-NC 4.0 and cc by nc and CC-BY-NC-SA 3.0", "SPDX-License-Identifier: GPL-2.0-or-later", "http://creativecommons.org/licenses/by-nc-nd/4.0/",
    "under the mit license under the mit license", "naïve license mit — the ＭＩＴ license, under the MIT Licence",
    "GNU Lesser General Public License, version 2.1 or GNU General Public License v3 or later", "Copyright (c) 2020 A B C. All rights reserved.",
    "x" * 5000 + " under the mit license " + "y " * 300 + "apache license version 2.0",
]


def scanned(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: (r.n_words, [(d["first"], d["last"], d["rule"], d["kept"]) for d in r.licenses]) for r in licenses.license_scan(docs, **kw).collect()}


def test_equals_the_scan_in_plain_python(spark):
    examples = [" ".join(example(_parser.parse(r.pattern.replace("@", "")))[1:-1].split()) for r in RULES]
    pairs = [f"{a} {b}" for a, b in zip(examples, examples[7:] + examples[:7], strict=True)]
    texts = TEXTS + examples + pairs
    got = scanned(spark, texts)
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    for i, r in enumerate(RULES):  # every signature is met by an example of its own
        assert any(d[2] == r.number for d in got[len(TEXTS) + i][1]), r


def test_signatures_across_chunks_are_found_once(spark, monkeypatch):
    whole = scanned(spark, TEXTS)
    long_text = " ".join(["word"] * 40 + [t for t in TEXTS if t and len(t) < 4000] * 6)
    monkeypatch.setattr(licenses, "CHUNK_CHARS", 2000)
    assert scanned(spark, TEXTS) == whole
    assert scanned(spark, [long_text, "😀 under the mit license " * 900])[0] == plain(long_text)
    monkeypatch.setattr(licenses, "CHUNK_CHARS", 700)
    assert scanned(spark, [long_text])[0] == plain(long_text)


def test_base_phrases_stay_and_higher_priority_suppresses(spark):
    rows = spark.createDataFrame([(None, "Licensed under the MIT License, SPDX-License-Identifier: Apache-2.0", "k", 3)] * 2, "doc_id long, text string, n_words string, spaced int")
    out = licenses.license_scan(rows).collect()
    assert len(out) == 2 and all(r.spaced == 3 and r.n_words == 11 for r in out)
    got = licenses.summary(licenses.license_scan(rows)).collect()
    assert [(r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got] == [(1, 1, 1, "mit", "apache-2,mit", 1.0)] * 2
    inner = spark.createDataFrame([(1, "GNU General Public License, version 3")], "doc_id long, text string")
    detections = licenses.license_scan(inner).select(F.explode("licenses").alias("d")).select("d.*").collect()
    assert {d.label for d in detections if d.kept} == {"gpl-3"} and any(d.label == "gpl" and not d.kept for d in detections)


def test_empty_table_and_no_python_in_the_plan(spark):
    empty = licenses.summary(licenses.license_scan(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0
    assert not any(x in empty._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001"])
def test_query_equals_its_sql(spark, sf_dir):
    assert differences(spark, connect(sf_dir), licenses.op11_license_scan, licenses.sql(), sf_dir) == ""
