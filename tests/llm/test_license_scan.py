import re

import pytest

from tidemark.llm import license_scan as L

DOCS = [
    (0, "Released under the MIT License."),
    (1, None),
    (2, ""),
    (3, "Licensed under the Apache License, Version 2.0. Under the MIT license, under the mit-license!"),
    (4, "CC BY-NC 4.0 cc by nc CC BY NC SA 4.0"),
    (5, "SPDX-License-Identifier: GPL-3.0-or-later"),
    (6, "GNU General Public License, version 3 or any later version; the unlicensed text"),
    (7, "Mit der under the; mitlicense apache license version 21"),
    (8, "é under the mit license"),
    (8, "é under the mit license"),
    (None, "BSD 3-Clause License. All rights reserved."),
    (9, "word " * 3000 + "Apache License Version 2 " * 50),
]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for phrase, label in L.PHRASES:
        parts = phrase.split(" ")
        found += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def normalised(text):
    return " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))


def every_match(norm, rules):
    """All matches of all rules, with no gate at all, in words of the text."""
    return [(norm[: m.start()].count(" "), norm[: m.end()].count(" ") + 1, r.priority, k, r.label) for k, r in enumerate(rules) for m in re.finditer(r.regex, norm)]


def brute_detections(text, rules):
    found = every_match(normalised(text), rules)
    rank = lambda d: (d[0], -d[1], -d[2], d[3])

    def gone(d):
        return any(e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] >= d[2] and (e[:2] != d[:2] or e[2] > d[2] or e[3] < d[3]) for e in found)

    return [d for d in sorted(found, key=rank) if not gone(d)]


def examples(regex):
    """Texts that a signature matches: with and without its options, and one for each of its alternatives."""

    def each(parsed, most):
        out = [""]
        for op, arg in parsed:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "ANY":
                more = ["a"]
            elif name == "IN":
                kind, value = arg[0]
                more = [chr(value if str(kind) == "LITERAL" else value[0])]
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                # what may be repeated freely is left out, but for one letter
                times = (min(int(high), max(1, low)) if str(inner[0][0]) != "ANY" else 0) if most else low
                more = each(inner, most) if times == 1 else ["".join(each(inner, most)[0] for _ in range(times))]
            elif name == "SUBPATTERN":
                more = each(arg[3], most)
            elif name == "BRANCH":
                more = [x for branch in arg[1] for x in each(branch, most)]
            elif name == "ASSERT_NOT":
                more = [""]
            else:
                raise AssertionError(name)
            out = [a + b for a in out for b in more]
        return out

    parsed = re._parser.parse(regex)
    return sorted({" ".join(x.split()) for most in (False, True) for x in each(parsed, most)})


def test_rules_are_many_and_none_can_fail_to_fire():
    rules = L.signatures()
    assert len(rules) > 350 and len(L.NOTICES) > 120 and len({r.regex for r in rules}) == len(rules)
    for k, r in enumerate(rules):
        assert not re.compile(r.regex).fullmatch("")
        texts = [t for t in examples(r.regex) if re.fullmatch(r.regex, t)]
        assert texts, r.regex
        for t in texts:
            assert r.keyword in t, ("the keyword is not part of a match", r, t)
            assert any(a in t for a in L.ANCHORS), ("no anchor in a match", r, t)
        assert any(k in [d[3] for d in brute_detections(t, rules)] for t in texts), ("never survives", r)


def test_every_rule_fires_in_spark(spark):
    rules = L.signatures()
    texts = [next(t for t in examples(r.regex) if re.fullmatch(r.regex, t) and k in [d[3] for d in brute_detections(t, rules)]) for k, r in enumerate(rules)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in L.scan(df).collect():
        found = [tuple(d) for d in r.detections]
        assert r.doc_id in [d[3] for d in found] and found == brute_detections(texts[r.doc_id], rules)


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Licensed under the Apache Software License, Version 2.0", "apache-2"), ("a BSD-style license", "bsd"), ("Do What The Fuck You Want To Public License", "wtfpl"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2+"), ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3+"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl-2"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal", "mit"),
        ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2+"),
    ],
)
def test_texts_and_their_label(spark, text, label):
    assert L.summarise(L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().labels == label


def test_against_brute_force(spark):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id long, text string, labels string, n_words string")
    rules = L.signatures()
    got = {}
    for r in L.scan(df).collect():
        got.setdefault(r.doc_id, []).append([tuple(d[:5]) for d in r.detections])
    lines = L.summarise(L.scan(df)).collect()
    assert len(lines) == len(DOCS)
    for doc_id, text in DOCS:
        assert got[doc_id][0] == [(d[0], d[1], d[2], d[3], d[4]) for d in brute_detections(text, rules)], doc_id
        for r in (x for x in lines if x.doc_id == doc_id):
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text)
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    by_id = {r.doc_id: r for r in lines}
    assert by_id[5].labels == "gpl-3+"
    assert by_id[6].labels == "gpl-3+" and by_id[7].labels == "" and by_id[7].score == 0
    assert "bsd-3-clause" in by_id[None].labels


def test_base_on_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in L.summarise(L.scan(docs)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])


def test_empty_table(spark):
    assert L.summarise(L.scan(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def test_native(spark, small):
    plan = L.summarise(L.scan(spark.read.parquet(f"{small}/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("n", [2000])
def test_many_detections_in_one_text(spark, n):
    df = spark.createDataFrame([(1, "under the MIT License " * n)], "doc_id long, text string")
    found = L.summarise(L.scan(df)).first()
    assert found.n_base == n and found.n_detections == n
