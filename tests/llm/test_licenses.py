"""License scans against a plain loop over Python's regular expressions, and against the SQL."""

import random
import re

import duckdb
import pytest

from granary.llm import license_rules, licenses

RULES = licenses.standard_rules()
SAMPLES = {
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "released under the MIT license": "mit",
    "All rights reserved.": "reserved",
    "GPLv2 or later; see LGPL-2.1": "gpl-2,lgpl-2.1",
    "an apache helicopter made available to all": "",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "SPDX-License-Identifier: MIT": "spdx",
    "Copyright (c) 2019 Someone": "copyright",
    "https://creativecommons.org/licenses/by-sa/4.0/": "creative-commons",
    "general public licence": "gpl",
    "Mozilla Public License 1.1, MPL 2.0": "mpl-1.1,mpl-2",
}


def plain(text, of=RULES):
    """The contract's columns but for doc_id."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = []
    for i in range(len(words)):
        said = " ".join(words[i : i + licenses.WIDTH]) + " "
        for k, r in enumerate(of):
            m = re.match(f"(?:{r.regex}) ", said)
            if m:
                found.append((i, i + m[0].count(" "), r.level, k, r))
    holds = lambda h, x: h[0] <= x[0] and h[1] >= x[1] and h[2] <= x[2] and (h[0] < x[0] or h[1] > x[1] or (h[2], h[3]) < (x[2], x[3]))
    stay = [x for x in found if x[4].base or not any(holds(h, x) for h in found)]
    base = [x for x in stay if x[4].base]
    spell = lambda xs: ",".join(sorted({x[4].label for x in xs}))
    return len(words), len(base), min((x[0] for x in base), default=None), max((x[0] for x in base), default=None), spell(base), spell(stay), max((license_rules.SCORES[x[2]] for x in stay), default=0.0)


@pytest.mark.parametrize("text", SAMPLES)
def test_samples(text):
    assert plain(text)[5] == SAMPLES[text]


def test_rules_are_hundreds_of_bounded_regexes():
    assert len(RULES) > 300 and len({r.regex for r in RULES}) > 300
    for r in RULES:
        assert r.regex.count(" ") < licenses.WIDTH and r.openings
        assert not re.search(r"[*+]", r.regex)


def test_openings():
    rule = lambda x: license_rules.Rule("", 0, x).openings
    assert rule("(?:mit|x11) licen[sc]e") == ["mit licence", "mit license", "x11 licence", "x11 license"]
    assert rule("copyright(?: by| c)? (?:19|20)[0-9]{2}") == ["copyright", "copyright by", "copyright c"]
    assert rule("gpl") == ["gpl"]
    assert rule("non ?commercial use") == ["non commercial", "noncommercial use"]


def texts(seed):
    r = random.Random(seed)
    out = [None, "", " ", "x" * 5000, "cc by cc by " * 300, "ALL RIGHTS RESERVED all rights reserved", "cc", "by", "cc  -- by", *SAMPLES]
    vocabulary = ["the", "all", "rights", "reserved", "cc", "by", "nc", "sa", "4", "0", "2", "general", "public", "license", "gnu", "version", "mit", "licensed", "under", "é", "Apache", "copyright", "c", "1999", "or", "later"]
    for _ in range(60):
        out.append(r.choice([" ", "\n", "-", ", "]).join(r.choice(vocabulary) for _ in range(r.randrange(40))))
    for label, sentence, *_ in license_rules.TEXTS:
        out.append("so " + re.sub(r"\(\?:|\)\??|\|[^)]*|\[[^\]]*\](?:\{[0-9,]+\})?|\?", "", sentence) + " " + label)
    return out


def test_scan_matches_plain_python_and_sql(spark, tmp_path):
    said = texts(3)
    rows = [(None if i == 4 else i, t, "lang", 5, "label") for i, t in enumerate(said)] + [(1, "mit license", "x", 1, "l")] * 2
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, row long, label string").repartition(4).write.parquet(path)
    key = lambda x: tuple((v is None, v) for v in x)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    df = licenses.op12_license_scan(spark, str(tmp_path))
    got = sorted((tuple(r[c] for c in names) for r in df.collect()), key=key)
    assert got == sorted(((r[0], *plain(r[1])) for r in rows), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted(con.execute(licenses.OP12_SQL).fetchall(), key=key) == got
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert licenses.op12_license_scan(spark, str(tmp_path)).count() == 0


def test_a_text_of_many_places_is_scanned_in_linear_time(spark):
    docs = spark.createDataFrame([(1, "licensed under the mit license " * 40_000)], "doc_id long, text string")
    rows, found = licenses.scan_licenses(docs)
    assert rows.count() == 1 and found.count() == 40_000
