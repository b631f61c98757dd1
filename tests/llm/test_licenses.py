"""Licence scan against its SQL and against a plain comparison."""

import re
from collections import Counter

from spooltrace.llm import licenses
from spooltrace.oracle.check import compare, duck_connect

from conftest import SF_SMALL


def dice(a, b):
    x, y = licenses._normal(a), licenses._normal(b)
    p, q = Counter(zip(x, x[1:])), Counter(zip(y, y[1:]))
    n = len(x) + len(y) - 2
    return 2 * sum((p & q).values()) / n if len(x) > 1 else 0.0


def brute(text):
    text = text or ""
    clean = re.sub("[^a-z0-9\n]+", " ", text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)))
    blocks = re.split("\n ?\n", clean)
    units = [("line", i, x) for i, x in enumerate(clean.split("\n"))]
    units += [("paragraph", i, x) for i, x in enumerate(blocks) if "\n" in x.strip(" ")]
    units += [("text", 0, clean)] * (len(blocks) > 1)
    hits = [(-d, name, kind, no) for kind, no, x in units for name, t in licenses.TEMPLATES.items()
            if (d := dice(x, t)) >= licenses.THRESHOLD]
    if not hits:
        return None, 0.0, "", 0
    best = min(hits)
    return best[1], -best[0], f"{best[2]}:{best[3]}", len({h[2:] for h in hits})


def frame(spark):
    mit, gpl = licenses.TEMPLATES["mit"], licenses.TEMPLATES["gpl-3.0-header"]
    lines = re.sub("\\s+", " ", mit)
    texts = [None, "", "word", "\n\n\n", mit, gpl.replace("\n", "\n\n"), "intro\n\n" + mit + "\n\nend", lines.upper(),
             "Released under the MIT License.\nAll rights reserved.\n", "released under the mit licence", "the " * 50_000,
             "All rights reserved.\n" * 500, "x\r\n \nLicensed under CC BY-NC 4.0!\n \n é", lines[:200], "All rights reserved."]
    rows = [(i, t, "l", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[4], (None, "Released under the MIT License.", "l", 0)],
                                 "doc_id long, text string, license string, no int")


def test_against_plain_comparison(spark):
    docs = frame(spark).unionByName(spark.read.parquet(f"{SF_SMALL}/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text", "lang license", "1 no"))
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=str)
    assert sorted(map(tuple, licenses.license_query(docs).collect()), key=str) == want
    assert licenses.license_query(docs.limit(0)).count() == 0


def test_against_sql(spark):
    con = duck_connect(SF_SMALL)
    con.register("fixture", frame(spark).select("doc_id", "text").toPandas())
    ok, msg = compare(licenses.license_query(frame(spark)), licenses.licenses_sql().replace("FROM documents", "FROM fixture"), con)
    assert ok, msg


def brute_window(text):
    """Best Dice over all windows of each template's size."""
    words = licenses._normal(text)
    return max(((dice(" ".join(words[i:i + n]), t), name) for name, t in licenses.TEMPLATES.items()
                for n in [len(licenses._normal(t))] for i in range(len(words) - n + 1)), default=(0.0, None))


def test_templates_inside_longer_units(spark):
    mit, bsd, gpl, apache = (licenses.TEMPLATES[x] for x in ("mit", "bsd-2-clause", "gpl-3.0-header", "apache-2.0-header"))
    prose = " ".join(f"word{i}" for i in range(200))
    hashed = "#!/bin/sh\n" + "\n#\n".join(f"# {x}" for x in gpl.split("\n")) + f"\n{prose}\n"
    broken = mit.replace("merge, publish, ", "").replace("the", "the the", 3)
    texts = {prose + " " + " ".join(mit.split()) + " " + prose: "mit", hashed.replace("version 3", "version\n#\n# 3"): "gpl-3.0-header",
             bsd + " THIS SOFTWARE IS PROVIDED AS IS " + prose: "bsd-2-clause",
             f"{prose}\n\n" + apache.replace(". ", ".\n\n") + f"\n\n{prose}": "apache-2.0-header",
             "Copyright 2021 Example Ltd. All rights reserved.": "all-rights-reserved",
             "Copyright 2020 A. Released under the MIT License.": "mit-notice", f"{prose} {broken} {prose}": "mit",
             f"{prose} {mit[:len(mit) // 2]} {prose}": None, "all rights " * 300: None}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_query(docs.unionByName(docs)).collect()}
    for i, (text, name) in enumerate(texts.items()):
        d, _ = brute_window(text)
        assert got[i].license == name, text
        assert got[i].dice == (max(d, brute(text)[1]) if name else 0.0)
        assert got[i].n_units >= (name is not None)


def test_common_licences_have_templates(spark):
    whole = {x: licenses.TEMPLATES[f"{x}-text"] for x in ("gpl-3.0", "gpl-2.0", "lgpl-2.1", "apache-2.0", "mpl-2.0", "cc0-1.0", "mit")}
    texts = {"Licensed under the MIT license.": "mit-notice-licensed", "Distributed under the MIT License.": "mit-notice-distributed",
             "Licensed under the Apache License 2.0.": "apache-2.0-notice-short",
             "governed by a BSD-style license that can be found in the LICENSE file": "bsd-notice",
             "This work is licensed under the GNU General Public License, version 2.": "gpl-2.0-notice",
             "// SPDX-License-Identifier: MPL-2.0": "spdx-mpl-2.0", licenses.TEMPLATES["lgpl-2.1-header"]: "lgpl-2.1-header",
             **{f"Copyright 2020 Someone\n\n{t}\nends here": x for x, t in whole.items()}}  # a text may quote its own header
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_query(docs).collect()}
    for i, name in enumerate(texts.values()):
        assert got[i].license.startswith(name) if i >= len(texts) - len(whole) else got[i].license == name
        assert got[i].dice == 1 or i < len(texts) - len(whole)
    found = {(r.doc_id, r.license) for r in licenses.window_matches(docs, ["doc_id"]).where("dice = 1").collect()}
    assert {(i, f"{x}-text") for i, x in enumerate(whole, len(texts) - len(whole))} <= found
