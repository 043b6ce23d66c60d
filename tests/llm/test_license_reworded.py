"""Reworded notices, SPDX lines, lines that only sound like licences, and odd rows."""

import pytest
from pyspark.sql import functions as F

from flowlab.llm import license_scan

NOTICES = {
    "apache": ("Distributed under the Apache License, Version 2.0.", "Licensed under Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
               "This file is made available under the terms of the Apache License 2.0."),
    "mit": ("Licensed under the MIT License.", "This software is distributed under the MIT License.", "SPDX-License-Identifier: MIT"),
    "gpl": ("Distributed under the GNU General Public License, version 2.", "GPLv3 or later, see the file COPYING.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "lgpl": ("Distributed under the GNU Lesser General Public License 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "bsd": ("Licensed under the BSD License.", "Use is governed by the BSD 3-Clause License."),
    "mpl": ("Distributed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("Available under CC BY 4.0.", "Text is available under the Creative Commons Attribution 4.0 licence."),
    "cc-by-sa": ("Available under CC BY-SA 4.0.", "Content is published under Creative Commons Attribution-ShareAlike 4.0."),
    "cc-by-nc": ("Available under CC BY-NC 4.0.",), "cc0": ("Dedicated under CC0 1.0.", "Released under CC0."),
    "proprietary": ("Example Ltd, all rights reserved worldwide.", "Copyright 2024 The Company. All Rights Reserved."),
}
PLAIN = ["a license to drive under the bridge by the public road", "the general public was not released", "the creative work of the commons was attributed to her",
         "she went to the university and all of us had rights", "two point zero is the version of the file", "licensed drivers under the law", "apache helicopters flew by",
         "permission was granted to him by the court without limitation"]


@pytest.fixture(scope="module")
def scanner(spark, docs):
    return license_scan.train(docs)


def test_reworded_notices(spark, scanner):
    lines = [(f, t) for f, ts in NOTICES.items() for t in ts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in lines] + PLAIN)], "doc_id long, text string")
    rows = license_scan.scan(df, scanner).collect()
    found = {r["doc_id"]: r["family"] for r in rows if r["family"] != "unknown"}
    assert found == {i: f for i, (f, _) in enumerate(lines)}


def test_odd_rows(spark, scanner, odd):
    assert license_scan.scan(odd, scanner).count() == 0
    long = " ".join(f"w{i}" for i in range(50_000))
    notice = "Licensed under the MIT License."
    rows = [(1, f"{long} {notice} {long}"), (1, f"{notice}\n{notice}"), (1, f"{notice}\n{notice}"), (None, notice), (2, None), (3, "\n" * 20_000 + notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("family", "words", "templates", "own", "predicted", "p", "k", "features", "grams"):
        df = df.withColumn(name, F.lit("clash"))
    got = sorted(((r["doc_id"], r["paragraph"], r["family"]) for r in license_scan.scan(df, scanner).collect()), key=str)
    assert got == sorted([(1, 0, "mit")] * 3 + [(1, 1, "mit")] * 2 + [(None, 0, "mit"), (3, 20_000, "mit")], key=str)


def test_training_without_documents(spark, docs):
    bare = license_scan.train(docs.limit(0))
    df = spark.createDataFrame([(1, "Licensed under the MIT License."), (2, "nothing of the kind here")], "doc_id long, text string")
    assert {r["doc_id"]: r["family"] for r in license_scan.scan(df, bare).collect()}.get(1) == "mit"


def test_training_reads_every_document(spark):
    rows = [(i if i % 3 else None, f"line {i} by the river\n" + ("the commons are open" if i in (7, 1234) else "the park is open")) for i in range(2500)]
    trained = license_scan.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert trained.seen["commons"] == 2 / 5000 and trained.seen["the"] == 1.0


def test_plain_lines_look_words_up_in_sets_made_once(spark):
    known, parts = ["free of charge", "under the terms", "the terms of"], ["charge", "free", "of", "terms", "the", "under", *(f"x{c}" for c in "abcdefgh")]
    texts = ["it is free of charge here\nfree of any charge\nfree and of some charge under a bridge", "under the terms\nthe the terms\nunder the", None, "",
             "Under THE\tterms 12\n\nno such words here\nfree of of charge the of terms", "of charge free of charge\nof charge free of charge"]
    df = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    want = []
    for line in "\n".join(t for t in texts if t).split("\n"):
        ws = line.lower().replace("12", "0").split()
        if len(ws) > 2 and not any(" ".join(ws[i:i + 3]) in known for i in range(len(ws) - 2)):
            want.append((ws, [w for w in ws if w in parts]))
    plain = license_scan.plain_lines(df, known, parts)
    assert sorted((r["words"], r["kept"]) for r in plain.collect()) == sorted(want) and len(want) == 5
    # the comparison of a whole line with all of ``known`` stands behind the look-up of its few words of the templates
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "INSET" in plan and plan.index("exists(") < plan.index("arrays_overlap(")


def test_training_hashes_no_list_for_every_line(spark, monkeypatch):
    """All lists of a training and a scan are sets of an expression; only lines near a template are compared with a literal array."""
    used = []
    whole = license_scan.listed
    monkeypatch.setattr(license_scan, "listed", lambda words: used.append(len(words)) or whole(words))
    df = spark.createDataFrame([(i, f"line {i} by the river is open\nthe commons of {i}") for i in range(50)], "doc_id long, text string")
    assert license_scan.scan(df, license_scan.train(df)).count() == 0
    assert len(used) == 1
