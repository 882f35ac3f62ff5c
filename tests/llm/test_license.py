from __future__ import annotations

import math

import duckdb
import pandas as pd

from roadgeo.llm import license

GRANT = dict((label, text) for label, text in license.TEMPLATES)["mit"]
TEXTS = [
    None, "", "  ...  ", "CC-BY all", "Licensed under CC BY-NC 4.0.", "x General  Public\nLicense y general public license", "All rights reserved. cc by", "All RightsK reserved", "Released under the MIT License.",
    "word " * 31 + GRANT.upper() + " word" * 200, ("filler words here " * 3000) + " Licensed under the Apache License, Version 2.0. " + "more " * 500, "under the license released", "éé Cc By éé", "permission is hereby granted free of charge",
]

#: Scattered words of short templates, and templates in other cases and with other signs between.
SCATTERED = ["The mit crowd released a film. Under it lies the license office.", "The apache 2 0 license was licensed under a version", "license mit the under released"]
TEXTS += [*SCATTERED, "word " * 70_000 + "RELEASED--under; the (MIT) License" + " word" * 70_000]

TEXTS += [f"{'filler ' * 77}{' '.join(w.title() for w in text.split())}, and {'the rest ' * 40}" for _, text in license.TEMPLATES]


def test_against_sql_and_plan(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "k")] * 2 + [(None, TEXTS[6], "k")]
    found = license.scan(spark.createDataFrame(rows, "doc_id long, text string, labels string"))
    plan = found._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    c = duckdb.connect()
    c.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows]}))
    want = c.execute(license.oracle_sql())
    names = [d[0] for d in want.description]
    plain = lambda r: tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else v for v in r)
    assert sorted(map(str, (plain(r[n] for n in names) for r in found.collect()))) == sorted(map(str, map(plain, want.fetchall())))
    by = {r.doc_id: r for r in found.collect()}
    assert by[9].labels == "mit" and by[10].labels == "apache-2.0" and by[4].labels == "cc-by,cc-by-nc-4.0" and by[5].n_base == 2 and by[7].n_base == 0 and by[0].labels == ""
    assert all(r.labels == "" and r.score == 0.0 for r in found.collect() if r.doc_id is not None and TEXTS[r.doc_id] in SCATTERED)
    assert by[len(TEXTS) - len(license.TEMPLATES) - 1].labels == "mit"
    for i, (label, text) in enumerate(license.TEMPLATES, len(TEXTS) - len(license.TEMPLATES)):
        assert label in by[i].labels.split(",") and by[i].score == 1.0 and license.step_of(text) >= len(text.split())
    assert max(len(t.split()) for _, t in license.TEMPLATES) > 200


def test_empty_table(spark):
    assert license.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
