from __future__ import annotations

import re

from spendguard.llm import licenses
from spendguard.llm.queries import op8_licenses

SCHEMA = "doc_id long, text string"


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = sorted((i, label) for p, label in licenses.BASE_PHRASES for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    return (len(words), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found})))


GRANT = licenses.TEMPLATES[1].text
ROWS = [(1, None), (2, ""), (3, "--- ..."), (4, "MIT License"), (5, "mit-license, the APACHE\nLicense; gnu General Public License" * 2), (6, "license"), (6, "license"),
        (7, f"x {GRANT} y"), (8, "the mit licensed"), (9, "été MIT  license\x00MIT License"), (None, "apache license"), (10, "license mit " * 3000),
        (11, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: x"),
        (12, "permission to redistribution source hereby conditions granted free of following charge copy"), (13, "ﬁ MİT license K")]


def test_base_phrases_and_edges(spark):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], SCHEMA + ", labels string")
    out = licenses.report(licenses.scan(docs)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    for i, text in ROWS:
        r = by[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert by[7].labels == "mit" and by[7].score == 1.0 and by[7].base_labels == ""
    assert by[11].labels == "bsd" and by[12].labels == "" and by[12].score == 0.0
    assert licenses.report(licenses.scan(docs.limit(0))).collect() == []


def test_a_notice_in_a_third_of_the_rows_or_in_all(spark):
    lgpl, agpl, bsd = (next(t.text for t in licenses.TEMPLATES if t.label == x) for x in ("lgpl", "agpl", "bsd"))
    for rows in ([(0, f"x {bsd} y", "bsd")] * 40 + [(1, f"plain words of row {i}", "") for i in range(80)],
                 [(0, lgpl, "lgpl")] * 40 + [(1, agpl, "agpl")]):
        out = licenses.report(licenses.scan(spark.createDataFrame([r[:2] for r in rows], SCHEMA))).collect()
        labels = {r[0]: set(r[2].split(",")) - {"gpl", ""} for r in rows}
        assert len(out) == len(rows) and all(set(r.labels.split(",")) - {"gpl", ""} == labels[r.doc_id] for r in out)


def test_a_file_of_many_notices(spark):
    every = " ; ".join(t.text for t in licenses.TEMPLATES)
    rows = [(0, every), *((i, f"plain words of row {i}") for i in range(1, 60))]
    out = {r.doc_id: r for r in licenses.report(licenses.scan(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert set(out[0].labels.split(",")) == {t.label for t in licenses.TEMPLATES} and out[0].score == 1.0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op8_licenses(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
