import os
import textwrap

import duckdb
import pytest

from strandloom.llm import licenses
from strandloom.llm.license_sql import LICENSE_SQL

PUBLISHED = "/usr/share/common-licenses"
SCHEMA = "doc_id bigint, text string, license_id string"


def scan(spark, texts, **more):
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], SCHEMA)
    return [r for r in sorted(licenses.scan_licenses(docs, **more).collect(), key=lambda r: r.doc_id)]


def layouts(text):
    """The usual ways to lay out a licence text."""
    paragraphs = [" ".join(p.split()) for p in text.split("\n\n") if p.strip()]
    for width in (60, 72, 80):
        wrapped = ["\n".join(textwrap.wrap(p, width)) for p in paragraphs]
        yield "\n\n".join(wrapped)
        for mark in ("# ", " * ", "// "):
            yield "\n".join(mark + line for line in "\n\n".join(wrapped).split("\n"))
    yield "\r\n\r\n".join(paragraphs)
    yield "Copyright (c) 2024 Someone\n\n" + paragraphs[0] + "\n\nCopyright 1999-2001 The Other Developers\nAll rights reserved.\n\n" + "\n\n".join(paragraphs[1:])
    yield "  " + " ".join(paragraphs).upper().replace("LICENSE", "LICENCE").replace("COPYRIGHT HOLDERS", "COPYRIGHT  OWNERS") + " "


def test_usual_layouts(spark):
    whole = [(i, t) for i, t in licenses.KNOWN if (i, t) not in licenses.NOTICES]
    texts = [(i, t) for i, text in whole for t in layouts(text)]
    assert {i for i, _ in whole} == {"MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "BSL-1.0"}
    for (want, text), row in zip(texts, scan(spark, [t for _, t in texts]), strict=True):
        assert row.license_id == want, text


def test_changed_texts_do_not_match(spark):
    whole = [t for i, t in licenses.KNOWN if (i, t) not in licenses.NOTICES][:40]
    texts = [v for t in whole for v in (t + " more", t.replace("WARRANT", "GUARANT").replace("warrant", "guarant"), t[: len(t) // 2])]
    assert {r.license_id for r in scan(spark, texts)} == {None}


def test_other_owners_of_bsd(spark):
    text = next(t for i, t in licenses.KNOWN if i == "BSD-3-Clause")
    got = scan(spark, [text.replace("the copyright holder nor", f"{who} nor") for who in ("the psutil authors", "Foo, Inc.", "Émile Zola")])
    assert [r.license_id for r in got] == ["BSD-3-Clause"] * 3 and len({r.text_digest for r in got}) == 1


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="no published texts on this machine")
def test_long_licences_as_published(spark):
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0-only", "GPL-3": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3": "LGPL-3.0-only", "MPL-2.0": "MPL-2.0", "Artistic": "Artistic-1.0-Perl"}
    texts = []
    for name, want in names.items():
        with open(f"{PUBLISHED}/{name}", errors="replace") as f:
            text = f.read()
        end = text.find("END OF TERMS AND CONDITIONS")
        texts += [(want, t) for t in (text, "# " + text.replace("\n", "\n# "), text.replace("\n", "\r\n"), *([text[:end]] if end >= 0 else []))]
    for (want, _), row in zip(texts, scan(spark, [t for _, t in texts]), strict=True):
        assert row.license_id == want


def test_sql_finds_planted_licences(spark):
    whole = [t for _, t in licenses.KNOWN]
    texts = [*whole, *[t for w in whole[:30:5] for t in layouts(w)], "Some words\n * Licensed under the Apache Licence, version 2.0\nReleased under the MIT License.\nend", None, "", "..."]
    got = [(r.doc_id, r.text_digest, r.license_id, r.notice_ids) for r in scan(spark, texts)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    found = duck.execute(f"SELECT doc_id, text_digest, license_id, notice_ids FROM ({LICENSE_SQL}) ORDER BY doc_id").fetchall()
    assert got == found and sum(r[2] is not None for r in found) > 60


def test_defined_cases(spark):
    lines = "Some words\n * Licensed under the Apache Licence, version 2.0\nmore"
    got = scan(spark, [None, "", "...", lines, lines, "x" * 50_000, "Released under the MIT License.", "© 2020 A\n(c) 2021 B"])
    assert [r.license_id for r in got] == [None] * 6 + ["MIT", None]
    assert [r.text_digest is None for r in got] == [True] * 3 + [False] * 4 + [True]
    assert [r.notice_ids for r in got] == ["", "", "", "Apache-2.0", "Apache-2.0", "", "MIT", ""]
    assert scan(spark, []) == []
    assert [(r.license_id, r.notice_ids) for r in scan(spark, ["Released under the MIT License."], known=[])] == [(None, "")]
    plan = licenses.scan_licenses(spark.createDataFrame([(1, "a", "b")], SCHEMA).where("doc_id = 1").select("doc_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.count("Scan ExistingRDD") <= 1
