"""The licence scan with whole licence texts, and notices of several lines among other content."""

from __future__ import annotations

import textwrap

import pytest

from taquilla.llm import licenses


@pytest.fixture(scope="module", autouse=True)
def steps(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("steps")))


APACHE, MIT = licenses.KNOWN[1][1], licenses.KNOWN[5][1]


@pytest.mark.parametrize("most_broadcast", [licenses.MOST_BROADCAST, 0])
def test_whole_texts_and_notices_among_content(spark, monkeypatch, most_broadcast):
    monkeypatch.setattr(licenses, "MOST_BROADCAST", most_broadcast)
    files = {f"{i}": t for i, t in licenses.known_rows()[len(licenses.KNOWN) :] if len(t) > 2000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(files)
    gpl = files["GPL-3.0"]
    commented = "\n".join(f"# {x}".rstrip() for x in APACHE.split("\n"))
    made = [
        (1, f"#!/bin/sh\n# Copyright 2020 Somebody\n#\n{commented}\n\nimport os\nprint(1)"),
        (2, "A readme.\n\n" + " ".join(MIT.split()) + "\n\nThe end."),
        (3, "A readme.\n\n" + textwrap.fill(" ".join(MIT.split()), 60) + "\n\nThe end."),
        (4, "A readme.\n\n" + MIT.replace("free of charge", "for a fee") + "\n\nThe end."),
        (5, "\n\n".join(MIT.split("\n\n")[1:]) + "\n\nThe end."),
        (6, f"{MIT}\n\ncode\n\n{APACHE}"),
    ]
    made += [(10 + i, t) for i, t in enumerate(files.values())]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    known = licenses.known_texts(spark)
    found = {r.doc_id: r for r in licenses.scan(docs, known).collect()}
    told = {d: (found[d].whole_license, found[d].n_notices, found[d].licenses) for d in range(1, 7)}
    assert told == {
        1: (None, 1, "Apache-2.0"),
        2: (None, 1, "MIT"),
        3: (None, 1, "MIT"),
        4: (None, 0, ""),
        5: (None, 0, ""),
        6: (None, 2, "Apache-2.0,MIT"),
    }
    for i, name in enumerate(files):
        assert found[10 + i].whole_license == name
    longer = spark.createDataFrame([(1, f"Title\n\n{gpl}\nand more")], docs.schema)
    [row] = licenses.scan(longer, known).collect()
    assert row.whole_license is None and "GPL-3.0" in row.licenses.split(",")
