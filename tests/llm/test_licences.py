"""Licence scan: planted notices are found and named, other text is not."""

import pytest

from lotbook.llm import licences

SCHEMA = "doc_id long, text string, family string, families string"
PLAIN = "An ordinary paragraph of a text about rivers and hills that goes on for a while."
FOUND = {
    1: (f"{PLAIN}\nReleased under the MIT License.\n{PLAIN}", ["mit"]),
    2: ("Licensed under the Apache License, Version 2.0.\nAll rights reserved.", ["all-rights-reserved", "apache"]),
    3: ("This work is licensed under the GNU General Public License, version 3.", ["gpl"]),
    4: ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    5: (PLAIN, []),
    6: ("The driving license of the man was under the rights of the public, reserved for all.", []),
    7: (None, []),
    8: ("", []),
    9: (" \n\t\n", []),
    10: (f"{PLAIN}\n" * 3000 + "All rights reserved.", ["all-rights-reserved"]),
}


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("l") / "docs")
    rows = [(i, t, "x", "y") for i, (t, _) in FOUND.items()]
    rows += [(None, "Released under the MIT License.", "", ""), (4, FOUND[4][0], "", "")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return licences.scan_documents(spark.read.schema(SCHEMA).parquet(path)).collect()


def test_planted_notices(scanned):
    assert len(scanned) == len(FOUND) + 2
    for row in scanned:
        if row.doc_id is None:
            assert row.families == ["mit"]
        else:
            assert row.families == FOUND[row.doc_id][1], row
    counts = {r.doc_id: r.n_paragraphs for r in scanned}
    assert (counts[1], counts[7], counts[8], counts[10]) == (3, 0, 0, 3001)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d"))
    docs = spark.read.schema(SCHEMA).parquet(str(tmp_path / "d"))
    assert licences.scan_documents(docs).count() == 0


def test_notices_without_keywords_and_over_several_lines(spark):
    mit = licences.TEMPLATES["mit"][2]
    apache = licences.TEMPLATES["apache"][1]
    want = {
        1: ("This is free and unencumbered software released into\nthe public domain.", ["public-domain"], 1),
        2: ("to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction", ["mit"], 1),
        3: (f"{PLAIN}\n" + "\n".join(mit.split()) + f".\n{PLAIN}", ["mit"], 1),
        4: ("no end\n" * 60 + "# " + apache.replace(" ", "\n# ") + "\n" + "no end\n" * 60, ["apache"], 1),
        5: (f"{mit.replace(' to ', chr(10) + 'to ')}.\n{apache.replace(' you', chr(10) + 'you')}", ["apache", "mit"], None),
        6: ("of this software\n\nand associated documentation\n\nfree of charge", [], 0),
        7: ("Released under the MIT License.\nLicensed under CC BY 4.0.", ["cc-by", "mit"], 2),
    }
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in want.items()], "doc_id long, text string")
    for row in licences.scan_documents(rows).collect():
        _, families, n = want[row.doc_id]
        assert row.families == families, row
        assert n is None or row.n_licence_paragraphs == n, row
