from meshspan.llm.license_scan import _MIT, KNOWN, license_scan


def test_license_scan(spark):
    mit = "The MIT Licence (MIT)\n\nCopyright (c) 2020 Someone Ltd.\n\n" + _MIT.lower().replace(", ", " , ").replace("\n", "\r\n\r\n")
    rows = [(1, mit), (1, mit), (2, None), (3, ""), (4, mit + " more"), (5, "first\n// licensed under the APACHE licence, version 2.0!\nlast\nReleased under the MIT License.\nreleased under the mit license"), (6, "no such word"), (None, next(t for n, t in KNOWN if n == "0BSD")), (7, "license " * 30_000), (8, "Copyright me. All rights reserved, license")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, notices string").repartition(3)
    got = sorted((r.doc_id or -1, r.licence or "", tuple(r.notices)) for r in license_scan(df).collect())
    assert got == [(-1, "0BSD", ()), (1, "MIT", ()), (1, "MIT", ()), (2, "", ()), (3, "", ()), (4, "", ()), (5, "", ("Apache-2.0", "MIT")), (6, "", ()), (7, "", ()), (8, "", ())]
    assert license_scan(df.limit(0)).count() == 0


def test_every_text_and_line_is_digested(spark):
    from pyspark.sql import functions as F

    from meshspan.llm.license_scan import digest

    rows = [(1, "This work is in the\npublic   domain."), (2, "This work is in the public-domain"), (3, "Do what you like.\nOther"), (4, "do WHAT, you like")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.licence, r.notices) for r in license_scan(df).collect()}
    assert got[1] == ("CC0-1.0", []) and got[2] == ("CC0-1.0", ["CC0-1.0"])
    own = spark.createDataFrame([("Own", "Do what you like")], "licence string, text string").select("licence", digest(F.col("text")).alias("digest"))
    got = {r.doc_id: (r.licence, r.notices) for r in license_scan(df, own).collect()}
    assert got[3] == (None, ["Own"]) and got[4] == ("Own", ["Own"])


def test_whole_texts_of_long_licences(spark):
    """Texts that many systems ship are known by digests; wrapping, case, markers and numbers do not matter."""
    import os

    import pytest

    folder = "/usr/share/common-licenses"
    if not os.path.isdir(folder):
        pytest.skip("no licence texts here")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    read = lambda f: open(f"{folder}/{f}", encoding="utf-8").read()
    rows = [(i, read(f)) for i, f in enumerate(names)] + [(100, read("Apache-2.0").upper().replace("\n", "\r\n")), (101, "\n".join("# " + x for x in read("GPL-3").split("\n"))), (102, read("GPL-3") + "x"), (103, read("Apache-2.0").split("   APPENDIX")[0])]
    got = {r.doc_id: r.licence for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values())
    assert (got[100], got[101], got[102], got[103]) == ("Apache-2.0", "GPL-3.0", None, "Apache-2.0")


def test_planted_notices_by_hand(spark):
    """Expected licences written by hand, apart from the operator's own tables."""
    planted = [
        ("Licensed under the Apache Licence, version 2.0", ["Apache-2.0"]), ("* LICENSED under CC-BY-NC 4.0", ["CC-BY-NC-4.0"]), ("-- this work is licensed under the GNU General Public License, version 3", ["GPL-3.0"]),
        ("Released under the MIT License!", ["MIT"]), ("Copyright 2020 A. Person", []), ("copyright holders be kind", []), ("A licence to fish", []),
    ]
    rows = [(i, f"Some words.\n{line}\nOther words.") for i, (line, _) in enumerate(planted)]
    got = {r.doc_id: r.notices for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(planted))] == [w for _, w in planted]


def test_a_digest_of_two_licences_gives_the_smaller_name(spark):
    from pyspark.sql import functions as F

    from meshspan.llm.license_scan import digest

    known = spark.createDataFrame([("Z", "same words"), ("A", "Same, words.")], "licence string, text string").select("licence", digest(F.col("text")).alias("digest"))
    got = license_scan(spark.createDataFrame([(1, "same words")], "doc_id long, text string"), known).first()
    assert (got.licence, got.notices) == ("A", ["A"])
