import duckdb

from resolvescope.llm.license_scans import TEMPLATES, scan_licenses, scan_sql

MIT = TEMPLATES[3].text
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_places_and_labels(docs, rows):
    words = MIT.split()
    texts = [
        (1, "Released under the MIT License. mit-license, MIT\nlicense; the mitt license"), (2, None), (3, ""), (4, "x " * 50 + MIT),
        (5, " ".join(w for i, w in enumerate(words) if i not in (20, 45))), (6, " ".join(words[:30])), (7, "GNU General  Public LICENSE apache license"),
        (8, "all rights reserved"), (9, "général public license"), (None, "apache license"), (1, "Released under the MIT License. mit-license, MIT\nlicense; the mitt license"), (10, "license"), (11, "word " * 30_000 + "mit license"),
    ]
    got = rows(scan_licenses(docs(texts)), *NAMES)
    one = (1, 12, 3, 3, 7, "mit", "mit", 1.0)
    assert got[0] == (None, 2, 1, 0, 0, "apache", "apache", 1.0)
    assert got[1:3] == [one, one]
    by_id = {r[0]: r[1:] for r in got}
    assert by_id[2] == by_id[3] == (0, 0, None, None, "", "", 0.0)
    assert by_id[4][1:6] == (0, None, None, "", "mit") and by_id[4][6] == 1.0
    assert by_id[5][5] == "mit" and 0.6 <= by_id[5][6] < 1
    assert by_id[6][5] == "" and by_id[6][6] == 0.0
    assert by_id[7] == (6, 2, 1, 4, "apache,gpl", "apache,gpl", 1.0)
    assert by_id[8][5:] == ("proprietary", 1.0)
    assert by_id[9] == (3, 0, None, None, "", "", 0.0)
    assert by_id[11][1:4] == (1, 30_000, 30_000)
    assert scan_licenses(docs([])).count() == 0


def test_notices_that_follow_each_other(spark, table, rows):
    """Each stands there in full, on a diagonal of its own, though together they are too long for one; also in SQL."""
    notice = "All rights reserved. "
    texts = [(1, notice * 2), (2, notice * 5 + "the end"), (3, f"{MIT} {MIT}"), (4, "rights reserved. rights reserved."), (5, f"{notice}word {notice}"), (6, "All rights are reserved")]
    schema = "doc_id long, text string, label string, start int, span int, hash long, digest string"
    frame = table([(*t, "x", 1, 2, 3, "y") for t in texts], schema)  # columns named like the operator's own
    got = {r[0]: r[6:] for r in rows(scan_licenses(frame), *NAMES)}
    assert got == {1: ("proprietary", 1.0), 2: ("proprietary", 1.0), 3: ("mit", 1.0), 4: ("", 0.0), 5: ("proprietary", 1.0), 6: ("", 0.0)}
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    assert {r[0]: r[6:] for r in db.execute(f"SELECT {', '.join(NAMES)} FROM ({scan_sql()})").fetchall()} == got


def test_equals_duckdb(spark, rows):
    path = "/root/testdata/sf0.001/documents.parquet"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    want = db.execute(f"SELECT {', '.join(NAMES)} FROM ({scan_sql()})").fetchall()
    assert rows(scan_licenses(spark.read.parquet(path)), *NAMES) == sorted(map(tuple, want), key=lambda r: [(v is not None, v) for v in r])
