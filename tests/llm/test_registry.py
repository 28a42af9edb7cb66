"""The registered queries against their SQL, on whole small tables."""

from __future__ import annotations

import duckdb
import pytest

from ruzi.llm.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
LINKED = [
    (1, "http://a.io/1", '<link href="http://bad.net/x" rel=canonical>'),
    (2, "http://b.io/1#top", '<LINK rel="canonical" href="//a.io/1">'),
    (3, "http://b.io/2", '<meta http-equiv="Refresh" content="0; url=/1">'),
    (4, "http://w.org/fr/1", '<link href="http://worse.net/x" rel=canonical>'),
    (5, "http://v.org/de/1", '<link href="http://worse.net/x" rel=canonical>'),
    (6, "http://c.io/a/b?q", '<link href="d" rel=canonical>'),
    (7, "http://c.io/a/d", '<link href="http://bad.net/y" rel=canonical>'),
    (8, None, None),
    (9, "x", "<link href=y rel=canonical>"),
]


def rows_of(query, con):
    found = con.execute(query)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)


def test_names():
    numbers = [int(name[2:].split("_")[0]) for name in QUERIES]
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    names, want = rows_of(ORACLE_SQL[name], con)
    assert sorted(df.columns) == names
    assert sorted((tuple(row[n] for n in names) for row in df.collect()), key=repr) == want


def test_aliases_equal_sql(spark, tmp_path):
    spark.createDataFrame(LINKED, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    name = "op10_redirect_equivalence"
    names, want = rows_of(ORACLE_SQL[name], con)
    got = sorted((tuple(row[n] for n in names) for row in QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    verdicts = {row[names.index("page_id")]: row[names.index("verdict")] for row in want}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow"}
