from __future__ import annotations

import re
from collections import defaultdict

import duckdb
import pytest
from cases import DOC_SCHEMA, edge_rows
from pyspark.sql import functions as F

from ruzi.llm import mixing


def water_fill(sizes, weights, multiple=3):
    """Shares by rounds: cap whoever is above, reshare the rest."""
    total, targets, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = total - sum(targets[i] for i in range(len(sizes)) if i not in open_)
        level = left / sum(weights[i] for i in open_)
        above = {i for i in open_ if level * weights[i] > multiple * sizes[i]}
        if not above:
            for i in open_:
                targets[i] = level * weights[i]
            return targets
        for i in above:
            targets[i] = float(multiple * sizes[i])
        open_ -= above
    return targets


def check(docs):
    rows = mixing.report(docs).collect()
    by_source = defaultdict(list)
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        assert (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        by_source[sources[r.doc_id]].append(r)
    names = sorted((s for s in by_source if s is not None), key=lambda s: s.encode()) + [None] * (None in by_source)
    sizes = [sum(r["size"] for r in by_source[s]) for s in names]
    targets = water_fill(sizes, [i % 3 + 1 for i in range(len(names))])
    for name, size, target in zip(names, sizes, targets):
        for r in by_source[name]:
            assert r.source_size == size and r.target == pytest.approx(target)
        assert sum(r.taken for r in by_source[name]) == pytest.approx(target, abs=1)
    placed = [r.position for r in rows if r.position is not None]
    assert placed == sorted(placed)
    return rows


def test_targets_and_taken_words(spark):
    rows = [(i, "w " * (i % 37 + (500 if i == 3 else 0)), "en", "hot" if i % 3 else f"s{i % 7}", 1) for i in range(600)]
    rows += [(1000 + i, "w w", "en", None, 1) for i in range(5)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC_SCHEMA + ", position int")
    first, again = check(docs), mixing.report(docs.repartition(7)).collect()
    assert sorted(first, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


def test_awkward_rows_and_empty(spark):
    rows = [(i, *row[1:]) for i, row in enumerate(edge_rows())]
    check(spark.createDataFrame(rows, DOC_SCHEMA))
    assert len(mixing.report(spark.createDataFrame(edge_rows(), DOC_SCHEMA)).collect()) == len(rows)
    assert mixing.report(spark.createDataFrame([], DOC_SCHEMA)).count() == 0
    blank = mixing.report(spark.createDataFrame([(1, None, "en", "s", 0)], DOC_SCHEMA)).first()
    assert (blank["size"], blank.target, blank.taken, blank.position) == (0, 0.0, 0, None)


@pytest.mark.parametrize("knots", [((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.5, 2.0), (1.0, 0.0)), ((0.0, 1.0), (0.3, 1.0), (0.3, 4.0), (1.0, 0.0)), ((0.0, 0.0), (0.4, 0.0), (1.0, 3.0))])
def test_inverse_demand(spark, knots):
    def demand(t):
        area = lambda until: sum((min(t1, until) - t0) * (w0 + w0 + (w1 - w0) / (t1 - t0) * (min(t1, until) - t0)) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if t0 < min(t1, until))
        return area(t) / area(1.0)

    for r in spark.range(101).select((F.col("id") / 100).alias("q")).withColumn("t", mixing.inverse_demand(F.col("q"), knots)).collect():
        assert demand(r.t) == pytest.approx(r.q, abs=1e-9)


def test_mixture_gives_the_taken_words(spark):
    rows = [(i, f"  d{i} " + "word\n " * (i % 9), "en", f"s{i % 4}", 5) for i in range(80)] + [(99, None, "en", "s0", None)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], DOC_SCHEMA + ", _copy string")
    taken = {r.doc_id: r.taken for r in mixing.report(docs).collect() if r.taken}
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    got, texts = defaultdict(int), {r[0]: r[1] for r in rows}
    for r in out.collect():
        got[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        assert texts[r.doc_id].startswith(r.text)
        assert r.text == texts[r.doc_id] or r.n_chars == len(r.text)
    assert got == taken


def test_clashing_names_pass_through(spark):
    names = ["_mix_base", "_mix_size", "_mix_copy", "_mix_take", "_mix_key", "_mix_inner", "_mix_row", "_mix_time", "_mix_order", "_mix_text", "words", "digest", "position", "Key"]
    rows = [(i, f"some words of {i}", "en", f"s{i % 3}", 5, *range(7, 7 + len(names))) for i in range(30)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA + "".join(f", `{name}` int" for name in names))
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    assert {tuple(r[5:]) for r in out.collect()} == {tuple(range(7, 7 + len(names)))}
    assert mixing.report(docs).count() == 30


def test_many_rows_of_one_id(spark):
    rows = [(None if i % 2 else 5, f"text {i} " * (i % 4), "en", "hot" if i % 3 else None, 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    narrow = docs.select("doc_id", "source", mixing.word_count(docs.text).alias("words"), mixing.digest_of(docs.text).alias("digest"))
    busy, idle = mixing.planned(narrow, F.col("words"), F.col("digest"))
    assert busy.count() == 1500 and idle.count() == 500
    most = busy.groupBy(F.substring("_mix_order", 1, mixing.BUCKET_DIGITS)).count().agg(F.max("count")).first()[0]
    assert most < 20
    first, again = (sorted(map(str, mixing.report(d).collect())) for d in (docs, docs.repartition(5)))
    assert first == again
    sums = mixing.report(docs).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in sums)


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    found = con.execute(mixing.SQL)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    got = mixing.report(spark.read.parquet(f"{folder}/documents.parquet"))
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == want
