from __future__ import annotations

import zlib

import numpy as np
from cases import DOC_SCHEMA, edge_rows

from ruzi.llm import quality_model as qm

DATA = "/root/testdata/sf0.01"


def walk(forest, row):
    total = forest.base
    for feature, threshold, leaf in zip(forest.feature, forest.threshold, forest.leaf):
        node = 0
        while node < len(feature):
            node = 2 * node + 1 + (row[feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return total


def test_flat_walk_equals_a_walk_tree_by_tree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] * x[:, 1] > 0)).astype(float)
    forest = qm.fit(x, y, bins=16)
    assert np.allclose(forest.margins(x), [walk(forest, row) for row in x])
    assert ((forest.scores(x) > 0.5) == y).mean() > 0.95


def test_one_class_or_no_labels():
    x = np.zeros((4, 2))
    assert np.allclose(qm.fit(x, np.ones(4)).scores(x), 0.999)
    assert np.allclose(qm.fit(x[:0], np.ones(0)).scores(x), 0.5)


def test_held_out_accuracy_and_no_leak(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    rows = qm.classify(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert len(unseen) > 50
    assert np.mean([r.predicted == r.quality for r in unseen]) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.withColumn("quality", qm.F.when(qm.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    again = {r.doc_id: r.score for r in qm.classify(docs, turned).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_awkward_rows(spark):
    docs = spark.createDataFrame([(*row, 1) for row in edge_rows()], DOC_SCHEMA + ", score int")
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, 0), (5, None), (None, 1), (999, 1), (100, 1), (10, 0)], "doc_id long, quality int")
    rows = qm.classify(docs, labels, max_rows=3).collect()
    assert len(rows) == len(edge_rows())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert qm.classify(docs.where("false"), labels).count() == 0
    assert {r.score for r in qm.classify(docs, labels.where("false")).collect()} == {0.5}
