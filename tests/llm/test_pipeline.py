from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
from cases import DOC_SCHEMA, edge_rows
from tokenizers import Tokenizer

import corpus_pipeline as cp
from ruzi.llm import packing, pii
from ruzi.llm.common import written

DATA = "/root/testdata/sf0.001"


def stages_of(spark, docs, folder):
    found = [docs]
    for _, stage in cp.STAGES:
        found.append(written(stage(spark, found[-1], folder)))
    return found


def check(found):
    docs, good, single, clean, mixed, packed = (df.collect() for df in found)
    assert all(df.columns == found[0].columns for df in found[:-1])
    key = lambda rows: Counter(map(tuple, rows))
    assert not key(good) - key(docs)
    assert not key(single) - key(good)
    assert len(clean) == len(single)
    for before, after in zip(sorted(single, key=str), sorted(clean, key=lambda r: str(r))):
        assert (before.text is None) == (after.text is None)
    assert not any(pii.spans(r.text or "") for r in clean if pii.redact_text(r.text or "") != r.text)
    texts = defaultdict(set)
    for r in clean:
        texts[r.doc_id].add(r.text)
    assert all(any((t or "").startswith(r.text) for t in texts[r.doc_id]) for r in mixed)
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    want = Counter()
    for r in mixed:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id] += len(ids)
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want
    return found


def test_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = check(stages_of(spark, docs, DATA))
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {r.doc_id for r in found[1].select("doc_id").collect()}
    judged = labels.collect()
    assert np.mean([(r.doc_id in kept) == (r.quality == 1) for r in judged]) > 0.95
    rows = cp.run(spark, DATA)
    assert rows.columns == [field.split()[0] for field in packing.SCHEMA.split(", ")]
    assert rows.count() == found[5].count()


def test_internal_names_pass_through(spark):
    names = ["score", "key", "row", "component", "first_row", "fp", "group", "_mix_size", "_mix_row", "_mix_copy", "node", "size", "label_id", "found", "rep"]
    rows = [(i, f"clean words number {i} and some more of {i % 50} in text {i * 7}", "en", f"s{i % 3}", 40, *range(5, 5 + len(names))) for i in range(60)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA + "".join(f", `{name}` int" for name in names))
    found = [docs]
    for name, stage in cp.STAGES[1:4]:
        found.append(written(stage(spark, found[-1], DATA)))
        assert found[-1].columns == docs.columns, name
        assert {tuple(r[5:]) for r in found[-1].collect()} == {tuple(range(5, 5 + len(names)))}, name
    scored = cp.STAGES[0][1](spark, docs, DATA)
    assert scored.columns == docs.columns and scored.count() <= 60


def test_awkward_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(*r, 1.5) for r in edge_rows()], DOC_SCHEMA + ", score double")
    check(stages_of(spark, docs, DATA))
    check(stages_of(spark, docs.where("false"), DATA))
