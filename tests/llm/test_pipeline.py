"""Every stage of the pipeline against a plain version of its decision, on its own input."""

import os

import pytest

import corpus_pipeline
from rulewright.llm import line_dedup

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    at = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{SF}/documents.parquet")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns(tables):
    for t in tables[1:-1]:
        assert t.columns == tables[0].columns


def test_quality(tables, spark):
    before, after = rows(tables[0]), rows(tables[1])
    assert all(before[d] == t for d, t in after.items())
    assert not any(brute.quality(t)["base_failed"] for t in after.values())
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    gone = set(before) - set(after)
    assert gone and len(good & gone) <= 0.05 * len(good)


def test_lines(tables):
    before = tables[1].collect()
    drop = brute.boilerplate([(r["source"], r["text"]) for r in before], line_dedup.RATIO, line_dedup.SMOOTH)
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in drop) for r in before}
    assert rows(tables[2]) == want


def test_near_copies(tables):
    before = rows(tables[2])
    assert rows(tables[3]) == {d: before[d] for d, (_, c) in brute.components(before).items() if c == d}


def test_decontamination(tables, spark):
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    before = rows(tables[3])
    assert rows(tables[4]) == {d: before[d] for d, (_, hit, _) in brute.decontaminate(before, items).items() if not hit}


def test_packing(tables):
    pieces = {}
    for r in tables[5].collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    assert set(pieces) == set(rows(tables[4]))
    for p in pieces.values():
        at = 0
        for start, n, total in sorted(p):
            assert start == at
            at += n
        assert at == total


def test_no_documents(spark, tables, tmp_path):
    docs = tables[0].where("false")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
