"""The pipeline's stages, each against what its own input holds."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_documents import plain_components, plain_ids, plain_leaks, plain_print

from surveyloom.llm import mixing, quality
from surveyloom.llm.common import shared_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], SF).write.parquet(path := shared_path(spark, name))
        made.append(spark.read.parquet(path))
    return made


def by_id(frame):
    return {r["doc_id"]: r["text"] for r in frame.collect()}


def test_columns(steps):
    assert all(s.schema == steps[0].schema for s in steps[:-1])


def test_quality_stage(spark, steps):
    good = {r["doc_id"] for r in quality.quality(steps[0], spark.read.parquet(f"{SF}/labels.parquet")).collect() if r["predicted"]}
    assert set(by_id(steps[1])) == good
    assert 0 < len(good) < steps[0].count()


def test_near_duplicate_stage(steps):
    before = by_id(steps[1])
    root = plain_components({d: plain_print(t) for d, t in before.items()})
    assert set(by_id(steps[2])) == {d for d in before if root[d] == d}
    assert len(set(root.values())) < len(before)


def test_decontamination_stage(spark, steps):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = by_id(steps[2])
    bad = {d for d, _ in plain_leaks(items, list(before.items()))}
    assert set(by_id(steps[3])) == set(before) - bad


def test_mixture_and_token_stages(steps):
    texts = by_id(steps[4])
    assert texts == by_id(steps[3])
    order = [r["doc_id"] for r in sorted(mixing.mixed(steps[3]).collect(), key=lambda r: r["position"])]
    want, at = {}, 0
    ids = plain_ids(texts)
    for d in order:
        want[d] = (at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in steps[5].collect()} == want


def test_run(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))


def test_odd_rows(spark, odd, none, tmp_path):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
