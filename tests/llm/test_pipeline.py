"""The pipeline's stages against brute force, each on its own input; and the registered queries against their SQL."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from talkweave.llm import bpe, registry
from tests.compare import database, differences
from tests.llm.test_dedup import brute_groups, roots

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    assert not differences(registry.QUERIES[name](spark, SMALL), database(SMALL), registry.ORACLES[name])


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs[-1], SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [x.collect() for x in inputs]
    before, known, exact, near, mixed, tokens = rows
    assert {r.doc_id for r in known} <= {r.doc_id for r in before} and len(known) >= 0.97 * len(before)
    least = {}
    for r in known:
        least[r.text] = min(r.doc_id, least.get(r.text, r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(least.values())
    pairs = brute_groups([(r.doc_id, r.text) for r in exact])
    gone = {k for k, v in roots(pairs).items() if k != v}
    left = {r.doc_id for r in exact} - {r.doc_id for r in near}
    assert left <= gone and len(left) >= 0.9 * len(gone)
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near} and abs(len(mixed) - len(near)) <= len({r.source for r in near})
    text = {r.doc_id: r.text for r in mixed}
    other = bpe.Encoder(bpe.load())
    assert sorted(r.doc_id for r in tokens) == sorted(r.doc_id for r in mixed)
    assert all(r.exact and "".join(other.decode(np.array(r.tokens))) == text[r.doc_id] for r in tokens)


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "tokens", "exact"]
    assert got.count() > 0 and got.where(~F.col("exact")).count() == 0
