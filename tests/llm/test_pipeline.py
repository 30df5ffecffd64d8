"""The pipeline against a plain version of each stage on the rows that its predecessor kept."""

import hashlib
import random

import corpus_pipeline
import pytest

from kerbline.llm import op1_decontamination as leak
from kerbline.llm import op6_secrets as secrets
from tests.llm.helpers import awkward, documents, labels, prose
from tests.llm.test_joins import components

tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(12)
    item = prose(rng, 30, 900)
    rows = awkward(rng)
    rows += [(300 + i, prose(rng, 150)) for i in range(40)] + [(400 + i, "!! ".join(prose(rng, 90).upper().split())) for i in range(40)]
    rows += [(500, prose(rng, 40) + " " + item + " " + prose(rng, 60)), (501, prose(rng, 70) + " password: hunter2hunter2 " + prose(rng, 60))]
    documents(spark, rows).write.parquet(f"{top}/documents.parquet")
    known = [(300 + i, 1, 0) for i in range(30)] + [(400 + i, 0, 0) for i in range(30)]
    labels(spark, known).write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "bpe"]
    found = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, folder))
        assert name == "bpe" or out.columns == docs.columns
        found[name] = (docs.collect(), out.collect())
        docs = out
    before, after = found["quality"]
    kept = {r.doc_id for r in after}
    assert not kept & set(range(400, 440)) and set(range(300, 340)) | {500, 501} <= kept

    before, after = found["near_dedup"]
    root = components([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in after if r.doc_id is not None} == {i for i, c in root.items() if i == c}

    before, after = found["decontamination"]
    assert {r.doc_id for r in before} - {r.doc_id for r in after} == {500}

    before, after = found["secrets"]
    assert len(before) == len(after)
    changed = {r.doc_id: r.text for r in after if r not in before}
    assert set(changed) == {501} and secrets.MARK in changed[501] and "hunter2" not in changed[501]

    before, after = found["bpe"]
    ranks, pattern = corpus_pipeline.op2_bpe._public(None)
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = {r.doc_id: own.encode_ordinary(r.text or "") for r in before if r.doc_id is not None}
    assert {r.doc_id: r.ids for r in after if r.doc_id is not None} == want
    assert all(r.decoded_sha256 == hashlib.sha256(own.decode_bytes(r.ids)).hexdigest() for r in after)


def test_stages_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_edit_bound():
    assert [leak.edits(n) for n in (4, 5, 9, 10, 40)] == [0, 1, 1, 2, 8]
