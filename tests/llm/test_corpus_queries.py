"""Registered corpus queries against their SQL, or against plain versions where SQL has none."""

import os

import pytest
from tokenizers import Tokenizer

from brute import repeated_bytes, sha
from compare import compare, oracle_connection
from hourwatt.llm.q_bpe import vocabulary
from hourwatt.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("HOURWATT_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the test tables are not here")


def test_all_operators_are_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    ok, note = compare(name, QUERIES[name], ORACLES[name], spark, SF_DIR, oracle_connection(SF_DIR))
    assert ok, note


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}


def test_suffix_query(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, SF_DIR).collect()}
    assert got == repeated_bytes(documents(spark), 400)


def test_bpe_query(spark):
    coder = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in QUERIES["op2_bpe_tree"](spark, SF_DIR).collect():
        ids = coder.encode(documents_once(spark)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(coder.decode(ids, skip_special_tokens=False).encode())


_DOCS: dict = {}


def documents_once(spark):
    if not _DOCS:
        _DOCS.update(documents(spark))
    return _DOCS


def test_packing_query_covers_every_document(spark):
    coder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = QUERIES["op4_packing"](spark, SF_DIR).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.length
    assert sizes == {k: len(coder.encode(t or "", add_special_tokens=False).ids) + 1 for k, t in documents_once(spark).items()}


def test_quality_query_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rows = QUERIES["op1_pu_quality"](spark, SF_DIR).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 5 and sum(r.predicted == r.quality for r in rows) >= 0.85 * len(rows)
