"""Registered queries on the smallest tables: against SQL where there is some, else against brute force in the tests of each operator."""

import pytest

from lorespark.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), sf_dir, ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


CONTRACT = {
    "op1": "doc_id keep_id group_size kept text_sha256", "op2": "doc_id fingerprint component_id", "op3": "doc_id piece start length ids_crc32 sequence_id offset", "op4": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op5": "doc_id size source_size target taken", "op6": "doc_id held_out n_tokens n_known train_tokens base_score score", "op7": "doc_id start end other_id", "op8": "vec_id n_links component_id kept", "op9": "doc_id held_out score predicted", "op10": "doc_id n_deleted", "op11": "page_id url text n_chars",
    "op12": "anchor_id positive_id rank negative_id positive_score negative_score", "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_have_the_rows_and_columns_of_their_contracts(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    number = name.split("_")[0]
    assert set(CONTRACT[number].split()) <= set(out.columns)
    rows = out.collect()
    table, column = {"op8": ("embeddings", "vec_id"), "op11": ("pages", "page_id"), "op12": ("embeddings", "vec_id"), "op13": ("conversations", "conv_id")}.get(number, ("documents", "doc_id"))
    ids = [r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(column).collect()]
    own = [r["anchor_id" if number == "op12" else column] for r in rows]
    if number in ("op7", "op12", "op13"):
        assert set(own) <= set(ids)
    elif number == "op3":
        assert set(own) == set(ids)
    else:
        assert sorted(own) == sorted(ids)
