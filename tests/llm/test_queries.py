"""Every registered operator over the smallest tables: its columns, and its SQL where there is one."""

import os

import pytest
from check import compare, oracle_connection

from millrace.llm import queries

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

COLUMNS = {
    "op1_nbest_pieces": "doc_id bigint, rank int, score double, n_ids bigint, ids array<int>, changes array<struct<at:int,removed:int,ids:array<int>>>, text_crc32 bigint, decoded_crc32 bigint",
    "op2_hash_tree": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_prefix_forest": "query_id bigint, rank int, vec_id bigint, score double",
    "op4_redirect_equivalence": "page_id bigint, host string, path string, rule string, verdict string",
    "op5_best_fit": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_induced_sorting": "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    "op7_threshold_table": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op8_lsh_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op9_capture_index": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11_stripes": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_pareto": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op13_limb_codes": "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string",
    "op10_markov": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
}


@pytest.fixture(scope="module")
def duck():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    found = queries.QUERIES[name](spark, FOLDER)
    assert sorted(f"{c} {kind}" for c, kind in found.dtypes) == sorted(x.strip() for x in COLUMNS[name].replace(", ", ";").split(";"))
    got = found.toPandas()
    assert len(got)
    if name in queries.ORACLES:
        assert compare(got, duck.execute(queries.ORACLES[name]).df()) is None
    if name == "op1_nbest_pieces":
        assert (got["text_crc32"] == got["decoded_crc32"]).all()
