"""The registered queries on the driver's tables: SQL where there is some, and their stated shapes."""

import duckdb
import pytest

from quarryfield.llm import queries

from ..test_catalog import KINDS, plain

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, name, sf):
    import glob
    import os

    con = duckdb.connect()
    for p in glob.glob(f"/root/testdata/{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, f"/root/testdata/{sf}")
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    rel = con.sql(queries.ORACLES[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert sorted(df.dtypes) == sorted((c, KINDS[str(t)]) for c, t in zip(rel.columns, rel.types))
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


SHAPES = {
    "op1_best_fit_packing": ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint", None),
    "op2_exact_top_k": ("query_id bigint, rank int, vec_id bigint, score bigint", 50),
    "op3_token_counts": ("doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", 200),
    "op4_personal_data": ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string", 200),
    "op5_line_dedup": ("doc_id bigint, n_lines bigint, n_dropped bigint, n_near bigint, text_sha256 string", 200),
    "op6_token_id_shards": ("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", 200),
    "op7_source_mix": ("doc_id bigint, size bigint, source_size bigint, target double, taken bigint", 200),
    "op8_simhash_near_dedup": ("doc_id bigint, fingerprint string, component_id bigint", 200),
    "op9_quality_rules": ("doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean", 200),
    "op10_chat_format": ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", None),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(spark, name):
    shape, rows = SHAPES[name]
    df = queries.QUERIES[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == shape
    if rows is not None:
        assert df.count() == rows
