"""The registered queries themselves: the contracts' columns and types, a row for each input row, and the rows of their SQL."""

import duckdb
import pytest

from galenic.llm import queries

COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op3_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op4_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op5_nearest": "query_id bigint, rank int, vec_id bigint, score double",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op11_collocations": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_cross_align": "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string",
    "op13_lsh_forest": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf_dir, name):
    got = queries.queries()[name](spark, sf_dir)
    types = dict(got.dtypes)
    assert all(types.get(c) == t for c, t in (x.split() for x in COLUMNS[name].split(", "))), types
    if name == "op11_collocations":
        ranks = [r.rank for r in got.where("lang = 'en'").collect()]
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and ranks
        return
    ids = sorted(r[0] for r in got.select(got.columns[0]).collect())
    if name == "op5_nearest":
        want = [r.vec_id for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").collect() for _ in range(5)]
    else:
        want = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    assert ids == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_of_the_sql(spark, awkward, sf_dir, name):
    """On the given table and on the awkward one, whose texts are null, empty, long and repeated and whose ids repeat."""
    sql = queries.oracle_sql()[name]
    order = lambda rows: sorted((tuple(r) for r in rows), key=repr)
    given = queries.queries()[name](spark, sf_dir)
    columns = sorted(given.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    assert order(given.select(*columns).collect()) == order(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())

    operator = {"op3_quality_rules": queries.quality_cascade, "op4_ngram_jaccard": lambda df: queries.similar_components(df, n_words=3, num=90, den=100), "op11_collocations": lambda df: queries.collocations(df, 100, 2000), "op13_lsh_forest": lambda df: queries.near_duplicates(df, n_words=3, num=85, den=100)}[name]
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text", "lang").toArrow())
    assert order(operator(awkward).select(*columns).collect()) == order(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())
