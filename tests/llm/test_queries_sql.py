import duckdb
import pytest
from llm_help import SF

from linkwright.llm import queries as q


def text(v):
    return str(v).lower() if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = q.queries()[name](spark, SF), con.sql(q.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = sorted(tuple(text(r[c]) for c in cols) for r in got.collect())
    assert rows == sorted(tuple(text(v) for v in r) for r in want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_contracts(spark):
    """The columns that the queries have to return first, in order."""
    first = {
        "op1_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op3_attention_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        "op4_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op5_simhash": ["doc_id", "fingerprint", "component_id"],
        "op6_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        "op7_factorisation_machine": ["doc_id", "held_out", "score", "predicted"],
        "op8_language_crf": ["doc_id", "held_out", "lang_pred", "score"],
        "op9_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op10_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    }
    for name, columns in first.items():
        assert q.queries()[name](spark, SF).columns[: len(columns)] == columns
