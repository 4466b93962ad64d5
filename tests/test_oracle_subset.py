"""A subset of the registered queries against their DuckDB oracle at sf0.001 (the driver runs
all of them at sf0.01; `tools/oracle_check.py` runs them locally)."""
import duckdb
import pytest

import __spark_entry__ as entry
from quarry.sources.views import TABLES
from tools.oracle_check import digest, rows_of

SUBSET = ["f_adaptive_training_set", "f_feedback_analysis", "f_keywords", "f_segments", "f_similarity_search",
          "f_request_metrics", "f_session_phase", "f_compare_models", "f_page_text", "f_stream_alerts",
          "f_stream_batches", "f_fill_template", "f_tfidf_vocab", "f_data_hash"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_has_a_name_and_most_have_oracles():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(sql) >= 0.9 * len(qs)


@pytest.mark.parametrize("name", SUBSET)
def test_matches_oracle(spark, sf, con, name):
    sdf = entry.queries()[name](spark, sf)
    scols, srec = sdf.columns, [tuple(r) for r in sdf.collect()]
    res = con.sql(entry.oracle_sql()[name])
    dcols, drec = res.columns, res.fetchall()
    assert sorted(scols) == sorted(dcols)
    assert len(srec) == len(drec)
    assert digest(rows_of(scols, srec)) == digest(rows_of(dcols, drec))
