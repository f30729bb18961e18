"""A sample of registered queries against their DuckDB oracle on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from attemptlab import registry
from check_oracles import digest
from tests.conftest import SF_SMALL

SAMPLE = ["clean_submissions", "first_mistake_and_fix", "pair_first_responses", "latest_per_pair", "scenario3_filter",
          "parse_tests_strict", "parse_tests_lenient", "explode_pass", "functional_correctness", "mistake_alignment_rmse",
          "efficiency_alignment", "token_tree_distance", "token_tf_cosine", "scenario2_prompt", "scenario3_prompt",
          "completion_table", "correlation_report", "elo_minibatch", "roc_auc", "person_fit", "id_subset_groups",
          "testlet_adjusted_difficulty", "render_submission", "extract_code", "char_levenshtein", "response_matrix",
          "scan_submissions", "scan_questions", "scan_responses", "scan_completions_json", "scan_scenario", "sink_scenarios",
          "question_tests", "lookup_tests", "lookup_template", "failure_placeholder", "execution_status", "scenario_metrics",
          "code_similarity_table", "is_cpp", "clean_code", "strip_cpp_fence", "undefined_print_flag", "model_spearman", "roc_curve"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(cols)
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(cols, drows)[0]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "submission_id" in df.columns


def test_every_query_has_oracle_or_reason():
    assert set(registry.all_queries()) == set(registry.all_oracles())
    assert set(registry.all_queries()) <= set(E.queries())
