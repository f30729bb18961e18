"""Grading, verification and metric edge cases."""

import math

from pyspark.sql import functions as F

from attemptlab.operators import grading as G
from attemptlab.operators import metrics as M

RES = "scenario int, model string, student_id long, question_id long, test_case_id int, stdout string, expected_output string, run_time string"


def results(spark):
    rows = [(2, "m", 1, 10, 0, " 1\n", "1", "0.5"), (2, "m", 1, 10, 1, None, "2", None),
            (2, "m", 1, 10, 2, "3", "3", "fail"), (2, "m", 1, 10, None, None, None, None),
            (2, "m", 1, 10, 3, "x", "4", "0")]
    return spark.createDataFrame(rows, RES)


def test_grade_missing_modes(spark):
    r = results(spark)
    zero = [x.correctness for x in G.grade_exact_match(r).orderBy(F.col("test_case_id").asc_nulls_last()).collect()]
    null = [x.correctness for x in G.grade_exact_match(r, missing="null").orderBy(F.col("test_case_id").asc_nulls_last()).collect()]
    assert zero == [1, 0, 1, 0, 0] and null == [1, 0, 1, 0, None]


def test_execution_status(spark):
    st = {(x.test_case_id): x.status for x in G.execution_status(results(spark)).collect()}
    assert st == {0: "ok", 1: "compile_error", 2: "timeout", None: "no_tests", 3: "ok"}


def test_verify_pads_and_joins(spark):
    stu = spark.createDataFrame([(2, 1, 10, "1", "Unittest 1: a Unittest 2: b Unittest 3: c Unittest 4: d")],
                                "scenario int, student_id long, question_id long, pass string, question_unittests string")
    joined, valid = G.verify_results(G.grade_exact_match(results(spark)), stu)
    got = sorted((x.test_case_id, x.real_student_correctness, x.correctness) for x in joined.collect())
    assert got == [(0, 1, 1), (1, 0, 0), (2, 0, 1), (3, 0, 0)]
    assert valid.count() == 4
    al = M.correctness_alignment(valid).first().value
    assert abs(al - 0.75) < 1e-12
    rm = M.mistake_alignment_rmse(joined).first().value
    assert abs(rm - abs(0.5 - 0.75)) < 1e-12


def test_efficiency_skips_fail_and_zero(spark):
    m = results(spark)
    s = m.withColumn("run_time", F.lit("1.0"))
    v = M.efficiency_alignment(m, s).first().value
    assert abs(v - 2.0) < 1e-12           # only 1.0 / 0.5 is numeric and non-zero


def test_functional_correctness_micro_average(spark):
    g = G.grade_exact_match(results(spark))
    v = M.functional_correctness(g).first().value
    assert abs(v - 2 / 5) < 1e-12


def test_unknown_scenario_raises(spark):
    import pytest
    g = G.grade_exact_match(results(spark).withColumn("scenario", F.lit(7)))
    stu = spark.createDataFrame([], "scenario int, student_id long, question_id long, pass string, question_unittests string")
    with pytest.raises(Exception):
        M.scenario_metrics(g, stu).collect()
    assert not math.isnan(0.0)
