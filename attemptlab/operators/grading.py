"""Grading of execution results and per-test-case verification against students.

Execution itself (compiling untrusted C++) is outside Spark's remit; the
execution-result table is an input.  Everything here is column expressions,
``posexplode`` and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlab.functions import text as X

KEYS3 = ["student_id", "question_id", "test_case_id"]
ANSWER_SLOT = r"\{\{\s*STUDENT_ANSWER\s*\}\}"
TESTCODE_SLOT = r"\{\{\s*TESTCASE\.testcode\s*\}\}"
# Template placeholders for the answer and the test code.
ANSWER_TOKEN = "{{ STUDENT_ANSWER }}"
TESTCODE_TOKEN = "{{ TESTCASE.testcode }}"


def execution_status(df: DataFrame) -> DataFrame:
    """Classify each result row: no_tests / timeout / compile_error / runtime_error / ok."""
    rt = F.col("run_time")
    status = (F.when(F.col("test_case_id").isNull(), "no_tests")
              .when(rt == "fail", "timeout")
              .when(F.col("stdout").isNull() & rt.isNull(), "compile_error")
              .when(F.col("stdout").isNull(), "runtime_error")
              .otherwise("ok"))
    return df.withColumn("status", status)


def grade_exact_match(df: DataFrame, missing: str = "zero") -> DataFrame:
    """``correctness`` = 1 if stripped stdout equals the expected output, else 0.

    ``missing="zero"`` keeps the reference code's behaviour (a row without a
    test case scores 0); ``missing="null"`` gives such rows a null instead.
    """
    match = F.coalesce(X.strip("stdout") == F.col("expected_output"), F.lit(False))
    score = F.when(match, 1).otherwise(0)
    if missing == "null":
        score = F.when(F.col("test_case_id").isNull(), F.lit(None)).otherwise(score)
    return df.withColumn("correctness", score.cast("int"))


def to_numeric(c) -> Column:
    """Text to double; anything unparsable (``fail``) becomes null."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def explode_pass(student: DataFrame) -> DataFrame:
    """One row per unit-test digit of each student attempt (padded to the test count)."""
    n = X.count_tests("question_unittests")
    padded = X.pad_pass("pass", n)
    extra = [c for c in ("scenario",) if c in student.columns]
    return (student.select(*extra, "student_id", F.col("question_id"),
                           F.posexplode(X.pass_digits(padded)).alias("test_case_id", "digit"))
            .select(*extra, "student_id", "question_id", "test_case_id",
                    F.col("digit").cast("int").alias("real_student_correctness")))


def verify_results(graded: DataFrame, student: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all joined rows, rows where both outcomes are 0/1)."""
    keys = (["scenario"] if "scenario" in graded.columns and "scenario" in student.columns else []) + KEYS3
    joined = graded.join(explode_pass(student), keys, "inner")
    valid = joined.filter(F.col("correctness").isin(0, 1) & F.col("real_student_correctness").isin(0, 1))
    return joined, valid


def question_tests(questions: DataFrame, order_col: str | None = None) -> DataFrame:
    """question_id -> lenient-parsed tests, one row per id.

    Of several catalogue rows with one id the last in the order of ``order_col`` wins; without an order column the
    ids must be unique.
    """
    if order_col is not None:
        questions = questions.groupBy("question_id").agg(F.max_by("question_unittests", order_col).alias("question_unittests"))
    return questions.select("question_id", X.parse_tests_lenient("question_unittests").alias("tests"))


def lookup_tests(completions: DataFrame, tests: DataFrame) -> DataFrame:
    """One row per (completion, test); a completion whose question has no tests keeps one null row."""
    j = completions.join(tests, "question_id", "left")
    return (j.select(*completions.columns,
                     F.posexplode_outer(X.format_testcases("tests", has_std_in=False)).alias("test_case_id", "tc"))
            .select(*completions.columns, "test_case_id",
                    X.strip_std_marker(F.col("tc.testcode")).alias("testcode"),
                    F.col("tc.expected_output").alias("expected_output"),
                    F.when(F.col("test_case_id").isNull(), "missing_tests").otherwise("ok").alias("lookup_status")))


def question_templates(questions: DataFrame, order_col: str) -> DataFrame:
    """question_id -> template of the first catalogue row in the order of ``order_col``."""
    return questions.groupBy("question_id").agg(F.min_by("question_template", order_col).alias("question_template"))


def lookup_template(completions: DataFrame, questions: DataFrame, order_col: str) -> DataFrame:
    """Attach the template of the first catalogue row of the question; missing -> ``missing_template``."""
    return (completions.join(question_templates(questions, order_col), "question_id", "left")
            .withColumn("template_status", F.when(F.col("question_template").isNull(), "missing_template").otherwise("ok")))


def render_submission(rows: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Source text per test: the test code and the answer put into the template.

    Placeholders are first normalised (any inner spacing), then replaced
    literally, so ``$`` and ``\\`` in code are kept as they are.
    """
    answer = X.strip_cpp_fence(F.col(answer_col))
    tpl = F.regexp_replace(F.regexp_replace(F.col("question_template"), TESTCODE_SLOT, TESTCODE_TOKEN),
                           ANSWER_SLOT, ANSWER_TOKEN)
    code = F.replace(F.replace(tpl, F.lit(TESTCODE_TOKEN), F.coalesce(F.col("testcode"), F.lit(""))),
                     F.lit(ANSWER_TOKEN), answer)
    return rows.withColumn("cpp_code", F.when(F.col("question_template").isNotNull(), code))
