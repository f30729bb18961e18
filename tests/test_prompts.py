"""Prompts from narrow rows: texts and profile join before the targets are exploded."""

import re

from pyspark.sql import functions as F

from attemptlab.operators import attempts as A
from attemptlab.operators import prompts as P
from tests.test_scenarios import Q, T0, LOG, timedelta


def test_prompts_of_narrow_rows_equal_those_of_whole_rows(spark):
    rows = [(10 * q + k, 1, q, f"{'good' if k else 'bad'} {q}", "Submit", "11" if k else "10", T0 + timedelta(10 * q + k))
            for q in range(4) for k in range(2)]
    qs = spark.createDataFrame([(q, q, f"t{q}", f"n{q}", "x", "tpl", "Unittest 1: Input: a STD input: Output: b")
                                for q in range(4)], Q)
    r = A.ScenarioRows(A.clean_submissions(spark.createDataFrame(rows, LOG)), qs)
    profile = A.student_topic_profile(A.join_questions(r.clean, qs))
    for n, keys, whole in ((2, r.latest_keys, r.latest), (3, r.s3_keys, r.s3), (4, r.s4_keys, r.s4)):
        name = "response_mistake" if n == 3 else "response"
        narrow = P.scenario234_prompts(keys, profile, n, attach=lambda x: A.add_text(x, r.texts, name=name))  # noqa: B023
        want = P.scenario234_prompts(whole, profile, n)
        assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, want.collect())) and narrow.count() == 4
        text = narrow.where(F.col("question_id") == 0).first()["prompt"]
        assert ("bad 1" in text and "good 1" not in text) if n == 3 else ("good 1" in text and "bad 1" not in text)
        plan = narrow._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Join")       # nothing is joined above the exploded targets


def test_leave_one_out_numbers_attempts_without_texts(spark):
    from attemptlab.plans import queries_prompts
    from tests.conftest import SF_SMALL

    for query in (queries_prompts.leave_one_out_examples, queries_prompts.example_number):
        df = query(spark, SF_SMALL)
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = next(i for i, x in enumerate(lines) if "WindowGroupLimit [student_id" in x)
        assert not re.search(r"\b(response|text)#", lines[at + 1])
        assert any("question_unittest" in x and "strategy=merge" in x for x in lines)       # the catalogue is never broadcast


def test_leave_one_out_examples_of_narrow_rows_keep_their_texts(spark):
    rows = [(10 * q + k, s, q, f"try {s} {q} {k}", "Submit", "11" if k else "10", T0 + timedelta(10 * q + k))
            for s in (1, 2) for q in range(3 + s) for k in range(2)]
    rows.append((99, 3, 0, "alone", "Submit", "11", T0))
    qs = spark.createDataFrame([(q, q, f"t{q}", f"n{q}", "x", "tpl", "u") for q in range(5)], Q)
    r = A.ScenarioRows(A.clean_submissions(spark.createDataFrame(rows + rows[:3], LOG)), qs)
    narrow = P.leave_one_out_examples(r.latest_keys, attach=lambda x: A.add_text(x, r.texts))
    got = {(x.student_id, x.target.response): [e.response for e in x.examples] for x in narrow.collect()}
    assert got == {(s, f"try {s} {q} 1"): [f"try {s} {o} 1" for o in range(4) if o != q] for s in (1, 2) for q in range(4)}
    assert sorted(map(tuple, narrow.collect())) == sorted(map(tuple, P.leave_one_out_examples(r.latest).collect()))
