"""Scenario derivation on a literal log, plus a re-partitioning check."""

from datetime import datetime, timedelta

from attemptlab.operators import attempts as A

T0 = datetime(2024, 1, 1)
LOG = "submission_id long, student_id long, question_unittest_id long, response string, response_type string, pass string, ts timestamp"
Q = "question_id long, week int, topic string, question_name string, question_text string, question_template string, question_unittests string"


def frames(spark):
    rows = [(1, 1, 7, "a", "Submit", "10", T0), (2, 1, 7, "b", "Submit", "11", T0 + timedelta(1)),
            (3, 1, 7, "a", "Submit", "01", T0 + timedelta(2)), (4, 1, 7, "c", "Precheck", "11", T0 + timedelta(3)),
            (5, 2, 7, "d", "Submit", "00", T0), (6, 2, 7, "e", "Submit", "11", T0 + timedelta(1)),
            (7, 2, 8, "f", "Submit", "NA", T0), (8, 2, 8, "g", "Submit", "1", T0)]
    subs = A.normalise_na(spark.createDataFrame(rows, LOG))
    qs = spark.createDataFrame([(7, 1, "t", "n", "x", "tpl", "Unittest 1: Input: a STD input: Output: b"),
                                (8, 1, "t", "n", "x", "tpl", "Unittest 1: Input: a STD input: Output: b")], Q)
    return subs, qs


def test_scenarios(spark):
    subs, qs = frames(spark)
    sc = A.derive_scenarios(subs, qs)
    assert sorted(r.submission_id for r in sc["Scenario2"].collect()) == [3, 6, 8]
    assert sorted(r.submission_id for r in sc["Scenario1"].collect()) == [6, 8]
    s3 = sorted(r.submission_id for r in sc["Scenario3"].collect())
    s4 = sorted(r.submission_id for r in sc["Scenario4"].collect())
    assert s3 == [1, 3] and s4 == [2]          # equal-text attempts of a mixed group are all kept


def test_repartition_invariance(spark):
    subs, qs = frames(spark)
    a = sorted(tuple(r) for r in A.derive_scenarios(subs, qs)["Scenario3"].drop("ts").collect())
    b = sorted(tuple(r) for r in A.derive_scenarios(subs.repartition(5), qs)["Scenario3"].drop("ts").collect())
    assert a == b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_carry_their_texts(spark):
    sc = A.derive_scenarios(*frames(spark))
    assert {(r.submission_id, r.response, r.response_mistake, r.response_correct) for r in sc["Scenario3"].collect()} == {
        (1, "a", "a", "b"), (3, "a", "a", "b")}
    assert {(r.submission_id, r.response, r.response_mistake, r.response_correct) for r in sc["Scenario4"].collect()} == {(2, "b", "a", "b")}
    assert {(r.submission_id, r.response, r.week) for r in sc["Scenario2"].collect()} == {(3, "a", 1), (6, "e", 1), (8, "g", 1)}


def test_rows_are_chosen_without_texts_and_catalogue_broadcast(spark):
    subs, qs = frames(spark)
    rows = A.ScenarioRows(A.clean_submissions(subs), qs)
    for keys in (rows.latest_keys, rows.s3_keys, rows.s4_keys):
        assert "response" not in keys.columns and "BroadcastHashJoin" not in plan(keys)
    for table in A.derive_scenarios(subs, qs).values():
        assert all("question_unittests" not in line for line in plan(table).splitlines() if "BroadcastExchange" in line)


def test_catalogue_rows_that_come_twice(spark):
    subs, qs = frames(spark)
    sc = A.derive_scenarios(subs, qs.unionByName(qs))
    assert sorted(r.submission_id for r in sc["Scenario2"].collect()) == [3, 6, 8]       # one row per pair
    assert sorted(r.submission_id for r in sc["Scenario3"].collect()) == [1, 1, 3, 3]    # one per catalogue row


def test_held_tables_equal_and_are_released(spark):
    subs, qs = frames(spark)
    rows = A.ScenarioRows(A.clean_submissions(subs), qs)
    held = rows.held()
    for name, table in held.tables().items():
        assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.tables()[name].collect()))
    assert held.keys.is_cached and held.texts.is_cached
    held.release()
    assert not spark._jsparkSession.sharedState().cacheManager().lookupCachedData(held.keys._jdf).isDefined()
