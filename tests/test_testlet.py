"""Testlet model: fit invariants and effect-table helpers."""

import math

from pyspark.sql import functions as F

from attemptlab.operators import stats as ST
from attemptlab.operators import testlet as TL
from attemptlab.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL


def test_fit_converges_and_predicts(spark):
    first = TL.first_attempt_only(Fixtures(spark, SF_SMALL).responses)
    b, eff = TL.fit_testlet_model(first)
    pred = TL.testlet_predict(TL.split_testlet_item(first), eff["student"], eff["item"], eff["testlet"], intercept=b)
    g = pred.agg(F.sum(F.col(TL.Y) - F.col("p_hat")).alias("g"), F.count(F.lit(1)).alias("n")).first()
    assert abs(g.g) / g.n < 1e-3                      # intercept score equation holds
    auc = ST.roc_auc(pred, "p_hat", TL.Y).first().auc
    assert auc > 0.6
    for k in ("student", "testlet"):
        assert abs(eff[k].agg(F.avg("Estimate")).first()[0]) < 1e-9   # centred blocks
    row = eff["item"].first()
    assert row["Q2.5"] < row["Estimate"] < row["Q97.5"] and row["Est.Error"] > 0
    assert not math.isnan(b)


def test_latest_ties_and_first_attempt(spark):
    df = spark.createDataFrame([(1, "1_1", 1, 5), (1, "1_1", 0, 5), (1, "1_1", 1, 3), (2, "1_1", 0, 1)],
                               "StudentID_SF long, ItemID_SF string, ItemScore int, T long")
    assert TL.latest_attempt_ties(df).filter("StudentID_SF = 1").count() == 2
    first = {(r.StudentID_SF, r.T, r.ItemScore) for r in TL.first_attempt_only(df).collect()}
    assert first == {(1, 3, 1), (2, 1, 0)}


def test_subset_is_first_interval(spark):
    df = spark.createDataFrame([(i, f"{i}_1") for i in range(31)], "StudentID_SF long, ItemID_SF string")
    kept = TL.id_subset_groups(df, "StudentID_SF", 3).count()
    assert kept == 11          # cut(1..31, 3): first interval holds positions 1..11


def test_train_test_stable(spark):
    df = spark.createDataFrame([(i, f"{i % 7}_1", i) for i in range(500)], "StudentID_SF long, ItemID_SF string, T long")
    a = {tuple(r) for r in TL.train_test_label(df, ["StudentID_SF", "ItemID_SF", "T"]).collect()}
    b = {tuple(r) for r in TL.train_test_label(df.repartition(5), ["StudentID_SF", "ItemID_SF", "T"]).collect()}
    assert a == b
    frac = sum(1 for r in a if r[3] == "test") / len(a)
    assert 0.12 < frac < 0.28


def test_subset_reads_the_rows_once_for_its_ids(spark):
    df = spark.range(300).selectExpr("id % 30 as StudentID_SF", "id")
    sub = TL.id_subset_groups(df, "StudentID_SF", 3)
    assert sub._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert sub.select("StudentID_SF").distinct().count() == 10
