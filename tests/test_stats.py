"""Rank statistics: ties, AUC symmetry, Spearman and Pearson guards."""

import random

import pandas as pd
from pyspark.sql import functions as F

from attemptlab.operators import ratings as RT
from attemptlab.operators import stats as ST


def avg_ranks(values):
    order = sorted(values)
    out = {}
    for v in set(values):
        first = order.index(v) + 1
        cnt = values.count(v)
        out[v] = first + (cnt - 1) / 2
    return out


def test_value_ranks_ties_across_slices(spark):
    rnd = random.Random(5)
    vals = [rnd.randrange(30) for _ in range(400)]
    df = spark.createDataFrame([(v % 2, float(v)) for v in vals], "g int, x double")
    got = {(r.g, r.x): r.avg_rank for r in ST.value_ranks(df, ["g"], "x", partitions=6).collect()}
    for g in (0, 1):
        want = avg_ranks([float(v) for v in vals if v % 2 == g])
        assert all(abs(got[(g, k)] - w) < 1e-12 for k, w in want.items())


def test_auc_symmetry_and_one_class(spark):
    rnd = random.Random(7)
    rows = [(rnd.random(), rnd.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(rows, "s double, y int")
    a = ST.roc_auc(df, "s", "y").first().auc
    b = ST.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first().auc
    assert abs(a + b - 1) < 1e-12
    one = spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int")
    assert ST.roc_auc(one, "s", "y").first().auc is None


def test_roc_curve_ends_at_one(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    pts = sorted((r.threshold, r.fpr, r.tpr) for r in ST.roc_curve(df, "s", "y").collect())
    assert pts[0] == (0.1, 1.0, 1.0) and pts[-1] == (0.9, 0.0, 0.5)


def test_pearson_constant_is_null(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (2, 1.0, 1.0), (2, 2.0, 2.0)], "g int, x double, y double")
    got = {r.g: r.r for r in ST.pearson_by(df, ["g"], "x", "y", "r").collect()}
    assert got[1] is None and abs(got[2] - 1.0) < 1e-12


def test_spearman_monotone(spark):
    df = spark.createDataFrame([(1, float(i), float(i ** 3)) for i in range(20)], "g int, x double, y double")
    assert abs(ST.spearman_by(df, ["g"], "x", "y", "rho").first().rho - 1.0) < 1e-12


def test_spearman_ties_nulls_and_constants(spark):
    rng = random.Random(11)
    rows = [("a", rng.randrange(7), rng.random() // 0.1) for _ in range(300)] + [("b", 1, float(i)) for i in range(5)]
    rows += [("a", None, 1.0), ("a", 3, None)]
    df = spark.createDataFrame(rows, "g string, x int, y double")
    got = {r.g: r.rho for r in ST.spearman_by(df, ["g"], "x", "y", "rho", partitions=5).collect()}
    own = pd.DataFrame(rows, columns=["g", "x", "y"]).query("g == 'a'").dropna()
    assert abs(got["a"] - own["x"].rank().corr(own["y"].rank())) < 1e-12
    assert got["b"] is None
    alone = ST.spearman_by(df.where("g = 'a'"), [], "x", "y", "rho").first().rho
    assert abs(alone - got["a"]) < 1e-12


def test_report_by_model_and_its_exchanges(spark):
    rng = random.Random(12)
    ab = [(m, f"s{i}", round(rng.random(), 1)) for m in ("t", "m1", "m2") for i in range(60) if rng.random() < 0.8]
    di = [(m, f"i{i}", round(rng.random(), 1)) for m in ("t", "m1", "m3") for i in range(60) if rng.random() < 0.8]
    ab += [(None, "s1", 0.3), ("m1", None, 0.3), ("m1", "s99", 0.5)]
    a = spark.createDataFrame(ab, "model string, student_id string, ability double")
    d = spark.createDataFrame(di, "model string, item_id string, difficulty double")
    report = RT.correlation_report(a, d, "t", "t")
    got = {r.model: r for r in report.collect()}
    assert set(got) == {"m1", "m2", "m3"}

    def plain(rows, model, ranks):
        truth, est = ({k: v for m, k, v in rows if m == name} for name in ("t", model))
        both = [k for k in truth if k in est]
        x, y = pd.Series([truth[k] for k in both], dtype=float), pd.Series([est[k] for k in both], dtype=float)
        return (x.rank().corr(y.rank()) if ranks else x.corr(y)) if both else None

    for m, r in got.items():
        for value, want in ((r.ability_pearson, plain(ab, m, False)), (r.difficulty_pearson, plain(di, m, False)),
                            (r.difficulty_spearman, plain(di, m, True))):
            assert (value is None and want is None) or abs(value - want) < 1e-9
    plan = report._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Exchange") <= 12, plan
