"""End-to-end flows over files written from the fixtures."""

import tempfile

from pyspark.sql import functions as F

from attemptlab.operators import attempts as A
from attemptlab.operators import grading as G
from attemptlab.plans import flows
from attemptlab.sources.fixtures import Fixtures
from tests.conftest import SF_SMALL


def test_scenario_and_metric_flows(spark):
    fx = Fixtures(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="attemptlab-flow-")
    (fx.submissions.withColumnRenamed("ts", "timestamp")
     .select("submission_id", "student_id", "question_unittest_id", "response", "response_type", "pass", "timestamp")
     .write.parquet(f"{root}/subs"))
    fx.questions.write.parquet(f"{root}/questions")
    tables = flows.scenario_tables(spark, f"{root}/subs", f"{root}/questions", out_root=f"{root}/out", fmt="parquet")
    want = A.latest_per_pair(A.join_questions(A.clean_submissions(A.normalise_na(fx.submissions)),
                                              A.normalise_na(fx.questions))).count()
    assert spark.read.parquet(f"{root}/out/Scenario2_full_data").count() == want

    ex = fx.executions
    results = ex.filter(F.col("model") != "R").select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("scenario"), *ex.columns)
    long = flows.metrics_report(results, tables, student_results=ex.filter(F.col("model") == "R").withColumn("scenario", F.lit(4)))
    metrics = {r.metric for r in long.collect()}
    assert {"functional_correctnes", "correctness_alignment", "mistake_alignment", "efficiency_alignment"} <= metrics


def test_ratings_and_testlet_flows(spark):
    fx = Fixtures(spark, SF_SMALL)
    graded = G.grade_exact_match(fx.executions)
    stacked, batches = flows.stack_scenarios({2: graded, 3: graded}, parts=2)
    root = tempfile.mkdtemp(prefix="attemptlab-flow-")
    ab, di, corr = flows.ratings_report(stacked, "batch", batches, "R", "R", out_root=root)
    assert corr.count() == 2 and ab.count() > 0 and di.count() > 0
    assert spark.read.parquet(f"{root}/ability").count() == ab.count()
    assert spark.read.json(f"{root}/correlations").count() == 2
    rep = flows.testlet_report(fx.responses)
    assert rep["items_by_testlet"].count() > 0 and rep["testlet_order"].count() > 0 and rep["varying_items"].count() > 0
    assert rep["effect_vs_correctness_line"].first().slope is not None
    assert rep["auc"].first().auc is not None
    assert rep["person_fit"].count() > 0 and rep["adjusted"].count() > 0


def test_prompt_and_file_metric_flows(spark):
    fx = Fixtures(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="attemptlab-flow-")
    subs, questions = A.normalise_na(fx.submissions), A.normalise_na(fx.questions)
    tables = A.derive_scenarios(subs, questions)
    profile = flows.topic_profile(tables, A.clean_submissions(subs))
    prompts = flows.prompt_tables(tables, profile, out_root=f"{root}/prompts", fmt="json")
    assert spark.read.json(f"{root}/prompts/Scenario2_prompts").count() == prompts["Scenario2"].count() > 0
    some = prompts["Scenario2"].select("student_id", "question_id").distinct()
    back = some.select("student_id", "question_id", F.lit("m").alias("model"), F.lit("int x;").alias("text"))
    table, success = flows.completion_report(some, back, ["m", "n"])
    assert table.count() == 2 * some.count()
    assert {r.model: (r.successes, r.total) for r in success.collect()} == {"m": (some.count(),) * 2, "n": (0, some.count())}

    ex = fx.executions
    results = ex.filter(F.col("model") != "R").select(F.explode(F.array(*[F.lit(i) for i in (2, 4)])).alias("scenario"), *ex.columns)
    results.write.partitionBy("model", "scenario").parquet(f"{root}/results")
    back.select(F.struct(F.concat_ws("_", "student_id", "question_id").alias("id")).alias("instance"),
                F.struct(F.array(F.struct("text")).alias("completions")).alias("result")).write.json(f"{root}/completions")
    long = flows.metrics_from_files(spark, f"{root}/results", tables, f"{root}/completions", scenario=2, model="A",
                                    out_path=f"{root}/metrics", lines=True)
    stored = {(r.scenario, r.model, r.metric) for r in spark.read.json(f"{root}/metrics").collect()}
    assert stored == {(r.scenario, r.model, r.metric) for r in long.collect()}
    assert (2, "A", "functional_correctnes") in stored and len(stored) >= 4


def test_unreadable_completion_document_is_named(spark):
    import pytest

    from attemptlab.sources import files
    root = tempfile.mkdtemp(prefix="attemptlab-flow-")
    with open(f"{root}/a.json", "w") as f:
        f.write('[{"instance": {"id": "1_2"}, "result": {"completions": [{"text": "x"}]}}]')
    assert [r.text for r in files.read_completions_json(spark, root).collect()] == ["x"]
    with open(f"{root}/b.json", "w") as f:
        f.write("not json")
    with pytest.raises(Exception, match="b.json"):
        files.read_completions_json(spark, root).collect()


def test_unknown_rate_is_printed(spark):
    from attemptlab.operators import prompts as P
    df = spark.createDataFrame([(1, [("loops", None, 0.5)])], "student_id long, profile array<struct<topic:string,pass_rate:double,perfect:double>>")
    text = df.select(P.profile_prompt(F.col("student_id"), F.col("profile")).alias("t")).first().t
    assert "'loops', the unit test pass rate is nan, and the rate of passing all tests is 0.50." in text
