"""Registered queries: sinks and scans as write/read round trips, key handling, sorts.

Sinks write into a fresh folder under the session's shared checkpoint
directory and the query returns what a reader gets back, so the check
compares the persisted table with the oracle.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.operators import grading as G
from attemptlab.operators import metrics as M
from attemptlab.plans import oracle_sql as O
from attemptlab.plans.queries_attempts import Flow
from attemptlab.plans.queries_grading import _GRADE, MetricFlow
from attemptlab.plans.queries_ratings import _W, _long
from attemptlab.plans.queries_similarity import _LONG, _metrics_long
from attemptlab.registry import fixtures, r6, register
from attemptlab.session import cut_lineage, ensure_checkpoint_dir
from attemptlab.sources import files

SV = ("submissions", "questions")
EV = ("submissions", "questions", "executions")
CV = ("submissions", "questions", "executions", "completions")
_SCEN = O.ctes(O.SUBS, O.QS, O.CLEAN, O.MERGED, O.MIXED, O.ALIGN, O.LATEST, O.S1)


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"


# every table with its row count and the sums of its numbers and text lengths
_CONTENT = "SELECT '{name}' AS name, count(*) AS n, CAST(sum({id}) AS BIGINT) AS id_sum, CAST(sum(length({text})) AS BIGINT) AS chars FROM {src}"


@register("sink_scenarios", _SCEN + " UNION ALL ".join(_CONTENT.format(name=n, id=i, text=t, src=src) for n, i, t, src in (
    ("Scenario1", "submission_id", "response", "s1"), ("Scenario2", "submission_id", "response", "latest"),
    ("Scenario3", "submission_id", "response || response_mistake", "final WHERE response = response_mistake"),
    ("Scenario4", "submission_id", "response || response_correct", "final WHERE response = response_correct"),
    ("Questions", "question_id", "question_template || question_unittests", "qs"))), SV)
def sink_scenarios(spark, sf):
    root = _folder(spark)
    rows = Flow(spark, sf).rows.held()
    tables = rows.tables()
    try:
        files.sink_scenarios(tables, root)
    finally:
        rows.release()
    text = {"Scenario3": ("submission_id", F.concat("response", "response_mistake")),
            "Scenario4": ("submission_id", F.concat("response", "response_correct")),
            "Questions": ("question_id", F.concat("question_template", "question_unittests"))}

    def content(n):
        i, t = text.get(n, ("submission_id", F.col("response")))
        return spark.read.parquet(f"{root}/{n}_full_data").agg(
            F.count(F.lit(1)).alias("n"), F.sum(i).alias("id_sum"), F.sum(F.length(t)).cast("long").alias("chars")) \
            .select(F.lit(n).alias("name"), "n", "id_sum", "chars")

    return reduce(DataFrame.unionByName, [content(n) for n in tables])


@register("scan_scenario", _SCEN + "SELECT submission_id, student_id, question_unittest_id, pass, epoch_us(ts) AS ts_us, response FROM final WHERE response = response_mistake", SV)
def scan_scenario(spark, sf):
    root = _folder(spark)
    f = Flow(spark, sf)
    files.write_table(f.rows.s3, f"{root}/Scenario3_full_data", fmt="csv", compression="gzip", max_rows_per_file=100_000)
    back = files.read_table(spark, f"{root}/Scenario3_full_data", f.rows.s3.schema, fmt="csv")
    return back.select("submission_id", "student_id", "question_unittest_id", "pass", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "response")


@register("scan_cached", _SCEN + "SELECT submission_id, question_id, topic FROM merged", SV)
def scan_cached(spark, sf):
    # held for reuse as files in the shared folder: no memory stays taken, no later query sees a cache
    m = cut_lineage(Flow(spark, sf).merged.select("submission_id", "question_id", "topic"))
    return m.select("submission_id", "question_id", "topic")


@register("sink_results_partitioned", _GRADE + "SELECT model, scenario, student_id, question_id, test_case_id, correctness FROM graded", EV)
def sink_results_partitioned(spark, sf):
    root = _folder(spark)
    files.write_table(MetricFlow(spark, sf).graded, root, partition_by=["model", "scenario"])
    return files.read_scenario_results(spark, root).select("model", F.col("scenario").cast("int").alias("scenario"), "student_id",
                                                           "question_id", "test_case_id", "correctness")


@register("scan_scenario_results", _GRADE + "SELECT model, scenario, student_id, question_id, test_case_id, correctness FROM graded WHERE model = 'A' AND scenario = 2", EV)
def scan_scenario_results(spark, sf):
    root = _folder(spark)
    files.write_table(MetricFlow(spark, sf).graded, root, partition_by=["model", "scenario"])
    back = files.read_scenario_results(spark, root)
    sel = back.filter((F.col("model") == "A") & (F.col("scenario") == 2))        # prunes to one folder
    return sel.select("model", F.col("scenario").cast("int").alias("scenario"), "student_id", "question_id", "test_case_id", "correctness")


@register("sink_ratings", _W + """SELECT model, student_id, round(ability, 6) AS ability FROM ab""", ("executions",))
def sink_ratings(spark, sf):
    root = _folder(spark)
    ab, _ = _long(spark, sf)
    files.write_table(ab, f"{root}/ability", partition_by=["model"])
    back = spark.read.parquet(f"{root}/ability")
    return back.select("model", "student_id", r6("ability").alias("ability"))


@register("sink_metrics_json", _LONG + "SELECT scenario, model, metric, round(value, 6) AS value FROM long", CV)
def sink_metrics_json(spark, sf):
    root = _folder(spark)
    files.sink_metrics_json(_metrics_long(spark, sf), root)
    back = spark.read.schema("scenario int, model string, metric string, value double").json(root)
    return back.select("scenario", "model", "metric", r6("value").alias("value"))


@register("rename_suffix", _GRADE + """SELECT scenario, model, student_id, question_id, test_case_id, correctness AS LLM_correctness,
  real_student_correctness FROM joined""", EV)
def rename_suffix(spark, sf):
    j = MetricFlow(spark, sf).joined
    return j.withColumnRenamed("correctness", "LLM_correctness").select(
        "scenario", "model", "student_id", "question_id", "test_case_id", "LLM_correctness", "real_student_correctness")


@register("normalise_keys", """SELECT DISTINCT CAST(split_part(instance_id, '_', 1) AS BIGINT) AS student_id,
  CAST(split_part(instance_id, '_', 2) AS BIGINT) AS question_id FROM completions""", ("completions",))
def normalise_keys(spark, sf):
    c = fixtures(spark, sf).completions
    parts = F.split("instance_id", "_")
    return c.select(parts[0].cast("long").alias("student_id"), parts[1].cast("long").alias("question_id")).distinct()


@register("semi_join_evaluated", _SCEN + """SELECT submission_id, student_id, question_id FROM final f
WHERE response = response_correct AND EXISTS (SELECT 1 FROM executions e WHERE e.student_id = f.student_id AND e.question_id = f.question_id)""", EV)
def semi_join_evaluated(spark, sf):
    f = MetricFlow(spark, sf)
    keys = fixtures(spark, sf).executions.select("student_id", "question_id")
    return f.rows.s4_keys.join(keys, ["student_id", "question_id"], "left_semi").select("submission_id", "student_id", "question_id")


@register("sort_by_time", _SCEN + "SELECT submission_id, pass FROM clean ORDER BY ts, submission_id", SV)
def sort_by_time(spark, sf):
    return Flow(spark, sf).clean.orderBy("ts", "submission_id").select("submission_id", "pass")


@register("sort_within_student", _SCEN + """SELECT student_id, submission_id,
  CAST(row_number() OVER (PARTITION BY student_id ORDER BY ts, submission_id) AS INTEGER) AS seq_in_student FROM latest""", SV)
def sort_within_student(spark, sf):
    w = Window.partitionBy("student_id").orderBy("ts", "submission_id")
    return Flow(spark, sf).latest.select("student_id", "submission_id", F.row_number().over(w).alias("seq_in_student"))
