"""Scenario metrics as one long table (scenario, model, metric, value).

The reference loops over models and scenarios on the driver; here both are
columns and every metric is one grouped aggregation over all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.operators import grading as G

# Metric names as the reference reports them (including its spelling).
FUNCTIONAL_CORRECTNESS = "functional_correctnes"
CORRECTNESS_ALIGNMENT = "correctness_alignment"
AST_EDIT_DISTANCE = "ast_edit_distance"
CODE_COSINE = "codebert_cosine_similarity"
MISTAKE_ALIGNMENT = "mistake_alignment"
EFFICIENCY_ALIGNMENT = "efficiency_alignment"
METRIC_ORDER = [FUNCTIONAL_CORRECTNESS, CORRECTNESS_ALIGNMENT, AST_EDIT_DISTANCE, CODE_COSINE,
                MISTAKE_ALIGNMENT, EFFICIENCY_ALIGNMENT]
# Which metrics each scenario reports.
SCENARIO_METRICS = {
    1: [FUNCTIONAL_CORRECTNESS],
    2: [FUNCTIONAL_CORRECTNESS, CORRECTNESS_ALIGNMENT, AST_EDIT_DISTANCE, CODE_COSINE],
    3: [FUNCTIONAL_CORRECTNESS, CORRECTNESS_ALIGNMENT, AST_EDIT_DISTANCE, CODE_COSINE, MISTAKE_ALIGNMENT],
    4: [FUNCTIONAL_CORRECTNESS, CORRECTNESS_ALIGNMENT, AST_EDIT_DISTANCE, CODE_COSINE, EFFICIENCY_ALIGNMENT],
}
GROUP = ["scenario", "model"]


def _long(df: DataFrame, metric: str, value: str = "value") -> DataFrame:
    return df.select(*GROUP, F.lit(metric).alias("metric"), F.col(value).cast("double").alias("value"))


def functional_correctness(graded: DataFrame) -> DataFrame:
    """Mean correctness over all test cases (micro average) per (scenario, model)."""
    return graded.groupBy(*GROUP).agg(F.avg("correctness").alias("value"))


def correctness_alignment(valid: DataFrame) -> DataFrame:
    eq = (F.col("correctness") == F.col("real_student_correctness")).cast("int")
    return valid.groupBy(*GROUP).agg(F.avg(eq).alias("value"))


def question_mistake_rates(joined: DataFrame) -> DataFrame:
    """Per question: share of model zeros and of student zeros (a null counts as not zero)."""
    z = lambda c: F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))
    return joined.groupBy(*GROUP, "question_id").agg(
        F.avg(z("correctness")).alias("LLM_question_mistake_prop"),
        F.avg(z("real_student_correctness")).alias("student_question_mistake_prop"))


def mistake_alignment_rmse(joined: DataFrame) -> DataFrame:
    d = F.col("LLM_question_mistake_prop") - F.col("student_question_mistake_prop")
    return question_mistake_rates(joined).groupBy(*GROUP).agg(F.sqrt(F.avg(d * d)).alias("value"))


def verified_metrics(joined: DataFrame) -> DataFrame:
    """Correctness alignment (scenarios from 2 on) and mistake RMSE (scenario 3), long, from one pass.

    The joined rows are summed per question once; both metrics roll these few rows up.
    """
    zero = lambda c: F.count_if(F.col(c) == 0).cast("double")
    both = F.col("correctness").isin(0, 1) & F.col("real_student_correctness").isin(0, 1)
    each = joined.filter(F.col("scenario") >= 2).groupBy(*GROUP, "question_id").agg(
        F.count(F.lit(1)).alias("_n"), zero("correctness").alias("_m0"), zero("real_student_correctness").alias("_s0"),
        F.count_if(both).alias("_valid"),
        F.count_if(both & (F.col("correctness") == F.col("real_student_correctness"))).alias("_same"))
    gap = (F.col("_m0") - F.col("_s0")) / F.col("_n")
    rolled = each.groupBy(*GROUP).agg(
        F.try_divide(F.sum("_same").cast("double"), F.sum("_valid")).alias("_align"),
        F.when(F.col("scenario") == 3, F.sqrt(F.avg(gap * gap))).alias("_rmse"))
    return (rolled.select(*GROUP, F.stack(F.lit(2), F.lit(CORRECTNESS_ALIGNMENT), F.col("_align"),
                                          F.lit(MISTAKE_ALIGNMENT), F.col("_rmse")).alias("metric", "value"))
            .filter(F.col("value").isNotNull()))


def efficiency_alignment(model_results: DataFrame, student_results: DataFrame) -> DataFrame:
    """Mean of student_time / model_time where both parse as numbers (a zero model time gives null)."""
    keys = [k for k in ["scenario"] if k in model_results.columns and k in student_results.columns] + G.KEYS3
    group = [c for c in GROUP if c in model_results.columns]
    extra = [c for c in group if c not in keys]
    s = student_results.select(*keys, G.to_numeric("run_time").alias("student_rt_num"))
    m = model_results.select(*keys, *extra, G.to_numeric("run_time").alias("LLM_rt_num"))
    ratio = F.try_divide(F.col("student_rt_num"), F.when(F.col("LLM_rt_num") != 0, F.col("LLM_rt_num")))
    return s.join(m, keys, "inner").groupBy(*group).agg(F.avg(ratio).alias("value"))


def completion_success(completions: DataFrame, group=("model",)) -> DataFrame:
    from attemptlab.functions.text import is_error_completion
    return completions.groupBy(*group).agg(
        F.count_if(~is_error_completion("text")).alias("successes"), F.count(F.lit(1)).alias("total"))


def scenario_metrics(graded: DataFrame, student: DataFrame, pair_metrics: DataFrame | None = None,
                     student_results: DataFrame | None = None) -> DataFrame:
    """All metrics of all (scenario, model) pairs as one long table.

    ``graded``: graded execution rows with ``scenario`` and ``model``.
    ``student``: scenario student rows with ``scenario`` (pass strings, tests).
    ``pair_metrics``: optional (scenario, model, metric, value) from code similarity.
    ``student_results``: optional student execution rows (scenario 4 efficiency).
    A scenario outside 1-4 raises, as in the reference.
    """
    joined, _ = G.verify_results(graded, student)
    parts = [_long(functional_correctness(graded), FUNCTIONAL_CORRECTNESS), verified_metrics(joined)]
    if student_results is not None:
        parts.append(_long(efficiency_alignment(graded.filter(F.col("scenario") == 4), student_results),
                           EFFICIENCY_ALIGNMENT))
    if pair_metrics is not None:
        parts.append(pair_metrics.filter(F.col("scenario") >= 2).select(*GROUP, "metric", F.col("value").cast("double")))
    out = reduce(DataFrame.unionByName, parts)
    bad = F.raise_error(F.concat(F.lit("Scenario "), F.col("scenario").cast("string"), F.lit(" is not implemented.")))
    return out.withColumn("scenario", F.when(F.col("scenario").between(1, 4), F.col("scenario")).otherwise(bad))


def metrics_matrix(long: DataFrame) -> DataFrame:
    """Wide (scenario, model) x metric table; metric columns in the reference's order."""
    return long.groupBy(*GROUP).pivot("metric", METRIC_ORDER).agg(F.first("value"))
