"""End-to-end flows over user files (the stages of the original workflow).

1. ``scenario_tables``  – raw log + catalogue -> Scenario1..4 and Questions tables.
2. ``prompt_tables``    – scenario tables -> prompts of every scenario; ``completion_report`` adds what the models returned.
3. ``metrics_report``   – graded execution results + scenario tables + completions -> long metric table;
   ``metrics_from_files`` reads results and completion files and writes the table as JSON.
4. ``ratings_report``   – graded results -> abilities, difficulties and correlations with the truth.
5. ``testlet_report``   – response log -> fit, AUC on held-out rows, person fit, effect and item tables.
Each flow is one Spark DAG per output; tables are written with the sinks in ``sources.files``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attemptlab.operators import attempts as A
from attemptlab.operators import grading as G
from attemptlab.operators import metrics as M
from attemptlab.operators import prompts as P
from attemptlab.operators import ratings as R
from attemptlab.operators import similarity as S
from attemptlab.operators import stats as ST
from attemptlab.operators import testlet as TL
from attemptlab.sources import files


def scenario_tables(spark: SparkSession, submissions_path: str, questions_path: str, out_root: str | None = None,
                    fmt: str = "csv") -> dict[str, DataFrame]:
    subs = files.read_submissions(spark, submissions_path, fmt)
    qs = files.read_questions(spark, questions_path, fmt)
    rows = A.ScenarioRows(A.clean_submissions(subs), qs)
    if out_root:
        held = rows.held()
        try:
            files.sink_scenarios(held.tables(), out_root, fmt)
        finally:
            held.release()
    return rows.tables()


def topic_profile(tables: dict[str, DataFrame], clean: DataFrame) -> DataFrame:
    """Pass rates per student and topic over all cleaned attempts."""
    return A.student_topic_profile(A.join_questions(clean, tables["Questions"]))


def prompt_tables(tables: dict[str, DataFrame], profile: DataFrame, out_root: str | None = None,
                  fmt: str = "parquet") -> dict[str, DataFrame]:
    """Prompts of scenario 1 (per question) and of scenarios 2-4 (per student and target attempt)."""
    out = {"Scenario1": P.scenario1_prompts(tables["Scenario1"])}
    for n in (2, 3, 4):
        out[f"Scenario{n}"] = P.scenario234_prompts(tables[f"Scenario{n}"], profile, n)
    if out_root:
        for name, df in out.items():
            files.write_table(df if fmt == "parquet" else df.withColumn("test_cases", F.to_json("test_cases")),
                              f"{out_root}/{name}_prompts", fmt)
    return out


def completion_report(prompts: DataFrame, completions: DataFrame, models: list[str],
                      keys=("student_id", "question_id")) -> tuple[DataFrame, DataFrame]:
    """(completion table, successes and totals per model) for prompts and what came back for them."""
    table = P.completion_table(prompts.select(*keys).distinct(), completions, models, keys)
    return table, M.completion_success(table)


def student_table(tables: dict[str, DataFrame]) -> DataFrame:
    cols = ["student_id", F.col("question_id"), "pass", "question_unittests", "response"]
    return reduce(DataFrame.unionByName, [tables[f"Scenario{n}"].select(F.lit(n).alias("scenario"), *cols) for n in (2, 3, 4)])


def metrics_report(results: DataFrame, tables: dict[str, DataFrame], completions: DataFrame | None = None,
                   student_results: DataFrame | None = None, out_path: str | None = None) -> DataFrame:
    """``results``: execution rows with model and scenario; ``completions``: (scenario, model, student_id, question_id, text)."""
    graded = G.grade_exact_match(results)
    student = student_table(tables)
    pair = None
    if completions is not None:
        stu = student.select("scenario", "student_id", "question_id", F.col("response").alias("student_response"))
        pairs = completions.withColumnRenamed("text", "LLM_response").join(stu, ["scenario", "student_id", "question_id"])
        sims = S.code_similarity_table(pairs, ["scenario", "model", "student_id", "question_id"])
        g = sims.groupBy("scenario", "model").agg(F.avg("ast_edit_distance").alias("d"),
                                                  F.avg("codebert_cosine_similarity").alias("c"))
        pair = g.select("scenario", "model", F.stack(F.lit(2), F.lit(M.AST_EDIT_DISTANCE), "d", F.lit(M.CODE_COSINE), "c")
                        .alias("metric", "value"))
    long = M.scenario_metrics(graded, student, pair_metrics=pair, student_results=student_results)
    if out_path:
        files.sink_metrics_json(long, out_path)
    return long


def metrics_from_files(spark: SparkSession, results_root: str, tables: dict[str, DataFrame], completions_path: str | None = None,
                       scenario: int | None = None, model: str | None = None, student_results: DataFrame | None = None,
                       out_path: str | None = None, lines: bool = False) -> DataFrame:
    """Metric table from stored (model, scenario) results and, for one scenario and model, its completion files.

    Code similarity compares only attempts that were evaluated: scenario 4 rows without an execution result of
    the same student and question are left out.
    """
    results = files.read_scenario_results(spark, results_root).withColumn("scenario", F.col("scenario").cast("int"))
    done = results.select("scenario", "student_id", "question_id").distinct()
    evaluated = dict(tables)
    keys = ["student_id", "question_id"]
    evaluated["Scenario4"] = tables["Scenario4"].join(done.filter("scenario = 4").select(*keys), keys, "left_semi")
    completions = None
    if completions_path is not None:
        texts = files.read_completions_json(spark, completions_path, lines=lines)
        completions = texts.select(F.lit(scenario).alias("scenario"), F.lit(model).alias("model"), *keys, "text")
    return metrics_report(results, evaluated, completions, student_results, out_path)


def ratings_report(graded: DataFrame, batch_col: str, batches: list, truth_student: str, truth_item: str,
                   out_root: str | None = None):
    """(ability, difficulty, correlations) by the mini-batch fold over ``batches`` in the given order.

    ``stack_scenarios`` gives scenarios 2-4 in order with a batch number.  With ``out_root`` the rating tables are
    written per model, the correlations as JSON.
    """
    ab, di = R.elo_minibatch(R.rating_stream(graded), batch_col, batches)
    report = R.correlation_report(ab, di, truth_student, truth_item)
    if out_root:
        files.write_table(ab, f"{out_root}/ability", partition_by=["model"])
        files.write_table(di, f"{out_root}/difficulty", partition_by=["model"])
        files.write_table(report.coalesce(1), f"{out_root}/correlations", "json")     # one row per model
    return ab, di, report


def stack_scenarios(graded: dict[int, DataFrame], parts: int, by: str = "question_id") -> tuple[DataFrame, list[int]]:
    """Graded rows of several scenarios with a ``batch`` along scenario and ``by``, and the list of batches."""
    order = sorted(graded)
    rows = R.union_scenarios(graded, [by]).drop("seq")
    place = F.element_at(F.create_map(*[F.lit(x) for i, n in enumerate(order) for x in (n, i)]), F.col("scenario"))
    batch = (place * parts + F.pmod(F.col(by), F.lit(parts))).cast("int")
    return rows.withColumn("batch", batch), list(range(len(order) * parts))


def testlet_report(responses: DataFrame, subset: bool = False):
    """Fit on the train split of first attempts; AUC on the test split; person fit on train.

    The whole log is used; ``subset=True`` asks for the quick run on a third of the testlets and a tenth of the
    students.
    """
    df = TL.split_testlet_item(responses)
    if subset:
        df = TL.id_subset_groups(TL.id_subset_groups(df, TL.TT, TL.N_TESTLET_GROUPS), TL.S, TL.N_STUDENT_GROUPS)
    first = TL.train_test_label(TL.first_attempt_only(df), [TL.S, TL.I, "T"])
    train = first.filter(F.col("split") == "train")
    test = first.filter(F.col("split") == "test")
    b, eff = TL.fit_testlet_model(train.select(TL.S, TL.I, "T", TL.Y))
    pred_test = TL.testlet_predict(test, eff["student"], eff["item"], eff["testlet"], intercept=b)
    pred_train = TL.testlet_predict(train, eff["student"], eff["item"], eff["testlet"], intercept=b)
    points, line = TL.testlet_effect_vs_correctness(eff["testlet"], first)
    ranges = TL.testlet_difficulty_range(eff["item"])
    return {
        "intercept": b,
        "effects": eff,
        "auc": ST.roc_auc(pred_test, "p_hat", TL.Y),
        "roc": ST.roc_curve(pred_test, "p_hat", TL.Y),
        "person_fit": TL.person_fit_ranked(TL.person_fit(pred_train)),
        "adjusted": TL.testlet_adjusted_difficulty(eff["item"], eff["testlet"]),
        "ranges": ranges,
        "widest_and_narrowest": TL.testlet_range_topk(ranges),
        "varying_items": TL.varying_items(TL.latest_attempt_ties(df)),
        "effect_vs_correctness": points,
        "effect_vs_correctness_line": line,
        "items_by_testlet": TL.item_difficulty_by_testlet(eff["item"]),
        "testlet_order": TL.testlet_mean_difficulty(eff["item"]).orderBy("mean_difficulty", TL.TT),
    }
