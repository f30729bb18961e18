"""Registered queries: code text functions, pair distances and similarity metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.functions import text as X
from attemptlab.functions import vectors as V
from attemptlab.operators import attempts as A
from attemptlab.operators import metrics as M
from attemptlab.operators import similarity as S
from attemptlab.plans import oracle_sql as O
from attemptlab.plans.queries_grading import _GRADE, MetricFlow
from attemptlab.registry import fixtures, r6, register

TP = ("text_pairs",)
TPAIR = "SELECT pair_id, left_text, right_text FROM text_pairs"


def _pairs(spark, sf):
    return fixtures(spark, sf).text_pairs


@register("clean_code", f"SELECT pair_id, {O.clean_code('right_text')} AS code FROM text_pairs", TP)
def clean_code(spark, sf):
    return _pairs(spark, sf).select("pair_id", X.clean_code("right_text").alias("code"))


_CPP = " OR ".join(f"contains(right_text, '{s}')" for s in X.CPP_INDICATORS)


@register("is_cpp", f"SELECT pair_id, ({_CPP}) AS is_cpp FROM text_pairs", TP)
def is_cpp(spark, sf):
    return _pairs(spark, sf).select("pair_id", X.is_cpp("right_text").alias("is_cpp"))


@register("tokenise_code", f"""SELECT pair_id, CAST(len({O.tokens(O.clean_code('left_text'))}) AS INTEGER) AS n_tokens,
  array_to_string({O.tokens(O.clean_code('left_text'))}, ' ') AS tokens FROM text_pairs""", TP)
def tokenise_code(spark, sf):
    t = X.tokens(X.clean_code("left_text"))
    return _pairs(spark, sf).select("pair_id", F.size(t).alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@register("token_head", f"SELECT pair_id, array_to_string({O.tokens(O.clean_code('left_text'))}[1:15], ' ') AS head FROM text_pairs", TP)
def token_head(spark, sf):
    return _pairs(spark, sf).select("pair_id", F.array_join(F.slice(X.tokens(X.clean_code("left_text")), 1, 15), " ").alias("head"))


@register("word_count", f"SELECT pair_id, CAST({O.words('left_text')} AS INTEGER) AS n_words FROM text_pairs", TP)
def word_count(spark, sf):
    return _pairs(spark, sf).select("pair_id", X.word_count(X.clean_code("left_text")).alias("n_words"))


_TA = f"list_distinct({O.tokens(O.clean_code('left_text'))})"
_TB = f"list_distinct({O.tokens(O.clean_code('right_text'))})"


@register("token_set_ops", f"""SELECT pair_id, CAST(len(list_intersect({_TA}, {_TB})) AS INTEGER) AS n_common,
  CAST(len(list_distinct(list_concat({_TA}, {_TB}))) AS INTEGER) AS n_union FROM text_pairs""", TP)
def token_set_ops(spark, sf):
    ta = F.array_distinct(X.tokens(X.clean_code("left_text")))
    tb = F.array_distinct(X.tokens(X.clean_code("right_text")))
    return _pairs(spark, sf).select("pair_id", F.size(F.array_intersect(ta, tb)).alias("n_common"),
                                    F.size(F.array_union(ta, tb)).alias("n_union"))


@register("token_jaccard_distance", f"SELECT pair_id, round({O.jaccard('left_text', 'right_text')}, 6) AS jaccard_distance FROM text_pairs", TP)
def token_jaccard_distance(spark, sf):
    j = S.add_jaccard_distance(_pairs(spark, sf), "left_text", "right_text")
    return j.select("pair_id", r6("jaccard_distance").alias("jaccard_distance"))


@register("char_levenshtein", f"""SELECT pair_id, CAST({O.list_levenshtein('a', 'b', 'common')} AS INTEGER) AS levenshtein
FROM (SELECT pair_id, a, b, list_intersect(list_distinct(a), list_distinct(b)) AS common
      FROM (SELECT pair_id, regexp_extract_all(left_text, '(?s).') AS a, regexp_extract_all(right_text, '(?s).') AS b FROM text_pairs))""", TP)
def char_levenshtein(spark, sf):
    return _pairs(spark, sf).select("pair_id", S.char_levenshtein("left_text", "right_text").alias("levenshtein"))


@register("token_tree_distance", "SELECT pair_id, round(ast_edit_distance, 6) AS ast_edit_distance FROM ("
          + O.tree_distance_cte("text_pairs", "left_text", "right_text", "pair_id") + ")", TP)
def token_tree_distance(spark, sf):
    t = S.add_tree_distance(_pairs(spark, sf), "left_text", "right_text")
    return t.select("pair_id", r6("ast_edit_distance").alias("ast_edit_distance"))


@register("token_tf_cosine", "WITH " + O.tf_cosine_ctes("text_pairs", "pair_id", "left_text", "right_text")
          + "\nSELECT pair_id, round(codebert_cosine_similarity, 6) AS cosine FROM cos", TP)
def token_tf_cosine(spark, sf):
    t = S.token_tf_cosine(_pairs(spark, sf), ["pair_id"], "left_text", "right_text", out="cos")
    return t.select("pair_id", r6("cos").alias("cosine"))


@register("vector_cosine", """SELECT left_id, right_id, round(coalesce(CASE WHEN nx > 0 AND ny > 0 THEN xy / (sqrt(nx) * sqrt(ny)) END, 0.0), 6) AS cosine
FROM (SELECT left_id, right_id, list_dot_product(x::DOUBLE[], y::DOUBLE[]) AS xy,
             list_dot_product(x::DOUBLE[], x::DOUBLE[]) AS nx, list_dot_product(y::DOUBLE[], y::DOUBLE[]) AS ny FROM vector_pairs)""",
          ("vector_pairs",))
def vector_cosine(spark, sf):
    vp = fixtures(spark, sf).vector_pairs
    return vp.select("left_id", "right_id", r6(V.vector_cosine("x", "y")).alias("cosine"))


# --- code pairs over the scenario tables ---------------------------------------------

_CODE_PAIRS = r"""comp AS (
  SELECT CAST(split_part(instance_id, '_', 1) AS BIGINT) AS student_id, CAST(split_part(instance_id, '_', 2) AS BIGINT) AS question_id,
         model, text FROM completions WHERE len(string_split(instance_id, '_')) = 2),
code_pairs AS (
  SELECT s.scenario, c.model, c.student_id, c.question_id, c.text AS LLM_response, s.response AS student_response
  FROM comp c JOIN student s ON c.student_id = s.student_id AND c.question_id = s.question_id)"""


def _code_pairs(f: MetricFlow) -> DataFrame:
    ids = X.split_instance_id("instance_id")
    comp = (f.completions.select(ids["student_id"].alias("student_id"), ids["question_id"].alias("question_id"), "model", "text")
            .filter(F.col("student_id").isNotNull() & F.col("question_id").isNotNull()))
    stu = f.student.select("scenario", "student_id", "question_id", A.DIGEST)
    pairs = comp.join(stu, ["student_id", "question_id"], "inner").withColumnRenamed("text", "LLM_response")
    return A.add_text(pairs, f.rows.texts, name="student_response")


_CP = _GRADE.rstrip() + ",\n" + _CODE_PAIRS + "\n"
CV = ("submissions", "questions", "executions", "completions")


@register("join_code_pairs", _CP + "SELECT scenario, model, student_id, question_id, LLM_response, student_response FROM code_pairs", CV)
def join_code_pairs(spark, sf):
    return _code_pairs(MetricFlow(spark, sf)).select("scenario", "model", "student_id", "question_id", "LLM_response", "student_response")


_SIM = (_CP.rstrip() + ",\ntree AS (" + O.tree_distance_cte("code_pairs", "LLM_response", "student_response",
                                                           "scenario, model, student_id, question_id, LLM_response, student_response")
        + "),\n" + O.tf_cosine_ctes("code_pairs", "scenario, model, student_id, question_id", "LLM_response", "student_response") + ",\n"
        + """sim AS (SELECT t.scenario, t.model, t.student_id, t.question_id, t.ast_edit_distance, c.codebert_cosine_similarity
        FROM tree t JOIN cos c USING (scenario, model, student_id, question_id, LLM_response, student_response))\n""")


@register("code_similarity_table", _SIM + """SELECT scenario, model, student_id, question_id, round(ast_edit_distance, 6) AS ast_edit_distance,
  round(codebert_cosine_similarity, 6) AS codebert_cosine_similarity FROM sim""", CV)
def code_similarity_table(spark, sf):
    t = S.code_similarity_table(_code_pairs(MetricFlow(spark, sf)), ["scenario", "model", "student_id", "question_id"])
    return t.select("scenario", "model", "student_id", "question_id", r6("ast_edit_distance").alias("ast_edit_distance"),
                    r6("codebert_cosine_similarity").alias("codebert_cosine_similarity"))


def pair_metrics(f: MetricFlow) -> DataFrame:
    t = S.code_similarity_table(_code_pairs(f), ["scenario", "model", "student_id", "question_id"])
    g = t.groupBy("scenario", "model").agg(F.avg("ast_edit_distance").alias(M.AST_EDIT_DISTANCE),
                                           F.avg("codebert_cosine_similarity").alias(M.CODE_COSINE))
    return g.select("scenario", "model", F.stack(F.lit(2), F.lit(M.AST_EDIT_DISTANCE), F.col(M.AST_EDIT_DISTANCE),
                                                 F.lit(M.CODE_COSINE), F.col(M.CODE_COSINE)).alias("metric", "value"))


@register("mean_code_distance", _SIM + "SELECT scenario, model, round(avg(ast_edit_distance), 6) AS value FROM sim GROUP BY scenario, model", CV)
def mean_code_distance(spark, sf):
    return pair_metrics(MetricFlow(spark, sf)).filter(F.col("metric") == M.AST_EDIT_DISTANCE).select("scenario", "model", r6("value").alias("value"))


@register("mean_code_cosine", _SIM + "SELECT scenario, model, round(avg(codebert_cosine_similarity), 6) AS value FROM sim GROUP BY scenario, model", CV)
def mean_code_cosine(spark, sf):
    return pair_metrics(MetricFlow(spark, sf)).filter(F.col("metric") == M.CODE_COSINE).select("scenario", "model", r6("value").alias("value"))


_LONG = _SIM + f""", long AS (
  SELECT scenario, model, '{M.FUNCTIONAL_CORRECTNESS}' AS metric, avg(correctness) AS value FROM graded GROUP BY scenario, model
  UNION ALL SELECT scenario, model, '{M.CORRECTNESS_ALIGNMENT}', avg(CASE WHEN correctness = real_student_correctness THEN 1 ELSE 0 END)
    FROM valid WHERE scenario >= 2 GROUP BY scenario, model
  UNION ALL SELECT scenario, model, '{M.MISTAKE_ALIGNMENT}', sqrt(avg((lr - sr) * (lr - sr))) FROM (
    SELECT scenario, model, question_id, avg(CASE WHEN correctness = 0 THEN 1 ELSE 0 END) AS lr,
           avg(CASE WHEN real_student_correctness = 0 THEN 1 ELSE 0 END) AS sr
    FROM joined WHERE scenario = 3 GROUP BY scenario, model, question_id) GROUP BY scenario, model
  UNION ALL SELECT 4, m.model, '{M.EFFICIENCY_ALIGNMENT}', avg(try_cast(s.run_time AS DOUBLE) / nullif(try_cast(m.run_time AS DOUBLE), 0))
    FROM executions s JOIN executions m USING (student_id, question_id, test_case_id) WHERE s.model = 'R' AND m.model <> 'R' GROUP BY m.model
  UNION ALL SELECT scenario, model, '{M.AST_EDIT_DISTANCE}', avg(ast_edit_distance) FROM sim WHERE scenario >= 2 GROUP BY scenario, model
  UNION ALL SELECT scenario, model, '{M.CODE_COSINE}', avg(codebert_cosine_similarity) FROM sim WHERE scenario >= 2 GROUP BY scenario, model)
"""


def _metrics_long(spark, sf) -> DataFrame:
    f = MetricFlow(spark, sf).held()        # made once: grading, verification, run times and code pairs all read them
    return M.scenario_metrics(f.graded, f.student, pair_metrics=pair_metrics(f), student_results=f.student_results)


@register("scenario_metrics", _LONG + "SELECT scenario, model, metric, round(value, 6) AS value FROM long", CV)
def scenario_metrics(spark, sf):
    return _metrics_long(spark, sf).select("scenario", "model", "metric", r6("value").alias("value"))


@register("union_models", _LONG + "SELECT model, CAST(count(*) AS BIGINT) AS n_metrics FROM long GROUP BY model", CV)
def union_models(spark, sf):
    return _metrics_long(spark, sf).groupBy("model").agg(F.count(F.lit(1)).alias("n_metrics"))


@register("alignment_and_similarity", _LONG + f"""SELECT scenario, model, metric, round(value, 6) AS value FROM long
WHERE metric IN ('{M.CORRECTNESS_ALIGNMENT}', '{M.AST_EDIT_DISTANCE}', '{M.CODE_COSINE}')""", CV)
def alignment_and_similarity(spark, sf):
    keep = [M.CORRECTNESS_ALIGNMENT, M.AST_EDIT_DISTANCE, M.CODE_COSINE]
    return _metrics_long(spark, sf).filter(F.col("metric").isin(keep)).select("scenario", "model", "metric", r6("value").alias("value"))


@register("metrics_matrix", _LONG + "SELECT scenario, model, " + ", ".join(
    f"round(max(value) FILTER (WHERE metric = '{m}'), 6) AS {m}" for m in M.METRIC_ORDER) + " FROM long GROUP BY scenario, model", CV)
def metrics_matrix(spark, sf):
    w = M.metrics_matrix(_metrics_long(spark, sf))
    return w.select("scenario", "model", *[r6(m).alias(m) for m in M.METRIC_ORDER])
