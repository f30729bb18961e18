"""Registered queries: rating folds, correlations and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlab.functions.vectors import logistic_p
from attemptlab.operators import grading as G
from attemptlab.operators import ratings as R
from attemptlab.operators import stats as ST
from attemptlab.registry import fixtures, r6, register

EV = ("executions",)
MODELS = ["A", "N", "R"]
TRUTH = "R"
BATCHES = [0, 1, 2, 3]      # question groups, in the order in which they are rated

_ROWS = """g AS (SELECT model, student_id, question_id, test_case_id,
  CASE WHEN coalesce(regexp_replace(stdout, '^\\s+|\\s+$', '', 'g') = expected_output, false) THEN 1 ELSE 0 END AS y FROM executions),
rows AS (SELECT model, CAST(student_id AS VARCHAR) AS student_id, CAST(question_id AS VARCHAR) || '_' || CAST(test_case_id AS VARCHAR) AS item_id,
  CAST(y AS DOUBLE) AS y, question_id % 4 AS batch, question_id, test_case_id FROM g WHERE test_case_id IS NOT NULL),
ab AS (SELECT model, student_id, avg(y) AS ability FROM rows GROUP BY model, student_id),
di AS (SELECT model, item_id, 1 - avg(y) AS difficulty FROM rows GROUP BY model, item_id)"""
_W = "WITH " + _ROWS + "\n"


def _stream(spark, sf):
    g = G.grade_exact_match(fixtures(spark, sf).executions)
    s = R.rating_stream(g)
    return s.select("model", F.col("student_id").cast("string").alias("student_id"), "item_id",
                    F.col("y").cast("double").alias("y"), (F.col("question_id") % 4).alias("batch"), "question_id", "test_case_id")


def _long(spark, sf):
    s = _stream(spark, sf)
    ab = s.groupBy("model", "student_id").agg(F.avg("y").alias("ability"))
    di = s.groupBy("model", "item_id").agg((1 - F.avg("y")).alias("difficulty"))
    return ab, di


@register("composite_item_id", """SELECT model, student_id, question_id, test_case_id,
  CASE WHEN test_case_id IS NULL THEN NULL ELSE CAST(question_id AS VARCHAR) || '_' || CAST(test_case_id AS VARCHAR) END AS item_id
FROM executions""", EV)
def composite_item_id(spark, sf):
    ex = fixtures(spark, sf).executions
    item = F.when(F.col("test_case_id").isNotNull(), F.concat_ws("_", F.col("question_id").cast("string"), F.col("test_case_id").cast("string")))
    return ex.select("model", "student_id", "question_id", "test_case_id", item.alias("item_id"))


@register("logistic_p", _W + """SELECT r.model, r.student_id, r.item_id, round(1 / (1 + exp(-(a.ability - d.difficulty))), 6) AS p
FROM rows r JOIN ab a USING (model, student_id) JOIN di d USING (model, item_id)""", EV)
def logistic(spark, sf):
    s = _stream(spark, sf)
    ab, di = _long(spark, sf)
    j = s.join(ab, ["model", "student_id"]).join(di, ["model", "item_id"])
    return j.select("model", "student_id", "item_id", r6(logistic_p("ability", "difficulty")).alias("p"))


@register("rasch_update", _W + """SELECT r.model, r.student_id, r.item_id,
  round(a.ability + 0.4 * (r.y - 1 / (1 + exp(-(a.ability - d.difficulty)))), 6) AS theta_new,
  round(d.difficulty - 0.4 * (r.y - 1 / (1 + exp(-(a.ability - d.difficulty)))), 6) AS z_new
FROM rows r JOIN ab a USING (model, student_id) JOIN di d USING (model, item_id)""", EV)
def rasch_update(spark, sf):
    s = _stream(spark, sf)
    ab, di = _long(spark, sf)
    j = s.join(ab, ["model", "student_id"]).join(di, ["model", "item_id"])
    th, z = R.rasch_update(F.col("ability"), F.col("difficulty"), F.col("y"))
    return j.select("model", "student_id", "item_id", r6(th).alias("theta_new"), r6(z).alias("z_new"))


@register("default_rating", _W + """SELECT r.model, r.student_id, r.item_id, r.batch, round(coalesce(a.ability, 0.0), 6) AS theta
FROM rows r LEFT JOIN (SELECT model, student_id, avg(y) AS ability FROM rows WHERE batch = 0 GROUP BY model, student_id) a
  USING (model, student_id)""", EV)
def default_rating(spark, sf):
    # ratings known after the first batch; a student without first-batch rows starts at the default
    s = _stream(spark, sf)
    known = s.filter(F.col("batch") == 0).groupBy("model", "student_id").agg(F.avg("y").alias("ability"))
    j = s.join(known, ["model", "student_id"], "left")
    return j.select("model", "student_id", "item_id", "batch", r6(R.default_rating(F.col("ability"))).alias("theta"))


def _waves_sql(batches: int, rounds: int) -> str:
    """CTE ``waves``: the rows with a batch of neighbouring levels (running maxima over students and items in turn)."""
    parts = ["l0 AS (SELECT model, student_id, item_id, y, question_id, 0 AS level FROM rows)"]
    for k, id_col in enumerate(["student_id", "item_id"] * rounds):
        order = f"PARTITION BY model, {id_col} ORDER BY question_id, student_id, item_id, y, level"
        parts.append(f"""l{k + 1} AS MATERIALIZED (SELECT * EXCLUDE (level, j), j + max(level - j) OVER
  (PARTITION BY model, {id_col} ORDER BY j ROWS UNBOUNDED PRECEDING) AS level
  FROM (SELECT *, row_number() OVER ({order}) AS j FROM l{k}))""")
    parts.append(f"""waves AS MATERIALIZED (SELECT *, CAST(least(floor(level * {batches} / (max(level) OVER (PARTITION BY model) + 1)),
  {batches - 1}) AS INTEGER) AS batch FROM l{2 * rounds})""")
    return ",\n".join(parts)


def _elo_sql(n_batches: int, source: str = "rows", more: str = "") -> str:
    parts = [_ROWS, *([more] if more else []),
             "ab0 AS (SELECT NULL::VARCHAR AS model, NULL::VARCHAR AS student_id, NULL::DOUBLE AS ability WHERE false)",
             "di0 AS (SELECT NULL::VARCHAR AS model, NULL::VARCHAR AS item_id, NULL::DOUBLE AS difficulty WHERE false)"]
    step = "0.4 * sum(e) / (1 + 0.4 * sum(p * (1 - p)) * (count(*) - 1) / count(*))"
    for b in range(n_batches):
        parts.append(f"""j{b} AS (SELECT r.model, r.student_id, r.item_id,
  r.y - 1 / (1 + exp(-(coalesce(a.ability, 0.0) - coalesce(d.difficulty, 0.0)))) AS e,
  1 / (1 + exp(-(coalesce(a.ability, 0.0) - coalesce(d.difficulty, 0.0)))) AS p
  FROM {source} r LEFT JOIN ab{b} a USING (model, student_id) LEFT JOIN di{b} d USING (model, item_id) WHERE r.batch = {b})""")
        parts.append(f"""ab{b + 1} AS (SELECT model, student_id, coalesce(a.ability, 0.0) + coalesce(s.d, 0.0) AS ability
  FROM ab{b} a FULL OUTER JOIN (SELECT model, student_id, {step} AS d FROM j{b} GROUP BY model, student_id) s USING (model, student_id))""")
        parts.append(f"""di{b + 1} AS (SELECT model, item_id, coalesce(a.difficulty, 0.0) - coalesce(s.d, 0.0) AS difficulty
  FROM di{b} a FULL OUTER JOIN (SELECT model, item_id, {step} AS d FROM j{b} GROUP BY model, item_id) s USING (model, item_id))""")
    n = n_batches
    return ("WITH " + ",\n".join(parts) + f"""
SELECT model, 'student' AS kind, student_id AS id, round(ability, 6) AS rating FROM ab{n}
UNION ALL SELECT model, 'item', item_id, round(difficulty, 6) FROM di{n}""")


def _ratings_long(ab, di):
    return (ab.select("model", F.lit("student").alias("kind"), F.col("student_id").alias("id"), r6("ability").alias("rating"))
            .unionByName(di.select("model", F.lit("item").alias("kind"), F.col("item_id").alias("id"), r6("difficulty").alias("rating"))))


@register("elo_minibatch", _elo_sql(4), EV)
def elo_minibatch(spark, sf):
    ab, di = R.elo_minibatch(_stream(spark, sf), "batch", BATCHES)
    return _ratings_long(ab, di)


def _wave_stream(spark, sf, batches):
    return R.wave_batches(_stream(spark, sf).drop("batch"), ["question_id"], batches)


@register("wave_batches", "WITH " + _ROWS + ",\n" + _waves_sql(8, 2) + """
SELECT model, student_id, item_id, y, batch FROM waves""", EV)
def wave_batches(spark, sf):
    return _wave_stream(spark, sf, 8).select("model", "student_id", "item_id", "y", "batch")


@register("elo_waves", _elo_sql(8, "waves", _waves_sql(8, 2)), EV)
def elo_waves(spark, sf):
    """The rating fold over eight batches along the order of the rows."""
    ab, di = R.elo_minibatch(_wave_stream(spark, sf, 8), "batch", list(range(8)))
    return _ratings_long(ab, di)


@register("union_scenarios", """SELECT scenario, model, student_id, question_id, test_case_id
FROM (SELECT unnest([2, 3, 4]) AS scenario, * FROM executions)""", EV)
def union_scenarios(spark, sf):
    ex = fixtures(spark, sf).executions
    u = R.union_scenarios({s: ex for s in (2, 3, 4)}, ["student_id", "question_id", "test_case_id"])
    return u.select("scenario", "model", "student_id", "question_id", "test_case_id")


@register("scan_ratings_projected", _W + "SELECT student_id, round(ability, 6) AS ability_A FROM ab WHERE model = 'A'", EV)
def scan_ratings_projected(spark, sf):
    ab, _ = _long(spark, sf)
    p = R.scan_ratings_projected(ab.filter(F.col("model") == "A"), "student_id", "ability", "A")
    return p.select("student_id", r6("ability_A").alias("ability_A"))


_WIDE = _W.rstrip() + """,
wide AS (SELECT student_id, max(ability) FILTER (WHERE model = 'A') AS ability_A, max(ability) FILTER (WHERE model = 'N') AS ability_N,
                max(ability) FILTER (WHERE model = 'R') AS ability_R FROM ab GROUP BY student_id)
"""


@register("outer_merge_models", _WIDE + "SELECT student_id, round(ability_A, 6) AS ability_A, round(ability_N, 6) AS ability_N, round(ability_R, 6) AS ability_R FROM wide", EV)
def outer_merge_models(spark, sf):
    ab, _ = _long(spark, sf)
    w = R.outer_merge_models(ab, "student_id", "ability", MODELS)
    return w.select("student_id", *[r6(f"ability_{m}").alias(f"ability_{m}") for m in MODELS])


@register("select_by_prefix", _WIDE + "SELECT student_id, round(ability_A, 6) AS ability_A, round(ability_N, 6) AS ability_N FROM wide", EV)
def select_by_prefix(spark, sf):
    ab, _ = _long(spark, sf)
    w = R.outer_merge_models(ab, "student_id", "ability", MODELS)
    cols = [c for c in w.columns if c.startswith("ability_") and c != f"ability_{TRUTH}"]
    return w.select("student_id", *[r6(c).alias(c) for c in cols])


_PAIRS = _W.rstrip() + """,
pairs AS (SELECT e.model, item_id, t.difficulty AS truth, e.difficulty AS est FROM di e JOIN di t USING (item_id)
          WHERE t.model = 'R' AND e.model <> 'R' AND t.difficulty IS NOT NULL AND e.difficulty IS NOT NULL),
apairs AS (SELECT e.model, student_id, t.ability AS truth, e.ability AS est FROM ab e JOIN ab t USING (student_id)
           WHERE t.model = 'R' AND e.model <> 'R' AND t.ability IS NOT NULL AND e.ability IS NOT NULL),
ranked AS (SELECT model, truth, est,
  rank() OVER (PARTITION BY model ORDER BY truth) + (count(*) OVER (PARTITION BY model, truth) - 1) / 2.0 AS rt,
  rank() OVER (PARTITION BY model ORDER BY est) + (count(*) OVER (PARTITION BY model, est) - 1) / 2.0 AS re FROM pairs)
"""


def _pearson_sql(x, y):
    return f"round(CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END, 6)"


@register("pairwise_complete", _PAIRS + "SELECT model, item_id FROM pairs", EV)
def pairwise_complete(spark, sf):
    _, di = _long(spark, sf)
    t = di.filter(F.col("model") == TRUTH).select("item_id", F.col("difficulty").alias("truth"))
    e = di.filter(F.col("model") != TRUTH).select("model", "item_id", F.col("difficulty").alias("est"))
    return R.pairwise_complete(e.join(t, "item_id"), "truth", "est").select("model", "item_id")


@register("model_pearson", _PAIRS + f"SELECT model, {_pearson_sql('truth', 'est')} AS ability_pearson FROM apairs GROUP BY model", EV)
def model_pearson(spark, sf):
    ab, _ = _long(spark, sf)
    c = R.model_correlations(ab, "student_id", "ability", TRUTH)
    return c.select("model", r6("ability_pearson").alias("ability_pearson"))


@register("model_spearman", _PAIRS + f"SELECT model, {_pearson_sql('rt', 're')} AS difficulty_spearman FROM ranked GROUP BY model", EV)
def model_spearman(spark, sf):
    _, di = _long(spark, sf)
    c = R.model_correlations(di, "item_id", "difficulty", TRUTH, spearman=True)
    return c.select("model", r6("difficulty_spearman").alias("difficulty_spearman"))


@register("correlation_report", _PAIRS + f"""SELECT model, a.ability_pearson, d.difficulty_pearson, s.difficulty_spearman
FROM (SELECT model, {_pearson_sql('truth', 'est')} AS ability_pearson FROM apairs GROUP BY model) a
FULL OUTER JOIN (SELECT model, {_pearson_sql('truth', 'est')} AS difficulty_pearson FROM pairs GROUP BY model) d USING (model)
FULL OUTER JOIN (SELECT model, {_pearson_sql('rt', 're')} AS difficulty_spearman FROM ranked GROUP BY model) s USING (model)""", EV)
def correlation_report(spark, sf):
    ab, di = _long(spark, sf)
    c = R.correlation_report(ab, di, truth_student=TRUTH, truth_item=TRUTH)
    return c.select("model", *[r6(x).alias(x) for x in ("ability_pearson", "difficulty_pearson", "difficulty_spearman")])


@register("average_rank", _W + """SELECT DISTINCT model, round(difficulty, 6) AS difficulty,
  rank() OVER (PARTITION BY model ORDER BY difficulty) + (count(*) OVER (PARTITION BY model, difficulty) - 1) / 2.0 AS avg_rank FROM di""", EV)
def average_rank(spark, sf):
    _, di = _long(spark, sf)
    r = ST.value_ranks(di, ["model"], "difficulty")
    return r.select("model", r6("difficulty").alias("difficulty"), "avg_rank")
