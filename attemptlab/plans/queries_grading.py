"""Registered queries: test-spec parsing, grading, verification and scenario metrics."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.functions import text as X
from attemptlab.operators import attempts as A
from attemptlab.operators import grading as G
from attemptlab.operators import metrics as M
from attemptlab.plans import oracle_sql as O
from attemptlab.plans.queries_attempts import Flow
from attemptlab.registry import cached_flow, fixtures, r6, register
from attemptlab.session import stored

SV = ("submissions", "questions")
EV = ("submissions", "questions", "executions")
_SCEN = O.ctes(O.SUBS, O.QS, O.CLEAN, O.MERGED, O.MIXED, O.ALIGN, O.LATEST)
_GRADE = _SCEN.rstrip() + ",\n" + ",\n".join([O.STUDENT, O.GRADED, O.DIGITS, O.JOINED]) + "\n"


class MetricFlow:
    """Scenario tables plus graded model results for scenarios 1-4 (built on first use)."""

    def __new__(cls, spark, sf_dir):
        return cached_flow(_MetricFlow, spark, sf_dir)


class _MetricFlow:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.base = Flow(spark, sf_dir)
        self.fx = fixtures(spark, sf_dir)

    def __getattr__(self, name):
        return getattr(self.base, name)

    def held(self) -> _MetricFlow:
        """The same flow over execution and student rows that are stored now, for metrics that read them several times.

        They are merged, not broadcast: the size of their files tells little about their size in memory.
        """
        out = _MetricFlow(self.spark, self.sf_dir)
        out.executions = stored(self.executions, "executions").hint("merge")
        out.student = stored(self.student, "student-rows").hint("merge")
        return out

    @cached_property
    def executions(self):
        return self.fx.executions

    @cached_property
    def student(self):
        """Rows of scenarios 2-4 with the digest of the response."""
        cols = ["student_id", "question_id", "pass", "question_unittests", A.DIGEST]
        b = self.base
        # scenarios 3 and 4 are two filters of the same aligned rows: one pass tags each row with
        # the scenarios it belongs to (a row may be in both when mistake and fix texts are equal)
        tags = F.filter(F.array(F.when(F.col(A.DIGEST) == F.col(A.MISTAKE), F.lit(3)),
                                F.when(F.col(A.DIGEST) == F.col(A.CORRECT), F.lit(4))),
                        lambda x: x.isNotNull())
        tagged = b.rows.aligned_keys.select(F.explode(tags).alias("scenario"), "student_id", "question_unittest_id", "pass", A.DIGEST)
        s34 = A.add_questions(tagged, b.qs).select("scenario", *cols)
        return b.rows.latest_keys.select(F.lit(2).alias("scenario"), *cols).unionByName(s34)

    @cached_property
    def results(self):
        ex = self.executions
        models = ex.filter(F.col("model") != "R")
        return models.select(F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("scenario"), *ex.columns)

    @cached_property
    def graded(self):
        return G.grade_exact_match(self.results)

    @cached_property
    def student_results(self):
        ex = self.executions
        return ex.filter(F.col("model") == "R").select(F.lit(4).alias("scenario"), *ex.columns)

    @cached_property
    def _verified(self):
        return G.verify_results(self.graded, self.student)

    @property
    def joined(self):
        return self._verified[0]

    @property
    def valid(self):
        return self._verified[1]

    @property
    def completions(self):
        return self.fx.completions


# --- text parsing -----------------------------------------------------------------

@register("count_tests", O.ctes(O.QS) + f"SELECT question_id, {O.count_tests('question_unittests')} AS num_unittest FROM qs", SV)
def count_tests(spark, sf):
    return Flow(spark, sf).qs.select("question_id", X.count_tests("question_unittests").alias("num_unittest"))


_LEN_BLOCKS = O.ctes(O.QS) + r"""
SELECT question_id, CAST(idx - 1 AS INTEGER) AS pos, nums[idx] AS unittest,
  regexp_replace(regexp_extract(body, '(?s)^\s*Input:\s*(.*?)\s*Output:\s*(.*)$', 1), '^\s+|\s+$', '', 'g') AS input,
  regexp_replace(regexp_extract(body, '(?s)^\s*Input:\s*(.*?)\s*Output:\s*(.*)$', 2), '^\s+|\s+$', '', 'g') AS output
FROM (SELECT question_id, nums, unnest(bodies) AS body, generate_subscripts(bodies, 1) AS idx
      FROM (SELECT question_id, regexp_extract_all(question_unittests, 'Unittest\s*(\d+):', 1) AS nums,
                   string_split_regex(question_unittests, 'Unittest\s*\d+:')[2:] AS bodies FROM qs))
"""


@register("parse_tests_lenient", _LEN_BLOCKS, SV)
def parse_tests_lenient(spark, sf):
    q = Flow(spark, sf).qs
    return (q.select("question_id", F.posexplode(X.parse_tests_lenient("question_unittests")).alias("pos", "t"))
            .select("question_id", "pos", "t.unittest", "t.input", "t.output"))


@register("question_tests", _LEN_BLOCKS.replace(O.ctes(O.QS), "WITH qs AS (SELECT question_id, arg_max(question_unittests, row_no) "
          "AS question_unittests FROM catalogue GROUP BY question_id)"), ("catalogue",))
def question_tests(spark, sf):
    t = G.question_tests(fixtures(spark, sf).catalogue, "row_no")
    return (t.select("question_id", F.posexplode("tests").alias("pos", "t"))
            .select("question_id", "pos", "t.unittest", "t.input", "t.output"))


_STRICT = O.ctes(O.QS) + r"""
, blocks AS (
  SELECT question_id, CAST(idx - 1 AS INTEGER) AS pos, body, instr(body, 'Input:') AS ii,
         instr(body, 'STD input:') AS si, instr(body, 'Output:') AS oi
  FROM (SELECT question_id, substr(block, instr(block, ':') + 1) AS body, idx
        FROM (SELECT question_id, unnest(pieces[2:]) AS block, generate_subscripts(pieces[2:], 1) AS idx
              FROM (SELECT question_id, string_split(question_unittests, 'Unittest') AS pieces FROM qs)))),
good AS (SELECT question_id FROM blocks GROUP BY question_id HAVING bool_and(ii > 0 AND si > 0 AND oi > 0))
SELECT question_id, pos,
  regexp_replace(substr(body, ii + 6, greatest(si - ii - 6, 0)), '^\s+|\s+$', '', 'g') AS input,
  regexp_replace(substr(body, si + 10, greatest(oi - si - 10, 0)), '^\s+|\s+$', '', 'g') AS std_in,
  regexp_replace(substr(body, oi + 7), '^\s+|\s+$', '', 'g') AS output
FROM blocks WHERE question_id IN (SELECT question_id FROM good)
""".replace("WITH ", "WITH ", 1)


@register("parse_tests_strict", _STRICT.replace("\n, blocks AS", ",\nblocks AS"), SV)
def parse_tests_strict(spark, sf):
    q = Flow(spark, sf).qs
    return (q.select("question_id", F.posexplode(X.parse_tests_strict("question_unittests")).alias("pos", "t"))
            .select("question_id", "pos", "t.input", "t.std_in", "t.output"))


@register("parsable_tests_only", O.ctes(O.QS) + r"""
SELECT question_id FROM (
  SELECT question_id, unnest(string_split(question_unittests, 'Unittest')[2:]) AS block FROM qs)
GROUP BY question_id
HAVING bool_and(instr(substr(block, instr(block, ':') + 1), 'Input:') > 0
            AND instr(substr(block, instr(block, ':') + 1), 'STD input:') > 0
            AND instr(substr(block, instr(block, ':') + 1), 'Output:') > 0)""", SV)
def parsable_tests_only(spark, sf):
    q = Flow(spark, sf).qs
    return q.filter(F.size(X.parse_tests_strict("question_unittests")) > 0).select("question_id")


@register("format_testcases", _LEN_BLOCKS.replace(
    "SELECT question_id, CAST(idx - 1 AS INTEGER) AS pos, nums[idx] AS unittest,",
    "SELECT question_id, CAST(idx - 1 AS INTEGER) AS pos, '' AS std_in,")
    .replace("1), '^\\s+|\\s+$', '', 'g') AS input", "1), '^\\s+|\\s+$', '', 'g') AS testcode")
    .replace("2), '^\\s+|\\s+$', '', 'g') AS output", "2), '^\\s+|\\s+$', '', 'g') AS expected_output"), SV)
def format_testcases(spark, sf):
    q = Flow(spark, sf).qs
    f = X.format_testcases(X.parse_tests_lenient("question_unittests"), has_std_in=False)
    return (q.select("question_id", F.posexplode(f).alias("pos", "t"))
            .select("question_id", "pos", "t.std_in", "t.testcode", "t.expected_output"))


@register("strip_std_marker", _LEN_BLOCKS.replace(
    "regexp_replace(regexp_extract(body, '(?s)^\\s*Input:\\s*(.*?)\\s*Output:\\s*(.*)$', 1), '^\\s+|\\s+$', '', 'g') AS input,",
    "regexp_replace(replace(regexp_replace(regexp_extract(body, '(?s)^\\s*Input:\\s*(.*?)\\s*Output:\\s*(.*)$', 1), '^\\s+|\\s+$', '', 'g'), 'STD input:', ''), '^\\s+|\\s+$', '', 'g') AS testcode,")
    .replace(", nums[idx] AS unittest", "")
    .replace(",\n  regexp_replace(regexp_extract(body, '(?s)^\\s*Input:\\s*(.*?)\\s*Output:\\s*(.*)$', 2), '^\\s+|\\s+$', '', 'g') AS output", ""), SV)
def strip_std_marker(spark, sf):
    q = Flow(spark, sf).qs
    return (q.select("question_id", F.posexplode(X.parse_tests_lenient("question_unittests")).alias("pos", "t"))
            .select("question_id", "pos", X.strip_std_marker("t.input").alias("testcode")))


@register("pad_pass", _SCEN + f"""SELECT submission_id, pass || repeat('0', greatest({O.count_tests('question_unittests')} - length(pass), 0)) AS pass_padded
FROM merged""", SV)
def pad_pass(spark, sf):
    m = Flow(spark, sf).merged
    return m.select("submission_id", X.pad_pass("pass", X.count_tests("question_unittests")).alias("pass_padded"))


@register("explode_pass", _GRADE + "SELECT * FROM digits", SV)
def explode_pass(spark, sf):
    return G.explode_pass(MetricFlow(spark, sf).student)


@register("testcase_index", _GRADE + "SELECT scenario, student_id, question_id, test_case_id FROM digits", SV)
def testcase_index(spark, sf):
    return G.explode_pass(MetricFlow(spark, sf).student).select("scenario", "student_id", "question_id", "test_case_id")


# --- grading ----------------------------------------------------------------------

@register("grade_exact_match", _GRADE + "SELECT scenario, model, student_id, question_id, test_case_id, correctness FROM graded", EV)
def grade_exact_match(spark, sf):
    return MetricFlow(spark, sf).graded.select("scenario", "model", "student_id", "question_id", "test_case_id", "correctness")


@register("execution_status", """SELECT model, student_id, question_id, test_case_id,
  CASE WHEN test_case_id IS NULL THEN 'no_tests' WHEN run_time = 'fail' THEN 'timeout'
       WHEN stdout IS NULL AND run_time IS NULL THEN 'compile_error' WHEN stdout IS NULL THEN 'runtime_error'
       ELSE 'ok' END AS status FROM executions""", ("executions",))
def execution_status(spark, sf):
    ex = fixtures(spark, sf).executions
    return G.execution_status(ex).select("model", "student_id", "question_id", "test_case_id", "status")


@register("to_numeric_coerce", "SELECT model, student_id, question_id, test_case_id, round(try_cast(run_time AS DOUBLE), 6) AS run_time_s FROM executions", ("executions",))
def to_numeric_coerce(spark, sf):
    ex = fixtures(spark, sf).executions
    return ex.select("model", "student_id", "question_id", "test_case_id", r6(G.to_numeric("run_time")).alias("run_time_s"))


@register("verify_results", _GRADE + """SELECT scenario, model, student_id, question_id, test_case_id, correctness,
  real_student_correctness, correctness IN (0, 1) AND real_student_correctness IN (0, 1) AS is_valid FROM joined""", EV)
def verify_results(spark, sf):
    f = MetricFlow(spark, sf)
    return f.joined.select("scenario", "model", "student_id", "question_id", "test_case_id", "correctness",
                           "real_student_correctness",
                           (F.col("correctness").isin(0, 1) & F.col("real_student_correctness").isin(0, 1)).alias("is_valid"))


@register("join_testcase_outcomes", _GRADE + "SELECT scenario, model, student_id, question_id, test_case_id, real_student_correctness FROM joined", EV)
def join_testcase_outcomes(spark, sf):
    return MetricFlow(spark, sf).joined.select("scenario", "model", "student_id", "question_id", "test_case_id", "real_student_correctness")


@register("valid_pairs", _GRADE + "SELECT scenario, model, student_id, question_id, test_case_id FROM valid", EV)
def valid_pairs(spark, sf):
    return MetricFlow(spark, sf).valid.select("scenario", "model", "student_id", "question_id", "test_case_id")


# --- metrics ----------------------------------------------------------------------

@register("functional_correctness", _GRADE + "SELECT scenario, model, round(avg(correctness), 6) AS value FROM graded GROUP BY scenario, model", EV)
def functional_correctness(spark, sf):
    m = M.functional_correctness(MetricFlow(spark, sf).graded)
    return m.select("scenario", "model", r6("value").alias("value"))


@register("correctness_alignment", _GRADE + """SELECT scenario, model,
  round(avg(CASE WHEN correctness = real_student_correctness THEN 1 ELSE 0 END), 6) AS value
FROM valid GROUP BY scenario, model""", EV)
def correctness_alignment(spark, sf):
    m = M.correctness_alignment(MetricFlow(spark, sf).valid)
    return m.select("scenario", "model", r6("value").alias("value"))


_RATES = """rates AS (SELECT scenario, model, question_id,
  avg(CASE WHEN correctness = 0 THEN 1 ELSE 0 END) AS llm_rate,
  avg(CASE WHEN real_student_correctness = 0 THEN 1 ELSE 0 END) AS student_rate
FROM joined GROUP BY scenario, model, question_id)"""


@register("question_mistake_rates", _GRADE.rstrip() + ",\n" + _RATES + """
SELECT scenario, model, question_id, round(llm_rate, 6) AS LLM_question_mistake_prop,
       round(student_rate, 6) AS student_question_mistake_prop FROM rates""", EV)
def question_mistake_rates(spark, sf):
    m = M.question_mistake_rates(MetricFlow(spark, sf).joined)
    return m.select("scenario", "model", "question_id", r6("LLM_question_mistake_prop").alias("LLM_question_mistake_prop"),
                    r6("student_question_mistake_prop").alias("student_question_mistake_prop"))


@register("mistake_alignment_rmse", _GRADE.rstrip() + ",\n" + _RATES + """
SELECT scenario, model, round(sqrt(avg((llm_rate - student_rate) * (llm_rate - student_rate))), 6) AS value
FROM rates GROUP BY scenario, model""", EV)
def mistake_alignment_rmse(spark, sf):
    m = M.mistake_alignment_rmse(MetricFlow(spark, sf).joined)
    return m.select("scenario", "model", r6("value").alias("value"))


_EFF = """SELECT m.model, round(avg(try_cast(s.run_time AS DOUBLE) / nullif(try_cast(m.run_time AS DOUBLE), 0)), 6) AS value
FROM executions s JOIN executions m USING (student_id, question_id, test_case_id)
WHERE s.model = 'R' AND m.model <> 'R' GROUP BY m.model"""


@register("efficiency_alignment", _EFF, ("executions",))
def efficiency_alignment(spark, sf):
    ex = fixtures(spark, sf).executions
    m = M.efficiency_alignment(ex.filter(F.col("model") != "R").withColumn("scenario", F.lit(4)),
                               ex.filter(F.col("model") == "R"))
    return m.select("model", r6("value").alias("value"))


@register("join_runtimes", """SELECT m.model, student_id, question_id, test_case_id, s.run_time AS student_run_time, m.run_time AS LLM_run_time
FROM executions s JOIN executions m USING (student_id, question_id, test_case_id) WHERE s.model = 'R' AND m.model <> 'R'""", ("executions",))
def join_runtimes(spark, sf):
    ex = fixtures(spark, sf).executions
    s = ex.filter(F.col("model") == "R").select(*G.KEYS3, F.col("run_time").alias("student_run_time"))
    m = ex.filter(F.col("model") != "R").select("model", *G.KEYS3, F.col("run_time").alias("LLM_run_time"))
    return s.join(m, G.KEYS3, "inner")


@register("completion_success", """SELECT model, CAST(count(*) FILTER (WHERE NOT starts_with(text, 'ERROR:')) AS BIGINT) AS successes,
  count(*) AS total FROM completions GROUP BY model""", ("completions",))
def completion_success(spark, sf):
    return M.completion_success(fixtures(spark, sf).completions)


@register("is_error_completion", "SELECT instance_id, conv_id, turn, starts_with(text, 'ERROR:') AS is_error FROM completions", ("completions",))
def is_error_completion(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("instance_id", "conv_id", "turn", X.is_error_completion("text").alias("is_error"))
