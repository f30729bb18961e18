"""Registered queries: sources, cleaning, joins, windows and scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlab.operators import attempts as A
from attemptlab.plans.oracle_sql import ALIGN, CLEAN, LATEST, MERGED, MIXED, QS, S1, SUBS, ctes
from functools import cached_property

from attemptlab.registry import cached_flow, fixtures, register
from attemptlab.session import scratch_folder
from attemptlab.sources import files

SV = ("submissions", "questions")


class Flow:
    """The scenario DAG over one fixture set; each table is built on first use."""

    def __new__(cls, spark, sf_dir):
        return cached_flow(_Flow, spark, sf_dir)


class _Flow:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir
        self.fx = fixtures(spark, sf_dir)

    @cached_property
    def subs(self):
        return A.normalise_na(self.fx.submissions)

    @cached_property
    def qs(self):
        return A.normalise_na(self.fx.questions)

    @cached_property
    def clean(self):
        return A.clean_submissions(self.subs)

    @cached_property
    def merged(self):
        return A.join_questions(self.clean, self.qs)

    @cached_property
    def mf(self):
        return A.first_mistake_and_fix(self.clean)

    @cached_property
    def alignment(self):
        return A.pair_first_responses(self.merged)

    @cached_property
    def rows(self):
        return A.ScenarioRows(self.clean, self.qs)

    @cached_property
    def final_keys(self):
        return A.add_questions(self.rows.aligned_keys, self.qs)

    @cached_property
    def latest(self):
        return A.latest_per_pair(self.merged)

    @cached_property
    def s1(self):
        return A.first_per_question(self.latest)


SUB_COLS = "submission_id, student_id, question_unittest_id, response_type, pass, response"


@register("scan_submissions", ctes(SUBS) + f"SELECT {SUB_COLS}, epoch_us(ts) AS ts_us FROM subs", SV)
def scan_submissions(spark, sf):
    """Written as JSON lines (compressed files of bounded size) and read back through the file reader."""
    path = scratch_folder(spark, "submissions")
    files.write_table(fixtures(spark, sf).submissions.withColumnRenamed("ts", "timestamp"), path, fmt="json", compression="gzip",
                      max_rows_per_file=100_000)
    return files.read_submissions(spark, path, fmt="json").select(*SUB_COLS.split(", "), F.unix_micros("ts").alias("ts_us"))


@register("scan_questions", ctes(QS) + "SELECT * FROM qs", SV)
def scan_questions(spark, sf):
    """Written as CSV with quoted line breaks and read back through the file reader."""
    path = scratch_folder(spark, "questions")
    files.write_table(fixtures(spark, sf).questions, path, fmt="csv")
    return files.read_questions(spark, path)


@register("drop_incomplete", ctes(SUBS) + f"""SELECT {SUB_COLS} FROM subs
  WHERE submission_id IS NOT NULL AND student_id IS NOT NULL AND question_unittest_id IS NOT NULL
    AND response_type IS NOT NULL AND ts IS NOT NULL AND pass IS NOT NULL AND response IS NOT NULL""", SV)
def drop_incomplete(spark, sf):
    return A.drop_incomplete(Flow(spark, sf).subs).select(*SUB_COLS.split(", "))


@register("is_perfect_score", ctes(SUBS) + "SELECT submission_id, pass, replace(pass, '1', '') = '' AS is_perfect FROM subs", SV)
def is_perfect_score(spark, sf):
    from attemptlab.functions.text import is_perfect
    return Flow(spark, sf).subs.select("submission_id", "pass", is_perfect("pass").alias("is_perfect"))


@register("clean_submissions", ctes(SUBS, CLEAN) + "SELECT submission_id, student_id, question_unittest_id, pass, is_perfect FROM clean", SV)
def clean_submissions(spark, sf):
    return Flow(spark, sf).clean.select("submission_id", "student_id", "question_unittest_id", "pass", "is_perfect")


@register("join_questions", ctes(SUBS, QS, CLEAN, MERGED) + "SELECT submission_id, question_id, week, topic FROM merged", SV)
def join_questions(spark, sf):
    return Flow(spark, sf).merged.select("submission_id", "question_id", "week", "topic")


@register("mixed_outcome_groups", ctes(SUBS, CLEAN, MIXED) + "SELECT * FROM mixed", SV)
def mixed_outcome_groups(spark, sf):
    return A.mixed_outcome_groups(Flow(spark, sf).clean)


_MF = ctes(SUBS, QS, CLEAN, MERGED, MIXED, ALIGN)


@register("first_mistake_and_fix", _MF + "SELECT submission_id, student_id, question_unittest_id, is_perfect FROM mf", SV)
def first_mistake_and_fix(spark, sf):
    return Flow(spark, sf).mf.select("submission_id", "student_id", "question_unittest_id", "is_perfect")


@register("union_mistake_fix", _MF + """SELECT submission_id, is_perfect FROM mf WHERE NOT is_perfect
  UNION ALL SELECT submission_id, is_perfect FROM mf WHERE is_perfect""", SV)
def union_mistake_fix(spark, sf):
    mf = Flow(spark, sf).mf.select("submission_id", "is_perfect")
    return mf.filter(~F.col("is_perfect")).unionByName(mf.filter(F.col("is_perfect")))


@register("pair_first_responses", _MF + "SELECT student_id, question_unittest_id, response_mistake, response_correct FROM alignment", SV)
def pair_first_responses(spark, sf):
    return Flow(spark, sf).alignment


@register("join_alignment", _MF + "SELECT submission_id, student_id, question_unittest_id, response_mistake = response AS is_mistake_text FROM final", SV)
def join_alignment(spark, sf):
    return Flow(spark, sf).final_keys.select("submission_id", "student_id", "question_unittest_id",
                                             (F.col(A.MISTAKE) == F.col(A.DIGEST)).alias("is_mistake_text"))


@register("scenario3_filter", _MF + "SELECT submission_id, student_id, question_unittest_id, is_perfect FROM final WHERE response = response_mistake", SV)
def scenario3_filter(spark, sf):
    return Flow(spark, sf).rows.s3_keys.select("submission_id", "student_id", "question_unittest_id", "is_perfect")


@register("scenario4_filter", _MF + "SELECT submission_id, student_id, question_unittest_id, is_perfect FROM final WHERE response = response_correct", SV)
def scenario4_filter(spark, sf):
    return Flow(spark, sf).rows.s4_keys.select("submission_id", "student_id", "question_unittest_id", "is_perfect")


_LATEST = ctes(SUBS, QS, CLEAN, MERGED, LATEST)


@register("latest_per_pair", _LATEST + "SELECT submission_id, student_id, question_unittest_id FROM latest", SV)
def latest_per_pair(spark, sf):
    return Flow(spark, sf).latest.select("submission_id", "student_id", "question_unittest_id")


@register("first_per_question", ctes(SUBS, QS, CLEAN, MERGED, LATEST, S1) + "SELECT submission_id, question_unittest_id FROM s1", SV)
def first_per_question(spark, sf):
    return Flow(spark, sf).s1.select("submission_id", "question_unittest_id")


@register("first_four_attempts", _LATEST + """SELECT * FROM (
  SELECT student_id, submission_id, CAST(row_number() OVER (PARTITION BY student_id ORDER BY ts, submission_id) AS INTEGER) AS attempt_no
  FROM latest) WHERE attempt_no <= 4""", SV)
def first_four_attempts(spark, sf):
    return A.first_four_attempts(Flow(spark, sf).latest).select("student_id", "submission_id", "attempt_no")


@register("min_attempts_filter", _LATEST + """SELECT student_id, submission_id FROM latest
  WHERE student_id IN (SELECT student_id FROM latest GROUP BY student_id HAVING count(*) >= 4)""", SV)
def min_attempts_filter(spark, sf):
    return A.min_attempts_filter(Flow(spark, sf).latest).select("student_id", "submission_id")


@register("question_representative", ctes(SUBS, QS, CLEAN, MERGED) + """SELECT question_unittest_id, submission_id FROM (
  SELECT *, row_number() OVER (PARTITION BY question_unittest_id ORDER BY ts, submission_id) AS rn FROM merged) WHERE rn = 1""", SV)
def question_representative(spark, sf):
    return A.question_representative(Flow(spark, sf).merged).select("question_unittest_id", "submission_id")


@register("student_topic_profile", ctes(SUBS, QS, CLEAN, MERGED) + r"""SELECT student_id, topic,
  round(avg(CAST(length(pass) - length(replace(pass, '1', '')) AS DOUBLE)
            / nullif(CAST(len(regexp_extract_all(question_unittests, 'Unittest\s+\d+:')) AS DOUBLE), 0)), 6) AS pass_rate,
  round(avg(CAST(is_perfect AS DOUBLE)), 6) AS perfect
FROM merged GROUP BY student_id, topic""", SV)
def student_topic_profile(spark, sf):
    from attemptlab.registry import r6
    p = A.student_topic_profile(Flow(spark, sf).merged)
    return p.select("student_id", "topic", r6("pass_rate").alias("pass_rate"), r6("perfect").alias("perfect"))


@register("sort_multi_key", _LATEST + "SELECT student_id, question_unittest_id, submission_id FROM merged ORDER BY student_id, question_unittest_id, ts, submission_id", SV)
def sort_multi_key(spark, sf):
    m = Flow(spark, sf).merged
    return m.orderBy("student_id", "question_unittest_id", "ts", "submission_id").select("student_id", "question_unittest_id", "submission_id")
