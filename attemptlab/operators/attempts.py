"""Submission cleaning and the four attempt scenarios.

Ordering follows the submission time with ``submission_id`` as tie-break, so
every keep-first / keep-last choice is deterministic under re-partitioning.
Keep-first/last use ``row_number() <= k`` windows: Spark plans them with a
partial ``WindowGroupLimit`` before the shuffle, so a hot (student, question)
group is cut to k rows map-side instead of landing whole in one task.
Group predicates use aggregation (partial, map-side) plus a semi join.
The scenarios choose their rows by digests of the responses; texts and
catalogue columns join only the chosen rows (``ScenarioRows``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.functions import text as X

# ---------------------------------------------------------------------------
# The strings a CSV reader treats as missing (pandas defaults).
# ---------------------------------------------------------------------------
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

PAIR = ["student_id", "question_unittest_id"]
QUESTION_COLS = ["question_id", "week", "topic", "question_name", "question_text",
                 "question_template", "question_unittests"]
DIGEST = "response_digest"
MISTAKE, CORRECT = f"{DIGEST}_mistake", f"{DIGEST}_correct"


def time_order(desc: bool = False) -> list[Column]:
    if desc:
        return [F.col("ts").desc(), F.col("submission_id").desc()]
    return [F.col("ts").asc(), F.col("submission_id").asc()]


def normalise_na(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Turn the textual missing-value tokens of string columns into nulls."""
    cols = columns or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    return df.select(*[F.when(F.array_contains(tokens, F.col(c)), F.lit(None)).otherwise(F.col(c)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.na.drop("any")


def clean_submissions(df: DataFrame) -> DataFrame:
    """Complete rows of type ``Submit`` whose pass string holds a ``1``; adds ``is_perfect``."""
    return (drop_incomplete(df)
            .filter(X.has_a_pass("pass") & (F.col("response_type") == "Submit"))
            .withColumn("is_perfect", X.is_perfect("pass")))


def join_questions(subs: DataFrame, questions: DataFrame) -> DataFrame:
    """Submissions joined with the 7 catalogue columns; incomplete joined rows dropped.

    The catalogue is not hinted for broadcast: its size grows with the
    question bank, so the planner decides from its measured size (AQE).
    """
    q = questions.select(*QUESTION_COLS)
    return drop_incomplete(subs.join(q, subs["question_unittest_id"] == q["question_id"], "inner"))


def mixed_outcome_groups(df: DataFrame) -> DataFrame:
    """(student, question) keys with at least one perfect and one imperfect attempt."""
    return (df.groupBy(*PAIR)
            .agg(F.bool_or("is_perfect").alias("_any_p"), F.bool_or(~F.col("is_perfect")).alias("_any_np"))
            .filter(F.col("_any_p") & F.col("_any_np")).select(*PAIR))


def first_mistake_and_fix(clean: DataFrame) -> DataFrame:
    """First imperfect and first perfect attempt of every mixed group (two rows per group)."""
    mixed = clean.join(mixed_outcome_groups(clean), PAIR, "left_semi")
    w = Window.partitionBy(*PAIR, "is_perfect").orderBy(*time_order())
    return mixed.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pair_first_responses(mf: DataFrame, text: str = "response") -> DataFrame:
    """Per (student, question): first mistake text and first correct text (mixed groups only).

    ``text`` may be the digest of the texts, which gives the digests of both.

    Works on the first-mistake/fix rows or on all attempts alike: ``min_by``
    keeps the earliest text of each kind, partially aggregated map-side.
    """
    key = F.struct("ts", "submission_id")
    return (mf.groupBy(*PAIR).agg(
        F.min_by(text, F.when(~F.col("is_perfect"), key)).alias(f"{text}_mistake"),
        F.min_by(text, F.when(F.col("is_perfect"), key)).alias(f"{text}_correct"))
        .filter(F.col(f"{text}_mistake").isNotNull() & F.col(f"{text}_correct").isNotNull()))


def join_alignment(merged: DataFrame, alignment: DataFrame) -> DataFrame:
    """Every attempt of a mixed group carrying that group's first mistake / fix texts."""
    return merged.join(alignment, PAIR, "inner")


def latest_per_pair(merged: DataFrame) -> DataFrame:
    """Scenario 2: the last attempt per (student, question)."""
    w = Window.partitionBy(*PAIR).orderBy(*time_order(desc=True))
    return merged.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def first_per_question(latest: DataFrame) -> DataFrame:
    """Scenario 1: the earliest row per question of the scenario-2 table."""
    w = Window.partitionBy("question_unittest_id").orderBy(*time_order())
    return latest.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def text_digest(text: str) -> Column:
    """SHA-256 of a text: stands for it wherever only equality counts."""
    return F.unhex(F.sha2(text, 256))


def with_digest(clean: DataFrame) -> DataFrame:
    """Cleaned attempts with the digest of the response in its place."""
    return clean.withColumn(DIGEST, text_digest("response")).drop("response")


def response_texts(clean: DataFrame) -> DataFrame:
    """Digest and text of the responses, each text once."""
    return clean.select(text_digest("response").alias(DIGEST), "response").distinct()


def add_text(rows: DataFrame, texts: DataFrame, digest: str = DIGEST, name: str = "response") -> DataFrame:
    """The text of a digest column, in its place."""
    t = texts.select(F.col(DIGEST).alias(digest), F.col("response").alias(name))
    return rows.join(t, digest, "inner").drop(digest)


def add_questions(rows: DataFrame, questions: DataFrame, one_each: bool = False) -> DataFrame:
    """Chosen rows with the 7 catalogue columns; rows without a complete question are dropped.

    ``one_each`` takes one catalogue row per question.  The catalogue is merged, not broadcast: its files tell
    little about its size in memory, and the rows are narrow.
    """
    q = drop_incomplete(questions.select(*QUESTION_COLS))
    q = (q.dropDuplicates(["question_id"]) if one_each else q).hint("merge")
    return rows.join(q, rows["question_unittest_id"] == q["question_id"], "inner")


def _same_text(final: DataFrame, kind: str) -> Column:
    """Equal by SHA-256: the optimiser moves the condition into the join key, which must not be a whole text."""
    if DIGEST in final.columns:
        return F.col(DIGEST) == F.col(f"{DIGEST}_{kind}")
    return F.sha2("response", 256) == F.sha2(f"response_{kind}", 256)


def scenario3_filter(final: DataFrame) -> DataFrame:
    """Attempts whose text is their group's first mistake, by digests where the rows hold these."""
    return final.filter(_same_text(final, "mistake"))


def scenario4_filter(final: DataFrame) -> DataFrame:
    """Attempts whose text is their group's first fix."""
    return final.filter(_same_text(final, "correct"))


class ScenarioRows:
    """The scenario tables of cleaned attempts, first without (``*_keys``), then with texts.

    Windows, aggregations and joins per (student, question) see narrow rows only: whether an attempt belongs to a
    scenario depends on digests, order and outcome.  A question that the catalogue lacks drops whole groups, so the
    catalogue may come after the choice.
    """

    def __init__(self, clean: DataFrame, questions: DataFrame):
        self.clean, self.questions = clean, questions

    @cached_property
    def keys(self) -> DataFrame:
        return with_digest(self.clean)

    @cached_property
    def texts(self) -> DataFrame:
        return response_texts(self.clean)

    @cached_property
    def aligned_keys(self) -> DataFrame:
        """Every attempt of a mixed group with the digests of that group's first mistake / fix texts."""
        return join_alignment(self.keys, pair_first_responses(self.keys, DIGEST))

    @cached_property
    def latest_keys(self) -> DataFrame:
        return add_questions(latest_per_pair(self.keys), self.questions, one_each=True)

    @cached_property
    def s1_keys(self) -> DataFrame:
        return first_per_question(self.latest_keys)

    @cached_property
    def s3_keys(self) -> DataFrame:
        return add_questions(scenario3_filter(self.aligned_keys), self.questions)

    @cached_property
    def s4_keys(self) -> DataFrame:
        return add_questions(scenario4_filter(self.aligned_keys), self.questions)

    def with_response(self, rows: DataFrame) -> DataFrame:
        """Rows of scenario 1 or 2 with their texts."""
        return add_text(rows, self.texts).select(*self.clean.columns, *QUESTION_COLS)

    def with_pair(self, rows: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of scenario 3 or 4: their text is the first one of its kind, ``other`` names the second."""
        t = add_text(rows, self.texts).withColumn(f"response_{own}", F.col("response"))
        t = add_text(t, self.texts, f"{DIGEST}_{other}", f"response_{other}")
        rest = [c for c in [*self.clean.columns, *QUESTION_COLS] if c not in PAIR]
        return t.select(*PAIR, *rest, "response_mistake", "response_correct")

    @cached_property
    def s1(self) -> DataFrame:
        return self.with_response(self.s1_keys)

    @cached_property
    def latest(self) -> DataFrame:
        return self.with_response(self.latest_keys)

    @cached_property
    def s3(self) -> DataFrame:
        return self.with_pair(self.s3_keys, "mistake", "correct")

    @cached_property
    def s4(self) -> DataFrame:
        return self.with_pair(self.s4_keys, "correct", "mistake")

    def tables(self) -> dict[str, DataFrame]:
        return {"Scenario1": self.s1, "Scenario2": self.latest, "Scenario3": self.s3, "Scenario4": self.s4,
                "Questions": self.questions}

    def held(self) -> "ScenarioRows":
        """The same tables over kept keys and texts (already by digest): for several outputs, until ``release``."""
        out = ScenarioRows(self.clean, self.questions)
        parts = int(self.clean.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        out.keys = self.keys.persist(StorageLevel.MEMORY_AND_DISK)
        out.texts = self.texts.repartition(parts, DIGEST).persist(StorageLevel.MEMORY_AND_DISK)
        return out

    def release(self) -> None:
        self.keys.unpersist()
        self.texts.unpersist()


def derive_scenarios(submissions: DataFrame, questions: DataFrame) -> dict[str, DataFrame]:
    """All scenario tables from a raw log and the catalogue (one DAG)."""
    # the first mistake / first fix texts come straight from one partial aggregation over all
    # attempts: a group is mixed exactly when both texts exist (same result as going through
    # first_mistake_and_fix, without its semi join and window)
    return ScenarioRows(clean_submissions(submissions), questions).tables()


def first_four_attempts(df: DataFrame, k: int = 4) -> DataFrame:
    """First ``k`` attempts per student in time order, numbered 1..k (``attempt_no``)."""
    w = Window.partitionBy("student_id").orderBy(*time_order())
    return df.withColumn("attempt_no", F.row_number().over(w)).filter(F.col("attempt_no") <= k)


def min_attempts_filter(df: DataFrame, k: int = 4) -> DataFrame:
    """Keep students with at least ``k`` rows (aggregate + semi join, skew-safe)."""
    keep = df.groupBy("student_id").count().filter(F.col("count") >= k).select("student_id")
    return df.join(keep, "student_id", "left_semi")


def question_representative(df: DataFrame, key: str = "question_unittest_id") -> DataFrame:
    """First row per question in time order."""
    w = Window.partitionBy(key).orderBy(*time_order())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def student_topic_profile(merged: DataFrame) -> DataFrame:
    """Per (student, topic): mean unit-test pass rate and share of perfect attempts."""
    ones = F.length(F.col("pass")) - F.length(F.replace(F.col("pass"), F.lit("1"), F.lit("")))
    rate = F.try_divide(ones.cast("double"), X.count_tests("question_unittests").cast("double"))
    return (merged.groupBy("student_id", "topic")
            .agg(F.avg(rate).alias("pass_rate"), F.avg(F.col("is_perfect").cast("double")).alias("perfect")))
