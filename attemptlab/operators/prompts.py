"""Prompt tables built with string expressions over joined attempt rows.

The leave-one-out example sets are bounded: a student contributes at most
four attempts, collected into one small array per student before the
targets are exploded, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlab.functions import text as X
from attemptlab.operators import attempts as A

# ---------------------------------------------------------------------------
# Prompt texts that must equal the reference's word for word.
# ---------------------------------------------------------------------------
BASE_INSTRUCTIONS = (
    "Provide ONLY your C++ implementation that will replace the {{ STUDENT_ANSWER }} block in the template. "
    "– Do NOT reproduce any part of the template "
    "– Do NOT emit `int main()` (it's already declared) "
    "– Ensure your code is correct, efficient, handles all edge cases, and includes any needed class definitions "
    "IMPORTANT: "
    "Your entire response must be exactly one Markdown C++ code-block. "
    "1. The first line of your output must be: ```cpp "
    "2. The last line of your output must be: ``` "
    "3. No extra characters, whitespace, or text may appear before the opening ```cpp or after the closing ```."
)
S2_INSTRUCTIONS = (
    "Provide ONLY your C++ implementation that will replace the {{ STUDENT_ANSWER }} block in the template. "
    "– Do NOT reproduce any part of the template "
    "– Do NOT emit `int main()` (it's already declared) "
    "– Ensure your code mirrors the style of the previous examples and includes any necessary class definitions "
    "IMPORTANT: your entire response must be exactly one Markdown C++ code‐block:\n"
    "1. First line: ```cpp\n"
    "2. Last line: ```\n"
)
S3_RATES_NOTE = (
    "When students submit a code to the platform, it will be tested by number of unit tests, where\n"
    "- Unit test pass rate = proportion of unit tests passed with the code\n"
    "- Full pass rate   = proportion of code passing all unit tests\n\n"
    "=== Past Mistake Examples ===\n"
)
S3_INSTRUCTIONS = (
    "⚠**Instructions:**\n"
    "1. Mimic your own coding style, naming conventions, indentation, and typical error patterns from the examples.\n"
    "2. Introduce a mistake you are likely to make (e.g., off‑by‑one index, wrong initialization, missing edge case).\n"
    "3. Do **not** produce a fully correct solution or add unfamiliar optimizations.\n\n"
    "4. Include any needed class definitions, and make sure the code is compatible with the Unit Test Input.\n"
    "5. Provide ONLY your C++ implementation that will replace the {{ STUDENT_ANSWER }} block in the template.\n"
    "6. Do NOT reproduce any part of the template.\n"
    "7. Do NOT emit `int main()` (it’s already declared).\n\n"
    "IMPORTANT: your entire response must be exactly one Markdown C++ code‑block:\n"
    "1. First line: ```cpp\n"
    "2. Last line: ```\n"
    "No extra characters, whitespace, or text before/after.\n"
)
S4_INSTRUCTIONS = (
    "Provide ONLY your C++ implementation that will replace the {{ STUDENT_ANSWER }} block in the template.  "
    "– Do NOT reproduce any part of the template  "
    "– Do NOT emit `int main()` (it’s already declared)  "
    "– Ensure your code is correct, handles all edge cases, and includes any needed class definitions  "
    "– Match the student’s usual efficiency style.\n\n"
    "IMPORTANT: your entire response must be exactly one Markdown C++ code‑block:\n"
    "1. First line: ```cpp\n"
    "2. Last line: ```\n"
    "No extra whitespace or text before/after.\n"
)
DASH = " — "
ERROR_MISSING = "ERROR: missing completion"



def _s(x) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(x)


def cat(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def question_line(r) -> Column:
    return cat("Question: ", r["question_name"], DASH, r["question_text"])


def base_prompt(r=None) -> Column:
    r = r if r is not None else F.struct("question_name", "question_text", "question_template")
    return cat(question_line(r), "\n\n", "Template:\n", r["question_template"], "\n\n", BASE_INSTRUCTIONS)


def profile_prompt(student_id: Column, profile: Column) -> Column:
    """Header plus one line per topic; rates printed with two decimals (half-even, like Python), unknown ones as nan."""
    def rate(c):
        return F.coalesce(F.format_number(c, 2), F.lit("nan"))

    lines = F.transform(profile, lambda t: cat(
        "- For topic '", t["topic"], "', the unit test pass rate is ", rate(t["pass_rate"]),
        ", and the rate of passing all tests is ", rate(t["perfect"]), ".\n"))
    return cat("Student ", student_id.cast("string"), " has the following performance across topics:\n",
               F.coalesce(F.array_join(lines, ""), F.lit("")))


def lookup_student_profile(profile: DataFrame) -> DataFrame:
    """student_id -> topic rows sorted by topic (bounded by the number of topics)."""
    return profile.groupBy("student_id").agg(
        F.array_sort(F.collect_list(F.struct("topic", "pass_rate", "perfect"))).alias("profile"))


def _examples(ex: Column, render) -> Column:
    return F.array_join(F.transform(ex, lambda e, i: render(e, i + 1)), "")


def scenario2_prompt(profile_text: Column, t: Column, ex: Column) -> Column:
    body = _examples(ex, lambda e, n: cat("Example ", n.cast("string"), ":\n", question_line(e), "\n",
                                          "Template:\n", e["question_template"], "\n", "Your Code:\n", e["response"], "\n\n"))
    return cat("=== Student Profile ===\n", profile_text, "\n", "Week: ", t["week"].cast("string"), "\n",
               "Topic: ", t["topic"], "\n\n", body,
               "Now, using that same student style, attempt this:\n", question_line(t), "\n",
               "Template:\n", t["question_template"], "\n\n", S2_INSTRUCTIONS)


def scenario3_prompt(profile_text: Column, t: Column, ex: Column) -> Column:
    body = _examples(ex, lambda e, n: cat("Example ", n.cast("string"), " (Week ", e["week"].cast("string"), ", Topic: ",
                                          e["topic"], "):\n", question_line(e), "\n", "Template:\n", e["question_template"],
                                          "\n", "Student's Response Code with Error:\n", e["response_mistake"], "\n\n"))
    return cat("=== Student Profile ===\n", profile_text, "\n", S3_RATES_NOTE, body,
               "=== New Target Problem ===\n", "Week: ", t["week"].cast("string"), ", Topic: ", t["topic"], "\n",
               question_line(t), "\n", "Template:\n", t["question_template"], "\n\n", S3_INSTRUCTIONS)


def scenario4_prompt(profile_text: Column, t: Column, ex: Column) -> Column:
    body = _examples(ex, lambda e, n: cat("Example ", n.cast("string"), ":\n", question_line(e), "\n",
                                          "Template:\n", e["question_template"], "\n", "Your Code:\n", e["response"], "\n\n"))
    return cat("Week: ", t["week"].cast("string"), "\n", "Topic: ", t["topic"], "\n\n", body,
               "Now, using that same student's coding style, attempt this:\n", question_line(t), "\n\n",
               "Template:\n", t["question_template"], "\n\n", S4_INSTRUCTIONS)


PROMPT_BUILDERS = {2: scenario2_prompt, 3: scenario3_prompt, 4: scenario4_prompt}


def scenario1_prompts(s1: DataFrame) -> DataFrame:
    """One prompt per question whose tests parse strictly."""
    rep = A.question_representative(s1)
    return (rep.select(F.col("question_unittest_id").alias("question_id"),
                       base_prompt().alias("prompt"),
                       X.parse_tests_strict("question_unittests").alias("test_cases"))
            .filter(F.size("test_cases") > 0))


def student_attempts(table: DataFrame, k: int = 4, attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """student_id -> its first k attempts in order, for students with >= k rows.

    ``attach`` adds the texts to the chosen rows of a table without them.
    """
    first = A.first_four_attempts(A.min_attempts_filter(table, k), k)
    first = attach(first) if attach else first
    cols = ["attempt_no", "question_unittest_id", "week", "topic", "question_name", "question_text",
            "question_template", "question_unittests"] + [c for c in ("response", "response_mistake") if c in first.columns]
    return first.groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("attempts"))


def _leave_one_out(per_student: DataFrame, *keep: str) -> DataFrame:
    return (per_student.select("student_id", F.explode("attempts").alias("target"), "attempts", *keep)
            .select("student_id", "target",
                    F.filter("attempts", lambda a: a["attempt_no"] != F.col("target")["attempt_no"]).alias("examples"), *keep))


def leave_one_out_examples(table: DataFrame, k: int = 4,
                           attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(student, target attempt, the other k-1 attempts in order) for students with >= k rows.

    ``attach`` adds the texts to the chosen rows of a table without them.
    """
    return _leave_one_out(student_attempts(table, k, attach))


def scenario234_prompts(table: DataFrame, profile: DataFrame, scenario: int, k: int = 4,
                        attach: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Per student with >= k attempts: one prompt per target among the first k attempts.

    The profile joins one row per student, before the targets are exploded with their examples.
    """
    prof = lookup_student_profile(profile)
    j = _leave_one_out(student_attempts(table, k, attach).join(prof, "student_id", "left"), "profile")
    profile_text = profile_prompt(F.col("student_id"), F.coalesce(F.col("profile"), F.array().cast(prof.schema["profile"].dataType)))
    build = PROMPT_BUILDERS[scenario]
    return (j.select("student_id", F.col("target")["question_unittest_id"].alias("question_id"),
                     F.col("target")["attempt_no"].alias("attempt_no"),
                     build(profile_text, F.col("target"), F.col("examples")).alias("prompt"),
                     X.parse_tests_strict(F.col("target")["question_unittests"]).alias("test_cases"))
            .filter(F.size("test_cases") > 0))


def completion_table(prompts: DataFrame, completions: DataFrame, models: list[str],
                     keys=("student_id", "question_id")) -> DataFrame:
    """Every prompt for every model, with the returned text or an ``ERROR:`` marker."""
    p = prompts.select(*keys, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    c = completions.select(*keys, "model", "text")
    return (p.join(c, [*keys, "model"], "left")
            .withColumn("text", F.coalesce(F.col("text"), F.lit(ERROR_MISSING))))
