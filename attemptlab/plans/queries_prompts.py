"""Registered queries: prompt tables, completion tables and code extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from attemptlab.functions import text as X
from attemptlab.operators import attempts as A
from attemptlab.operators import grading as G
from attemptlab.operators import prompts as P
from attemptlab.plans import oracle_sql as O
from attemptlab.plans.queries_attempts import Flow
from attemptlab.registry import fixtures, register
from attemptlab.session import scratch_folder
from attemptlab.sources import files

SV = ("submissions", "questions")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_QL = "'Question: ' || {p}question_name || ' — ' || {p}question_text"
_PROF = """prof AS (SELECT student_id, topic,
  avg(CAST(length(pass) - length(replace(pass, '1', '')) AS DOUBLE)
      / nullif(CAST(len(regexp_extract_all(question_unittests, 'Unittest\\s+\\d+:')) AS DOUBLE), 0)) AS pass_rate,
  avg(CAST(is_perfect AS DOUBLE)) AS perfect FROM merged GROUP BY student_id, topic),
proftext AS (SELECT student_id, string_agg('- For topic ''' || topic || ''', the unit test pass rate is ' || coalesce(format('{:.2f}', pass_rate), 'nan')
  || ', and the rate of passing all tests is ' || coalesce(format('{:.2f}', perfect), 'nan') || '.' || chr(10), '' ORDER BY topic) AS lines
  FROM prof GROUP BY student_id),
parsable AS (SELECT question_id FROM (
  SELECT question_id, unnest(string_split(question_unittests, 'Unittest')[2:]) AS block FROM qs)
  GROUP BY question_id
  HAVING bool_and(instr(substr(block, instr(block, ':') + 1), 'Input:') > 0
              AND instr(substr(block, instr(block, ':') + 1), 'STD input:') > 0
              AND instr(substr(block, instr(block, ':') + 1), 'Output:') > 0))"""
_BASE = O.ctes(O.SUBS, O.QS, O.CLEAN, O.MERGED, O.MIXED, O.ALIGN, O.LATEST, O.S1, _PROF)


def _f4(table: str) -> str:
    return f""", tbl AS (SELECT * FROM {table} WHERE student_id IN (SELECT student_id FROM {table} GROUP BY student_id HAVING count(*) >= 4)),
f4 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY student_id ORDER BY ts, submission_id) AS INTEGER) AS attempt_no
                      FROM tbl) WHERE attempt_no <= 4),
pairs AS (SELECT t.student_id, t.attempt_no AS target_no, e.*  EXCLUDE (student_id),
                 CAST(CASE WHEN e.attempt_no > t.attempt_no THEN e.attempt_no - 1 ELSE e.attempt_no END AS INTEGER) AS n
          FROM f4 t JOIN f4 e ON t.student_id = e.student_id AND e.attempt_no <> t.attempt_no)
"""


def _example_sql(scenario: int) -> str:
    if scenario == 3:
        return ("'Example ' || CAST(n AS VARCHAR) || ' (Week ' || CAST(week AS VARCHAR) || ', Topic: ' || topic || '):\n' || "
                + _QL.format(p="") + " || '\nTemplate:\n' || question_template || '\nStudent''s Response Code with Error:\n' || response_mistake || '\n\n'")
    return ("'Example ' || CAST(n AS VARCHAR) || ':\n' || " + _QL.format(p="")
            + " || '\nTemplate:\n' || question_template || '\nYour Code:\n' || response || '\n\n'")


def _prompt_sql(scenario: int) -> str:
    prof = ("'Student ' || CAST(t.student_id AS VARCHAR) || ' has the following performance across topics:\n' || coalesce(p.lines, '')")
    q = _QL.format(p="t.")
    if scenario == 2:
        return (f"'=== Student Profile ===\n' || {prof} || '\nWeek: ' || CAST(t.week AS VARCHAR) || '\nTopic: ' || t.topic || '\n\n' || ex.body"
                f" || 'Now, using that same student style, attempt this:\n' || {q} || '\nTemplate:\n' || t.question_template || '\n\n' || {lit(P.S2_INSTRUCTIONS)}")
    if scenario == 3:
        return (f"'=== Student Profile ===\n' || {prof} || '\n' || {lit(P.S3_RATES_NOTE)} || ex.body || '=== New Target Problem ===\nWeek: ' || CAST(t.week AS VARCHAR)"
                f" || ', Topic: ' || t.topic || '\n' || {q} || '\nTemplate:\n' || t.question_template || '\n\n' || {lit(P.S3_INSTRUCTIONS)}")
    return (f"'Week: ' || CAST(t.week AS VARCHAR) || '\nTopic: ' || t.topic || '\n\n' || ex.body"
            f" || 'Now, using that same student''s coding style, attempt this:\n' || {q} || '\n\nTemplate:\n' || t.question_template || '\n\n' || {lit(P.S4_INSTRUCTIONS)}")


def _prompts_oracle(scenario: int, table: str) -> str:
    return (_BASE.rstrip() + _f4(table) + f""", ex AS (SELECT student_id, target_no AS attempt_no, string_agg({_example_sql(scenario)}, '' ORDER BY n) AS body
  FROM pairs GROUP BY student_id, target_no)
SELECT t.student_id, t.question_unittest_id AS question_id, t.attempt_no, {_prompt_sql(scenario)} AS prompt,
       CAST(len(string_split(t.question_unittests, 'Unittest')) - 1 AS INTEGER) AS n_tests
FROM f4 t JOIN ex USING (student_id, attempt_no) LEFT JOIN proftext p USING (student_id)
WHERE t.question_unittest_id IN (SELECT question_id FROM parsable)""")


_TABLES = {2: "latest", 3: "(SELECT * FROM final WHERE response = response_mistake)",
           4: "(SELECT * FROM final WHERE response = response_correct)"}


def _prompts(spark, sf, scenario: int):
    f = Flow(spark, sf)
    r = f.rows
    table = {2: r.latest_keys, 3: r.s3_keys, 4: r.s4_keys}[scenario]
    name = "response_mistake" if scenario == 3 else "response"      # a scenario 3 response is the first mistake
    profile = A.student_topic_profile(f.merged)
    p = P.scenario234_prompts(table, profile, scenario, attach=lambda rows: A.add_text(rows, r.texts, name=name))
    return p.select("student_id", "question_id", "attempt_no", "prompt", F.size("test_cases").alias("n_tests"))


@register("scenario234_prompts", _prompts_oracle(2, _TABLES[2]), SV)
def scenario234_prompts(spark, sf):
    return _prompts(spark, sf, 2)


@register("scenario2_prompt", _prompts_oracle(2, _TABLES[2]), SV)
def scenario2_prompt(spark, sf):
    return _prompts(spark, sf, 2)


@register("scenario3_prompt", _prompts_oracle(3, _TABLES[3]), SV)
def scenario3_prompt(spark, sf):
    return _prompts(spark, sf, 3)


@register("scenario4_prompt", _prompts_oracle(4, _TABLES[4]), SV)
def scenario4_prompt(spark, sf):
    return _prompts(spark, sf, 4)


def _examples(spark, sf):
    r = Flow(spark, sf).rows
    return P.leave_one_out_examples(r.latest_keys, attach=lambda rows: A.add_text(rows, r.texts))


@register("leave_one_out_examples", _BASE.rstrip() + _f4("latest") + """SELECT student_id, target_no AS attempt_no,
  string_agg(CAST(attempt_no AS VARCHAR), ',' ORDER BY attempt_no) AS example_attempts FROM pairs GROUP BY student_id, target_no""", SV)
def leave_one_out_examples(spark, sf):
    loo = _examples(spark, sf)
    return loo.select("student_id", F.col("target")["attempt_no"].alias("attempt_no"),
                      F.array_join(F.transform("examples", lambda e: e["attempt_no"].cast("string")), ",").alias("example_attempts"))


@register("example_number", _BASE.rstrip() + _f4("latest") + "SELECT student_id, target_no, attempt_no, n FROM pairs", SV)
def example_number(spark, sf):
    loo = _examples(spark, sf)
    return (loo.select("student_id", F.col("target")["attempt_no"].alias("target_no"), F.posexplode("examples").alias("i", "e"))
            .select("student_id", "target_no", F.col("e")["attempt_no"].alias("attempt_no"), (F.col("i") + 1).alias("n")))


@register("profile_prompt", _BASE + """SELECT student_id, 'Student ' || CAST(student_id AS VARCHAR)
  || ' has the following performance across topics:\n' || lines AS profile_text FROM proftext""", SV)
def profile_prompt(spark, sf):
    prof = P.lookup_student_profile(A.student_topic_profile(Flow(spark, sf).merged))
    return prof.select("student_id", P.profile_prompt(F.col("student_id"), F.col("profile")).alias("profile_text"))


@register("lookup_student_profile", _BASE + "SELECT student_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM prof GROUP BY student_id", SV)
def lookup_student_profile(spark, sf):
    prof = P.lookup_student_profile(A.student_topic_profile(Flow(spark, sf).merged))
    return prof.select("student_id", F.array_join(F.transform("profile", lambda t: t["topic"]), ",").alias("topics"))


@register("base_prompt", O.ctes(O.QS) + f"SELECT question_id, {_QL.format(p='')} || '\n\nTemplate:\n' || question_template || '\n\n' || {lit(P.BASE_INSTRUCTIONS)} AS prompt FROM qs", SV)
def base_prompt(spark, sf):
    return Flow(spark, sf).qs.select("question_id", P.base_prompt().alias("prompt"))


@register("scenario1_prompts", _BASE + f"""SELECT question_unittest_id AS question_id,
  {_QL.format(p='')} || '\n\nTemplate:\n' || question_template || '\n\n' || {lit(P.BASE_INSTRUCTIONS)} AS prompt,
  CAST(len(string_split(question_unittests, 'Unittest')) - 1 AS INTEGER) AS n_tests
FROM s1 WHERE question_unittest_id IN (SELECT question_id FROM parsable)""", SV)
def scenario1_prompts(spark, sf):
    p = P.scenario1_prompts(Flow(spark, sf).s1)
    return p.select("question_id", "prompt", F.size("test_cases").alias("n_tests"))


# --- completions --------------------------------------------------------------------

_MODELS = ["acme_model-a", "acme_model-b", "other_model_c"]
_COMP = r"""comp AS (SELECT CAST(split_part(instance_id, '_', 1) AS BIGINT) AS student_id,
  CAST(split_part(instance_id, '_', 2) AS BIGINT) AS question_id, model, text FROM completions)"""


def _comp(spark, sf):
    c = fixtures(spark, sf).completions
    ids = X.split_instance_id("instance_id")
    return c.select(ids["student_id"].alias("student_id"), ids["question_id"].alias("question_id"), "model", "text")


@register("completion_table", _BASE.rstrip() + ",\n" + _COMP + f"""
SELECT p.student_id, p.question_id, p.model, coalesce(c.text, {lit(P.ERROR_MISSING)}) AS text
FROM (SELECT DISTINCT student_id, question_unittest_id AS question_id, unnest({_MODELS!r}) AS model FROM latest) p
LEFT JOIN comp c USING (student_id, question_id, model)""".replace('["', "['").replace('"]', "']").replace('", "', "', '"),
          ("submissions", "questions", "completions"))
def completion_table(spark, sf):
    f = Flow(spark, sf)
    prompts = f.latest.select("student_id", F.col("question_unittest_id").alias("question_id")).distinct()
    return P.completion_table(prompts, _comp(spark, sf), _MODELS)


@register("split_instance_id", """SELECT instance_id,
  CASE WHEN len(string_split(instance_id, '_')) = 2 THEN try_cast(split_part(instance_id, '_', 1) AS BIGINT) END AS student_id,
  CASE WHEN len(string_split(instance_id, '_')) = 2 THEN try_cast(split_part(instance_id, '_', 2) AS BIGINT) END AS question_id
FROM completions""", ("completions",))
def split_instance_id(spark, sf):
    c = fixtures(spark, sf).completions
    ids = X.split_instance_id("instance_id")
    return c.select("instance_id", ids["student_id"].alias("student_id"), ids["question_id"].alias("question_id"))


@register("composite_id_only", "SELECT instance_id FROM completions WHERE instr(instance_id, '_') > 0 AND len(string_split(instance_id, '_')) = 2", ("completions",))
def composite_id_only(spark, sf):
    c = fixtures(spark, sf).completions
    return c.filter((F.instr("instance_id", "_") > 0) & (F.size(F.split("instance_id", "_")) == 2)).select("instance_id")


@register("scan_completions_json", O.ctes(_COMP) + "SELECT student_id, question_id, text FROM comp", ("completions",))
def scan_completions_json(spark, sf):
    """Written as completion documents (both shapes) and as one state per line, read back through the file reader."""
    c = fixtures(spark, sf).completions
    state = F.struct(F.struct(F.col("instance_id").alias("id")).alias("instance"),
                     F.struct(F.array(F.struct(F.col("text").alias("text"))).alias("completions")).alias("result"))
    docs, lines = scratch_folder(spark, "completion-documents"), scratch_folder(spark, "completion-states")
    # one document per conversation group, of either shape
    grouped = (c.filter(F.col("conv_id") % 2 == 0).withColumn("state", state)
               .groupBy(F.floor(F.col("conv_id") / 20).alias("part")).agg(F.collect_list("state").alias("states"))
               .select("part", F.when(F.col("part") % 2 == 0, F.to_json("states"))
                       .otherwise(F.to_json(F.struct(F.col("states").alias("request_states")))).alias("value")))
    grouped.write.partitionBy("part").text(docs)
    c.filter(F.col("conv_id") % 2 != 0).select(state.alias("s")).select("s.*").write.json(lines)
    read = files.read_completions_json(spark, f"{docs}/part=*").unionByName(files.read_completions_json(spark, lines, lines=True))
    return read.select("student_id", "question_id", "text")


@register("normalise_model_name", "SELECT DISTINCT model, regexp_replace(model, '^[^_]*_', '') AS model_name FROM completions", ("completions",))
def normalise_model_name(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("model", X.normalise_model_name("model").alias("model_name")).distinct()


_STOPS = ["\n\n", ". ", "```"]


@register("truncate_at_stop", "SELECT conv_id, turn, CASE " + " ".join(
    f"WHEN instr(text, {lit(s)}) > 0 THEN split_part(text, {lit(s)}, 1)" for s in _STOPS) + " ELSE text END AS text FROM completions",
          ("completions",))
def truncate_at_stop(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("conv_id", "turn", X.truncate_at_stop("text", _STOPS).alias("text"))


def _extract_sql(t: str) -> str:
    fence = r"(?s)```(?:c\+\+|cpp)?\n(.*?)```"
    code = f"CASE WHEN regexp_matches({t}, '{fence}') THEN {O.strip(f'regexp_extract({t}, {lit(fence)}, 1)')} ELSE {t} END"
    lines = f"string_split_regex({O.strip(code)}, '\\r\\n|\\r|\\n')"
    blank = (f"list_transform({lines}, lambda l: CASE WHEN starts_with({O.strip('l')}, '#include') "
             f"OR starts_with({O.strip('l')}, 'using namespace') THEN '' ELSE l END)")
    joined = O.strip(f"array_to_string({blank}, chr(10))")
    before = O.strip(f"split_part({joined}, 'int main', 1)")
    return f"CASE WHEN instr({joined}, 'int main') > 0 THEN {before} ELSE {joined} END"


@register("extract_code", f"SELECT conv_id, turn, {_extract_sql('text')} AS code FROM completions", ("completions",))
def extract_code(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("conv_id", "turn", X.extract_code("text").alias("code"))


@register("undefined_print_flag", "SELECT conv_id, turn, contains(text, 'print(') AND NOT contains(text, 'void print()') AND NOT contains(text, 'print()') AS print_warning FROM completions", ("completions",))
def undefined_print_flag(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("conv_id", "turn", X.undefined_print_flag("text").alias("print_warning"))


@register("strip_cpp_fence", "SELECT conv_id, turn, regexp_replace(text, '^```cpp\\s*|\\s*```$', '', 'g') AS answer FROM completions", ("completions",))
def strip_cpp_fence(spark, sf):
    c = fixtures(spark, sf).completions
    return c.select("conv_id", "turn", X.strip_cpp_fence("text").alias("answer"))


# --- test lookup and rendering ------------------------------------------------------------

_LOOK = O.ctes(_COMP) + r""", last_row AS (
  SELECT question_id, arg_max(question_unittests, row_no) AS question_unittests FROM catalogue GROUP BY question_id),
first_row AS (SELECT question_id, arg_min(question_template, row_no) AS question_template FROM catalogue GROUP BY question_id),
tests AS (
SELECT question_id, CAST(idx - 1 AS INTEGER) AS test_case_id,
  regexp_replace(replace(regexp_replace(regexp_extract(body, '(?s)^\s*Input:\s*(.*?)\s*Output:\s*(.*)$', 1), '^\s+|\s+$', '', 'g'), 'STD input:', ''), '^\s+|\s+$', '', 'g') AS testcode,
  regexp_replace(regexp_extract(body, '(?s)^\s*Input:\s*(.*?)\s*Output:\s*(.*)$', 2), '^\s+|\s+$', '', 'g') AS expected_output
FROM (SELECT question_id, unnest(bodies) AS body, generate_subscripts(bodies, 1) AS idx
      FROM (SELECT question_id, string_split_regex(question_unittests, 'Unittest\s*\d+:')[2:] AS bodies FROM last_row)))
"""
LV = ("catalogue", "completions")


def _lookup(spark, sf, comp=None):
    cat = fixtures(spark, sf).catalogue
    return G.lookup_tests(comp if comp is not None else _comp(spark, sf), G.question_tests(cat, "row_no"))


@register("lookup_tests", _LOOK + """SELECT c.student_id, c.question_id, c.model, t.test_case_id, t.testcode, t.expected_output,
  CASE WHEN t.test_case_id IS NULL THEN 'missing_tests' ELSE 'ok' END AS lookup_status
FROM comp c LEFT JOIN tests t USING (question_id)""", LV)
def lookup_tests(spark, sf):
    return _lookup(spark, sf).select("student_id", "question_id", "model", "test_case_id", "testcode", "expected_output", "lookup_status")


@register("failure_placeholder", _LOOK + """SELECT c.student_id, c.question_id, c.model FROM comp c
WHERE c.question_id NOT IN (SELECT question_id FROM tests)""", LV)
def failure_placeholder(spark, sf):
    return _lookup(spark, sf).filter(F.col("test_case_id").isNull()).select("student_id", "question_id", "model")


@register("lookup_template", _LOOK + """SELECT c.student_id, c.question_id, c.model, t.question_template,
  CASE WHEN t.question_template IS NULL THEN 'missing_template' ELSE 'ok' END AS template_status
FROM comp c LEFT JOIN first_row t USING (question_id)""", LV)
def lookup_template(spark, sf):
    t = G.lookup_template(_comp(spark, sf), fixtures(spark, sf).catalogue, "row_no")
    return t.select("student_id", "question_id", "model", "question_template", "template_status")


@register("render_submission", _LOOK + f"""SELECT c.student_id, c.question_id, c.model, t.test_case_id,
  replace(replace(regexp_replace(regexp_replace(p.question_template, '\\{{\\{{\\s*TESTCASE\\.testcode\\s*\\}}\\}}', '{{{{ TESTCASE.testcode }}}}', 'g'),
                                 '\\{{\\{{\\s*STUDENT_ANSWER\\s*\\}}\\}}', '{{{{ STUDENT_ANSWER }}}}', 'g'),
                  '{{{{ TESTCASE.testcode }}}}', t.testcode),
          '{{{{ STUDENT_ANSWER }}}}', regexp_replace({_extract_sql("c.text")}, '^```cpp\\s*|\\s*```$', '', 'g')) AS cpp_code
FROM comp c JOIN tests t USING (question_id) JOIN first_row p USING (question_id)""", LV)
def render_submission(spark, sf):
    # the code is taken out of each completion once, before the tests multiply the rows
    comp = _comp(spark, sf).withColumn("answer", X.extract_code("text")).drop("text")
    look = _lookup(spark, sf, comp).filter(F.col("test_case_id").isNotNull())
    rows = look.join(G.question_templates(fixtures(spark, sf).catalogue, "row_no"), "question_id")
    return G.render_submission(rows).select("student_id", "question_id", "model", "test_case_id", "cpp_code")
