"""Fixture views over the driver's test tables.

Each view is plain SQL that runs unchanged in Spark SQL and in DuckDB, so a
query and its oracle start from identical inputs.  Every view reads whole
tables; keys are spread with modular arithmetic so the derived tables keep
realistic group sizes while the numbers of students, attempts and results
grow with the scale factor (one student per event user).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

# Submission log: one row per event; the response text is a whole document.
SUBMISSIONS = """
SELECT e.event_id AS submission_id, e.user_id AS student_id, e.event_id % 20 AS question_unittest_id,
  CASE WHEN e.event_type IN ('error','signup') THEN 'Precheck' ELSE 'Submit' END AS response_type, e.ts AS ts,
  concat(CASE WHEN (k * 7 + e.user_id) % 10 < 8 THEN '1' ELSE '0' END,
         CASE WHEN (k * 3 + e.user_id) % 10 < 7 THEN '1' ELSE '0' END,
         CASE WHEN (k + e.user_id * 3) % 10 < 8 THEN '1' ELSE '0' END,
         CASE WHEN k % 50 = 3 THEN '' WHEN (k * 11 + e.user_id * 7) % 10 < 6 THEN '1' ELSE '0' END) AS pass,
  d.text AS response
FROM (SELECT event_id, user_id, event_type, ts, CAST(floor(event_id / 20) AS BIGINT) AS k,
             event_id % (SELECT count(*) FROM documents) AS doc_key
      FROM events) e
JOIN documents d ON d.doc_id = e.doc_key
"""

# Question catalogue: every part is a question.
QUESTIONS = """
SELECT p_partkey AS question_id, p_size % 12 + 1 AS week, p_type AS topic, p_name AS question_name,
  concat('Write ', p_name) AS question_text,
  concat('int g;', chr(10), '{{ STUDENT_ANSWER }}', chr(10), 'int main(){}') AS question_template,
  concat('Unittest 1: Input: f(', CAST(p_size AS STRING), ') STD input: 1 Output: ', CAST(p_size + 1 AS STRING), chr(10),
         'Unittest 2: Input: f(2) STD input: 2 Output: 3', chr(10),
         'Unittest 3: Input: f(3) STD input: Output: 4', chr(10),
         CASE WHEN p_partkey % 7 = 6 THEN 'Unittest 4: Input: f(4) Output: 5'
              ELSE 'Unittest 4: Input: f(4) STD input: 9 Output: 5' END) AS question_unittests
FROM part
"""

# Catalogue as a file may hold it: rows in an order (row_no), some question ids twice with another template and
# other tests, some not at all.
CATALOGUE = """
SELECT question_id AS row_no, question_id, question_template, question_unittests FROM questions WHERE question_id % 9 <> 4
UNION ALL
SELECT question_id + 1000000000 AS row_no, question_id, concat('// again', chr(10), question_template) AS question_template,
  concat('Unittest 1: Input: again(', CAST(question_id AS STRING), ') Output: ', CAST(question_id AS STRING), chr(10),
         'Unittest 2: Input: STD input: x Output: y') AS question_unittests
FROM questions WHERE question_id % 9 <> 4 AND question_id % 5 = 2
UNION ALL
SELECT question_id - 1000000000 AS row_no, question_id, concat('zz ', question_template) AS question_template,
  'Unittest 1: Input: old Output: old' AS question_unittests
FROM questions WHERE question_id % 9 <> 4 AND question_id % 5 = 3
"""

# Response log of the testlet model (student, "testlet_item", 0/1 score, attempt order T).
RESPONSES = """
SELECT o.o_custkey % (SELECT max(user_id) + 1 FROM events) AS StudentID_SF,
  concat(CAST(l.l_partkey % 30 AS STRING), '_', CAST(l.l_linenumber AS STRING)) AS ItemID_SF,
  CASE WHEN l.l_linenumber = 7 AND l.l_partkey % 30 = 0 THEN 1
       WHEN (o.o_custkey % 200) * 3 + (l.l_partkey % 30) * 5 + l.l_quantity * 20 > 900 THEN 1 ELSE 0 END AS ItemScore,
  l.l_orderkey AS T
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

# Execution results of three models, one row per (model, student, question, test case); some rows have no test
# case, no output, a failed or no run time.
EXECUTIONS = """
SELECT model, student_id, question_id, CAST(test_case_id AS INTEGER) AS test_case_id,
  CAST(test_case_id + 1 AS STRING) AS expected_output,
  CASE WHEN q % 10 = 0 OR q % 13 = 0 THEN NULL WHEN q % 3 = 0 THEN 'x'
       ELSE concat(' ', CAST(test_case_id + 1 AS STRING), chr(10)) END AS stdout,
  CASE WHEN q % 20 = 0 THEN NULL WHEN q % 10 = 0 THEN 'fail' WHEN q % 17 = 0 THEN '0'
       ELSE concat(CAST(q AS STRING), '.25') END AS run_time
FROM (SELECT model, student_id, question_id,
        CASE WHEN question_id = 19 AND t4 = 3 THEN NULL ELSE t4 END AS test_case_id, q
      FROM (SELECT l_returnflag AS model, l_orderkey % (SELECT max(user_id) + 1 FROM events) AS student_id,
              l_partkey % 20 AS question_id, l_linenumber % 4 AS t4, CAST(max(l_quantity) AS BIGINT) AS q
            FROM lineitem GROUP BY 1, 2, 3, 4) g) t
"""

# Model completions keyed by "student_question" instance ids: fenced (tagged or not), with headers, with a main
# function, plain, or failed.
COMPLETIONS = """
SELECT concat(CAST(conv_id % (SELECT max(user_id) + 1 FROM events) AS STRING), '_', CAST(turn % 20 AS STRING)) AS instance_id,
  conv_id, turn,
  CASE WHEN conv_id % 3 = 0 THEN 'acme_model-a' WHEN conv_id % 3 = 1 THEN 'acme_model-b' ELSE 'other_model_c' END AS model,
  CASE WHEN conv_id % 11 = 5 THEN concat('ERROR: ', text)
       WHEN conv_id % 9 = 1 THEN concat('```cpp', chr(10), text, chr(10), '```')
       WHEN conv_id % 9 = 2 THEN concat('Answer:', chr(10), '```c++', chr(10), '#include <vector>', chr(10), '  using namespace std;',
                                        chr(10), text, chr(10), 'print(1);', chr(10), '```', chr(10), 'Done.')
       WHEN conv_id % 9 = 3 THEN concat('```', chr(10), text, chr(10), 'int main() { return 0; }', chr(10), '```')
       WHEN conv_id % 9 = 4 THEN concat('void print() {}', chr(10), text, ' print(2)')
       WHEN conv_id % 9 = 5 THEN concat('#include <map>', chr(10), text, chr(10), 'int main(){}')
       ELSE text END AS text
FROM conversations WHERE role = 'assistant'
"""

# Pairs of neighbouring embedding vectors.
VECTOR_PAIRS = """
SELECT a.vec_id AS left_id, b.vec_id AS right_id, a.label AS label, a.embedding AS x, b.embedding AS y
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
"""

# Conversation turn pairs (user prompt, assistant answer) as text pairs.
TEXT_PAIRS = """
SELECT u.conv_id AS pair_id, u.text AS left_text,
  CASE WHEN u.conv_id % 6 = 1 THEN concat('cpp', chr(10), a.text) WHEN u.conv_id % 6 = 2 THEN concat('C++  ', chr(10), a.text)
       WHEN u.conv_id % 6 = 3 THEN concat('#include <map>', chr(10), a.text) WHEN u.conv_id % 6 = 4 THEN concat(a.text, ' std::move(x);')
       ELSE a.text END AS right_text
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'
"""

# Closed-form log-odds per student, item and testlet: stand-ins for fitted effects.
EFFECTS = """
SELECT 'student' AS level, CAST(StudentID_SF AS STRING) AS id,
       ln((sum(ItemScore) + 0.5) / (count(*) - sum(ItemScore) + 0.5)) AS Estimate
FROM responses GROUP BY StudentID_SF
UNION ALL
SELECT 'item' AS level, ItemID_SF AS id,
       ln((sum(ItemScore) + 0.5) / (count(*) - sum(ItemScore) + 0.5)) AS Estimate
FROM responses GROUP BY ItemID_SF
UNION ALL
SELECT 'testlet' AS level, split_part(ItemID_SF, '_', 1) AS id,
       ln((sum(ItemScore) + 0.5) / (count(*) - sum(ItemScore) + 0.5)) AS Estimate
FROM responses GROUP BY split_part(ItemID_SF, '_', 1)
"""

VIEWS = {
    "submissions": SUBMISSIONS,
    "questions": QUESTIONS,
    "catalogue": CATALOGUE,
    "responses": RESPONSES,
    "executions": EXECUTIONS,
    "completions": COMPLETIONS,
    "vector_pairs": VECTOR_PAIRS,
    "text_pairs": TEXT_PAIRS,
    "effects": EFFECTS,
}
# views that read other views
VIEW_DEPS = {"effects": ["responses"], "catalogue": ["questions"]}


_REGISTERED: dict[int, tuple[SparkSession, str]] = {}   # holds the session, so its id stays unique
_BASE: dict[tuple[int, str, str], DataFrame] = {}


def _sid(spark: SparkSession) -> int:
    return id(spark._jsparkSession)


def register_base_tables(spark: SparkSession, sf_dir: str) -> None:
    """Register the driver's parquet tables as temp views (lazy scans), once per folder in a row."""
    seen = _REGISTERED.get(_sid(spark))
    if seen is not None and seen[0] is spark and seen[1] == sf_dir:
        return
    for name in BASE_TABLES:
        key = (_sid(spark), sf_dir, name)
        if key not in _BASE:
            _BASE[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        _BASE[key].createOrReplaceTempView(name)
    _REGISTERED[_sid(spark)] = (spark, sf_dir)


_FIXTURES: dict[tuple[int, str], "Fixtures"] = {}


def get_fixtures(spark: SparkSession, sf_dir: str) -> "Fixtures":
    """One (plan-only) fixture set per session and folder."""
    key = (_sid(spark), sf_dir)
    if key not in _FIXTURES:
        _FIXTURES[key] = Fixtures(spark, sf_dir)
    return _FIXTURES[key]


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._cache: dict[str, DataFrame] = {}

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        if name not in self._cache:
            deps = {d: self.view(d) for d in VIEW_DEPS.get(name, [])}
            register_base_tables(self.spark, self.sf_dir)
            for d, df in deps.items():
                df.createOrReplaceTempView(d)
            self._cache[name] = self.spark.sql(VIEWS[name])   # analysed now: later view swaps do not touch it
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.view(name)
        raise AttributeError(name)


def with_views(body: str, *names: str) -> str:
    """Prefix an oracle query with the fixture views it reads, as CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
    if not ctes:
        return body
    stripped = body.lstrip()
    if stripped[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{stripped[5:]}"
    return f"WITH {ctes}\n{body}"
