"""Shared DuckDB CTE fragments for the oracle queries."""

from attemptlab.operators.attempts import NA_TOKENS

_NA_LIST = ", ".join("'" + t.replace("'", "''") + "'" for t in NA_TOKENS)


def na(col: str) -> str:
    return f"CASE WHEN {col} IN ({_NA_LIST}) THEN NULL ELSE {col} END AS {col}"


SUBS = f"""subs AS (
  SELECT submission_id, student_id, question_unittest_id, {na('response_type')}, ts, {na('pass')}, {na('response')}
  FROM submissions)"""

QS = f"""qs AS (
  SELECT question_id, week, {na('topic')}, {na('question_name')}, {na('question_text')},
         {na('question_template')}, {na('question_unittests')} FROM questions)"""

CLEAN = """clean AS (
  SELECT *, replace(pass, '1', '') = '' AS is_perfect FROM subs
  WHERE submission_id IS NOT NULL AND student_id IS NOT NULL AND question_unittest_id IS NOT NULL
    AND response_type IS NOT NULL AND ts IS NOT NULL AND pass IS NOT NULL AND response IS NOT NULL
    AND instr(pass, '1') > 0 AND response_type = 'Submit')"""

MERGED = """merged AS (
  SELECT c.*, q.question_id, q.week, q.topic, q.question_name, q.question_text, q.question_template, q.question_unittests
  FROM clean c JOIN qs q ON c.question_unittest_id = q.question_id
  WHERE q.question_id IS NOT NULL AND q.week IS NOT NULL AND q.topic IS NOT NULL AND q.question_name IS NOT NULL
    AND q.question_text IS NOT NULL AND q.question_template IS NOT NULL AND q.question_unittests IS NOT NULL)"""

MIXED = """mixed AS (
  SELECT student_id, question_unittest_id FROM clean GROUP BY student_id, question_unittest_id
  HAVING bool_or(is_perfect) AND bool_or(NOT is_perfect))"""

ALIGN = """mf AS (
  SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.student_id, c.question_unittest_id, c.is_perfect
                                               ORDER BY c.ts, c.submission_id) AS rn
                 FROM clean c JOIN mixed m USING (student_id, question_unittest_id)) WHERE rn = 1),
mf_merged AS (SELECT mf.* FROM mf JOIN qs q ON mf.question_unittest_id = q.question_id),
alignment AS (
  SELECT student_id, question_unittest_id,
         max(CASE WHEN NOT is_perfect THEN response END) AS response_mistake,
         max(CASE WHEN is_perfect THEN response END) AS response_correct
  FROM mf_merged GROUP BY student_id, question_unittest_id
  HAVING count(CASE WHEN NOT is_perfect THEN 1 END) > 0 AND count(CASE WHEN is_perfect THEN 1 END) > 0),
final AS (SELECT m.*, a.response_mistake, a.response_correct FROM merged m JOIN alignment a USING (student_id, question_unittest_id))"""

LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY student_id, question_unittest_id
                                              ORDER BY ts DESC, submission_id DESC) AS rn FROM merged) WHERE rn = 1)"""

S1 = """s1 AS (
  SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY question_unittest_id ORDER BY ts, submission_id) AS rn1
                 FROM latest) WHERE rn1 = 1)"""


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


TOKEN_RE = r"[\p{L}\p{N}_]+|[{}();,=+\-*/]"
WORD_RE = r"[\p{L}\p{N}_]+"


def clean_code(x: str) -> str:
    return strip(f"regexp_replace({x}, '(?i)^(cpp|python|java|c\\+\\+)\\s*\\n', '')")


def tokens(x: str) -> str:
    return f"regexp_extract_all({x}, '{TOKEN_RE}')"


def count_tests(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, 'Unittest\\s+\\d+:')) AS INTEGER)"


STUDENT = """student AS (
  SELECT 2 AS scenario, student_id, question_id, pass, question_unittests, response FROM latest
  UNION ALL SELECT 3, student_id, question_id, pass, question_unittests, response FROM final WHERE response = response_mistake
  UNION ALL SELECT 4, student_id, question_id, pass, question_unittests, response FROM final WHERE response = response_correct)"""

GRADED = f"""graded AS (
  SELECT unnest([1, 2, 3, 4]) AS scenario, e.*,
         CASE WHEN coalesce({strip('e.stdout')} = e.expected_output, false) THEN 1 ELSE 0 END AS correctness
  FROM executions e WHERE e.model <> 'R')"""

DIGITS = f"""digits AS (
  SELECT scenario, student_id, question_id, CAST(i AS INTEGER) AS test_case_id,
         CAST(substr(pp, CAST(i AS INTEGER) + 1, 1) AS INTEGER) AS real_student_correctness
  FROM (SELECT *, unnest(range(length(pp))) AS i
        FROM (SELECT *, pass || repeat('0', greatest({count_tests('question_unittests')} - length(pass), 0)) AS pp FROM student)))"""

JOINED = """joined AS (SELECT * FROM graded JOIN digits USING (scenario, student_id, question_id, test_case_id)),
valid AS (SELECT * FROM joined WHERE correctness IN (0, 1) AND real_student_correctness IN (0, 1))"""


def labels(x: str) -> str:
    return f"list_transform({tokens(clean_code(x))}, lambda t: regexp_replace(t, '[^a-zA-Z0-9_]', '_', 'g'))"


def list_levenshtein(a: str, b: str, common: str) -> str:
    """Edit distance of two lists.  DuckDB's function compares bytes: every common element becomes one byte of its
    own, the others of a side share one; more than 120 common elements are refused."""
    def bytes_of(x, missing):
        return (f"array_to_string(list_transform({x}, lambda t: chr(CAST(CASE WHEN list_position({common}, t) > 0 "
                f"THEN list_position({common}, t) + 3 ELSE {missing} END AS INTEGER))), '')")

    return (f"CASE WHEN len({common}) > 120 THEN CAST(error('more than 120 common elements') AS BIGINT) "
            f"ELSE levenshtein({bytes_of(a, 1)}, {bytes_of(b, 2)}) END")


def words(x: str) -> str:
    return f"len(regexp_extract_all({clean_code(x)}, '{WORD_RE}'))"


def tree_distance_cte(src: str, a: str, b: str, keep: str) -> str:
    """SELECT producing ``ast_edit_distance`` for columns a, b of relation src (keep: passthrough cols)."""
    return f"""SELECT {keep}, CASE WHEN (wa + wb) / 2.0 = 0 THEN 0.0
      ELSE least(1.0, CAST(d AS DOUBLE) / greatest((wa + wb) / 2.0, 1.0)) END AS ast_edit_distance
FROM (SELECT {keep}, wa, wb,
        CASE WHEN len(la) = 0 AND len(lb) = 0 THEN 0
             WHEN len(la) = 0 THEN CASE WHEN list_contains(lb, 'empty') THEN len(lb) ELSE len(lb) + 1 END
             WHEN len(lb) = 0 THEN CASE WHEN list_contains(la, 'empty') THEN len(la) ELSE len(la) + 1 END
             ELSE {list_levenshtein('la', 'lb', 'common')} END AS d
      FROM (SELECT {keep}, la, lb, list_intersect(list_distinct(la), list_distinct(lb)) AS common, wa, wb
            FROM (SELECT {keep}, {labels(a)} AS la, {labels(b)} AS lb, {words(a)} AS wa, {words(b)} AS wb FROM {src})))"""


def jaccard(a: str, b: str) -> str:
    ta = f"list_distinct({tokens(clean_code(a))})"
    tb = f"list_distinct({tokens(clean_code(b))})"
    return f"""CASE WHEN len({ta}) = 0 AND len({tb}) = 0 THEN 0.0
  WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 1.0
  ELSE 1.0 - CAST(len(list_intersect({ta}, {tb})) AS DOUBLE) / CAST(len(list_distinct(list_concat({ta}, {tb}))) AS DOUBLE) END"""


def tf_cosine_ctes(src: str, keys: str, a: str, b: str) -> str:
    """CTEs ending in ``cos`` with columns keys, a, b, codebert_cosine_similarity."""
    return f"""pk AS (SELECT DISTINCT {keys}, {a}, {b} FROM {src}),
toks AS (SELECT {keys}, {a}, {b}, 0 AS side, unnest({tokens(clean_code(a))}) AS token FROM pk
         UNION ALL SELECT {keys}, {a}, {b}, 1 AS side, unnest({tokens(clean_code(b))}) AS token FROM pk),
cnt AS (SELECT {keys}, {a}, {b}, token, CAST(count(*) FILTER (WHERE side = 0) AS DOUBLE) AS l,
               CAST(count(*) FILTER (WHERE side = 1) AS DOUBLE) AS r FROM toks GROUP BY ALL),
sums AS (SELECT {keys}, {a}, {b}, sum(l * r) AS xy, sum(l * l) AS xx, sum(r * r) AS yy FROM cnt GROUP BY ALL),
cos AS (SELECT pk.*, coalesce(CASE WHEN xx > 0 AND yy > 0 THEN xy / (sqrt(xx) * sqrt(yy)) END, 0.0) AS codebert_cosine_similarity
        FROM pk LEFT JOIN sums USING ({keys}, {a}, {b}))"""
