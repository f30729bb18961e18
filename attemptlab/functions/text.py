"""Text functions over submission, test-spec and completion strings.

All are built-in Spark expressions (JVM side, whole-stage codegen); no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------
# Substrings that mark a snippet as C++.
CPP_INDICATORS = ["#include", "std::", "::", "cout", "cin", "endl", "class", "public:",
                  "private:", "protected:", "int main(", "namespace", "template<", "vector<"]
# Line prefixes blanked out of extracted code.
BLANKED_LINE_PREFIXES = ["#include", "using namespace"]
# Marker that prefixes a failed completion.
ERROR_PREFIX = "ERROR:"
# A word: letters, digits and underscore in any script (Python's Unicode \w).
WORD = r"[\p{L}\p{N}_]+"
# A code token: a word or one of the punctuation characters {}();,=+-*/
TOKEN = r"[\p{L}\p{N}_]+|[{}();,=+\-*/]"
# Test-count pattern of the grading step.
TEST_HEADER = r"Unittest\s+\d+:"
# Lenient unit-test block pattern (number, input, output).
LENIENT_TEST = r"(?s)Unittest\s*(\d+):\s*Input:\s*(.*?)\s*Output:\s*(.*?)(?=Unittest\s*\d+:|$)"
# Fenced code block (first one wins); the language tag may be c++ or cpp.
FENCE = r"(?s)```(?:c\+\+|cpp)?\n(.*?)```"
# Leading language marker line dropped before tokenising.
LANG_MARKER = r"(?i)^(cpp|python|java|c\+\+)\s*\n"
# Markdown fence around a student answer before rendering.
CPP_FENCE_EDGES = r"^```cpp\s*|\s*```$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()``: trim all leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(_c(c), r"^\s+|\s+$", "")


def is_perfect(pass_str) -> Column:
    """Every character of the pass string is ``1`` (empty string counts as perfect)."""
    return F.replace(_c(pass_str), F.lit("1"), F.lit("")) == F.lit("")


def has_a_pass(pass_str) -> Column:
    return F.instr(_c(pass_str), "1") > 0


def count_tests(spec) -> Column:
    """Number of ``Unittest <n>:`` headers in a test specification."""
    return F.regexp_count(_c(spec), F.lit(TEST_HEADER))


def pad_pass(pass_str, n) -> Column:
    """Right-pad with ``0`` up to ``n`` characters; never truncates (unlike rpad)."""
    p = _c(pass_str)
    return F.concat(p, F.repeat(F.lit("0"), F.greatest(_c(n) - F.length(p), F.lit(0))))


def pass_digits(pass_str) -> Column:
    """Pass string as an array of one-character strings (empty string -> empty array)."""
    p = _c(pass_str)
    return F.when(F.length(p) > 0, F.split(p, "")).otherwise(F.array().cast("array<string>"))


def parse_tests_lenient(spec) -> Column:
    """``array<struct<unittest,input,output>>`` by regex; ``STD input:`` stays inside ``input``."""
    s = _c(spec)
    nums = F.regexp_extract_all(s, F.lit(LENIENT_TEST), 1).alias("unittest")
    ins = F.regexp_extract_all(s, F.lit(LENIENT_TEST), 2).alias("input")
    outs = F.regexp_extract_all(s, F.lit(LENIENT_TEST), 3).alias("output")
    # zip first: a lambda body is evaluated per element, so it must not hold the regex scans
    return F.transform(F.arrays_zip(nums, ins, outs), lambda t: F.struct(
        strip(t["unittest"]).alias("unittest"), strip(t["input"]).alias("input"), strip(t["output"]).alias("output")))


def _strict_block(block: Column) -> Column:
    body = F.substring(block, F.instr(block, ":") + 1, 1 << 30)
    ii = F.instr(body, "Input:")
    si = F.instr(body, "STD input:")
    oi = F.instr(body, "Output:")
    ok = (ii > 0) & (si > 0) & (oi > 0)
    return F.struct(
        ok.alias("ok"),
        strip(F.substring(body, ii + 6, F.greatest(si - ii - 6, F.lit(0)))).alias("input"),
        strip(F.substring(body, si + 10, F.greatest(oi - si - 10, F.lit(0)))).alias("std_in"),
        strip(F.substring(body, oi + 7, 1 << 30)).alias("output"))


STRICT_TESTS_TYPE = "array<struct<input:string,std_in:string,output:string>>"


def parse_tests_strict(spec) -> Column:
    """``array<struct<input,std_in,output>>``; one incomplete block empties the whole list."""
    pieces = F.split(_c(spec), "Unittest")
    blocks = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    parsed = F.transform(blocks, _strict_block)
    good = F.transform(parsed, lambda t: F.struct(t["input"].alias("input"),
                                                  t["std_in"].alias("std_in"),
                                                  t["output"].alias("output")))
    empty = F.array().cast(STRICT_TESTS_TYPE)
    return F.when(F.exists(parsed, lambda t: ~t["ok"]), empty).otherwise(good)


def format_testcases(tests, has_std_in: bool = True) -> Column:
    """``{input, output, [std_in]}`` -> ``{testcode, expected_output, std_in}`` (std_in defaults to '')."""
    def one(t):
        std = t["std_in"] if has_std_in else F.lit(None).cast("string")
        return F.struct(t["input"].alias("testcode"), t["output"].alias("expected_output"),
                        F.coalesce(std, F.lit("")).alias("std_in"))
    return F.transform(_c(tests), one)


def strip_std_marker(testcode) -> Column:
    return strip(F.replace(_c(testcode), F.lit("STD input:"), F.lit("")))


def strip_cpp_fence(answer) -> Column:
    return F.regexp_replace(_c(answer), CPP_FENCE_EDGES, "")


def extract_code(text) -> Column:
    """First fenced block if any, blank ``#include``/``using namespace`` lines, cut at ``int main``."""
    t = _c(text)
    code = F.when(t.rlike(FENCE), strip(F.regexp_extract(t, FENCE, 1))).otherwise(t)
    lines = F.split(strip(code), r"\r\n|\r|\n")
    blank = F.transform(lines, lambda ln: F.when(
        F.exists(F.array(*[F.lit(p) for p in BLANKED_LINE_PREFIXES]),
                 lambda p: F.startswith(strip(ln), p)), F.lit("")).otherwise(ln))
    joined = strip(F.array_join(blank, "\n"))
    return F.when(F.instr(joined, "int main") > 0,
                  strip(F.substring_index(joined, "int main", 1))).otherwise(joined)


def undefined_print_flag(code) -> Column:
    c = _c(code)
    return c.contains("print(") & ~c.contains("void print()") & ~c.contains("print()")


def clean_code(code) -> Column:
    """Drop a leading language-marker line, then strip."""
    return strip(F.regexp_replace(_c(code), LANG_MARKER, ""))


def is_cpp(code) -> Column:
    c = _c(code)
    out = F.lit(False)
    for s in CPP_INDICATORS:
        out = out | c.contains(s)
    return out


def tokens(code) -> Column:
    """Code tokens: words or single punctuation characters, in order."""
    return F.regexp_extract_all(_c(code), F.lit(TOKEN), 0)


def word_count(code) -> Column:
    return F.regexp_count(_c(code), F.lit(WORD))


def is_error_completion(text) -> Column:
    return F.startswith(_c(text), F.lit(ERROR_PREFIX))


def split_instance_id(instance_id) -> Column:
    """``"sid_qid"`` -> struct(student_id, question_id); other shapes give nulls."""
    parts = F.split(_c(instance_id), "_")
    ok = F.size(parts) == 2
    return F.struct(
        F.when(ok, parts[0].try_cast("long")).alias("student_id"),
        F.when(ok, parts[1].try_cast("long")).alias("question_id"))


def split_testlet_item(item_id) -> Column:
    """``"testlet_item"`` -> struct(Testlet_ID, Item_ID); extra pieces dropped, missing -> null."""
    parts = F.split(_c(item_id), "_")
    return F.struct(F.try_element_at(parts, F.lit(1)).alias("Testlet_ID"),
                    F.try_element_at(parts, F.lit(2)).alias("Item_ID"))


def normalise_model_name(model) -> Column:
    """Drop the vendor part before the first ``_``."""
    return F.regexp_replace(_c(model), r"^[^_]*_", "")


def truncate_at_stop(text, stops: list[str]) -> Column:
    """Cut at the first *listed* stop sequence that occurs (list order, not position)."""
    t = _c(text)
    out = t
    for s in reversed(stops):
        out = F.when(F.instr(t, s) > 0, F.substring_index(t, s, 1)).otherwise(out)
    return out
