"""Edge cases of the text functions on literal frames."""

from pyspark.sql import functions as F

from attemptlab.functions import text as X


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("r")).first()["r"]


def test_is_perfect(spark):
    df = spark.createDataFrame([("111",), ("110",), ("",), ("0",), (None,)], "p string")
    got = [r[0] for r in df.select(X.is_perfect("p")).collect()]
    assert got == [True, False, True, False, None]


def test_pad_never_truncates(spark):
    df = spark.createDataFrame([("1", 4), ("11111", 3), ("", 2)], "p string, n int")
    assert [r[0] for r in df.select(X.pad_pass("p", F.col("n"))).collect()] == ["1000", "11111", "00"]


def test_pass_digits_empty(spark):
    df = spark.createDataFrame([("",), ("101",)], "p string")
    assert [r[0] for r in df.select(X.pass_digits("p")).collect()] == [[], ["1", "0", "1"]]


def test_strip_all_whitespace(spark):
    assert one(spark, X.strip("v"), " \t x y\n\r ") == "x y"


def test_count_tests_needs_space(spark):
    assert one(spark, X.count_tests("v"), "Unittest 1: a Unittest2: b Unittest  3: c") == 2


SPEC = "Unittest 1: Input: f(1) STD input: 5 Output: 2\nUnittest 2: Input: f(2) STD input:  Output: 3\n"


def test_parse_strict_and_lenient(spark):
    df = spark.createDataFrame([(SPEC,), (SPEC + "Unittest 3: Input: g Output: 9",)], "v string")
    strict = [r[0] for r in df.select(X.parse_tests_strict("v")).collect()]
    assert [(t.input, t.std_in, t.output) for t in strict[0]] == [("f(1)", "5", "2"), ("f(2)", "", "3")]
    assert strict[1] == []                      # one incomplete block empties the row
    lenient = df.select(X.parse_tests_lenient("v")).collect()[1][0]
    assert [(t.unittest, t.input, t.output) for t in lenient] == [
        ("1", "f(1) STD input: 5", "2"), ("2", "f(2) STD input:", "3"), ("3", "g", "9")]


def test_format_testcases_default_std_in(spark):
    df = spark.createDataFrame([(SPEC,)], "v string")
    r = df.select(X.format_testcases(X.parse_tests_lenient("v"), has_std_in=False)).first()[0]
    assert r[0].testcode == "f(1) STD input: 5" and r[0].std_in == "" and r[0].expected_output == "2"


def test_extract_code_paths(spark):
    cases = [
        ("```cpp\n#include <x>\nint f(){}\n```", "int f(){}"),
        ("intro\n```c++\nint a;\n```\nmiddle\n```\nint b;\n```", "int a;"),
        ("```\nusing namespace std;\nint g;\nint main(){}\n```", "int g;"),
        ("no fence int h; int main() {} int main() {}", "no fence int h;"),
        ("  a\r\n#include <y>\r\nb  ", "a\n\nb"),
    ]
    df = spark.createDataFrame(cases, "v string, want string")
    for got, want in df.select(X.extract_code("v"), "want").collect():
        assert got == want


def test_clean_code_and_is_cpp(spark):
    assert one(spark, X.clean_code("v"), "CPP \nint x;  ") == "int x;"
    assert one(spark, X.is_cpp("v"), "std::vector<int> v;") is True
    assert one(spark, X.is_cpp("v"), "def f(): pass") is False


def test_split_ids(spark):
    df = spark.createDataFrame([("7",), ("7_8",), ("7_8_9",), ("x_1",)], "v string")
    got = [tuple(r[0]) for r in df.select(X.split_instance_id("v")).collect()]
    assert got == [(None, None), (7, 8), (None, None), (None, 1)]


def test_split_testlet_item(spark):
    df = spark.createDataFrame([("3_4",), ("3",), ("3_4_5",)], "v string")
    got = [tuple(r[0]) for r in df.select(X.split_testlet_item("v")).collect()]
    assert got == [("3", "4"), ("3", None), ("3", "4")]


def test_truncate_at_stop_list_order(spark):
    # the first *listed* stop that occurs wins, even if another occurs earlier
    assert one(spark, X.truncate_at_stop("v", ["END", "."]), "a. b END c") == "a. b "
    assert one(spark, X.truncate_at_stop("v", ["END", "."]), "a. b") == "a"
    assert one(spark, X.truncate_at_stop("v", ["END"]), "abc") == "abc"


def test_tokens_unicode_words(spark):
    assert one(spark, X.tokens("v"), "é_x=f(a,b);") == ["é_x", "=", "f", "(", "a", ",", "b", ")", ";"]
    assert one(spark, X.word_count("v"), "été 2 x_y") == 3


def test_model_name_and_error(spark):
    assert one(spark, X.normalise_model_name("v"), "vendor_model_x") == "model_x"
    assert one(spark, X.is_error_completion("v"), "ERROR: boom") is True
