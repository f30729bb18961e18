"""File readers and sinks with explicit schemas (no inference)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlab.functions import text as X
from attemptlab.operators.attempts import normalise_na

SUBMISSION_SCHEMA = T.StructType([
    T.StructField("submission_id", T.LongType()),
    T.StructField("student_id", T.LongType()),
    T.StructField("question_unittest_id", T.LongType()),
    T.StructField("response", T.StringType()),
    T.StructField("response_type", T.StringType()),
    T.StructField("pass", T.StringType()),          # text: keeps leading zeros such as "0110"
    T.StructField("timestamp", T.TimestampType()),
])
QUESTION_SCHEMA = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("week", T.IntegerType()),
    T.StructField("topic", T.StringType()),
    T.StructField("question_name", T.StringType()),
    T.StructField("question_text", T.StringType()),
    T.StructField("question_template", T.StringType()),
    T.StructField("question_unittests", T.StringType()),
])
RESPONSE_LOG_SCHEMA = T.StructType([
    T.StructField("StudentID_SF", T.LongType()),
    T.StructField("ItemID_SF", T.StringType()),
    T.StructField("ItemScore", T.IntegerType()),
    T.StructField("T", T.LongType()),
])
EXECUTION_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("scenario", T.IntegerType()),
    T.StructField("student_id", T.LongType()),
    T.StructField("question_id", T.LongType()),
    T.StructField("test_case_id", T.IntegerType()),
    T.StructField("cpp_code", T.StringType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("expected_output", T.StringType()),
    T.StructField("run_time", T.StringType()),     # number, "fail" or empty
])
_STATE = T.StructType([
    T.StructField("instance", T.StructType([T.StructField("id", T.StringType())])),
    T.StructField("result", T.StructType([T.StructField("completions", T.ArrayType(
        T.StructType([T.StructField("text", T.StringType())])))])),
])
STATES_DOC = T.StructType([T.StructField("request_states", T.ArrayType(_STATE))])
STATES_LIST = T.ArrayType(_STATE)
TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"
PLAIN_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"      # for columns without a time zone


def read_table(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool = True) -> DataFrame:
    """CSV with a header, JSON lines or Parquet with a fixed schema; NA tokens become null in every format.

    Quoted CSV fields may hold line breaks, which makes a file one task; ``multi_line=False`` reads files without
    such fields in splits.  JSON lines and Parquet are always read in splits: prefer them for large tables.
    """
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        df = reader.parquet(path)
    elif fmt == "json":
        df = reader.option("timestampFormat", TIMESTAMP).json(path)
    else:
        df = (reader.option("header", True).option("multiLine", multi_line).option("timestampFormat", TIMESTAMP)
              .option("timestampNTZFormat", PLAIN_TIMESTAMP).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path))
    return normalise_na(df)


def read_submissions(spark, path, fmt="csv", multi_line=True):
    return read_table(spark, path, SUBMISSION_SCHEMA, fmt, multi_line).withColumnRenamed("timestamp", "ts")


def read_questions(spark, path, fmt="csv", multi_line=True):
    return read_table(spark, path, QUESTION_SCHEMA, fmt, multi_line)


def read_responses(spark, path, fmt="csv", multi_line=False):
    return read_table(spark, path, RESPONSE_LOG_SCHEMA, fmt, multi_line)


def read_scenario_results(spark, root: str, fmt="parquet") -> DataFrame:
    """All (model, scenario) result partitions in one read; filters on model/scenario prune folders."""
    reader = spark.read.option("basePath", root)
    if fmt == "parquet":
        return reader.parquet(root)
    return normalise_na(reader.schema(EXECUTION_SCHEMA).option("header", True).csv(root))


def read_completions_json(spark: SparkSession, path: str, scenario: int | None = None, lines: bool = False) -> DataFrame:
    """Completion documents: ``{request_states: [...]}`` or a bare list of states, one document per file.

    A document that is neither fails the read and names its file.  ``lines=True`` reads one state per line, in
    splits: the form for outputs too large for one document.
    """
    if lines:
        doc = (spark.read.schema(_STATE).json(path)
               .select(F.input_file_name().alias("source"), F.struct("instance", "result").alias("state")))
        return explode_states(doc, extra=["source"], scenario=scenario)
    raw = spark.read.text(path, wholetext=True).withColumn("source", F.input_file_name())
    states = F.coalesce(F.from_json("value", STATES_DOC)["request_states"], F.from_json("value", STATES_LIST),
                        F.raise_error(F.concat(F.lit("neither a document nor a list of states: "), "source")))
    return explode_states(raw.select("source", F.explode(states).alias("state")), extra=["source"], scenario=scenario)


def explode_states(df: DataFrame, extra: list[str] = (), scenario: int | None = None) -> DataFrame:
    """One row per completion of each state; the state's id is kept with each of its texts."""
    rows = df.select(*extra, F.col("state")["instance"]["id"].alias("instance_id"),
                     F.explode(F.col("state")["result"]["completions"]).alias("c"))
    rows = rows.select(*extra, "instance_id", F.col("c")["text"].alias("text"))
    if scenario == 1:
        return rows.select(*extra, F.col("instance_id").try_cast("long").alias("question_id"), "text")
    ids = X.split_instance_id("instance_id")
    return (rows.filter(F.instr("instance_id", "_") > 0)
            .select(*extra, ids["student_id"].alias("student_id"), ids["question_id"].alias("question_id"), "text")
            .filter(F.col("student_id").isNotNull() & F.col("question_id").isNotNull()))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                replace: str = "table", max_rows_per_file: int = 5_000_000, compression: str | None = None) -> None:
    """Write a table; ``partition_by`` gives one folder per (model, scenario) like the reference's files.

    ``replace="table"`` overwrites everything; ``"partitions"`` only the folders that ``df`` has rows for, all others
    stay as they are.  Rows of a partition are brought together before they are written, so that its files are few,
    and a large partition is cut into files of at most ``max_rows_per_file`` rows by the rebalancing of large
    shuffle partitions and by the writer.  A failed write leaves the folders of ``"partitions"`` untouched: new files
    are moved in only when all of them are complete.
    """
    if replace not in ("table", "partitions"):
        raise ValueError(f"replace is 'table' or 'partitions', not {replace!r}")
    if replace == "partitions" and not partition_by:
        raise ValueError("partition-wise replacement needs partition_by")
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode("overwrite").option("maxRecordsPerFile", max_rows_per_file) \
        .option("partitionOverwriteMode", "dynamic" if replace == "partitions" else "static")
    if compression:
        w = w.option("compression", compression)        # gzip keeps a CSV or JSON file from being split: bound its rows
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).option("quote", '"').option("escape", '"').option("timestampFormat", TIMESTAMP) \
            .option("timestampNTZFormat", PLAIN_TIMESTAMP).option("quoteAll", True).csv(path)
    elif fmt == "json":
        w.option("timestampFormat", TIMESTAMP).option("timestampNTZFormat", PLAIN_TIMESTAMP).json(path)
    else:
        w.parquet(path)


def sink_scenarios(tables: dict[str, DataFrame], root: str, fmt: str = "parquet") -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}_full_data", fmt, compression="zstd" if fmt == "parquet" else None)


def sink_metrics_json(long: DataFrame, path: str) -> None:
    """The (scenario, model, metric, value) table as JSON; it has one row per metric, so it is small."""
    long.coalesce(1).write.mode("overwrite").json(path)
