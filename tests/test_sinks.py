"""Partition-wise replacement of result tables."""

import glob

import pytest
from pyspark.sql import functions as F

from attemptlab.sources import files as FS

KEYS = ["model", "scenario"]


def results(spark, rows):
    return spark.createDataFrame(rows, "model string, scenario int, student_id long, correctness int")


def read(spark, path):
    return {tuple(r) for r in spark.read.parquet(path).select("model", "scenario", "student_id", "correctness").collect()}


OLD = [("a", 1, 1, 0), ("a", 2, 1, 0), ("b", 1, 1, 1), ("b", 1, 2, 1)]


def test_one_partition_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "results")
    FS.write_table(results(spark, OLD), path, partition_by=KEYS)
    before = set(glob.glob(f"{path}/model=a/**/*.parquet", recursive=True))
    FS.write_table(results(spark, [("b", 1, 9, 0), ("c", 3, 1, 1)]), path, partition_by=KEYS, replace="partitions")
    assert read(spark, path) == {("a", 1, 1, 0), ("a", 2, 1, 0), ("b", 1, 9, 0), ("c", 3, 1, 1)}
    assert set(glob.glob(f"{path}/model=a/**/*.parquet", recursive=True)) == before
    # the same write once more gives the same table
    FS.write_table(results(spark, [("b", 1, 9, 0), ("c", 3, 1, 1)]), path, partition_by=KEYS, replace="partitions")
    assert len(read(spark, path)) == 4
    FS.write_table(results(spark, OLD[:1]), path, partition_by=KEYS)
    assert read(spark, path) == {OLD[0]}


def test_failed_write_leaves_every_partition(spark, tmp_path):
    path = str(tmp_path / "results")
    FS.write_table(results(spark, OLD), path, partition_by=KEYS)
    bad = results(spark, [("b", 1, 7, 0), ("b", 1, 8, 0), ("a", 1, 8, 1)]).withColumn(
        "correctness", F.when(F.col("student_id") == 8, F.raise_error(F.lit("lost"))).otherwise(F.col("correctness")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        FS.write_table(bad, path, partition_by=KEYS, replace="partitions")
    assert read(spark, path) == set(OLD)


def test_files_are_few_and_bounded(spark, tmp_path):
    path = str(tmp_path / "results")
    many = spark.range(4000).repartition(8).select(
        F.when(F.col("id") % 4 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("model"), F.lit(1).alias("scenario"),
        F.col("id").alias("student_id"), F.lit(1).alias("correctness"))
    FS.write_table(many, path, partition_by=KEYS, replace="partitions", max_rows_per_file=500)
    counts = {r["f"]: r["n"] for r in spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sum(counts.values()) == 4000 and max(counts.values()) <= 500
    assert len(counts) <= 4000 // 500 + 2          # not one file per task and partition
    FS.write_table(many.limit(0), path, partition_by=KEYS, replace="partitions")
    assert spark.read.parquet(path).count() == 4000


def test_replacement_needs_partitions(spark, tmp_path):
    with pytest.raises(ValueError):
        FS.write_table(results(spark, OLD), str(tmp_path / "x"), replace="partitions")
    with pytest.raises(ValueError):
        FS.write_table(results(spark, OLD), str(tmp_path / "x"), partition_by=KEYS, replace="some")


def test_text_files_can_be_compressed(spark, tmp_path):
    many = results(spark, OLD)
    for fmt in ("csv", "json"):
        path = str(tmp_path / fmt)
        FS.write_table(many, path, fmt=fmt, compression="gzip", max_rows_per_file=1)
        assert glob.glob(f"{path}/*.{fmt}.gz") and not glob.glob(f"{path}/*.{fmt}")
        back = spark.read.schema(many.schema)
        back = back.option("header", True).csv(path) if fmt == "csv" else back.json(path)
        assert {tuple(r) for r in back.collect()} == set(OLD)


@pytest.fixture(scope="module")
def metric_rows(spark):
    """Metrics over rows that are not stored."""
    from attemptlab.operators import metrics as M
    from attemptlab.plans.queries_grading import MetricFlow
    from attemptlab.plans.queries_similarity import pair_metrics
    from tests.conftest import SF_SMALL

    f = MetricFlow(spark, SF_SMALL)
    long = M.scenario_metrics(f.graded, f.student, pair_metrics=pair_metrics(f), student_results=f.student_results)
    return sorted((r.scenario, r.model, r.metric, round(r.value, 6)) for r in long.collect())


@pytest.mark.parametrize("name", ["scenario_metrics", "union_models", "sink_metrics_json", "metrics_matrix"])
def test_metrics_read_stored_rows(spark, metric_rows, name, monkeypatch):
    from attemptlab import registry
    from attemptlab.sources import files
    from tests.conftest import SF_SMALL

    seen = []
    write = files.sink_metrics_json
    monkeypatch.setattr(files, "sink_metrics_json", lambda long, path: (seen.append(long), write(long, path)))
    df = registry.all_queries()[name](spark, SF_SMALL)
    plan = (seen or [df])[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "l_quantity" not in plan and "WindowGroupLimit" not in plan      # graded rows and attempts are made once, not per metric
    got = [r.asDict() for r in df.collect()]
    if name == "union_models":
        assert {r["model"]: r["n_metrics"] for r in got} == {m: sum(r[1] == m for r in metric_rows) for m in {r[1] for r in metric_rows}}
    elif name == "metrics_matrix":
        assert sorted((r["scenario"], r["model"], m, v) for r in got for m, v in r.items()
                      if m not in KEYS and v is not None) == metric_rows
    else:
        assert sorted((r["scenario"], r["model"], r["metric"], r["value"]) for r in got) == metric_rows
