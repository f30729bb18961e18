"""Online ability / difficulty ratings and their comparison with ground truth.

Two forms of the rating fold (theta += K(y - p), z -= K(y - p), p logistic):

* ``elo_minibatch`` – every row of a batch reads the ratings at the start of
  the batch; damped steps per student and per item come from two grouped
  aggregations.  Fully parallel; equals the sequential fold when no id
  repeats inside a batch.
* ``elo_sequential`` – the exact ordered fold, for small data and as a check
  of the other form only: an ordered fold cannot be spread over tasks, each
  model's rows pass through one Python task, chunk after chunk.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attemptlab.functions.vectors import logistic_p
from attemptlab.operators import stats as ST
from attemptlab.session import cut_lineage, drop_folder, scratch_folder

# Learning rate and starting rating of the reference's update.
K_DEFAULT = 0.4
START_RATING = 0.0


def rasch_update(theta, z, resp, K: float = K_DEFAULT):
    """One update step as columns: (theta_new, z_new)."""
    delta = F.lit(K) * (resp - logistic_p(theta, z))
    return theta + delta, z - delta


def default_rating(c):
    return F.coalesce(c, F.lit(START_RATING))


def rating_stream(graded: DataFrame) -> DataFrame:
    """Graded rows -> (model, student_id, item_id, y) with item = question_test (rows without a test dropped)."""
    return graded.filter(F.col("test_case_id").isNotNull() & F.col("correctness").isNotNull()).select(
        "*", F.concat_ws("_", F.col("question_id").cast("string"), F.col("test_case_id").cast("string")).alias("item_id"),
        F.col("correctness").alias("y"))


def _running_level(rows: DataFrame, keys: list[str], order: list[str], slices: int) -> DataFrame:
    """``level`` raised so that it grows by one at least from row to row of each key, in this order.

    Rows are cut into ``slices`` ranges of (key, order), so the rows of a hot key are spread over tasks; a key that
    reaches over several slices takes count and level of the earlier ones from a table of one row per slice and key.
    """
    cut = cut_lineage(rows.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id()))
    own = Window.partitionBy("_slice", *keys).orderBy(*order)
    ranked = (cut.withColumn("_j", F.row_number().over(own))
              .withColumn("_m", F.max(F.col("level") - F.col("_j")).over(own.rowsBetween(Window.unboundedPreceding, 0))))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (ranked.groupBy(*keys, "_slice").agg(F.max("_j").alias("_n"), F.max("_m").alias("_top"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
            .withColumn("_carry", F.max(F.col("_top") - F.col("_off")).over(earlier)))
    carried = ends.where("_off > 0").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                                            F.col("_slice").alias("_s"), "_off", "_carry")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    off = F.coalesce("_off", F.lit(0))
    return (ranked.join(carried, reduce(lambda a, b: a & b, same, F.col("_slice") == F.col("_s")), "left")
            .withColumn("level", (off + F.col("_j") + F.greatest(F.col("_m") - off, "_carry")).cast("long"))
            .select(*rows.columns))


def wave_batches(stream: DataFrame, order_cols: list[str], batches: int | None, group=("model",), rounds: int = 2,
                 slices: int | None = None) -> DataFrame:
    """``stream`` with a ``batch`` (0 to ``batches`` - 1) that follows the ordered fold, so that ids rarely repeat in one.

    The level of a row is the number of rows that must come before it: one more than that of the row before it of
    its student and of its item, in the order of ``order_cols`` (ties by student, item and outcome).  Rows of one
    level share no id, hence a batch per level is the ordered fold itself.  Levels are found by running maxima over
    students and items in turn, ``rounds`` times; too few rounds leave levels too low (an id may then repeat in a
    level), never out of order within an item.  ``batches`` joins neighbouring levels into batches of equal width
    per group; None keeps each level as a batch.  Rows with a null id form a chain of their own; an empty stream gives
    an empty result; columns named ``batch`` or ``level`` are refused.
    """
    clash = {"batch", "level", "_slice", "_j", "_m"} & set(stream.columns)
    if clash:
        raise ValueError(f"columns of the stream in the way: {sorted(clash)}")
    group = list(group)
    order = list(dict.fromkeys([*order_cols, "student_id", "item_id", "y", "level"]))
    slices = slices or int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stream.withColumn("level", F.lit(0).cast("long"))
    for _ in range(rounds):
        for id_col in ("student_id", "item_id"):
            rows = _running_level(rows, [*group, id_col], order, slices)
    if batches is None:
        return rows.withColumnRenamed("level", "batch")
    rows = cut_lineage(rows)
    ends = rows.groupBy(*group).agg((F.max("level") + 1).alias("_levels")) \
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_levels")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.lit(True))
    width = F.floor(F.col("level") * F.lit(batches) / F.col("_levels"))
    return rows.join(ends, same).withColumn("batch", F.least(width, F.lit(batches - 1)).cast("int")).select(*stream.columns, "batch")


def elo_minibatch(stream: DataFrame, batch_col: str, batches: list, group=("model",), K: float = K_DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Batch-synchronous rating fold over ``batches`` in the given order; returns (ability, difficulty) tables.

    Every row of a batch reads the ratings at the start of the batch.  An id with n rows in the batch moves by
    K * sum(y - p) / (1 + K * sum(p (1 - p)) (n - 1) / n): its single steps for n = 1, and for many rows a
    step that is damped by the curvature, as the steps of an ordered fold damp each other; it cannot overshoot
    however many rows a batch holds.  Choose the batches along the order of the fold (scenario, then time), as
    ``wave_batches`` does: more of them come closer to it.  Rows of other batches than the listed ones are refused.
    """
    spark = stream.sparkSession
    group = list(group)
    rows = stream.select(*group, batch_col, F.col("student_id").cast("string").alias("student_id"),
                         F.col("item_id").cast("string").alias("item_id"), F.col("y").cast("double").alias("y"))
    known = F.col(batch_col).isin(list(batches))
    rows = rows.filter(F.when(F.coalesce(known, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(
        F.lit("row of a batch that is not listed: "), F.coalesce(F.col(batch_col).cast("string"), F.lit("null")))).cast("boolean")))
    path = scratch_folder(spark, "rating-batches")
    rows.write.partitionBy(batch_col).parquet(path)       # one folder per batch: each pass prunes to it
    kinds = rows.schema[batch_col].dataType.simpleString()
    stored = spark.read.schema(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != batch_col)
                               + f", {batch_col} {kinds}").parquet(path)
    ab_schema = ", ".join(f"{g} string" for g in group)
    ability = spark.createDataFrame([], f"{ab_schema}, student_id string, ability double")
    difficulty = spark.createDataFrame([], f"{ab_schema}, item_id string, difficulty double")

    def steps(j: DataFrame, id_col: str) -> DataFrame:
        damping = F.lit(1.0) + F.lit(K) * F.sum("_w") * (F.count(F.lit(1)) - 1) / F.count(F.lit(1))
        return j.groupBy(*group, id_col).agg((F.lit(K) * F.sum("_e") / damping).alias("_d"))

    for b in batches:
        p = logistic_p(default_rating(F.col("ability")), default_rating(F.col("difficulty")))
        j = (stored.filter(F.col(batch_col) == F.lit(b)).join(ability, [*group, "student_id"], "left")
             .join(difficulty, [*group, "item_id"], "left")
             .withColumn("_p", p).withColumn("_e", F.col("y") - F.col("_p")).withColumn("_w", F.col("_p") * (1 - F.col("_p"))))
        ability = cut_lineage(
            ability.join(steps(j, "student_id"), [*group, "student_id"], "full_outer")
            .select(*group, "student_id", (default_rating(F.col("ability")) + F.coalesce("_d", F.lit(0.0))).alias("ability")))
        difficulty = cut_lineage(
            difficulty.join(steps(j, "item_id"), [*group, "item_id"], "full_outer")
            .select(*group, "item_id", (default_rating(F.col("difficulty")) - F.coalesce("_d", F.lit(0.0))).alias("difficulty")))
    drop_folder(spark, path)
    return ability, difficulty


_FOLD_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("rec", T.IntegerType()),
    T.StructField("_pos", T.LongType()), T.StructField("student_id", T.StringType()),
    T.StructField("item_id", T.StringType()), T.StructField("y", T.DoubleType()),
    T.StructField("key", T.StringType()), T.StructField("rating", T.DoubleType()),
])
_STATE_SCHEMA = "model string, rec int, key string, rating double"
REC_ROW, REC_STUDENT, REC_ITEM = 0, 1, 2


def _fold_chunk(K: float):
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        model = pdf["model"].iloc[0]
        rows = pdf[pdf["rec"] == REC_ROW].sort_values("_pos")
        st = pdf[pdf["rec"] == REC_STUDENT]
        it = pdf[pdf["rec"] == REC_ITEM]
        ability = dict(zip(st["key"], st["rating"]))
        difficulty = dict(zip(it["key"], it["rating"]))
        touched_s, touched_i = set(), set()
        for s, i, y in zip(rows["student_id"].to_numpy(), rows["item_id"].to_numpy(), rows["y"].to_numpy()):
            th = ability.get(s, START_RATING)
            z = difficulty.get(i, START_RATING)
            d = K * (y - 1.0 / (1.0 + math.exp(-(th - z))))
            ability[s] = th + d
            difficulty[i] = z - d
            touched_s.add(s)
            touched_i.add(i)
        out = [(model, REC_STUDENT, s, ability[s]) for s in touched_s] + \
              [(model, REC_ITEM, i, difficulty[i]) for i in touched_i]
        return pd.DataFrame(out, columns=["model", "rec", "key", "rating"])
    return fold


def elo_sequential(stream: DataFrame, order_cols: list[str], K: float = K_DEFAULT,
                   chunk_rows: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Exact ordered fold per model over rows sorted by ``order_cols``, for small data; returns (ability, difficulty)."""
    spark = stream.sparkSession
    base = ["model", "student_id", "item_id", "y"]
    rows = stream.select(F.col("model").cast("string").alias("model"),
                         F.col("student_id").cast("string").alias("student_id"),
                         F.col("item_id").cast("string").alias("item_id"), F.col("y").cast("double").alias("y"),
                         *[c for c in order_cols if c not in base])
    order = list(dict.fromkeys([*order_cols, "model", "student_id", "item_id"]))   # total order: ties broken by ids
    n = rows.count()
    n_chunks = max(1, math.ceil(n / chunk_rows))
    path = scratch_folder(spark, "rating-chunks")
    (rows.repartitionByRange(n_chunks, *order)
         .sortWithinPartitions(*order)
         .withColumn("_pos", F.monotonically_increasing_id())
         .withColumn("_chunk", F.spark_partition_id())
         .write.partitionBy("_chunk").parquet(path))
    chunked = spark.read.parquet(path)
    state = spark.createDataFrame([], _STATE_SCHEMA)
    chunk_ids = sorted(r[0] for r in chunked.select("_chunk").distinct().collect())   # at most n_chunks ids
    for c in chunk_ids:
        cur = chunked.filter(F.col("_chunk") == c)
        ids = (cur.select("model", F.lit(REC_STUDENT).alias("rec"), F.col("student_id").alias("key"))
               .unionByName(cur.select("model", F.lit(REC_ITEM).alias("rec"), F.col("item_id").alias("key"))).distinct())
        touched = state.join(ids, ["model", "rec", "key"], "left_semi")
        recs = (cur.select("model", F.lit(REC_ROW).alias("rec"), "_pos", "student_id", "item_id", "y",
                           F.lit(None).cast("string").alias("key"), F.lit(None).cast("double").alias("rating"))
                .unionByName(touched.select("model", "rec", F.lit(None).cast("long").alias("_pos"),
                                            F.lit(None).cast("string").alias("student_id"),
                                            F.lit(None).cast("string").alias("item_id"),
                                            F.lit(None).cast("double").alias("y"), "key", "rating")))
        updated = cut_lineage(recs.groupBy("model").applyInPandas(_fold_chunk(K), schema=_STATE_SCHEMA))
        state = cut_lineage(state.join(updated, ["model", "rec", "key"], "left_anti").unionByName(updated))
    ability = state.filter(F.col("rec") == REC_STUDENT).select("model", F.col("key").alias("student_id"), F.col("rating").alias("ability"))
    difficulty = state.filter(F.col("rec") == REC_ITEM).select("model", F.col("key").alias("item_id"), F.col("rating").alias("difficulty"))
    return ability, difficulty


# --- comparison with the truth columns -------------------------------------------------

def scan_ratings_projected(df: DataFrame, id_col: str, param: str, model: str) -> DataFrame:
    """Key plus one parameter renamed ``<param>_<model>`` (only these columns are read)."""
    return df.select(id_col, F.col(param).alias(f"{param}_{model}"))


def outer_merge_models(long: DataFrame, id_col: str, param: str, models: list[str]) -> DataFrame:
    """Wide id x model table via one grouped pivot (the n-way full outer merge in a single shuffle)."""
    w = long.groupBy(id_col).pivot("model", models).agg(F.first(param))
    return w.select(id_col, *[F.col(m).alias(f"{param}_{m}") for m in models])


def pairwise_complete(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.na.drop(subset=[a, b])


def model_correlations(long: DataFrame, id_col: str, param: str, truth_model: str,
                       spearman: bool = False) -> DataFrame:
    """Per model: Pearson (and optionally Spearman) of its parameter against the truth model's."""
    truth = long.filter(F.col("model") == truth_model).select(id_col, F.col(param).alias("_truth"))
    est = long.filter(F.col("model") != truth_model).select("model", id_col, F.col(param).alias("_est"))
    j = pairwise_complete(est.join(truth, id_col, "inner"), "_truth", "_est")
    out = ST.pearson_by(j, ["model"], "_truth", "_est", f"{param}_pearson").drop("n")
    if spearman:
        out = out.join(ST.spearman_by(j, ["model"], "_truth", "_est", f"{param}_spearman"), "model", "left")
    return out


def _truth_pairs(long: DataFrame, id_col: str, param: str, truth_model: str) -> DataFrame:
    """(param, model, _truth, _est): each model's value of an id with the truth's, from one grouping by id."""
    value, own = F.col(param).cast("double"), F.col("model") == F.lit(truth_model)
    ids = (long.where(F.col("model").isNotNull() & F.col(id_col).isNotNull() & F.col(param).isNotNull()).groupBy(id_col)
           .agg(F.max(F.when(own, value)).alias("_truth"),
                F.collect_list(F.when(~own, F.struct("model", value.alias("_est")))).alias("_all")))
    return (ids.where(F.col("_truth").isNotNull()).select(F.lit(param).alias("param"), "_truth", F.explode("_all").alias("_e"))
            .select("param", F.col("_e.model").alias("model"), "_truth", F.col("_e._est").alias("_est")))


def correlation_report(ability: DataFrame, difficulty: DataFrame, truth_student: str = "student",
                       truth_item: str = "item") -> DataFrame:
    """ability Pearson + difficulty Pearson/Spearman per model, one row per model.

    Both tables hold one row per model and id.  They are stacked, grouped by id once, and the pairs of a model's value
    with the truth's are stored, so that neither the ratings nor what they are made of is computed again per statistic.
    """
    pairs = cut_lineage(_truth_pairs(ability, "student_id", "ability", truth_student)
                        .unionByName(_truth_pairs(difficulty, "item_id", "difficulty", truth_item)))
    params = ("ability", "difficulty")
    split = pairs.select("model", *[F.when(F.col("param") == p, F.col(c)).alias(f"{p}{c}") for p in params for c in ("_truth", "_est")])
    linear = split.groupBy("model").agg(*[ST.pearson(f"{p}_truth", f"{p}_est").alias(f"{p}_pearson") for p in params])
    ranked = ST.spearman_by(pairs.where("param = 'difficulty'"), ["model"], "_truth", "_est", "difficulty_spearman")
    return linear.join(ranked, "model", "left")


def union_scenarios(tables: dict[int, DataFrame], order_cols: list[str]) -> DataFrame:
    """Stack scenario results in scenario order; ``seq`` = (scenario, position within the scenario)."""
    parts = [t.withColumn("scenario", F.lit(s)) for s, t in sorted(tables.items())]
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("seq", F.struct("scenario", *order_cols))
