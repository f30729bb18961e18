"""Order statistics without a single-partition window.

``value_ranks`` turns a column into exact tie-averaged ranks per group:
1. aggregate to one row per distinct (group, value) – partial, map-side;
2. range-partition those rows by (group, value) so every task holds one
   contiguous slice of the order;
3. running sums inside each slice plus the totals of all earlier slices
   (one row per slice and group it holds; joined, and broadcast only if its
   measured size allows).
No task ever sees more than one slice, however large a group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.session import cut_lineage


def _parts(df: DataFrame, n: int | None) -> int:
    return n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def ordered_sums(df: DataFrame, group: list[str], value: str, measures: dict[str, Column],
                 partitions: int | None = None, totals: bool = False) -> DataFrame:
    """Per distinct (group, value): ``<m>`` at the value and ``<m>_before`` over strictly smaller values.

    With ``totals``, ``<m>_total`` over the group as well, from the per-slice sums.
    """
    names = list(measures)
    agg = df.groupBy(*group, value).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    # slice ids come from sampled range bounds: materialise them once so that the
    # totals and the running sums below see the same slices (also after a lost executor)
    ranged = cut_lineage(agg.repartitionByRange(_parts(df, partitions), *group, value)
                         .withColumn("_slice", F.spark_partition_id()))
    sliced = ranged.groupBy("_slice", *group).agg(*[F.sum(n).alias(f"_tot_{n}") for n in names])
    earlier = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_tot_{n}").over(Window.partitionBy(*group)).alias(f"{n}_total") for n in names if totals]
    offsets = sliced.select("_slice", *group, *[F.coalesce(F.sum(f"_tot_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}")
                                                 for n in names], *whole)
    inside = Window.partitionBy("_slice", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("_slice", *group, value, *names,
                          *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_in_{n}") for n in names])
    out = local.join(offsets, ["_slice", *group], "inner")
    return out.select(*group, value, *names, *[(F.col(f"_in_{n}") + F.col(f"_off_{n}")).alias(f"{n}_before") for n in names],
                      *[f"{n}_total" for n in names if totals])


def value_ranks(df: DataFrame, group: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """(group, value, avg_rank): 1-based rank with ties given their average rank."""
    s = ordered_sums(df, group, value, {"n": F.lit(1)}, partitions)
    return s.select(*group, value, (F.col("n_before") + (F.col("n") + 1) / 2.0).alias("avg_rank"))


def pearson(x: str, y: str) -> Column:
    """Population Pearson correlation; null when either side is constant (no ANSI divide error)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 0) & (sy > 0), F.try_divide(F.covar_pop(x, y), sx * sy))


def pearson_by(df: DataFrame, group: list[str], x: str, y: str, out: str) -> DataFrame:
    return df.groupBy(*group).agg(pearson(x, y).alias(out), F.count(F.lit(1)).alias("n"))


def spearman_by(df: DataFrame, group: list[str], x: str, y: str, out: str, partitions: int | None = None) -> DataFrame:
    """Pearson of tie-averaged ranks per group, over the rows that have both values.

    Rows are first combined to distinct value pairs with their counts, so a frequent value is no hot key.  The values
    of both columns are ranked in one pass (the column is one more group key).  Tie-averaged ranks of N rows have the
    mean (N + 1) / 2, so the moments need no pass for it.
    """
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*group, x, y).agg(F.count(F.lit(1)).alias("_n"))
    kinds = {df.schema[c].dataType.simpleString() for c in (x, y)}
    kind = kinds.pop() if len(kinds) == 1 else "double"
    values = pairs.select(*group, x, y, "_n", F.explode(F.array(*[
        F.struct(F.lit(axis).alias("_axis"), F.col(c).cast(kind).alias("_value")) for axis, c in (("x", x), ("y", y))])).alias("_v")) \
        .select(*group, x, y, "_n", "_v.*")
    key = [*group, "_axis"]
    s = ordered_sums(values, key, "_value", {"_m": F.col("_n")}, partitions, totals=True)
    # distance of the rank from the mean rank; both of a pair meet in one join and one aggregation
    ranks = s.select(*key, "_value", (F.col("_m_before") + (F.col("_m") - F.col("_m_total")) / 2.0).alias("_d"))
    ranked = values.join(ranks, [*key, "_value"]).groupBy(*group, x, y).agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_axis") == a, F.col("_d"))).alias(f"_d{a}") for a in "xy"])
    moments = ranked.groupBy(*group).agg(*[F.sum(F.col("_n") * F.col(f"_d{a}") * F.col(f"_d{b}")).alias(a + b)
                                           for a, b in (("x", "x"), ("y", "y"), ("x", "y"))])
    return moments.select(*group, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.try_divide(
        F.col("xy"), F.sqrt("xx") * F.sqrt("yy"))).alias(out))


def roc_auc(df: DataFrame, score: str, label: str, group: list[str] = (), auto_direction: bool = False,
            partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve (Mann-Whitney form, ties count one half); null with one class only."""
    df, group, extra = _grouped(df, group)
    s = ordered_sums(df, group, score, {"pos": (F.col(label) == 1).cast("long"),
                                         "neg": (F.col(label) == 0).cast("long")}, partitions)
    g = s.groupBy(*group).agg(
        F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.try_divide(F.col("_u"), F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                                           F.col("n_pos").cast("double") * F.col("n_neg")))
    if auto_direction:
        auc = F.greatest(auc, F.lit(1.0) - auc)
    return g.select(*group, auc.alias("auc"), "n_pos", "n_neg").drop(*extra)


def roc_curve(df: DataFrame, score: str, label: str, group: list[str] = (), partitions: int | None = None) -> DataFrame:
    """(threshold, fpr, tpr): a case is called positive when its score >= threshold."""
    df, group, extra = _grouped(df, group)
    neg_score = df.withColumn("_neg_score", -F.col(score))
    s = ordered_sums(neg_score, group, "_neg_score", {"pos": (F.col(label) == 1).cast("long"),
                                                       "neg": (F.col(label) == 0).cast("long")}, partitions)
    tot = s.groupBy(*group).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    if extra:           # one group: its totals are scalars
        j = s.withColumns({c: tot.select(c).scalar() for c in ("_P", "_N")})
    else:
        j = s.join(tot, group, "inner")
    keep = [g for g in group if g not in extra]
    return j.select(*keep, (-F.col("_neg_score")).alias("threshold"),
                    F.try_divide((F.col("neg_before") + F.col("neg")).cast("double"), F.col("_N")).alias("fpr"),
                    F.try_divide((F.col("pos_before") + F.col("pos")).cast("double"), F.col("_P")).alias("tpr"))


def _grouped(df: DataFrame, group) -> tuple[DataFrame, list[str], list[str]]:
    """Ungrouped statistics use one constant group key for the slices; their totals are scalars."""
    group = list(group)
    if group:
        return df, group, []
    return df.withColumn("_all", F.lit(0)), ["_all"], ["_all"]
