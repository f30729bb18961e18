"""Response-log operators and the testlet response model.

The model ``logit P(score=1) = b + u_student + u_item + u_testlet`` is fitted
by penalised maximum likelihood with block-wise Newton steps: each pass is a
few joins of the response rows with the (much smaller) effect tables and one
grouped aggregation per block.  The planner decides per join whether an
effect table is small enough to broadcast (AQE, measured size); nothing is
hinted because the student table grows with the data.  Effects are
checkpointed into the shared folder after each pass.
Item effects are logits of success: larger means easier, as in the source.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.functions import text as X
from attemptlab.functions.vectors import fit_residuals
from attemptlab.operators import stats as ST
from attemptlab.session import cut_lineage

S, I, TT, Y = "StudentID_SF", "ItemID_SF", "Testlet_ID", "ItemScore"
# Quick-run subset defaults and the split setting of the source.
N_TESTLET_GROUPS = 3
N_STUDENT_GROUPS = 10
TEST_FRACTION = 0.20
SEED = 123
Z_95 = 1.96


def split_testlet_item(df: DataFrame) -> DataFrame:
    parts = X.split_testlet_item(I)
    return df.withColumn(TT, parts["Testlet_ID"]).withColumn("Item_Within_Testlet", parts["Item_ID"])


def latest_attempt_ties(df: DataFrame) -> DataFrame:
    """Rows whose T equals the (student, item) maximum; ties are all kept."""
    w = Window.partitionBy(S, I).orderBy(F.col("T").desc())
    return df.withColumn("_r", F.rank().over(w)).filter("_r = 1").drop("_r")


def first_attempt_only(df: DataFrame) -> DataFrame:
    """Exactly one row per (student, item): minimal T, ties broken by score."""
    w = Window.partitionBy(S, I).orderBy(F.col("T").asc(), F.col(Y).asc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def varying_items(latest: DataFrame) -> DataFrame:
    """Items with at least two distinct non-null scores."""
    return (latest.groupBy(I).agg(F.countDistinct(Y).alias("n_distinct_scores"))
            .filter(F.col("n_distinct_scores") >= 2))


def response_matrix(latest: DataFrame) -> DataFrame:
    """Student x item scores over varying items as sparse rows: ``scores`` = array of (item, score) by item.

    Ties on T collapse by max.  One row per student whatever the number of items; nothing is collected.
    """
    kept = latest.join(varying_items(latest).select(I), I, "left_semi")
    return (kept.groupBy(S, I).agg(F.max(Y).alias("score")).groupBy(S)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(I).alias("item"), "score"))).alias("scores")))


def response_matrix_wide(matrix: DataFrame, items: list[str]) -> DataFrame:
    """One column per item of the given list, null where a student has no score."""
    by_item = F.map_from_entries("scores")
    return matrix.select(S, *[F.element_at(by_item, F.lit(i)).alias(i) for i in items])


def _hash_key(c: Column, seed: int) -> Column:
    return F.md5(F.concat(c.cast("string"), F.lit(f"|{seed}")))


def id_subset_groups(df: DataFrame, id_col: str, n_groups: int, seed: int = SEED) -> DataFrame:
    """Keep the rows whose id falls in the first of ``n_groups`` equal-width groups of a shuffled id order.

    The shuffle is the md5 order of (id, seed); positions come from the
    range-partitioned rank helper, so no window sees all ids at once.  The ids are read off the rows once: ranks,
    count and selection use the stored list.
    """
    ids = cut_lineage(df.select(F.col(id_col).alias("_id")).distinct().withColumn("_h", _hash_key(F.col("_id"), seed)))
    ranks = ST.value_ranks(ids, [], "_h")
    total = ids.agg(F.count(F.lit(1)).alias("_n")).scalar()
    # cut(seq_along(ids), breaks = n_groups) splits [1, N] into equal-width, right-closed intervals
    # (only the outer ends are widened), so the first one holds positions <= 1 + (N - 1) / n_groups
    bound = F.lit(1.0) + (F.col("_n") - 1) / float(n_groups)
    first = (ids.join(ranks, "_h").withColumn("_n", total)
             .filter(F.col("avg_rank") <= bound).select(F.col("_id").alias(id_col)))
    return df.join(first, id_col, "left_semi")


def train_test_label(df: DataFrame, key_cols: list[str], fraction: float = TEST_FRACTION, seed: int = SEED) -> DataFrame:
    """``split`` = test with probability ``fraction`` from a hash of the row key (stable under re-partitioning)."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.withColumn("split", F.when(u < fraction, "test").otherwise("train"))


# --- effects-based operators -----------------------------------------------------------------

def testlet_predict(rows: DataFrame, student: DataFrame, item: DataFrame, testlet: DataFrame,
                    intercept: Column | float = 0.0) -> DataFrame:
    """p_hat = logistic(b + u_s + u_i + u_t); levels without an effect use 0."""
    j = (rows.join(student.select(S, F.col("Estimate").alias("_us")), S, "left")
         .join(item.select(I, F.col("Estimate").alias("_ui")), I, "left")
         .join(testlet.select(TT, F.col("Estimate").alias("_ut")), TT, "left"))
    b = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    eta = b + F.coalesce("_us", F.lit(0.0)) + F.coalesce("_ui", F.lit(0.0)) + F.coalesce("_ut", F.lit(0.0))
    return j.withColumn("p_hat", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))).drop("_us", "_ui", "_ut")


def person_fit(pred: DataFrame) -> DataFrame:
    """Per student: n_items, outfit = mean z^2, infit = sum(w z^2) / sum(w)."""
    z, w = fit_residuals(F.col(Y), F.col("p_hat"))
    r = pred.select(S, (z * z).alias("res2"), w.alias("w"))
    return r.groupBy(S).agg(F.count(F.lit(1)).alias("n_items"), F.avg("res2").alias("outfit"),
                            F.try_divide(F.sum(F.col("w") * F.col("res2")), F.sum("w")).alias("infit"))


def person_fit_ranked(fit: DataFrame) -> DataFrame:
    return fit.orderBy(F.col("outfit").desc(), F.col(S))


def testlet_correctness(first: DataFrame) -> DataFrame:
    return first.groupBy(TT).agg(F.avg(Y).alias("correctness"))


def testlet_effect_vs_correctness(testlet_eff: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points: effect with mean correctness, line: least-squares slope and intercept)."""
    pts = testlet_eff.join(testlet_correctness(first), TT, "left")
    line = pts.agg(F.regr_slope("correctness", "Estimate").alias("slope"),
                   F.regr_intercept("correctness", "Estimate").alias("intercept"))
    return pts, line


def item_difficulty_by_testlet(item_eff: DataFrame) -> DataFrame:
    """Item effects with their testlet (from the item id); unmapped items dropped."""
    return split_testlet_item(item_eff).filter(F.col(TT).isNotNull())


def testlet_mean_difficulty(item_eff: DataFrame) -> DataFrame:
    return item_difficulty_by_testlet(item_eff).groupBy(TT).agg(F.avg("Estimate").alias("mean_difficulty"))


def left_join_means(item_eff: DataFrame) -> DataFrame:
    items = item_difficulty_by_testlet(item_eff)
    return items.join(testlet_mean_difficulty(item_eff), TT, "left")


def testlet_difficulty_range(item_eff: DataFrame) -> DataFrame:
    """max - min item estimate and item count per testlet, testlets with more than one item."""
    return (item_difficulty_by_testlet(item_eff).groupBy(TT)
            .agg((F.max("Estimate") - F.min("Estimate")).alias("range"), F.count(F.lit(1)).alias("n_items"))
            .filter(F.col("n_items") > 1))


def testlet_range_topk(ranges: DataFrame, n: int = 5) -> DataFrame:
    """Top-n and bottom-n testlets by range (the report's feature: a limit)."""
    top = ranges.orderBy(F.col("range").desc(), F.col(TT)).limit(n).withColumn("end", F.lit("top"))
    bottom = ranges.orderBy(F.col("range").asc(), F.col(TT)).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def testlet_adjusted_difficulty(item_eff: DataFrame, testlet_eff: DataFrame) -> DataFrame:
    """item effects, their testlet, and total = item estimate + testlet estimate."""
    m = item_difficulty_by_testlet(item_eff).select(I, TT, F.col("Estimate").alias("Estimate_item"))
    t = testlet_eff.select(TT, F.col("Estimate").alias("Estimate_testlet"))
    return m.join(t, TT, "left").withColumn("total", F.col("Estimate_item") + F.col("Estimate_testlet"))


def random_effects(u: DataFrame, info_col: str = "info", tau2: float = 1.0) -> DataFrame:
    """Estimate, Est.Error, Q2.5, Q97.5 from an effect and its Fisher information sum p(1-p)."""
    se = F.lit(1.0) / F.sqrt(F.col(info_col) + F.lit(1.0 / tau2))
    return (u.withColumn("Est.Error", se).withColumn("Q2.5", F.col("Estimate") - Z_95 * se)
            .withColumn("Q97.5", F.col("Estimate") + Z_95 * se))


def level_slopes(rows: DataFrame, intercept: float, eff: dict[str, DataFrame], tau2: dict | None = None) -> DataFrame:
    """(level, id, n, slope): derivative of the penalised log-likelihood at each effect, per row of that level."""
    tau2 = {"student": 1.0, "item": 1.0, "testlet": 1.0, **(tau2 or {})}
    p = testlet_predict(rows, eff["student"], eff["item"], eff["testlet"], intercept)
    parts = []
    for level, c in (("student", S), ("item", I), ("testlet", TT)):
        g = p.groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(Y) - F.col("p_hat")).alias("_g"))
        parts.append(eff[level].join(g, c).select(
            F.lit(level).alias("level"), F.col(c).cast("string").alias("id"), "n",
            ((F.col("_g") - F.col("Estimate") / tau2[level]) / F.col("n")).alias("slope")))
    return reduce(DataFrame.unionByName, parts)


# --- model fit --------------------------------------------------------------------------

def fit_testlet_model(train: DataFrame, tau2: dict | None = None, max_passes: int = 200, tol: float = 1e-4):
    """Penalised ML fit of intercept + student/item/testlet random intercepts.

    Passes go on until no effect changes by ``tol`` or more; a fit that has not settled after ``max_passes``
    raises instead of returning unfinished effects.  Returns (intercept, {"student": df, "item": df, "testlet": df}) where each
    effect table has (level id, Estimate, info, Est.Error, Q2.5, Q97.5).
    """
    tau2 = {"student": 1.0, "item": 1.0, "testlet": 1.0, **(tau2 or {})}
    rows = split_testlet_item(train).select(S, I, TT, F.col(Y).cast("double").alias("y"))
    rows = cut_lineage(rows)
    keys = {"student": S, "item": I, "testlet": TT}
    eff = {k: rows.select(c).distinct().withColumn("u", F.lit(0.0)) for k, c in keys.items()}
    eff = {k: cut_lineage(v) for k, v in eff.items()}
    ybar = rows.agg(F.avg("y")).first()[0]
    b = math.log((ybar + 1e-9) / (1 - ybar + 1e-9))

    def with_eta(b_val):
        j = rows
        for k, c in keys.items():
            j = j.join(eff[k].withColumnRenamed("u", f"u_{k}"), c, "left")
        eta = F.lit(b_val) + sum((F.coalesce(F.col(f"u_{k}"), F.lit(0.0)) for k in keys), F.lit(0.0))
        return j.withColumn("p", F.lit(1.0) / (F.lit(1.0) + F.exp(-eta)))

    for _ in range(max_passes):
        deltas = []
        for k, c in keys.items():
            p = with_eta(b)
            g = p.groupBy(c).agg(F.sum(F.col("y") - F.col("p")).alias("_g"),
                                 F.sum(F.col("p") * (1 - F.col("p"))).alias("_h"))
            new = cut_lineage(eff[k].join(g, c, "left")
                              .withColumn("_step", (F.coalesce("_g", F.lit(0.0)) - F.col("u") / tau2[k])
                                          / (F.coalesce("_h", F.lit(0.0)) + 1.0 / tau2[k]))
                              .select(c, (F.col("u") + F.col("_step")).alias("u"), F.abs("_step").alias("_d")))
            deltas.append(new.select("_d"))
            eff[k] = new.select(c, "u")
        # re-centre: items are nested in testlets, so a shared shift moves from items to their testlet
        itm = split_testlet_item(eff["item"].withColumnRenamed("u", "u_item"))
        w = itm.join(eff["testlet"].withColumnRenamed("u", "u_t"), TT, "left").withColumn(
            "w", F.col("u_item") + F.coalesce("u_t", F.lit(0.0)))
        c_t = cut_lineage(w.groupBy(TT).agg(F.sum("w").alias("_sw"), F.count(F.lit(1)).alias("_n")).select(
            TT, ((F.col("_sw") / tau2["item"]) / (F.col("_n") / tau2["item"] + 1.0 / tau2["testlet"])).alias("u")))
        eff["item"] = cut_lineage(w.join(c_t.withColumnRenamed("u", "c"), TT, "left")
                                  .select(I, (F.col("w") - F.coalesce("c", F.lit(0.0))).alias("u")))
        eff["testlet"] = c_t
        # move the block means into the intercept (one small job for both)
        means = {r["k"]: r["m"] for r in eff["student"].select(F.lit("student").alias("k"), "u")
                 .unionByName(c_t.select(F.lit("testlet").alias("k"), "u")).groupBy("k").agg(F.avg("u").alias("m")).collect()}
        for k in ("student", "testlet"):
            m = means.get(k) or 0.0
            eff[k] = eff[k].withColumn("u", F.col("u") - F.lit(m))
            b += m
        p = with_eta(b)
        gb = p.agg(F.sum(F.col("y") - F.col("p")).alias("g"), F.sum(F.col("p") * (1 - F.col("p"))).alias("h")).first()
        step = gb["g"] / gb["h"] if gb["h"] else 0.0
        b += step
        change = max(deltas[0].unionByName(deltas[1]).unionByName(deltas[2]).agg(F.max("_d")).first()[0] or 0.0, abs(step))
        if change < tol:
            break
    else:
        raise RuntimeError(f"no convergence after {max_passes} passes: the last change was {change}")
    p = with_eta(b)
    out = {}
    for k, c in keys.items():
        info = p.groupBy(c).agg(F.sum(F.col("p") * (1 - F.col("p"))).alias("info"))
        out[k] = random_effects(eff[k].join(info, c, "left").withColumnRenamed("u", "Estimate")
                                .withColumn("info", F.coalesce("info", F.lit(0.0))), tau2=tau2[k])
    return b, out
