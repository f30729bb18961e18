"""Registered queries: response log, subsets, effects, ROC and person fit."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from attemptlab.functions.vectors import fit_residuals
from attemptlab.operators import stats as ST
from attemptlab.operators import testlet as TL
from attemptlab.registry import cached_flow, fixtures, r6, register
from attemptlab.session import scratch_folder
from attemptlab.sources import files

RV = ("responses",)
EV = ("responses", "effects")
S, I, TT, Y = TL.S, TL.I, TL.TT, TL.Y

_RESP = """resp AS (SELECT *, split_part(ItemID_SF, '_', 1) AS Testlet_ID,
  CASE WHEN len(string_split(ItemID_SF, '_')) >= 2 THEN split_part(ItemID_SF, '_', 2) END AS Item_Within_Testlet FROM responses),
first AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY StudentID_SF, ItemID_SF ORDER BY T, ItemScore) AS rn FROM resp) WHERE rn = 1),
latest AS (SELECT * EXCLUDE (rk) FROM (SELECT *, rank() OVER (PARTITION BY StudentID_SF, ItemID_SF ORDER BY T DESC) AS rk FROM resp) WHERE rk = 1)"""
_EFF = """eff_s AS (SELECT CAST(id AS BIGINT) AS StudentID_SF, Estimate FROM effects WHERE level = 'student'),
eff_i AS (SELECT id AS ItemID_SF, Estimate FROM effects WHERE level = 'item'),
eff_t AS (SELECT id AS Testlet_ID, Estimate FROM effects WHERE level = 'testlet'),
pred AS (SELECT f.*, 1 / (1 + exp(-(coalesce(s.Estimate, 0.0) + coalesce(i.Estimate, 0.0) + coalesce(t.Estimate, 0.0)))) AS p_hat
         FROM first f LEFT JOIN eff_s s USING (StudentID_SF) LEFT JOIN eff_i i USING (ItemID_SF) LEFT JOIN eff_t t USING (Testlet_ID)),
items AS (SELECT ItemID_SF, split_part(ItemID_SF, '_', 1) AS Testlet_ID, Estimate FROM eff_i WHERE split_part(ItemID_SF, '_', 1) IS NOT NULL)"""
W = "WITH " + _RESP + "\n"
WE = "WITH " + _RESP + ",\n" + _EFF + "\n"


class TFlow:
    """Response-log tables and stand-in effects (built on first use)."""

    def __new__(cls, spark, sf_dir):
        return cached_flow(_TFlow, spark, sf_dir)


class _TFlow:
    def __init__(self, spark, sf):
        self.fx = fixtures(spark, sf)

    @cached_property
    def resp(self):
        return TL.split_testlet_item(self.fx.responses)

    @cached_property
    def first(self):
        return TL.first_attempt_only(self.resp)

    @cached_property
    def latest(self):
        return TL.latest_attempt_ties(self.resp)

    def _level(self, level):
        return self.fx.effects.filter(F.col("level") == level)

    @cached_property
    def eff_s(self):
        return self._level("student").select(F.col("id").cast("long").alias(S), "Estimate")

    @cached_property
    def eff_i(self):
        return self._level("item").select(F.col("id").alias(I), "Estimate")

    @cached_property
    def eff_t(self):
        return self._level("testlet").select(F.col("id").alias(TT), "Estimate")

    @cached_property
    def pred(self):
        return TL.testlet_predict(self.first, self.eff_s, self.eff_i, self.eff_t)


COLS = [S, I, "T", Y]


@register("scan_responses", "SELECT * FROM responses", RV)
def scan_responses(spark, sf):
    """Written as CSV (no line breaks, so read in splits) and read back through the file reader."""
    path = scratch_folder(spark, "responses")
    files.write_table(fixtures(spark, sf).responses, path, fmt="csv")
    return files.read_responses(spark, path)


@register("split_testlet_item", W + "SELECT StudentID_SF, ItemID_SF, T, Testlet_ID, Item_Within_Testlet FROM resp", RV)
def split_testlet_item(spark, sf):
    return TFlow(spark, sf).resp.select(S, I, "T", TT, "Item_Within_Testlet")


@register("latest_attempt_ties", W + "SELECT StudentID_SF, ItemID_SF, T, ItemScore FROM latest", RV)
def latest_attempt_ties(spark, sf):
    return TFlow(spark, sf).latest.select(*COLS)


@register("first_attempt_only", W + "SELECT StudentID_SF, ItemID_SF, T, ItemScore FROM first", RV)
def first_attempt_only(spark, sf):
    return TFlow(spark, sf).first.select(*COLS)


@register("varying_items", W + "SELECT ItemID_SF, count(DISTINCT ItemScore) AS n_distinct_scores FROM latest GROUP BY ItemID_SF HAVING count(DISTINCT ItemScore) >= 2", RV)
def varying_items(spark, sf):
    return TL.varying_items(TFlow(spark, sf).latest)


@register("response_matrix", W + """SELECT StudentID_SF, CAST(count(*) AS INTEGER) AS n_items,
  string_agg(ItemID_SF || ':' || CAST(score AS VARCHAR), ',' ORDER BY ItemID_SF) AS scores
FROM (SELECT StudentID_SF, ItemID_SF, max(ItemScore) AS score FROM latest
      WHERE ItemID_SF IN (SELECT ItemID_SF FROM latest GROUP BY ItemID_SF HAVING count(DISTINCT ItemScore) >= 2)
      GROUP BY StudentID_SF, ItemID_SF) GROUP BY StudentID_SF""", RV)
def response_matrix(spark, sf):
    m = TL.response_matrix(TFlow(spark, sf).latest)
    text = F.transform("scores", lambda s: F.concat_ws(":", s["item"], s["score"].cast("string")))
    return m.select(S, F.size("scores").alias("n_items"), F.array_join(text, ",").alias("scores"))


def _subset_sql(src: str, col: str, n: int, name: str, key: str) -> str:
    return f"""{name}_ids AS (SELECT {col} AS id, row_number() OVER (ORDER BY md5({key} || '|123')) AS pos, count(*) OVER () AS n
  FROM (SELECT DISTINCT {col} FROM {src})),
{name} AS (SELECT * FROM {src} WHERE {col} IN (SELECT id FROM {name}_ids WHERE pos <= 1 + (n - 1) / {n}.0))"""


_SUB = W.rstrip() + ",\n" + _subset_sql("resp", "Testlet_ID", 3, "sub_t", "Testlet_ID") + ",\n" + \
    _subset_sql("sub_t", "StudentID_SF", 10, "sub_s", "CAST(StudentID_SF AS VARCHAR)") + "\n"


@register("id_subset_groups", _SUB + "SELECT StudentID_SF, ItemID_SF, T, ItemScore FROM sub_s", RV)
def id_subset_groups(spark, sf):
    r = TFlow(spark, sf).resp
    sub = TL.id_subset_groups(TL.id_subset_groups(r, TT, TL.N_TESTLET_GROUPS), S, TL.N_STUDENT_GROUPS)
    return sub.select(*COLS)


@register("id_in_subset", _SUB + "SELECT StudentID_SF, ItemID_SF, T, ItemScore FROM sub_t", RV)
def id_in_subset(spark, sf):
    r = TFlow(spark, sf).resp
    return TL.id_subset_groups(r, TT, TL.N_TESTLET_GROUPS).select(*COLS)


@register("train_test_label", W + """SELECT StudentID_SF, ItemID_SF, T,
  CASE WHEN ('0x' || substr(md5(CAST(StudentID_SF AS VARCHAR) || '|' || ItemID_SF || '|' || CAST(T AS VARCHAR) || '|123'), 1, 8))::BIGINT / 4294967296.0 < 0.2
       THEN 'test' ELSE 'train' END AS split FROM first""", RV)
def train_test_label(spark, sf):
    f = TL.train_test_label(TFlow(spark, sf).first, [S, I, "T"])
    return f.select(S, I, "T", "split")


@register("testlet_predict", WE + "SELECT StudentID_SF, ItemID_SF, round(p_hat, 6) AS p_hat FROM pred", EV)
def testlet_predict(spark, sf):
    return TFlow(spark, sf).pred.select(S, I, r6("p_hat").alias("p_hat"))


@register("fit_residuals", WE + """SELECT StudentID_SF, ItemID_SF, round((ItemScore - p_hat) / sqrt(p_hat * (1 - p_hat)), 6) AS z,
  round(p_hat * (1 - p_hat), 6) AS w FROM pred""", EV)
def fit_residuals_q(spark, sf):
    p = TFlow(spark, sf).pred
    z, w = fit_residuals(F.col(Y), F.col("p_hat"))
    return p.select(S, I, r6(z).alias("z"), r6(w).alias("w"))


_PF = WE.rstrip() + """,
pf AS (SELECT StudentID_SF, count(*) AS n_items, avg(z * z) AS outfit, sum(w * z * z) / sum(w) AS infit
       FROM (SELECT StudentID_SF, (ItemScore - p_hat) / sqrt(p_hat * (1 - p_hat)) AS z, p_hat * (1 - p_hat) AS w FROM pred)
       GROUP BY StudentID_SF)
"""


@register("person_fit", _PF + "SELECT StudentID_SF, n_items, round(outfit, 6) AS outfit, round(infit, 6) AS infit FROM pf", EV)
def person_fit(spark, sf):
    pf = TL.person_fit(TFlow(spark, sf).pred)
    return pf.select(S, "n_items", r6("outfit").alias("outfit"), r6("infit").alias("infit"))


@register("person_fit_ranked", _PF + "SELECT StudentID_SF, round(outfit, 6) AS outfit FROM pf ORDER BY outfit DESC, StudentID_SF", EV)
def person_fit_ranked(spark, sf):
    pf = TL.person_fit_ranked(TL.person_fit(TFlow(spark, sf).pred))
    return pf.select(S, r6("outfit").alias("outfit"))


_ROC = WE.rstrip() + """,
sc AS (SELECT p_hat AS score, sum(CASE WHEN ItemScore = 1 THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN ItemScore = 0 THEN 1 ELSE 0 END) AS neg
       FROM pred GROUP BY p_hat),
cum AS (SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before,
               sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp FROM sc)
"""


# scores rounded to 9 places (as for the curve) so that both engines see the same ties
@register("roc_auc", _ROC.replace("SELECT p_hat AS score", "SELECT round(p_hat, 9) AS score").replace("GROUP BY p_hat", "GROUP BY round(p_hat, 9)")
          + """SELECT round(sum(pos * (neg_before + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum""", EV)
def roc_auc(spark, sf):
    a = ST.roc_auc(TFlow(spark, sf).pred.withColumn("score", F.round("p_hat", 9)), "score", Y)
    return a.select(r6("auc").alias("auc"), "n_pos", "n_neg")


# the curve's thresholds are the scores rounded to 9 places: engines differ in the last bits of exp() (and in how they
# would round such a value again, so it is given as it is)
@register("roc_curve", _ROC.replace("SELECT p_hat AS score", "SELECT round(p_hat, 9) AS score").replace("GROUP BY p_hat", "GROUP BY round(p_hat, 9)")
          + """SELECT score AS threshold, round(fp / (SELECT sum(neg) FROM sc), 6) AS fpr,
  round(tp / (SELECT sum(pos) FROM sc), 6) AS tpr FROM cum""", EV)
def roc_curve(spark, sf):
    pred = TFlow(spark, sf).pred.withColumn("score", F.round("p_hat", 9))
    c = ST.roc_curve(pred, "score", Y)
    return c.select("threshold", r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("testlet_correctness", W + "SELECT Testlet_ID, round(avg(ItemScore), 6) AS correctness FROM first GROUP BY Testlet_ID", RV)
def testlet_correctness(spark, sf):
    return TL.testlet_correctness(TFlow(spark, sf).first).select(TT, r6("correctness").alias("correctness"))


_PTS = WE.rstrip() + """,
pts AS (SELECT t.Testlet_ID, t.Estimate, c.correctness FROM eff_t t LEFT JOIN
        (SELECT Testlet_ID, avg(ItemScore) AS correctness FROM first GROUP BY Testlet_ID) c USING (Testlet_ID))
"""


@register("left_join_correctness", _PTS + "SELECT Testlet_ID, round(Estimate, 6) AS Estimate, round(correctness, 6) AS correctness FROM pts", EV)
def left_join_correctness(spark, sf):
    f = TFlow(spark, sf)
    pts, _ = TL.testlet_effect_vs_correctness(f.eff_t, f.first)
    return pts.select(TT, r6("Estimate").alias("Estimate"), r6("correctness").alias("correctness"))


@register("testlet_effect_vs_correctness", _PTS + "SELECT round(regr_slope(correctness, Estimate), 6) AS slope, round(regr_intercept(correctness, Estimate), 6) AS intercept FROM pts", EV)
def testlet_effect_vs_correctness(spark, sf):
    f = TFlow(spark, sf)
    _, line = TL.testlet_effect_vs_correctness(f.eff_t, f.first)
    return line.select(r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@register("item_difficulty_by_testlet", WE + "SELECT ItemID_SF, Testlet_ID, round(Estimate, 6) AS Estimate FROM items", EV)
def item_difficulty_by_testlet(spark, sf):
    d = TL.item_difficulty_by_testlet(TFlow(spark, sf).eff_i)
    return d.select(I, TT, r6("Estimate").alias("Estimate"))


@register("mapped_items_only", WE + "SELECT ItemID_SF FROM eff_i WHERE split_part(ItemID_SF, '_', 1) IS NOT NULL", EV)
def mapped_items_only(spark, sf):
    return TL.split_testlet_item(TFlow(spark, sf).eff_i).filter(F.col(TT).isNotNull()).select(I)


@register("distinct_pairs", W + "SELECT DISTINCT ItemID_SF, Testlet_ID FROM resp", RV)
def distinct_pairs(spark, sf):
    return TFlow(spark, sf).resp.select(I, TT).distinct()


_MEAN = WE.rstrip() + ",\nmeans AS (SELECT Testlet_ID, avg(Estimate) AS mean_difficulty FROM items GROUP BY Testlet_ID)\n"


@register("testlet_mean_difficulty", _MEAN + "SELECT Testlet_ID, round(mean_difficulty, 6) AS mean_difficulty FROM means", EV)
def testlet_mean_difficulty(spark, sf):
    return TL.testlet_mean_difficulty(TFlow(spark, sf).eff_i).select(TT, r6("mean_difficulty").alias("mean_difficulty"))


@register("testlet_order_by_mean", _MEAN + "SELECT Testlet_ID, round(mean_difficulty, 6) AS mean_difficulty FROM means ORDER BY mean_difficulty", EV)
def testlet_order_by_mean(spark, sf):
    m = TL.testlet_mean_difficulty(TFlow(spark, sf).eff_i).orderBy("mean_difficulty", TT)
    return m.select(TT, r6("mean_difficulty").alias("mean_difficulty"))


@register("left_join_means", _MEAN + "SELECT ItemID_SF, Testlet_ID, round(Estimate, 6) AS Estimate, round(mean_difficulty, 6) AS mean_difficulty FROM items LEFT JOIN means USING (Testlet_ID)", EV)
def left_join_means(spark, sf):
    j = TL.left_join_means(TFlow(spark, sf).eff_i)
    return j.select(I, TT, r6("Estimate").alias("Estimate"), r6("mean_difficulty").alias("mean_difficulty"))


_RANGE = WE.rstrip() + """,
ranges AS (SELECT Testlet_ID, max(Estimate) - min(Estimate) AS range, count(*) AS n_items FROM items GROUP BY Testlet_ID HAVING count(*) > 1)
"""


@register("testlet_difficulty_range", _RANGE + "SELECT Testlet_ID, round(range, 6) AS range, n_items FROM ranges", EV)
def testlet_difficulty_range(spark, sf):
    r = TL.testlet_difficulty_range(TFlow(spark, sf).eff_i)
    return r.select(TT, r6("range").alias("range"), "n_items")


@register("testlet_range_topk", _RANGE + """SELECT Testlet_ID, round(range, 6) AS range, 'top' AS "end" FROM (SELECT * FROM ranges ORDER BY range DESC, Testlet_ID LIMIT 5)
UNION ALL SELECT Testlet_ID, round(range, 6), 'bottom' FROM (SELECT * FROM ranges ORDER BY range ASC, Testlet_ID LIMIT 5)""", EV)
def testlet_range_topk(spark, sf):
    r = TL.testlet_range_topk(TL.testlet_difficulty_range(TFlow(spark, sf).eff_i))
    return r.select(TT, r6("range").alias("range"), "end")


@register("testlet_adjusted_difficulty", WE + """SELECT ItemID_SF, Testlet_ID, round(i.Estimate, 6) AS Estimate_item, round(t.Estimate, 6) AS Estimate_testlet,
  round(i.Estimate + t.Estimate, 6) AS total FROM items i LEFT JOIN eff_t t USING (Testlet_ID)""", EV)
def testlet_adjusted_difficulty(spark, sf):
    f = TFlow(spark, sf)
    a = TL.testlet_adjusted_difficulty(f.eff_i, f.eff_t)
    return a.select(I, TT, *[r6(c).alias(c) for c in ("Estimate_item", "Estimate_testlet", "total")])


@register("random_effects", WE + """SELECT e.StudentID_SF, round(e.Estimate, 6) AS Estimate, round(1 / sqrt(i.info + 1.0), 6) AS "Est.Error",
  round(e.Estimate - 1.96 / sqrt(i.info + 1.0), 6) AS "Q2.5", round(e.Estimate + 1.96 / sqrt(i.info + 1.0), 6) AS "Q97.5"
FROM eff_s e JOIN (SELECT StudentID_SF, sum(p_hat * (1 - p_hat)) AS info FROM pred GROUP BY StudentID_SF) i USING (StudentID_SF)""", EV)
def random_effects(spark, sf):
    f = TFlow(spark, sf)
    info = f.pred.groupBy(S).agg(F.sum(F.col("p_hat") * (1 - F.col("p_hat"))).alias("info"))
    re = TL.random_effects(f.eff_s.join(info, S))
    return re.select(S, *[r6(F.col(f"`{c}`")).alias(c) for c in ("Estimate", "Est.Error", "Q2.5", "Q97.5")])


# the fit itself has no SQL form, but its optimum has: at every level of every block the slope of the penalised
# log-likelihood is zero.  The query gives each level's rows and that slope per row, to three places.
_LEVELS = (("student", S), ("item", I), ("testlet", TT))
_TRAIN = W.rstrip() + """,
train AS (SELECT * FROM first WHERE ('0x' || substr(md5(CAST(StudentID_SF AS VARCHAR) || '|' || ItemID_SF || '|' || CAST(T AS VARCHAR) || '|123'), 1, 8))::BIGINT / 4294967296.0 >= 0.2)
"""


@register("fit_testlet_model", _TRAIN + " UNION ALL ".join(
    f"SELECT '{k}' AS level, CAST({c} AS VARCHAR) AS id, count(*) AS n, CAST(0.0 AS DOUBLE) AS slope FROM train GROUP BY {c}"
    for k, c in _LEVELS), RV)
def fit_testlet_model(spark, sf):
    f = TFlow(spark, sf)
    train = TL.train_test_label(f.first, [S, I, "T"]).filter(F.col("split") == "train")
    b, eff = TL.fit_testlet_model(train.select(S, I, "T", Y))
    return TL.level_slopes(train, b, eff).select("level", "id", "n", F.abs(F.round("slope", 3)).alias("slope"))
