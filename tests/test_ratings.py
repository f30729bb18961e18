"""Rating folds: sequential fold equals a plain Python fold; invariants of the update."""

import math
import random

import numpy as np
import pytest

from attemptlab.operators import ratings as R

K = 0.4


def python_fold(rows):
    ab, di = {}, {}
    for m, s, i, y in rows:
        th, z = ab.get((m, s), 0.0), di.get((m, i), 0.0)
        d = K * (y - 1 / (1 + math.exp(-(th - z))))
        ab[(m, s)], di[(m, i)] = th + d, z - d
    return ab, di


def stream(spark, n=300, seed=1):
    rnd = random.Random(seed)
    rows = [(m, str(rnd.randrange(12)), f"q{rnd.randrange(9)}", rnd.randrange(2), k)
            for k in range(n) for m in ("a",) ] + [("b", str(rnd.randrange(5)), f"q{rnd.randrange(4)}", rnd.randrange(2), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "model string, student_id string, item_id string, y int, seq long")


def test_sequential_equals_python(spark):
    rows, df = stream(spark)
    ab, di = R.elo_sequential(df, ["seq"], chunk_rows=70)      # several chunks
    want_ab, want_di = python_fold([(m, s, i, y) for m, s, i, y, _ in sorted(rows, key=lambda r: (r[4], r[0], r[1], r[2]))])
    got_ab = {(r.model, r.student_id): r.ability for r in ab.collect()}
    got_di = {(r.model, r.item_id): r.difficulty for r in di.collect()}
    assert got_ab.keys() == want_ab.keys() and got_di.keys() == want_di.keys()
    assert all(abs(got_ab[k] - v) < 1e-9 for k, v in want_ab.items())
    assert all(abs(got_di[k] - v) < 1e-9 for k, v in want_di.items())


def test_minibatch_size_one_equals_sequential(spark):
    rows, df = stream(spark, n=15, seed=3)
    ab, di = R.elo_minibatch(df.filter("model = 'a'"), "seq", list(range(15)))
    want_ab, want_di = python_fold([(m, s, i, y) for m, s, i, y, _ in sorted(rows, key=lambda r: r[4]) if m == "a"])
    got_ab = {(r.model, r.student_id): r.ability for r in ab.collect()}
    assert all(abs(got_ab[k] - v) < 1e-9 for k, v in want_ab.items())
    assert abs(sum(r.ability for r in ab.collect()) + sum(r.difficulty for r in di.collect())) < 1e-9


def test_unlisted_batch_is_refused(spark):
    _, df = stream(spark, n=5)
    with pytest.raises(Exception, match="not listed"):
        R.elo_minibatch(df, "seq", [0, 1])


def test_minibatch_follows_the_ordered_fold(spark):
    """Four batches on the fixture: no wider than the exact ratings, abilities in nearly the same order."""
    from attemptlab.plans import queries_ratings as Q

    rows = Q._stream(spark, "/root/testdata/sf0.01")
    plain = sorted((r.batch, r.question_id, r.student_id, r.model, r.item_id, r.y) for r in rows.collect())
    want_ab, want_di = python_fold([(m, s, i, y) for _, _, s, m, i, y in plain])
    ab, di = R.elo_minibatch(rows, "batch", Q.BATCHES)
    got_ab = {(r.model, r.student_id): r.ability for r in ab.collect()}
    got_di = {(r.model, r.item_id): r.difficulty for r in di.collect()}
    assert got_ab.keys() == want_ab.keys() and got_di.keys() == want_di.keys()
    for got, want in ((got_ab, want_ab), (got_di, want_di)):
        assert min(want.values()) <= min(got.values()) and max(got.values()) <= max(want.values())
    keys = sorted(want_ab)
    assert np.corrcoef([got_ab[k] for k in keys], [want_ab[k] for k in keys])[0, 1] >= 0.85


def test_a_batch_per_level_is_the_ordered_fold(spark):
    """Levels share no id, and the fold over them equals the plain one, a hot student and slices cut within ids included."""
    rows, df = stream(spark, n=14, seed=5)
    hot = [("a", "hot", f"q{k % 9}", k % 2, 100 + k) for k in range(8)]
    df = df.unionByName(spark.createDataFrame(hot, df.schema))
    waves = R.wave_batches(df, ["seq"], None, rounds=6, slices=5).cache()
    levels = waves.agg({"batch": "max"}).first()[0] + 1
    for id_col in ("student_id", "item_id"):
        assert waves.groupBy("model", "batch", id_col).count().where("count > 1").count() == 0
    ab, di = R.elo_minibatch(waves, "batch", list(range(levels)))
    order = sorted(rows + hot, key=lambda r: (r[4], r[1], r[2], r[3]))
    want_ab, want_di = python_fold([(m, s, i, y) for m, s, i, y, _ in order])
    got_ab = {(r.model, r.student_id): r.ability for r in ab.collect()}
    got_di = {(r.model, r.item_id): r.difficulty for r in di.collect()}
    assert got_ab.keys() == want_ab.keys() and all(abs(got_ab[k] - v) < 1e-9 for k, v in want_ab.items())
    assert got_di.keys() == want_di.keys() and all(abs(got_di[k] - v) < 1e-9 for k, v in want_di.items())
    waves.unpersist()


def test_wave_batches_follow_the_ordered_fold(spark):
    """Eight batches on the fixture: abilities and items in nearly the order of the plain fold."""
    from attemptlab.plans import queries_ratings as Q

    rows = Q._stream(spark, "/root/testdata/sf0.01").drop("batch")
    plain = sorted((r.question_id, r.student_id, r.item_id, r.y, r.model) for r in rows.collect())
    want_ab, want_di = python_fold([(m, s, i, y) for _, s, i, y, m in plain])
    ab, di = R.elo_minibatch(R.wave_batches(rows, ["question_id"], 8), "batch", list(range(8)))
    got_ab = {(r.model, r.student_id): r.ability for r in ab.collect()}
    got_di = {(r.model, r.item_id): r.difficulty for r in di.collect()}
    for got, want in ((got_ab, want_ab), (got_di, want_di)):
        keys = sorted(want)
        assert got.keys() == want.keys()
        assert np.corrcoef([got[k] for k in keys], [want[k] for k in keys])[0, 1] >= 0.8


def test_wave_batches_edges(spark):
    _, df = stream(spark, n=3)
    assert R.wave_batches(df.limit(0), ["seq"], 4).count() == 0
    nulls = spark.createDataFrame([("a", None, "q", 1, 1), ("a", None, "q", 1, 1), (None, "s", None, 0, 2)], df.schema)
    assert sorted(r.batch for r in R.wave_batches(nulls, ["seq"], None).collect()) == [0, 0, 1]
    with pytest.raises(ValueError, match="in the way"):
        R.wave_batches(df.withColumnRenamed("seq", "batch"), ["batch"], 4)
