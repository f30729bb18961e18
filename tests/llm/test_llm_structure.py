"""Merkle manifest, periodic runs and the n-gram Jaccard join against plain definitions on small tables."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from attemptlab.llm import jaccard_join, merkle, periodic
from attemptlab.llm.common import WordHash
from attemptlab.llm.queries import QUERIES

# further columns whose names clash with internal ones
EXTRA = "grp string, pos long, leaf string, digest string, path string, token long, rid long, n int, runs string, h long"
CLASH = ("x", 1, "y", "z", "p", 2, 3, 4, "r", 5)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- manifest

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = f"doc_id long, source string, lang string, n_chars long, text string, {EXTRA}"


def plain_leaf(row, lower=False):
    out = ""
    for name, v in zip(COLUMNS, row, strict=True):
        if v is None:
            out += "-"
            continue
        v = str(v)
        if lower and name == "text":
            v = re.sub("[A-Z]", lambda m: m[0].lower(), v)
        out += f"{len(v.encode())}:{v}"
    return sha(out)


def plain_tree(leaves):
    """Levels from the leaves up, and the siblings of each leaf per level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 8])) for i in range(0, len(last), 8)])
    return levels


def plain_path(levels, at):
    out = []
    for level in levels[:-1]:
        lo = at // 8 * 8
        out.append(("".join(level[lo:at]), "".join(level[at + 1:lo + 8])))
        at //= 8
    return out


def plain_manifest(rows):
    """(doc_id, leaf) -> (subroot, root, proof, folded, verified)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    top = plain_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            path = plain_path(trees[g], i) + plain_path(top, k)
            changed = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            folded = plain_leaf(r, lower=changed)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r[0], plain_leaf(r), trees[g][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), folded,
                        folded == top[-1][0]))
    return out


def manifest_rows():
    rng = random.Random(4)
    rows = [(i, f"s{i % 3}" if i % 11 else None, rng.choice(["en", "de", "é"]), i * 7 if i % 13 else None,
             rng.choice(["Text Ä ", "lower ", "", None]) and f"Text {i}" if i % 17 else None) for i in range(150)]
    rows += [(500, None, None, None, None), (501, "s", "one", 4, "ABC"), (502, "s", "", 4, "empty name of a group")]
    rows += [(7, "again", "en", 1, "a repeated id"), (8, "s", "en", 1, "twice"), (8, "s", "en", 1, "twice")]
    rows += [(None, "s", "de", 1, "no id"), (600, "s", "de", 9, "Long " * 50_000)]
    return rows


def query11(docs):
    changed = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS]
    from attemptlab.llm.common import held_fold
    claims = F.when(held_fold("doc_id", 3) == 0, merkle.leaf_digest(changed))
    return merkle.verified_leaves(docs, COLUMNS, claims)


def order_of(rows):
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


def test_manifest_matches_plain_tree(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in query11(docs).collect()]
    assert order_of(got) == order_of(plain_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, "s", "en", i, f"T{i}") for i in range(n)]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    assert order_of(tuple(r) for r in query11(docs).collect()) == order_of(plain_manifest(rows))


def test_manifest_many_groups(spark):
    rows = [(i, "s", f"g{i % 70}", i, f"T{i}") for i in range(140)]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)
    assert order_of(tuple(r) for r in query11(docs).collect()) == order_of(plain_manifest(rows))


def test_manifest_requests_of_some_leaves(spark):
    docs = spark.createDataFrame([(*r, *CLASH) for r in manifest_rows()], SCHEMA)
    built = merkle.build_manifest(docs, COLUMNS)
    every = {(r["grp"], r["pos"]): r for r in merkle.prove(built).collect()}
    some = merkle.prove(built, built.leaves.where("pos % 5 = 2 or n = 1")).collect()
    assert {(r["grp"], r["pos"]) for r in some} == {k for k, r in every.items() if r["pos"] % 5 == 2 or r["n"] == 1}
    assert all(every[r["grp"], r["pos"]]["path"] == r["path"] for r in some)


def test_manifest_large_group_is_dealt_over_tasks(spark):
    """One group's leaves are ranked in more than one task."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"),
                                      F.lit(1).alias("n_chars"), F.lit("t").alias("text"))
    built = merkle.build_manifest(docs, COLUMNS)
    assert built.leaves.agg(F.max("pos"), F.countDistinct("pos")).first()[:] == (39_999, 40_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = merkle._ranked(docs.select(F.lit("").alias("grp"), "doc_id"), ["doc_id"], "t")
        assert placed.where("pos <> doc_id").count() == 0
        assert placed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# ---------------------------------------------------------------- runs

def plain_runs(text, least=6, exponent=4):
    found = {}
    n = len(text)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and text[j] == text[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def word_lists(rng, count):
    for _ in range(count):
        v, n = rng.choice([1, 2, 3, 5, 50]), rng.choice([0, 1, 2, 3, 6, 10, 40, 120])
        w = [str(rng.randrange(v)) for _ in range(n)]
        if n > 8 and rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // (3 + rng.randrange(8))
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        yield [x.encode() for x in w]


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 3), (10, 3), (5, 5)])
def test_runs_match_definition(least, exponent):
    rng = random.Random(least)
    for _ in range(200):
        texts = list(word_lists(rng, 4))
        assert periodic.runs_of_batch(texts, WordHash(), least, exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_runs_at_the_borders_and_nested():
    w = ["a", "b"] * 8 + ["x"] + ["c"] * 6 + ["x"] + (["p"] * 7 + ["q"]) * 4
    texts = [[x.encode() for x in w], [], [b"a"] * 6, [b"a"] * 5]
    got = periodic.runs_of_batch(texts, WordHash(), 6, 4)
    assert got == [plain_runs(t) for t in texts]
    assert got[2] == [(0, 6, 1)] and got[3] == []


def test_runs_of_very_long_texts():
    one = [b"a"] * 200_000
    assert periodic.runs_of_batch([one], WordHash(), 6, 4) == [[(0, 200_000, 1)]]
    mixed = [b"x" if i % 5000 == 0 else str(i % 7).encode() for i in range(60_000)]
    assert len(periodic.runs_of_batch([mixed], WordHash(), 6, 4)[0]) == 12


def test_runs_reject_less_than_three_periods():
    with pytest.raises(ValueError):
        periodic.runs_of_batch([[b"a"] * 9], WordHash(), 4, 2)


def test_runs_query_matches_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(80)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "\x0bä ä\tä ä ä ä ü"), (1003, "a " * 30), (1003, "a " * 30),
             (1004, "Aa aA " * 5), (1005, "z" * 100_000), (None, "k " * 9)]
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, {EXTRA}")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()]
    want = []
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = zlib.crc32(("" if i is None else str(i)).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        gone = set(itertools.chain.from_iterable(range(s + q, s + length) for s, length, q in runs))
        s, length, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        want.append((i, len(runs), s, length, q, 1000 * length // q if runs else None,
                     sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)),
                     hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert order_of(got) == order_of(want)


def test_runs_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert periodic.digest(periodic.periodic_runs(periodic.planted_repeats(empty))).count() == 0


# ---------------------------------------------------------------- join

def plain_set(text, size=3):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return frozenset()
    k = min(size, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1))


def plain_components(rows, size=3, percent=90):
    """(id, size of the set, smallest id) per row; rows with equal sets are linked too."""
    sets = [plain_set(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), i if not sets[k] else least.get(find(k))) for k, (i, _) in enumerate(rows)]


def edited(rng, words, edits, vocabulary):
    w = list(words)
    for _ in range(edits):
        at = rng.randrange(len(w))
        kind = rng.randrange(3)
        new = f"{vocabulary}{rng.randrange(10 ** 6)}"
        if kind == 0:
            w[at] = new
        elif kind == 1:
            w.insert(at, new)
        else:
            del w[at]
    return " ".join(w)


def join_rows(seed):
    rng = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "a b"), (6, "A  b"), (7, "a b c"), (8, "one two")]
    at = 10
    for n in (12, 30, 60, 120, 240):
        base = [f"w{rng.randrange(300)}" for _ in range(n)]
        for _ in range(2):
            rows.append((at, " ".join(base)))
            at += 1
        for edits in (0, 1, 1, 2, 2, 3, 4, 5, 6):      # around the threshold, with and without the base
            rows.append((at, edited(rng, base, min(edits, n // 12), "e")))
            at += 1
    # a common passage in texts of their own, and chains in which each text differs a little from the one before
    passage = [f"c{k}" for k in range(80)]
    for _ in range(15):
        rows.append((at, " ".join(passage + [f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 25))])))
        at += 1
    chain = [f"k{k}" for k in range(100)]
    for k in range(12):
        rows.append((at, " ".join(chain)))
        at += 1
        chain[k * 7] = f"n{k}"
    rows += [(3, "one"), (12, "an id once more with another text"), (None, " ".join(passage)), (None, "no id either"),
             (at, "long " * 30_000), (at + 1, "long " * 20_000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_matches_all_pairs(spark, seed):
    rows = join_rows(seed)
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(4)
    got = [tuple(r) for r in jaccard_join.similar_components(docs).collect()]
    assert order_of(got) == order_of(plain_components(rows))


def test_join_in_blocks(spark, monkeypatch):
    """Blocks of two and hot from five on: every bucket and every leader is spread over many groups."""
    monkeypatch.setattr(jaccard_join, "_HOT", 5)
    monkeypatch.setattr(jaccard_join, "_PROFILES", 2)
    monkeypatch.setattr(jaccard_join, "_VERIFY_ROWS", 2)
    rows = join_rows(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.similar_components(docs, size=2, percent=80).collect()]
    assert order_of(got) == order_of(plain_components(rows, 2, 80))


def test_join_prefix_is_long_enough():
    for n in range(1, 300):
        for percent in (50, 80, 90, 100):
            assert jaccard_join.prefix_length(n, percent) == n - -(-percent * n // 100) + 1 >= 1


def test_join_of_empty_tables_and_text_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.similar_components(empty).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", None)], "doc_id string, text string")
    assert {tuple(r) for r in jaccard_join.similar_components(named).collect()} == {("a", 1, "a"), ("b", 1, "a"), ("c", 0, "c")}


def test_join_emits_few_links_for_a_group_of_near_copies(spark):
    """120 near copies of one text: links grow with the members, not with their pairs."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    rows = [(k, edited(rng, base, 1, "e")) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tried = []
    verified = jaccard_join._verified

    def counted(pairs, *args):
        tried.append(pairs.count())
        return verified(pairs, *args)

    jaccard_join._verified = counted
    try:
        got = [tuple(r) for r in jaccard_join.similar_components(docs).collect()]
    finally:
        jaccard_join._verified = verified
    assert order_of(got) == order_of(plain_components(rows))
    assert sum(tried) < 10 * len(rows)
