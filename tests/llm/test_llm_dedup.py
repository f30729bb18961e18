"""Exact dedup, MinHash groups, substring dedup and decontamination against plain definitions on small tables."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attemptlab.llm import decontaminate, exact_dedup, minhash, substring
from attemptlab.llm.common import words

BLANK = {ord(c): None for c in " \t\n\x0b\x0c\r"}
EXTRA = "doc_id long, text string, norm string, salt int, rid long, h long, tokens string, k1 long, words string"


def table(spark, rows):
    """Documents with further columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "y", 4, "z") for i, t in rows], EXTRA).repartition(3)


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "One"), (5, "on e"), (6, "a b"), (7, "a b"),
            (8, "ab\r\n"), (9, "ab")]
    base = [prose(rng, n) for n in (30, 60, 120, 300)]
    at = 10
    for text in base:
        for _ in range(4):
            rows.append((at, text))
            rows.append((at + 1, near(rng, text, 1)))
            rows.append((at + 2, near(rng, text, 3)))
            rows.append((at + 3, text.upper()))
            rows.append((at + 4, prose(rng, 20) + " " + " ".join(text.split()[:40]) + " " + prose(rng, 15)))
            at += 5
    rows += [(at, prose(rng, 2000)), (at + 1, " ".join(["same"] * 200)), (at + 2, " ".join(["same"] * 90)),
             (at + 3, "x" * 5000)]
    rows.append(rows[12])       # a repeated row
    return rows


def test_exact_groups(spark, corpus):
    got = exact_dedup.exact_groups(table(spark, corpus), salts=3).collect()
    groups = {}
    for i, t in corpus:
        groups.setdefault((t or "").translate(BLANK), []).append((-len(t or ""), i))
    assert len(got) == len(corpus)
    text = dict(corpus)
    for r in got:
        key = (text[r["doc_id"]] or "").translate(BLANK)
        assert r["keep_id"] == min(groups[key])[1]
        assert r["group_size"] == len(groups[key])
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
        assert r["text_sha256"] == hashlib.sha256(key.encode()).hexdigest()


def test_exact_keeps_one_row_per_group(spark, corpus):
    docs = table(spark, corpus)
    kept = exact_dedup.keep_first_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({(t or "").translate(BLANK) for _, t in corpus})


def test_exact_null_id_and_empty_table(spark):
    got = exact_dedup.exact_groups(spark.createDataFrame([(None, "a"), (1, "a")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(None, None, True), (1, None, False)}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_groups(empty).count() == 0


@pytest.mark.parametrize("keep", [exact_dedup.keep_first_copies, minhash.keep_smallest])
def test_different_texts_under_a_null_or_repeated_id_stay(spark, keep):
    rng = random.Random(7)
    a, b, c, d = (prose(rng, 40, 10 ** 6) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (1, d), (2, c)]
    got = [(r["doc_id"], r["text"]) for r in keep(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


def plain_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = words(t, lower=True)
        n = min(size, len(w))
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent,block", [(4, 80, 64), (2, 50, 2)])
def test_near_duplicates_match_all_pairs(spark, corpus, size, percent, block):
    # the lower threshold makes chains and mixed buckets; more, shorter bands then keep the recall
    bands = {} if percent == 80 else {"bands": 80, "rows": 3, "least_agreement": 0.2}
    got = minhash.near_duplicate_groups(table(spark, corpus), size=size, percent=percent, block=block, **bands).collect()
    want = plain_components(corpus, size, percent)
    assert len(got) == len(corpus)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_pair_at_the_threshold_with_a_poor_signature(spark):
    # 80 of 100 words in common; the signatures agree in 0.715 of their bytes
    texts = [" ".join([f"s16c{i}" for i in range(80)] + [f"s16{x}{i}" for i in range(10)]) for x in "ab"]
    got = minhash.near_duplicate_groups(table(spark, list(enumerate(texts))), 1, 80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0}


def test_near_duplicates_without_rows_or_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicate_groups(empty).count() == 0
    some = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicate_groups(some).collect()}
    assert got == {None: None, 4: 4, 5: 5}


def test_star_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (250, 300)]
    got = {r["node"]: r["root"] for r in minhash.star_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 200, 250: 200}
    assert got == want


def plain_repeats(texts, window):
    lists = [words(t) for t in texts]
    seen = {}
    for w in lists:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i:i + window])] = seen.get(tuple(w[i:i + window]), 0) + 1
    out = []
    for w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,hot,most", [(35, 20_000, 400_000), (12, 1, 50), (3, 2, 1)])
def test_substring_matches_plain_windows(spark, corpus, window, hot, most):
    got = substring.digest(substring.remove_repeats(table(spark, corpus), window, hot=hot, most_words=most)).collect()
    want = sorted((i, *x) for (i, _), x in zip(corpus, plain_repeats([t for _, t in corpus], window), strict=True))
    assert sorted(map(tuple, got)) == want


def test_shared_passage_is_not_one_group(spark, monkeypatch):
    rng = random.Random(11)
    passage = prose(rng, 50, 10 ** 6)
    texts = [f"{prose(rng, 40, 10 ** 6)} {passage} {prose(rng, 40, 10 ** 6)}" for _ in range(300)]
    rows = list(enumerate(texts))
    docs = substring._keyed(table(spark, rows), "doc_id", "text")
    seen = spark.sparkContext.accumulator(0)
    shards = substring._shards

    def counting(window, most_words):
        run = shards(window, most_words)

        def counted(batches):
            def tallied():
                for batch in batches:
                    seen.add(batch.num_rows)
                    yield batch
            yield from run(tallied())

        return counted

    monkeypatch.setattr(substring, "_shards", counting)
    spans = {r["k1"]: r["spans"] for r in substring.repeated_spans(docs, hot=100).collect()}
    assert seen.value < 100          # before, one segment per document under one route
    assert len(spans) == 300
    got = {r["doc_id"]: r["n_removed"] for r in substring.remove_repeats(table(spark, rows), hot=100).collect()}
    assert set(got.values()) == {50}


def test_segments_of_many_texts_at_once():
    rng = random.Random(7)
    lists = [[rng.randint(1, 4) for _ in range(rng.choice([0, 1, 4, 5, 9, 40]))] for _ in range(60)]
    hashes = [np.array(x, np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in lists]
    sizes = np.array([len(x) for x in lists])
    for window in (3, 5, 12):
        every = substring.runs(np.concatenate(hashes), sizes, window)
        for chosen in (None, np.zeros(1 << 20, np.uint64)):          # no minimiser is hot
            at, weight, first = 0, substring._weights(every, window), np.cumsum(sizes) - sizes
            for i, h in enumerate(hashes):
                one = substring.runs(h, sizes[i:i + 1], window, chosen)
                mine = every.text == i
                assert one.start.tolist() == (every.start[mine] - first[i]).tolist()
                assert one.end.tolist() == (every.end[mine] - first[i]).tolist()
                assert one.route.tolist() == every.route[mine].tolist()
                assert substring._weights(one, window).tolist() == weight[mine].tolist()
                at += int(mine.sum())
                gram = min(substring.GRAM, window)
                for s, e, least, n in zip(one.start, one.end, one.least, weight[mine], strict=True):
                    assert n == 1 + ((one.grams[s:e + window - gram] == least).sum() > 1)
            assert at == len(every.text)


def test_texts_are_searched_together(spark, monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, 60, 50) for _ in range(150)]
    rows = list(enumerate(texts + texts))
    calls = spark.sparkContext.accumulator(0)
    runs = substring.runs

    def counted(*args):
        calls.add(1)
        return runs(*args)

    monkeypatch.setattr(substring, "runs", counted)
    got = substring.remove_repeats(table(spark, rows).coalesce(2)).collect()
    assert {r["n_removed"] for r in got} == {60}
    assert 0 < calls.value < 300          # before, three calls per text


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    rng = random.Random(13)
    segments = [[rng.randint(1, 50_000) for _ in range(60)] for _ in range(400)]
    segments += [s[:40] for s in segments[:40]]          # 40 words twice: their suffixes alone stay equal for long
    text = np.array([x for s in segments for x in (*s, 0)])
    argsort, done = np.argsort, []

    def counted(keys):
        done.append(len(keys))
        return argsort(keys)

    monkeypatch.setattr(np, "argsort", counted)
    order = substring.suffix_array(text, 61)
    assert sum(done) < 2 * len(text)                     # before, all in each of five rounds
    upto = [text[i:].tolist() for i in range(len(text))]
    upto = [x[:x.index(0) + 1] for x in upto]
    assert sorted(order.tolist()) == list(range(len(text)))
    in_order = [upto[i] for i in order.tolist()]
    assert in_order == sorted(in_order)


def test_substring_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring.digest(substring.remove_repeats(empty)).count() == 0


def test_fm_index_counts_every_pattern():
    rng = random.Random(5)
    for _ in range(20):
        symbols = rng.choice([2, 3, 9])
        segments = [np.array([rng.randint(1, symbols) for _ in range(rng.randint(1, 12))]) for _ in range(rng.randint(1, 8))]
        copies = np.array([rng.randint(1, 3) for _ in segments])
        index = substring.FMIndex(segments, copies, symbols + 1)
        for length in (1, 2, 4):
            for pattern in {tuple(s[i:i + length]) for s in segments for i in range(len(s) - length + 1)}:
                lo, hi = np.array([0]), np.array([len(index.text)])
                for c in reversed(pattern):
                    lo, hi = index.extend(np.array([c]), lo, hi)
                found = int(index.weight[hi[0]] - index.weight[lo[0]])
                want = sum(int(k) for s, k in zip(segments, copies, strict=True)
                           for i in range(len(s) - length + 1) if tuple(s[i:i + length]) == pattern)
                assert found == want


def test_masks_hit_every_pattern_of_substitutions():
    w, k = decontaminate.WINDOW, decontaminate.SUBSTITUTIONS
    for bad in itertools.combinations(range(w), k):
        assert any(all(m[i] == "0" or o + i not in bad for i in range(len(m)))
                   for m in decontaminate.MASKS for o in range(w - len(m) + 1)), bad


def plain_pairs(docs, items, least=5):
    out = {}
    for i, t in docs:
        own = decontaminate.tokens(t)
        for j, u in items:
            item = decontaminate.tokens(u)
            w = min(decontaminate.WINDOW, len(item))
            need = w - decontaminate.SUBSTITUTIONS if len(item) >= decontaminate.WINDOW else w
            if len(item) < least:
                continue
            best = max((sum(item[a + x] == own[b + x] for x in range(w))
                        for a in range(len(item) - w + 1) for b in range(len(own) - w + 1)), default=0)
            if best >= need:
                out[i, j] = max(best, out.get((i, j), 0))
    return out


def test_decontamination_matches_all_alignments(spark):
    rng = random.Random(9)
    items = [(j, prose(rng, n)) for j, n in enumerate((12, 15, 40, 30, 7, 6, 3, 0))] + [(20, None), (2, prose(rng, 14))]
    items = [(100 + k if j == 2 and k else j, t) for k, (j, t) in enumerate(items)]
    docs = [(0, None), (1, ""), (2, "w1 w2")]
    for i in range(3, 60):
        text = prose(rng, rng.randint(5, 80)).split()
        j, item = rng.choice(items)
        w = decontaminate.tokens(item)
        if w and rng.random() < 0.8:
            lo = rng.randint(0, max(0, len(w) - 10))
            piece = w[lo:lo + rng.randint(8, 30)]
            for _ in range(rng.randint(0, 5)):
                piece[rng.randrange(len(piece))] = "zz"
            at = rng.randint(0, len(text))
            text[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in piece]
        docs.append((i, " ".join(text)))
    docs.append(docs[10])
    bench = spark.createDataFrame([(j, t, 1) for j, t in items], "item_id long, text string, h int")
    got = {(r["doc_id"], r["item_id"]): r["equal_tokens"]
           for r in decontaminate.contaminated_pairs(table(spark, docs), bench).collect()}
    assert got == plain_pairs(docs, items)
    kept = decontaminate.drop_contaminated(table(spark, docs), bench)
    assert kept.columns == table(spark, docs).columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {i for i, _ in docs} - {i for i, _ in got}


def test_decontamination_empty_sides(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m"), (None, "x")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_pairs(docs, none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == 2
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert decontaminate.contaminated_pairs(docs.limit(0), bench).count() == 0
    assert [r[0] for r in decontaminate.contaminated_pairs(docs, bench).select("doc_id").collect()] == [1]


def test_queries_read_whole_tables(spark):
    from attemptlab.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert queries.QUERIES["op1_exact_dedup"](spark, sf).count() == n
    assert queries.QUERIES["op7_substring_dedup"](spark, sf).count() == n
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op3_minhash"](spark, sf).collect()}
    assert got == plain_components(docs, 4, 80)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    pairs = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op2_decontamination"](spark, sf)
             .select("doc_id", "item_id").collect()}
    plain = {(d, i) for d, t in docs for i, u in items if t and u in t}
    assert plain <= pairs
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_mixed_bucket_gives_joining_links_only(spark):
    # one bucket: a component of 40 texts, 6 single texts that are near all of them, 2 that only look near
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join([*base, f"x{i}"]) for i in range(46)}
    texts |= {i: " ".join(base[:60] + [f"y{i}_{k}" for k in range(40)]) for i in (46, 47)}
    root = {i: 0 if i < 40 else i for i in texts}
    placed = spark.createDataFrame([(0, 1, i, root[i], 101 if i < 46 else 100) for i in texts],
                                   "slot int, band long, doc_id long, root long, n_shingles long")
    signs = spark.createDataFrame([(i, b"\1" * 256, [i]) for i in texts], "doc_id long, signature binary, bands array<long>")
    for block in (512, 7):
        links = minhash._settled(placed, signs, table(spark, list(texts.items())), 1, 80, 0.66, block).collect()
        groups = 2 * 7 if block == 7 else 1
        assert len(links) <= groups * (len(set(root.values())) - 1)
        top = dict(root)
        for r in links:
            one, two = top[r["a"]], top[r["b"]]
            assert r["a"] < 46 and r["b"] < 46
            top = {i: min(one, two) if t in (one, two) else t for i, t in top.items()}
        assert {top[i] for i in range(46)} == {0} and top[46] == 46 and top[47] == 47


@pytest.mark.parametrize("keep", [exact_dedup.keep_first_copies, minhash.keep_smallest])
def test_columns_of_any_name_are_kept(spark, keep):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text, "x", "p"), (2, text, "y", "q"), (3, "other words altogether", "z", "r")],
                                 "doc_id long, text string, __sha string, ___SHA string")
    got = sorted(tuple(r) for r in keep(docs).select("doc_id", "__sha", "___SHA").collect())
    assert got == [(1, "x", "p"), (3, "z", "r")]
