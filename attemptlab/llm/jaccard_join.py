"""Exact Jaccard join of word n-gram sets with grouped prefixes, and the components of its links.

A document's set is put into one global order, rare shingles first (estimated from count sketches over all documents;
any order is right, this one keeps buckets small).  Sets that reach the similarity share a shingle among the first
``n - ceil(t * n) + 1`` of each: the prefix.

1. Documents with the same set are one class; copies cost nothing from here on.
2. Classes with the same size and the same prefix are one group.  Only groups enter the index of prefix shingles.
3. Group pairs that meet under a shingle are filtered by size and by position: with the shingle as their first common
   one, the rest of the two sets must still reach the overlap that the similarity asks for.  Groups without such a
   partner leave the bucket at once.
4. The pairs that are left are expanded to the groups' members, compared by somewhat longer prefixes that must have
   several shingles in common, and verified on the full sets.  First each group is
   compared with the most central group of each of its buckets, and the components of these links are contracted.  Then every
   bucket that still holds several components is settled: its groups are collapsed to profiles of equal component,
   size and position, and all profile pairs of different components that pass the filter are expanded and verified.
   So all links between components are tried, but a group of near copies isn't expanded into all its pairs.
5. Components are contracted by alternating large-star and small-star steps.

Sets are kept as hashes of 64 bits.  Nothing about single documents reaches the driver; the sketch has a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import WordHash, bitmap_of, gram_hashes, map_rows, maybe, stored, word_hashes, words
from attemptlab.llm.minhash import shingle_set, star_components

_SLOTS = 18               # each sketch counts in 2 ** _SLOTS slots
_HOT = 50_000             # shingles that so many documents hold are indexed in a way that splits their buckets
_MORE = 8                 # shingles after the prefix that are kept to compare pairs before they are verified
_VERIFY_ROWS = 128        # members that meet one leader in a task at a time
_PROFILES = 2048          # profiles of a bucket that meet in a task at a time


def _slot(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - _SLOTS)).astype(np.int64)


def sketches(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences per slot of the word hashes and documents per slot of the shingle hashes, over all rows of ``texts``."""
    slots = 1 << _SLOTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, none = WordHash(), np.zeros(2 * slots, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            split = [word_hashes(held, words(t.as_py(), lower=True)) for t in batch.column(0)]
            sets = [np.unique(gram_hashes(h, min(size, len(h)))) for h in split if len(h)]
            counts[:slots] += np.bincount(_slot(np.concatenate([*split, none])), minlength=slots)
            counts[slots:] += np.bincount(_slot(np.concatenate([*sets, none])), minlength=slots)
        at = np.flatnonzero(counts)
        for s in range(0, len(at), 100_000):
            part = at[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part])], names=["slot", "n"])

    got = texts.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * slots, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out[:slots], out[slots:]


class Order:
    """The global order of shingles: those of clusters after all others, then by the frequencies of their words.

    A shingle that many documents hold lifts its slot of the sketch above the even filling by chance (mean and
    deviation of the counts); its level is the logarithm of the excess.  Within a level, the sum of the words'
    logarithmic frequencies puts shingles of rare words, which few documents share, first.
    """

    def __init__(self, of_words: np.ndarray, of_shingles: np.ndarray):
        self.word = np.rint(4 * np.log2(1 + of_words)).astype(np.int32)
        base = np.median(of_shingles)
        excess = (of_shingles - base) / (5 * np.sqrt(base) + 1)
        self.level = np.floor(np.log2(np.maximum(excess, 0.5))).astype(np.int32) + 1
        self.hot = of_shingles - base >= _HOT

    def ordered(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct shingles of a word sequence sorted by hash, and their order (ties by hash)."""
        k = min(size, len(hashes))
        items, at = np.unique(gram_hashes(hashes, k), return_index=True)
        own = self.word[_slot(hashes)]
        sums = np.convolve(own, np.ones(k, np.int32), "valid")
        return items, np.argsort(self.level[_slot(items)] * 4096 + sums[at], kind="stable")


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _signed(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A row per document: running number, id, size and digest of its set, digest of the prefix, the prefix.

    ``prefix`` goes on for ``_MORE`` shingles beyond its length ``p``.  ``cold`` is the number of shingles at the head of the prefix before the first hot one.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = Order(*sketches(docs.select("text"), size))
    state: dict = {}

    def sign(rids: pa.Array, ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        held = state.setdefault("held", WordHash())
        out: dict[str, list] = {k: [] for k in ("n", "set_a", "set_b", "pre_a", "pre_b", "prefix", "p", "cold")}
        for text in texts:
            hashes = word_hashes(held, words(text.as_py(), lower=True))
            items, ranked = order.ordered(hashes, size) if len(hashes) else (hashes, np.zeros(0, np.int64))
            n = len(items)
            p = prefix_length(n, percent) if n else 0
            longer = items[ranked[:p + _MORE]]
            prefix = longer[:p]
            hot = np.flatnonzero(order.hot[_slot(prefix)])
            for k, part in (("set", items), ("pre", prefix)):
                a, b = np.frombuffer(xxhash.xxh128_digest(part.tobytes()), np.int64).tolist()
                out[f"{k}_a"].append(a)
                out[f"{k}_b"].append(b)
            out["n"].append(n)
            out["prefix"].append(longer.view(np.int64))
            out["p"].append(p)
            out["cold"].append(int(hot[0]) if len(hot) else len(prefix))
        yield {"rid": rids, "doc_id": ids, **out}

    return map_rows(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), sign,
                    f"rid long, doc_id {kind}, n int, set_a long, set_b long, pre_a long, pre_b long, prefix array<long>, p int, cold int",
                    rows=500)


def _sets(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(rid, items): the full sets of ``classes`` (rid, doc_id, set_a, set_b), made from the texts.

    A bitmap of the ids keeps the other texts from being hashed and moved; what it lets through by chance drops out
    in the join.
    """
    ids = bitmap_of(classes.select(F.xxhash64("doc_id").alias("h")), "h")
    state: dict = {}

    def make(keys: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        held = state.setdefault("held", WordHash())
        near = np.flatnonzero(maybe(ids, keys.to_numpy()))
        data = [shingle_set(t.as_py(), size, held).tobytes() for t in texts.take(pa.array(near))]
        both = [np.frombuffer(xxhash.xxh128_digest(d), np.int64).tolist() for d in data]
        yield {"set_a": [a for a, _ in both], "set_b": [b for _, b in both], "items": data}

    made = map_rows(docs.select(F.xxhash64("doc_id").alias("h"), "text"), make,
                    "set_a long, set_b long, items binary", rows=500)
    return made.join(classes.select("rid", "set_a", "set_b"), ["set_a", "set_b"]).select("rid", "items").dropDuplicates(["rid"])


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``classes`` whose full sets reach ``percent``.

    Linked sets of overlap o share k shingles in the first ``n - o + k`` of each, so pairs whose longer prefixes have
    fewer in common than their lengths and the least overlap of their sizes ask for drop out before any set is made.  The partners of one ``a`` are dealt into blocks of about
    ``_VERIFY_ROWS``; its set is sent once to each block.
    """
    one, two = (classes.select(F.col("rid").alias(c), F.col("prefix").alias(f"p_{c}"), F.col("n").alias(f"n_{c}")) for c in "ab")
    overlap = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / F.lit(100 + percent))
    least = overlap + F.least(*[F.size(f"p_{c}") - F.col(f"n_{c}") for c in "ab"])
    pairs = stored(pairs.join(one, "a").join(two, "b").where(F.size(F.array_intersect("p_a", "p_b")) >= least)
                   .select("a", "b"), "join-near")
    blocks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(_VERIFY_ROWS)).cast("long").alias("blocks"))
    dealt = stored(pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block")), "join-dealt")
    ends = dealt.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    sets = stored(_sets(docs, stored(classes.join(ends, "rid", "left_semi"), "join-ends"), size), "join-sets")
    members = dealt.join(sets.withColumnRenamed("rid", "b"), "b").select("a", "block", "b", "items")
    leaders = (dealt.select("a", "block").distinct().join(sets.withColumnRenamed("rid", "a"), "a")
               .select("a", "block", F.col("a").alias("b"), "items"))

    def check(group: pa.Table) -> pa.Table:
        a = group["a"][0].as_py()
        ids = group["b"].to_pylist()
        items = [np.frombuffer(x, np.uint64) for x in group["items"].to_pylist()]
        left = items[ids.index(a)]
        ok = []
        for i, right in zip(ids, items, strict=True):
            if i != a:
                common = np.intersect1d(left, right, assume_unique=True).size
                if 100 * common >= percent * (len(left) + len(right) - common):
                    ok.append(i)
        return pa.table({"a": pa.array([a] * len(ok), pa.int64()), "b": pa.array(ok, pa.int64())})

    return members.unionByName(leaders).groupBy("a", "block").applyInArrow(check, "a long, b long")


def _passes(n: str, r: str, m: str, s: str, percent: int):
    """Size and position filter: two sets of sizes ``n`` and ``m`` with ``r`` and ``s`` shingles from the common one on."""
    need = F.lit(percent) * (F.col(n) + F.col(m))
    return ((F.lit(100 + percent) * F.least(r, s) >= need)
            & (F.lit(100) * F.least(n, m) >= F.lit(percent) * F.greatest(n, m)))


def _rooted(df: DataFrame, roots: DataFrame, col: str, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias(col), F.col("root").alias("__root"))
    return df.join(r, col, "left").withColumn(name, F.coalesce("__root", col)).drop("__root")


def _profile_pairs(profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of profiles (token, root, n, r) of one bucket, of different components, that pass the filter.

    A bucket's profiles are dealt into blocks of bounded size, and each pair of blocks has a join key of its own, so
    that a large bucket is spread over many tasks.
    """
    blocks = profiles.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"),
                                           F.ceil(F.count(F.lit(1)) / F.lit(_PROFILES)).cast("int").alias("blocks")) \
        .where("lo <> hi").select("token", "blocks")
    part = F.pmod(F.xxhash64("root", "n", "r"), F.col("blocks")).cast("int")
    dealt = (profiles.join(blocks, "token").withColumn("own", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "root", "n", "r"))
    dealt = stored(dealt, "join-blocks")
    one, two = (dealt.withColumnsRenamed({c: f"{c}{k}" for c in ("own", "root", "n", "r")}) for k in (1, 2))
    return (one.join(two, ["token", "lo", "hi"])
            .where(((F.col("lo") == F.col("hi")) | (F.col("own1") != F.col("own2"))) & (F.col("root1") < F.col("root2"))
                   & _passes("n1", "r1", "n2", "r2", percent))
            .select("token", "root1", "n1", "r1", "root2", "n2", "r2"))


def _with_partner(index: DataFrame, percent: int) -> DataFrame:
    """Rows (token, gid, n, r) that have another group in their bucket with which they pass the filter.

    Rows are compared with the distinct (n, r) of their bucket, of which there are few however large it is.
    """
    shapes = index.groupBy("token", F.col("n").alias("m"), F.col("r").alias("s")).agg(F.count(F.lit(1)).alias("rows"))
    same = (F.col("m") == F.col("n")) & (F.col("s") == F.col("r"))
    other = shapes.withColumnRenamed("token", "__token")
    return index.join(other, (F.col("token") == F.col("__token")) & _passes("n", "r", "m", "s", percent)
                      & (~same | (F.col("rows") > 1)), "left_semi")


def linked_classes(docs: DataFrame, signed: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (set_a, set_b, rid, least) and the components (node, root) of their rids."""
    full = signed.where("n > 0")
    classes = stored(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least"), F.min("rid").alias("rid")), "join-classes")
    reps = full.join(classes.select("rid"), "rid", "left_semi")
    groups = reps.groupBy("n", "pre_a", "pre_b").agg(F.min("rid").alias("gid"))
    named = stored(reps.join(groups, ["n", "pre_a", "pre_b"])
                   .select("rid", "gid", "n", "doc_id", "set_a", "set_b", "cold", "p", "prefix"), "join-groups")
    head = F.slice("prefix", F.lit(1), F.col("p"))
    index = named.where("rid = gid").select("gid", "n", "cold", F.posexplode(head).alias("i", "token")) \
        .select("token", "gid", "n", (F.col("n") - F.col("i")).alias("r"), (F.col("i") >= F.col("cold")).alias("hot"))
    # hot buckets are combined in the tasks and can be split by the planner; all others are moved once
    members = stored(_with_partner(index.where("not hot").drop("hot").repartition("token"), percent)
                     .unionByName(_with_partner(index.where("hot").drop("hot"), percent)), "join-members")
    # the leader of a bucket is the group with the fewest shingles before the common one
    leaders = (members.groupBy("token").agg(F.max(F.struct((F.col("r") * F.lit(1000.0) / F.col("n")).cast("int").alias("share"),
                                                           (-F.col("gid")).alias("first"), "n", "r")).alias("best"))
               .select("token", (-F.col("best.first")).alias("leader"), F.col("best.n").alias("m"), F.col("best.r").alias("s")))
    stars = (members.join(leaders, "token").where(F.col("gid") != F.col("leader")).where(_passes("n", "r", "m", "s", percent))
             .select(F.col("leader").alias("a"), "gid").distinct())
    of_group, keyed = named.select("gid", F.col("rid").alias("b")), named.select("rid", "n", "doc_id", "set_a", "set_b", "prefix")
    # every group with the central groups of its buckets, and the members of a group with its first
    inner = named.where("rid <> gid").select(F.col("gid").alias("a"), F.col("rid").alias("b"))
    tried = stored(stars.join(of_group, "gid").select("a", "b").unionByName(inner), "join-tried")
    links = stored(_verified(tried, docs, keyed, size, percent), "join-links")
    roots = star_components(links)

    # buckets that still hold several components, and groups likewise, under their own number from position 0 on
    placed = _rooted(members.select("token", "gid", "n", "r").join(of_group.withColumnRenamed("b", "rid"), "gid"), roots, "rid", "root")
    own = _rooted(named.join(inner.select(F.col("a").alias("gid")).distinct(), "gid", "left_semi")
                  .select(F.xxhash64("gid", "n").alias("token"), "n", F.col("n").alias("r"), "rid"), roots, "rid", "root")
    placed = stored(placed.select("token", "n", "r", "rid", "root").unionByName(own.select("token", "n", "r", "rid", "root")), "join-placed")
    profiles = placed.groupBy("token", "root", "n", "r").agg(F.count(F.lit(1)).alias("rows"))
    hits = stored(_profile_pairs(profiles, percent), "join-profiles")

    def side(k: str, name: str) -> DataFrame:
        return placed.select("token", F.col("root").alias(f"root{k}"), F.col("n").alias(f"n{k}"), F.col("r").alias(f"r{k}"),
                             F.col("rid").alias(name))

    last = (hits.join(side("1", "a"), ["token", "root1", "n1", "r1"]).join(side("2", "b"), ["token", "root2", "n2", "r2"])
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    final = stored(_verified(last.join(done, ["a", "b"], "left_anti"), docs, keyed, size, percent), "join-last")
    if not final.isEmpty():
        roots = star_components(links.unionByName(final))
    return classes, roots


def similar_components(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct ``size``-word
    shingles, or its whole word sequence when shorter; a null text or one without words has an empty set and no
    links.  Documents are linked when 100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable.  Rows are told apart by their sets, not by their ids: rows of one id with different texts are only in
    one component if their texts are linked, and each takes its own component's smallest id.  A null id is never the
    smallest (null only where a component has no other).  An empty table gives an empty result; other columns are
    ignored, whatever their names.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = stored(_signed(whole, size, percent), "join-signed")
    classes, roots = linked_classes(whole, signed, size, percent)
    rooted = _rooted(classes, roots, "rid", "root")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("set_a", "set_b", "component_id")
    linked = signed.where("n > 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "set_a", "set_b") \
        .join(named, ["set_a", "set_b"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(signed.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))
