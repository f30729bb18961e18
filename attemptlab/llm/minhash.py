"""Near-duplicate groups: MinHash with banding, signature verification, exact confirmation, connected components.

Plan, all of it in Spark jobs over thin rows:

1. One pass over the texts gives each document its distinct shingles' count and digest, ``bands`` band keys (each
   of ``rows`` universal hash minima) and a short signature.
2. Documents with the same shingle set are one class; only class representatives go on, so copies cost nothing.
3. Representatives meet in their buckets (band keys).  Each is compared with the leader of its bucket, the
   best-shared leader first; pairs must pass the signature, then the comparison of the full shingle sets.
4. Components are contracted with alternating large-star and small-star steps.  The other leaders are compared
   only where they are in another component.
5. Buckets that still hold several components are settled: members outside the largest component are compared
   with all of other components, in blocks of bounded size, so that no link is lost and no bucket is capped.  Only
   confirmed links that join two components leave a group.

Pairs are never expanded within a group of copies, nothing about single documents reaches the driver, and tables
that are used twice are written to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import WordHash, free_name, gram_hashes, map_rows, mix, word_hashes, words
from attemptlab.session import ensure_checkpoint_dir

SIGNED = ("rid long, doc_id {id}, n_shingles long, set_a long, set_b long, bands array<long>, signature binary")


def shingle_set(text: str | None, size: int, held: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, an empty one none."""
    hashes = word_hashes(held, words(text, lower=True))
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(size, len(hashes))))


class Family:
    """``k`` universal hash functions a * x + b on 32 bits (a odd), and their minima over a set."""

    def __init__(self, k: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 2 ** 32, (k, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2 ** 32, (k, 1), dtype=np.uint32)
        self.work = np.empty((k, 256), np.uint32)

    def minima(self, items: np.ndarray) -> np.ndarray:
        x = (items >> np.uint64(32)).astype(np.uint32) ^ items.astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), 256):
            part = x[s:s + 256]
            work = self.work[:, :len(part)]
            np.multiply(self.a, part, out=work)
            work += self.b
            np.minimum(best, work.min(1), out=best)
        return best


def _signed(docs: DataFrame, size: int, bands: int, rows: int, signature: int) -> DataFrame:
    """One row per document that has shingles, and one without bands for the others."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    state: dict = {}

    def sign(rids: pa.Array, ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        if not state:
            state.update(held=WordHash(), family=Family(max(bands * rows, signature)),
                         salt=mix(np.arange(1, bands + 1, dtype=np.uint64)))
        out: dict[str, list] = {k: [] for k in ("n_shingles", "set_a", "set_b", "bands", "signature")}
        for text in texts:
            items = shingle_set(text.as_py(), size, state["held"])
            out["n_shingles"].append(len(items))
            a, b = np.frombuffer(xxhash.xxh128_digest(items.tobytes()), np.int64).tolist()
            out["set_a"].append(a)
            out["set_b"].append(b)
            if not len(items):
                out["bands"].append([])
                out["signature"].append(b"")
                continue
            minima = state["family"].minima(items)
            grid = minima[:bands * rows].reshape(bands, rows).astype(np.uint64)
            key = state["salt"].copy()
            for c in range(rows):
                key = mix(key + grid[:, c] * np.uint64(0x9E3779B97F4A7C15))
            out["bands"].append(key.view(np.int64))
            out["signature"].append((mix(minima[:signature].astype(np.uint64)) & np.uint64(255)).astype(np.uint8).tobytes())
        yield {"rid": rids, "doc_id": ids, **out}

    return map_rows(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), sign,
                    SIGNED.format(id=kind), rows=500)


def _agreement(a: Column, b: Column) -> Column:
    """Share of equal bytes of two signatures."""
    @F.pandas_udf("double")
    def share(x, y):
        import pandas as pd

        if not len(x):
            return pd.Series([], dtype="float64")
        left = np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(len(y), -1)
        return pd.Series((left == right).mean(1))

    return share(a, b)


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of representatives whose full shingle sets reach ``percent``.

    ``texts`` (doc_id, text) holds the representatives that occur in buckets; a pair's two texts meet in one row.
    """
    both = (pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"))
    kind = pairs.schema["a"].dataType.simpleString()
    state: dict = {}

    def check(a: pa.Array, b: pa.Array, ta: pa.Array, tb: pa.Array) -> Iterator[dict[str, list]]:
        held = state.setdefault("held", WordHash())
        recent: dict = {}
        ok = []
        for i, x, y in zip(a.to_pylist(), ta, tb, strict=True):
            if i not in recent:
                if len(recent) >= 16:
                    recent.clear()
                recent[i] = shingle_set(x.as_py(), size, held)
            left, right = recent[i], shingle_set(y.as_py(), size, held)
            common = np.intersect1d(left, right, assume_unique=True).size
            ok.append(100 * common >= percent * (len(left) + len(right) - common))
        at = pa.array(ok, pa.bool_())
        yield {"a": a.filter(at), "b": b.filter(at)}

    return map_rows(both.select("a", "b", "text_a", "text_b"), check, f"a {kind}, b {kind}", rows=500)


_ROWS_PER_TASK = 250_000


def _cut(df: DataFrame, thin: bool = False) -> DataFrame:
    """Write to the shared checkpoint folder and go on from there.

    A ``thin`` table (a few numbers per row) is read by as many tasks as its counted rows ask for, so that small
    tables don't cost one small file per partition in every later exchange.
    """
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint()
    return out.coalesce(max(1, -(-out.count() // _ROWS_PER_TASK))) if thin else out


def star_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node that each node of ``edges`` (a, b) reaches.

    Alternates large-star (every larger neighbour links to the smallest) and small-star (every node links its
    smaller neighbours to the smallest) until the links no longer change.  Minima are aggregated before the
    shuffle, so a hub with any number of neighbours costs one row per task.
    """
    links = _cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), thin=True)

    def summary(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    state = summary(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        near = links.union(links.select("v", "u"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(small_least, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.u", "e.v").where("u <> v").distinct())
        links = _cut(small, thin=True)
        after = summary(links)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components did not settle within {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .union(links.select(F.col("v"), F.col("v")).distinct())


def _rooted(df: DataFrame, roots: DataFrame, col: str, name: str) -> DataFrame:
    """``df`` with the component of ``col`` (itself if it has no link)."""
    r = roots.select(F.col("node").alias(col), F.col("root").alias("__root"))
    return df.join(r, col, "left").withColumn(name, F.coalesce("__root", col)).drop("__root")


def near_duplicate_groups(docs: DataFrame, size: int = 4, percent: int = 80, bands: int = 32, rows: int = 5,
                          signature: int = 256, least_agreement: float = 0.66, block: int = 512,
                          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased; a document's set holds its distinct ``size``-word
    shingles, or its whole word sequence when shorter; a null text or one without words has an empty set and no
    links.  Documents are linked when 100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable.  With the default bands a pair at 0.8 fails to meet with a probability of about 3e-6; its
    signature agrees in 0.8 of the bytes (deviation 0.025), and the bound lies more than five deviations below.
    Repeated rows of one id get one row each and belong to the same component; a null id is a group of its own.  Other columns are ignored.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = _cut(_signed(whole, size, bands, rows, signature))
    full = signed.where("n_shingles > 0 and doc_id is not null")

    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = _cut(full.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"])
                .select("doc_id", "n_shingles", "signature", "bands"))
    lone = reps.select("doc_id", F.posexplode("bands").alias("slot", "band"))
    # buckets with one member never go on; rows are combined in the tasks before the shuffle
    leaders = (lone.groupBy("slot", "band").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last"))
               .where("leader <> last").select("slot", "band", "leader"))
    members = _cut(lone.join(leaders, ["slot", "band"]), thin=True)

    stars = _cut(members.where("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b"))
                 .agg(F.count(F.lit(1)).alias("shared")), thin=True)
    ends = stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # only documents that share a bucket are moved, once, with what all later comparisons need
    texts = _cut(whole.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    sizes = _cut(reps.join(ends, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def promising(pairs: DataFrame) -> DataFrame:
        """Pairs that the sizes and the signatures allow."""
        s = pairs.join(sizes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"),
                                    F.col("signature").alias("sig_a")), "a") \
            .join(sizes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"),
                               F.col("signature").alias("sig_b")), "b") \
            .where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        return s.where(_agreement(F.col("sig_a"), F.col("sig_b")) >= least_agreement).select("a", "b")

    best = stars.groupBy("b").agg(F.max(F.struct("shared", "a"))["a"].alias("a")).select("a", "b")
    linked = _cut(_confirm(promising(best), texts, size, percent), thin=True)
    roots = star_components(linked)

    others = _rooted(_rooted(stars.join(best, ["a", "b"], "left_anti").select("a", "b"), roots, "a", "root_a"),
                     roots, "b", "root_b").where("root_a <> root_b").select("a", "b")
    more = _cut(_confirm(promising(others), texts, size, percent), thin=True)
    linked = linked.union(more)
    if not more.isEmpty():
        roots = star_components(linked)

    # buckets with several components: compare across components, in blocks
    placed = _rooted(members.select("slot", "band", "doc_id"), roots, "doc_id", "root") \
        .join(sizes.select("doc_id", "n_shingles"), "doc_id")
    last = _cut(_settled(placed, sizes.select("doc_id", "signature", "bands"), texts, size, percent, least_agreement, block),
                thin=True)
    if not last.isEmpty():
        roots = star_components(linked.union(last))

    named = _rooted(classes.select("set_a", "set_b", F.col("rep").alias("doc_id")), roots, "doc_id", "component_id") \
        .select("set_a", "set_b", "component_id")
    thin = signed.select("doc_id", "n_shingles", "set_a", "set_b",
                         F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), 1).otherwise(0).alias("has"))
    # documents without shingles belong to no class: they get a key of their own instead of a common one
    keyed = thin.withColumn("set_a", F.when(F.col("has") == 1, F.col("set_a")).otherwise(F.xxhash64("doc_id")))
    return (keyed.join(named.withColumn("has", F.lit(1)), ["has", "set_a", "set_b"], "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


_BLOCK_SHINGLES = 1_000_000     # shingles of the members of a block, on average


def _settled(placed: DataFrame, signs: DataFrame, texts: DataFrame, size: int, percent: int, least_agreement: float,
             block: int) -> DataFrame:
    """Confirmed links (a, b) that join the components of each bucket, at most one per component and group.

    In a bucket with several components, the members outside its largest one meet all members: both sides are dealt
    into blocks of bounded size, and each pair of blocks is one group.  The first pass over the groups looks at the
    signatures alone and keeps the members that have a promising partner in another component, the second brings
    their texts and compares full sets; a pair whose components have been joined in the group needs no comparison.
    A pair is looked at in the first bucket that holds both.
    """
    parts = placed.groupBy("slot", "band", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("w") / F.lit(_BLOCK_SHINGLES)), F.lit(1)).cast("int")
    mixed = (parts.groupBy("slot", "band").agg(F.max(F.struct("n", "w", "root")).alias("main"), F.sum("n").alias("n"),
                                               F.sum("w").alias("w"), F.count(F.lit(1)).alias("roots"))
             .where("roots > 1").withColumn("all_blocks", blocks)
             .withColumn("n", F.col("n") - F.col("main.n")).withColumn("w", F.col("w") - F.col("main.w"))
             .select("slot", "band", F.col("main.root").alias("main"), "all_blocks", blocks.alias("few_blocks")))
    rest = (placed.join(mixed, ["slot", "band"]).join(signs, "doc_id")
            .withColumn("few", F.col("root") != F.col("main"))
            .withColumn("bands", F.transform("bands", lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))))
    own = F.xxhash64("doc_id")
    cols = ["slot", "band", "lo", "hi", "left", "few", "doc_id", "root", "n_shingles", "signature", "bands"]

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    dealt = rest.where("few").withColumn("lo", F.pmod(own, F.col("few_blocks")).cast("int")).withColumn("hi", every("all_blocks")) \
        .withColumn("left", F.lit(True)).select(cols) \
        .unionByName(rest.withColumn("hi", F.pmod(own, F.col("all_blocks")).cast("int")).withColumn("lo", every("few_blocks"))
                     .withColumn("left", F.lit(False)).select(cols))
    key = ["slot", "band", "lo", "hi"]
    kind = placed.schema["doc_id"].dataType.simpleString()

    def partners(group: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each row of the left side with its promising rows of the right side, and their agreement."""
        ids, roots, few = (group[c].to_numpy() for c in ("doc_id", "root", "few"))
        n, slot, left = group["n_shingles"].to_numpy(), group["slot"][0].as_py(), group["left"].to_numpy()
        sig = np.frombuffer(b"".join(group["signature"].to_pylist()), np.uint8).reshape(len(ids), -1)
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[:, :slot]
        right = np.flatnonzero(~left)
        for i in np.flatnonzero(left).tolist():
            j = right[(roots[right] != roots[i]) & (~few[right] | (ids[right] > ids[i]))
                      & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            if len(j):
                share = (sig[j] == sig[i]).mean(1)
                at = (share >= least_agreement) & ~(bands[j] == bands[i]).any(1)
                if at.any():
                    yield i, j[at], share[at]

    def promising(group: pa.Table) -> pa.Table:
        keep = np.zeros(group.num_rows, bool)
        for i, j, _ in partners(group):
            keep[i] = keep[j] = True
        return group.filter(pa.array(keep))

    def settle(group: pa.Table) -> pa.Table:
        ids, roots, texts = (group[c].to_pylist() for c in ("doc_id", "root", "text"))
        held, sets, parent = WordHash(), {}, {r: r for r in roots}
        a, b = [], []

        def top(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        def items(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i], size, held)
            return sets[i]

        for i, near, share in partners(group):
            for j in near[np.argsort(-share, kind="stable")].tolist():
                if top(roots[i]) == top(roots[j]):
                    continue
                x, y = items(i), items(j)
                common = np.intersect1d(x, y, assume_unique=True).size
                if 100 * common >= percent * (len(x) + len(y) - common):
                    parent[top(roots[i])] = top(roots[j])
                    a.append(ids[i])
                    b.append(ids[j])
        t = group.schema.field("doc_id").type
        return pa.table({"a": pa.array(a, t), "b": pa.array(b, t)})

    # ids and texts of one document meet once per group that has a promising pair for it
    dealt = dealt.select(cols)
    near = dealt.groupBy(key).applyInArrow(promising, dealt.schema)
    return near.join(texts, "doc_id").groupBy(key).applyInArrow(settle, f"a {kind}, b {kind}").distinct()


def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that lead their group, with all their columns; repeated rows of an id and text become one.

    Different texts under one id, or without an id, stay apart; columns of any name are kept as they are.
    """
    kept = near_duplicate_groups(docs, id_col=id_col, text_col=text_col, **options).where("kept") \
        .select(F.col("doc_id").alias("__kept")).distinct()
    sha = free_name(docs, "__sha")
    own = docs.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    return own.join(kept, own[id_col].eqNullSafe(kept["__kept"]), "left_semi").dropDuplicates([id_col, sha]).drop(sha)

