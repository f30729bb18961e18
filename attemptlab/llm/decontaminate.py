"""Benchmark decontamination with spaced seeds.

A passage is an overlap when ``WINDOW`` consecutive tokens of a benchmark item and of a document, aligned token
by token, differ in at most ``SUBSTITUTIONS`` places.  Fixed masks read some positions and ignore the others;
the three masks together hit every such window (all patterns of two substitutions in twelve places are covered),
so the search is lossless.  Equal masked hashes of item and document are joined, and every alignment that a hit
proposes is verified on the tokens around it.

The items' hashes are folded into a bitmap of fixed size, which is all that is broadcast: it keeps positions that
cannot match from leaving the scan.  However large the benchmark grows, the join decides; a fuller bitmap only
lets more rows through.  What leaves the scan are short token regions around possible hits, never whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import WordHash, map_rows, mix
from attemptlab.session import ensure_checkpoint_dir

WINDOW, SUBSTITUTIONS = 12, 2
#: Fixed masks; "1" is read, "0" is ignored.
MASKS = ("11101011", "101100111", "1111101")
_WORD = re.compile(r"\w+")
_BITS = 25


class _Held(WordHash):
    def __missing__(self, word: str) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def tokens(text: str | None) -> list[str]:
    """Lower-cased runs of word characters; punctuation and white space do not count."""
    return _WORD.findall((text or "").lower())


def masked(hashes: np.ndarray, mask: str, which: int) -> np.ndarray:
    """Hash of what a mask reads at every position where it fits."""
    m = len(hashes) - len(mask) + 1
    acc = np.full(max(m, 0), which + 1, np.uint64)
    if m > 0:
        for i, c in enumerate(mask):
            if c == "1":
                acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + m]
        acc = mix(acc)
    return acc


def seed_masks(lengths: list[int]) -> list[str]:
    """The fixed masks, and one solid mask for each token count of items shorter than a window."""
    return [*MASKS, *("1" * n for n in sorted(lengths))]


def verify(item: list[str], region: list[str], shift: int) -> int:
    """Most equal tokens of a qualifying window when item token i lies on region token i + shift; 0 if none.

    An item shorter than a window qualifies only as a whole without substitutions.
    """
    lo, hi = max(0, -shift), min(len(item), len(region) - shift)
    width = min(WINDOW, len(item))
    if hi - lo < width:
        return 0
    same = np.fromiter((item[i] == region[i + shift] for i in range(lo, hi)), np.int64, hi - lo)
    total = np.cumsum(np.append(0, same))
    best = int((total[width:] - total[:-width]).max())
    return best if best >= (WINDOW - SUBSTITUTIONS if len(item) >= WINDOW else len(item)) else 0


def _cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64((1 << _BITS) - 1)
    return h & low, (h >> np.uint64(32)) & low


def contaminated_pairs(docs: DataFrame, items: DataFrame, least_tokens: int = 5, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, equal_tokens, window): one row per document and item that share an overlap.

    ``equal_tokens`` of ``window`` tokens agree in the best window.  Null or empty texts and items of fewer than
    ``least_tokens`` tokens have no overlaps; repeated rows of an id give one row; an empty table on either side
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = items.schema[item_col].dataType.simpleString()

    def split(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        yield {"item_id": ids, "tokens": [tokens(t) for t in texts.to_pylist()]}

    bench = _cut(map_rows(items.select(item_col, item_text).dropDuplicates(), split,
                          f"item_id {item_kind}, tokens array<string>")
                 .where(F.size("tokens") >= least_tokens).withColumn("n", F.size("tokens")))
    short = [r[0] for r in bench.where(F.col("n") < WINDOW).select("n").distinct().collect()]   # at most WINDOW values
    masks = seed_masks(short)

    def item_seeds(ids: pa.Array, lists: pa.Array) -> Iterator[dict[str, list]]:
        held = _Held()
        out: dict[str, list] = {"item_id": [], "h": [], "at": []}
        for i, own in zip(ids.to_pylist(), lists.to_pylist(), strict=True):
            hashes = np.fromiter((held[w] for w in own), np.uint64, len(own))
            for k, mask in enumerate(masks):
                if len(own) >= WINDOW if k < len(MASKS) else len(own) == len(mask):
                    h = masked(hashes, mask, k).view(np.int64).tolist()
                    out["item_id"] += [i] * len(h)
                    out["h"] += h
                    out["at"] += range(len(h))
        yield out

    seeds = _cut(map_rows(bench.select("item_id", "tokens"), item_seeds, f"item_id {item_kind}, h long, at int").distinct())
    low = (1 << _BITS) - 1
    spot = F.explode(F.array(F.col("h").bitwiseAND(F.lit(low)), F.shiftright("h", 32).bitwiseAND(F.lit(low)))).alias("p")
    # at most 2 ** (_BITS - 6) rows of one 64-bit word
    filled = (seeds.select(spot).groupBy(F.shiftright("p", 6).alias("w"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow())
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    bitmap[filled["w"].to_numpy()] = filled["bits"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def possible(h: np.ndarray) -> np.ndarray:
        bits = shared.value
        one, two = _positions(h)
        hit = np.flatnonzero((bits[one >> np.uint64(6)] >> (one & np.uint64(63))) & np.uint64(1))
        return hit[((bits[two[hit] >> np.uint64(6)] >> (two[hit] & np.uint64(63))) & np.uint64(1)).astype(bool)]

    def scan(rids: pa.Array, ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        held = _Held()
        out: dict[str, list] = {k: [] for k in ("rid", "doc_id", "start", "tokens", "seeds")}
        for rid, doc, text in zip(rids.to_pylist(), ids.to_pylist(), texts, strict=True):
            own = tokens(text.as_py())
            hashes = np.fromiter((held[w] for w in own), np.uint64, len(own))
            hits = []
            for k, mask in enumerate(masks):
                h = masked(hashes, mask, k)
                at = possible(h)
                hits += zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)
            hits.sort()
            s = 0
            while s < len(hits):
                e = s + 1
                while e < len(hits) and hits[e][0] - hits[e - 1][0] <= 2 * WINDOW:
                    e += 1
                lo = max(0, hits[s][0] - WINDOW)
                hi = min(len(own), hits[e - 1][0] + 2 * WINDOW)
                out["rid"].append(rid)
                out["doc_id"].append(doc)
                out["start"].append(lo)
                out["tokens"].append(own[lo:hi])
                out["seeds"].append([{"h": h, "at": a - lo} for a, h in hits[s:e]])
                s = e
        yield out

    regions = _cut(map_rows(docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col), F.col(text_col)),
                            scan, f"rid long, doc_id {kind}, start int, tokens array<string>, "
                                  "seeds array<struct<h:long,at:int>>"))
    found = (regions.select("rid", "start", F.explode("seeds").alias("s"))
             .select("rid", "start", F.col("s.h").alias("h"), F.col("s.at").alias("on"))
             .join(seeds, "h").select("rid", "start", "item_id", (F.col("on") - F.col("at")).alias("shift")).distinct())
    both = (found.join(regions.select("rid", "doc_id", "start", "tokens"), ["rid", "start"])
            .join(bench.select("item_id", F.col("tokens").alias("item_tokens")), "item_id"))

    def check(ids: pa.Array, its: pa.Array, shifts: pa.Array, own: pa.Array, item: pa.Array) -> Iterator[dict[str, list]]:
        best = [verify(i, r, s) for s, r, i in zip(shifts.to_pylist(), own.to_pylist(), item.to_pylist(), strict=True)]
        yield {"doc_id": ids, "item_id": its, "equal_tokens": best,
               "window": [min(WINDOW, len(i)) for i in item.to_pylist()]}

    checked = map_rows(both.select("doc_id", "item_id", "shift", "tokens", "item_tokens"), check,
                       f"doc_id {kind}, item_id {item_kind}, equal_tokens long, window long")
    return (checked.where("equal_tokens > 0").groupBy("doc_id", "item_id")
            .agg(F.max("equal_tokens").alias("equal_tokens"), F.max("window").alias("window")))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **options) -> DataFrame:
    """The rows of ``docs`` without any overlap, with all their columns; rows with a null id have none to lose."""
    bad = contaminated_pairs(docs.where(F.col(id_col).isNotNull()), items, id_col=id_col, text_col=text_col, **options) \
        .select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["__bad"], "left_anti")
