"""Periodic runs of words, by enumerating maximal pairs on the LCP-interval tree.

A run is a stretch of words with smallest period q that is at least ``exponent`` periods (and ``least`` words) long
and that no neighbouring word extends.  Its first ``length - q`` words occur again q words later: a pair of equal
stretches at distance q that can't be extended to either side.  Such maximal pairs are found bottom-up on the tree of
LCP intervals of the suffix array.  Every interval holds its positions in text order with their class, the word to
the left; smaller intervals are merged into the largest child.  A position that comes in makes a pair with its
neighbour of another class, if the distance is at most length / (exponent - 1).  The partner of a run is always a
direct neighbour: a nearer occurrence would give the stretch a smaller period.  With the distance limits the pairs
are exactly the runs (and multiples of their periods, of which the smallest counts); nothing has to be extended.

Before that, stretches that can't hold a run are passed over: a run of period q has at least ``exponent * q`` words,
and all its word triples after the first q occur already at most q words before.  For each power of two T, maximal
stretches of triples that recur within T words are taken if they are long enough for some q in (T/2, T].  This is a
necessary condition, so nothing is lost, and it costs a sort of the hashes of a batch.

Rows are independent: there is no shuffle, and a document is worked on whole, in memory in proportion to its length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import WordHash, gram_hashes, map_rows, mix, word_hashes, words

_BLOCK = 1000


class Positions:
    """Sorted positions in blocks of bounded size, so that long lists take new members in little time."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int):
        self.blocks, self.size = [[first]], 1

    def add(self, x: int) -> tuple[int, int]:
        """Insert and return the neighbours before and after (-1 where there is none)."""
        blocks = self.blocks
        k = 0
        if len(blocks) > 1:
            lo, hi = 0, len(blocks) - 1
            while lo < hi:
                mid = (lo + hi) // 2
                if blocks[mid][-1] < x:
                    lo = mid + 1
                else:
                    hi = mid
            k = lo
        block = blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else blocks[k - 1][-1] if k else -1
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        insort(block, x)
        self.size += 1
        if len(block) > 2 * _BLOCK:
            blocks[k:k + 1] = [block[:_BLOCK], block[_BLOCK:]]
        return before, after

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block


def suffix_array(codes: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling prefixes until all ranks differ."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        key = rank * (n + 1)
        key[:n - h] += rank[h:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        rank = new
        h *= 2
        if rank[order[-1]] == n - 1 or h >= n:
            return order


def lcp_array(codes: list[int], order: list[int]) -> list[int]:
    """Common prefix of each suffix in ``order`` with the one before it (first 0)."""
    n = len(codes)
    prior = [-1] * n
    for a, b in zip(order, order[1:], strict=False):
        prior[b] = a
    out = [0] * n
    common = 0
    for i in range(n):
        j = prior[i]
        if j < 0:
            common = 0
            continue
        most = n - max(i, j)
        while common < most and codes[i + common] == codes[j + common]:
            common += 1
        out[i] = common
        if common:
            common -= 1
    return [out[i] for i in order]


def maximal_pairs(codes: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of a code sequence that is looked at as a whole text."""
    n = len(codes)
    if n < 2:
        return []
    order = suffix_array(codes).tolist()
    seq = codes.tolist()
    lcp = lcp_array(seq, order)
    floor = _fewest(least, exponent, 1, least)
    found: dict[tuple[int, int], int] = {}

    def pair(i: int, j: int, depth: int) -> None:
        q = j - i
        if q * (exponent - 1) > depth or q + depth < least:
            return
        if i and seq[i - 1] == seq[j - 1] or j + depth < n and seq[i + depth] == seq[j + depth]:
            return      # the same class on the left, or the same child of the interval
        key = (i, q + depth)
        if q < found.get(key, n):
            found[key] = q

    def merge(into: Positions, other: Positions, depth: int) -> Positions:
        if into.size < other.size:
            into, other = other, into
        for x in other:
            before, after = into.add(x)
            if before >= 0:
                pair(before, x, depth)
            if after >= 0:
                pair(x, after, depth)
        return into

    stack: list[tuple[int, Positions]] = []     # open intervals: depth, positions of the children so far
    for k in range(1, n + 1):
        depth = lcp[k] if k < n else 0
        node = Positions(order[k - 1])
        # close deeper intervals; children that meet at one depth are joined there
        while stack and stack[-1][0] > depth:
            at, held = stack.pop()
            node = merge(held, node, at)
        if depth < floor:
            stack.clear()
        elif stack and stack[-1][0] == depth:
            stack[-1] = (depth, merge(stack[-1][1], node, depth))
        else:
            stack.append((depth, node))
    return sorted((s, length, q) for (s, length), q in found.items())


def _fewest(least: int, exponent: int, lo: int, hi: int) -> int:
    """Least length of the repeated part of a run with a period from ``lo`` to ``hi``."""
    return min(max(least - q, (exponent - 1) * q) for q in range(lo, max(lo, min(hi, least)) + 1))


def _spans(gap: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> list[tuple[int, int]]:
    """Stretches that may hold a run, with a word on either side, as intervals of the concatenated texts.

    ``gap`` is the distance of the word triple at each position to its last occurrence in the same text (large where
    there is none); ``starts`` and ``ends`` are the bounds of each position's text.
    """
    out = []
    most = int(gap.max(initial=0, where=gap < len(gap)))
    t = 1
    while t < 2 * most:
        need = _fewest(least, exponent, t // 2 + 1, t) - 2
        near = np.concatenate(([False], gap <= t, [False]))
        turns = np.flatnonzero(near[1:] != near[:-1])
        a, b = turns[::2], turns[1::2]
        keep = b - a >= need
        a, b = a[keep], b[keep]
        out += zip(np.maximum(a - t - 1, starts[a]).tolist(), np.minimum(b + 3, ends[a]).tolist(), strict=True)
        t *= 2
    return sorted(out)


def runs_of_batch(texts: list[list[bytes]], held: WordHash, least: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, a list of words."""
    hashes = [word_hashes(held, text) for text in texts]
    if exponent < 3:
        raise ValueError("neighbouring occurrences give all runs only from three periods on")
    if _fewest(least, exponent, 1, least) < 3:      # shorter than a word triple can show
        return [maximal_pairs(h, least, exponent) for h in hashes]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.concatenate(([0], np.cumsum([len(h) for h in hashes], dtype=np.int64)))
    grams = [mix(gram_hashes(h, 3) + np.uint64(k + 1)) for k, h in enumerate(hashes)]       # apart by text
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
    if not len(flat):
        return out
    place = np.concatenate([np.arange(len(g)) + b for g, b in zip(grams, bounds[:-1], strict=True)])
    order = np.argsort(flat, kind="stable")
    far = np.iinfo(np.int64).max
    by = place[order]
    step = np.full(len(flat), far)
    step[1:] = np.where(flat[order][1:] == flat[order][:-1], by[1:] - by[:-1], far)
    gap = np.full(bounds[-1], far)
    gap[by] = step
    sizes = np.diff(bounds)
    spans = _spans(gap, np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes), least, exponent)
    at = 0
    while at < len(spans):
        lo, hi = spans[at]
        k = int(np.searchsorted(bounds, lo, "right")) - 1
        at += 1
        while at < len(spans) and spans[at][0] <= hi and spans[at][0] < bounds[k + 1]:
            hi = max(hi, spans[at][1])
            at += 1
        shift = int(lo - bounds[k])
        out[k] += [(s + shift, length, q) for s, length, q in maximal_pairs(hashes[k][shift:shift + hi - lo], least, exponent)]
    return out


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and ``collapsed``: one row per input row.

    Words are runs without ASCII white space, numbered from 0 and compared as they are.  ``collapsed`` joins by one
    space the words that no run contains after its first period.  A null or empty text has no words, no runs and an
    empty ``collapsed``.  Repeated rows are treated alike, a null id is kept, an empty table gives an empty result;
    other columns are ignored, whatever their names.  Texts are taken whole, at any length.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    state: dict = {}

    def find(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        held = state.setdefault("held", WordHash())
        split = [words(t.as_py()) for t in texts]
        found = runs_of_batch(split, held, least, exponent)
        kept = []
        for text, runs in zip(split, found, strict=True):
            if runs:
                cover = np.zeros(len(text) + 1, np.int64)
                for s, length, q in runs:
                    cover[s + q] += 1
                    cover[s + length] -= 1
                text = [text[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]
            kept.append(b" ".join(text).decode("utf-8", "surrogatepass"))
        yield {"doc_id": ids, "n_words": [len(t) for t in split], "collapsed": kept,
               "runs": [[{"start": s, "length": length, "period": q} for s, length, q in runs] for runs in found]}

    return map_rows(docs.select(id_col, text_col), find,
                    f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string",
                    rows=250)


def planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (id and text) with the tails of a tenth of the texts replaced by repeats of a stretch.

    With h the CRC-32 of the id as text and g = h div 10: where h ends in 0 and the text has n > 0 words, each word
    i >= a becomes word a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))
    staged = docs.select(F.col(id_col), F.col(text_col), h.alias("__h")).withColumn(
        "__w", F.when(F.col("__h") % 10 == 0, F.regexp_extract_all(text_col, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    staged = staged.withColumn("__g", F.floor(F.col("__h") / 10)).withColumn("__n", F.size("__w"))
    staged = staged.withColumn("__a", F.when(F.col("__n") > 0, F.col("__g") % F.col("__n")).cast("int"))
    staged = staged.withColumn("__p", (F.lit(1) + F.floor((F.col("__n") - F.col("__a")) / (F.lit(3) + F.col("__g") % 8))).cast("int"))
    tail = F.col("__n") - F.col("__a")
    again = F.flatten(F.array_repeat(F.slice("__w", F.col("__a") + 1, F.col("__p")), F.ceil(tail / F.col("__p")).cast("int")))
    changed = F.array_join(F.concat(F.slice("__w", F.lit(1), F.col("__a")), F.slice(again, F.lit(1), tail)), " ")
    return staged.select(id_col, F.when(F.col("__n") > 0, changed).otherwise(F.col(text_col)).alias(text_col))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (ties: smallest start, then period) and digests of the runs and the kept words."""
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("longest"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return (found.withColumn("__best", best)
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("__best.start").alias("start"),
                    (-F.col("__best.longest")).alias("length"), F.col("__best.period").alias("period"),
                    F.floor(F.lit(-1000) * F.col("__best.longest") / F.col("__best.period")).cast("long").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
