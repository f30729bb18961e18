"""Substring deduplication: words covered by a window of ``window`` words that starts more than once anywhere.

A shard is a set of segments that must be compared with each other.  Every window belongs to the smallest hash
of its inner word runs (its minimiser), so equal windows always meet; consecutive windows with one minimiser
form a segment.  Only segments whose minimiser occurs at least twice in the corpus leave their document, and
equal segments are counted together.

Per shard a compressed FM-index is built over the distinct segments: suffix array, Burrows-Wheeler transform, a
wavelet matrix with the counts of ones before every place.  The segments are then streamed against it:
backward search, one word to the left at a time for all segments in step, yields their matching statistics as
maximal intervals that occur at least twice (copies weigh as often as they occur); intervals of at least a
window go back to the documents.

A segment carries words of its document's own context on either side of the words that its minimiser stands for,
so a passage that many documents share would bring one distinct segment per document under one route.  Windows
whose minimiser occurs more than ``hot`` times are therefore segments of their own, routed by their whole hash:
those that occur once stay in their document, equal ones are counted in the tasks before the shuffle, and the
count alone says that they repeat.  So an index holds at most ``hot`` segments of one route.

All exchanges are keyed by minimiser, segment, window or document; the driver gets three bitmaps of fixed size (hot
minimisers, documents that hold one, and windows among theirs that occur twice), which may let too much through,
never too little.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import bitmap_of, gram_hashes, map_rows, maybe, mix, stored, words

GRAM = 8
_SINGLE = np.uint64(0x5851F42D4C957F2D)
_PART = 1 << 14           # words searched at once


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    reach, best = 1, x
    while reach * 2 <= width:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(best[:len(best) - rest], best[rest:]) if rest else best


@dataclass
class Segments:
    """Consecutive windows of a text with one route; places are words counted over all the texts."""
    text: np.ndarray         # number of the text
    start: np.ndarray        # first and last window (exclusive)
    end: np.ndarray
    least: np.ndarray        # minimiser
    route: np.ndarray
    single: np.ndarray
    grams: np.ndarray        # hashes of the word runs from every place on


def runs(hashes: np.ndarray, sizes: np.ndarray, window: int, hot: np.ndarray | None = None) -> Segments:
    """Segments of texts that stand one after the other, with ``sizes`` words each.

    The route is the minimiser; a window with a minimiser in the bitmap ``hot`` is a single, routed by its own hash.
    """
    gram = min(GRAM, window)
    n = np.maximum(sizes - window + 1, 0)                  # windows of each text
    g = gram_hashes(hashes, gram)
    if not n.any():
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool), g)
    text = np.repeat(np.arange(len(sizes)), n)
    at = np.arange(len(text)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n)
    least = sliding_min(g, window - gram + 1)[at]
    route, busy = least, np.zeros(len(least), bool)
    if hot is not None:
        busy = maybe(hot, least)
        if busy.any():
            route = np.where(busy, mix(gram_hashes(hashes, window)[at] ^ _SINGLE), least)
    cut = np.flatnonzero((route[1:] != route[:-1]) | busy[1:] | busy[:-1] | (text[1:] != text[:-1])) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut, [len(route)]]) - 1
    return Segments(text[first], at[first], at[last] + 1, least[first], route[first], busy[first], g)


def _weights(found: Segments, window: int) -> np.ndarray:
    """1 per segment, or 2 if its minimiser stands in it more than once (then it may repeat a window itself)."""
    out = np.ones(len(found.start), np.int64)
    for i in range(0, len(out), _PART):                    # bounds the places held at once
        start, least = found.start[i:i + _PART], found.least[i:i + _PART]
        n = found.end[i:i + _PART] - start + window - min(GRAM, window)
        first = np.cumsum(n) - n
        at = np.arange(n.sum()) + np.repeat(start - first, n)
        same = found.grams[at] == np.repeat(least, n)
        out[i:i + _PART][np.add.reduceat(same, first, dtype=np.int64) > 1] = 2
    return out


def _parts(texts: pa.Array, rows=None) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """(rows, their words): the texts in parts of a bounded number of words, or one longer text."""
    some, lists, size = [], [], 0
    for row in range(len(texts)) if rows is None else rows:
        own = words(texts[row].as_py())
        if some and size + len(own) > _PART:
            yield some, lists
            some, lists, size = [], [], 0
        some.append(row)
        lists.append(own)
        size += len(own)
    if some:
        yield some, lists


class WaveletMatrix:
    """Rank of symbols in a sequence: per binary digit, the number of ones before every place."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.levels = []
        seq = seq.astype(np.int32)
        for b in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(seq) - int(ones[-1])))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.start = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, before, zeros in self.levels:
            ones = before.take(at)
            at = np.where((c & (1 << b)) != 0, ones + zeros, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``c`` before ``at``, elementwise; ``at`` may have several rows."""
        return self._walk(c, at) - self.start[c]


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their symbols up to the first 0, ``depth`` at most: prefix doubling from packed leading symbols.

    A suffix is sorted again only while others share all its leading symbols and none of these is 0.
    """
    n = len(text)
    bits = max(1, int(text.max()).bit_length())
    reach = max(1, min(62 // bits, depth))
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(reach):
        key <<= bits
        key[:n - i] |= text[i:]
        open_[:n - i] &= text[i:] > 0
        open_[n - i:] = False
    order = np.argsort(key)
    rank, slots, group = np.empty(n, np.int64), np.arange(n), key[order]
    while True:
        # slots of one group are neighbours; the rank of a group is its first slot
        new = np.concatenate([[True], (group[1:] != group[:-1])])
        rank[order[slots]] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        again = ~(new & np.append(new[1:], True)) & open_[order[slots]]
        slots = slots[again]
        if reach >= depth or not len(slots):
            return order
        left = order[slots]
        key = rank[left] * (n + 1) + rank[left + reach]
        by = np.argsort(key)
        order[slots], group = left[by], key[by]
        open_[left] = open_[left + reach]
        reach *= 2


class FMIndex:
    """Index of segments (arrays of symbols from 1 on) that occur ``copies`` times each; 0 ends a segment."""

    def __init__(self, segments: list[np.ndarray], copies: np.ndarray, symbols: int):
        zero = np.zeros(1, np.int64)
        self.text = np.concatenate([p for s in segments for p in (s, zero)])
        sizes = np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))
        self.base = np.cumsum(sizes) - sizes
        order = suffix_array(self.text, int(sizes.max()))
        self.bwt = WaveletMatrix(self.text[order - 1], symbols)
        counts = np.bincount(self.text, minlength=symbols)
        self.first = np.cumsum(counts) - counts
        self.weight = np.concatenate([[0], np.cumsum(np.repeat(copies, sizes)[order])])
        self.sizes, self.copies = sizes - 1, copies

    def extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range of the pattern with ``c`` put before it."""
        lo, hi = self.first[c] + self.bwt.rank(c, np.stack([lo, hi]))
        return lo, hi

    def repeated(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, start, end): intervals of ``least`` words or more that occur at least twice, maximal to the left.

        Every repeated window of ``least`` words lies in one of them.
        """
        n = len(self.text)
        long = self.sizes >= least
        twice = np.flatnonzero(long & (self.copies > 1))        # these occur twice as a whole
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(twice, np.zeros(len(twice), np.int64), self.sizes[twice])]
        lane = np.flatnonzero(long & (self.copies == 1))
        end = self.sizes[lane].copy()
        at, lo, hi = end.copy(), np.zeros(len(lane), np.int64), np.full(len(lane), n)
        while len(lane):
            new_lo, new_hi = self.extend(self.text[self.base[lane] + at - 1], lo, hi)
            ok = self.weight[new_hi] - self.weight[new_lo] >= 2
            at = at - ok
            lo, hi = np.where(ok, new_lo, lo), np.where(ok, new_hi, hi)
            stop = ~ok | (at == 0)
            if stop.any():
                good = stop & (end - at >= least)
                if good.any():
                    out.append((lane[good], at[good], end[good]))
                # windows that reach from before ``at`` to ``end`` or beyond occur once only
                fresh = np.where(stop, np.minimum(end - 1, at + least - 1), end)
                fresh = np.where(stop & (at == 0), 0, fresh)
                end = fresh
                at, lo, hi = np.where(stop, end, at), np.where(stop, 0, lo), np.where(stop, n, hi)
                left = end >= least
                lane, end, at, lo, hi = lane[left], end[left], at[left], lo[left], hi[left]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _names(routes: list[int], segments: list[bytes]) -> np.ndarray:
    """128-bit hash of each segment and its route, as two columns."""
    both = b"".join(xxhash.xxh3_128_digest(s, r & 0xFFFFFFFFFFFFFFFF) for r, s in zip(routes, segments, strict=True))
    return np.frombuffer(both, np.int64).reshape(-1, 2)


def _shards(window: int, most_words: int):
    """(s1, s2, lo, hi): repeated intervals of distinct segments, which come in order of their routes.

    A single that comes here occurs twice: it is its own interval and stays out of the index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        alone: list[tuple] = []
        n_words, last = 0, None

        def rows(names: np.ndarray, lo, hi) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
                names=["s1", "s2", "lo", "hi"])

        def search() -> pa.RecordBatch:
            symbol: dict[bytes, int] = defaultdict(count(1).__next__)
            segments = [np.fromiter(map(symbol.__getitem__, text.split(b" ")), np.int64) for _, text, _ in held]
            index = FMIndex(segments, np.array([h[2] for h in held], np.int64), len(symbol) + 1)
            lane, start, end = index.repeated(window)
            hit = [held[i] for i in lane.tolist()]
            return rows(_names([h[0] for h in hit], [h[1] for h in hit]), start, end)

        for batch in batches:
            for route, text, copies, single in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if single:
                    alone.append((route, text.encode()))
                    continue
                if route != last and n_words >= most_words:       # a route is never divided
                    yield search()
                    held, n_words = [], 0
                last = route
                held.append((route, text.encode(), copies))
                n_words += text.count(" ") + 1
            if alone:
                yield rows(_names(*map(list, zip(*alone, strict=True))), np.zeros(len(alone)), np.full(len(alone), window))
                alone = []
        if held:
            yield search()

    return run


def repeated_spans(docs: DataFrame, window: int = 35, hot: int = 2_000, most_words: int = 400_000) -> DataFrame:
    """(k1, k2, spans): per document (keyed by its id and text) the word intervals covered by repeated windows.

    ``docs`` has k1, k2, doc_id and text, as ``_keyed`` makes them.
    """
    def segmented(lists: list[list[bytes]], hot: np.ndarray | None = None) -> tuple[Segments, np.ndarray]:
        """Segments of some texts, and the place of the first word of each text."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lists)), np.uint64, sizes.sum())
        return runs(hashes, sizes, window, hot), np.cumsum(sizes) - sizes

    def minimisers(k1: pa.Array, k2: pa.Array, ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        a, b = k1.to_numpy(), k2.to_numpy()
        for rows, lists in _parts(texts):
            found, _ = segmented(lists)
            row = np.array(rows)[found.text]
            yield {"k1": a[row], "k2": b[row], "h": found.least.view(np.int64), "weight": _weights(found, window)}

    small = stored(map_rows(docs, minimisers, "k1 long, k2 long, h long, weight long"), "minimisers")
    twice = stored(small.groupBy("h").agg(F.sum("weight").alias("n")).where("n >= 2"), "repeated-minimisers")
    hits = (small.select("k1", "k2", "h").join(twice.select("h"), "h").groupBy("k1", "k2")
            .agg(F.collect_set("h").alias("hits")))      # per document: no longer than its text
    sc = docs.sparkSession.sparkContext
    frequent = twice.where(F.col("n") > hot)
    busy = again = None
    if not frequent.isEmpty():
        busy = sc.broadcast(bitmap_of(frequent, "h"))

        def holding(k1: pa.Array, h: pa.Array) -> Iterator[dict[str, list]]:
            yield {"k1": k1.to_numpy()[maybe(busy.value, h.to_numpy())]}

        holders = sc.broadcast(bitmap_of(map_rows(small.select("k1", "h"), holding, "k1 long", rows=100_000), "k1"))

        def singles(k1: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
            parts = [np.zeros(0, np.uint64)]
            for _, lists in _parts(texts, np.flatnonzero(maybe(holders.value, k1.to_numpy())).tolist()):
                found, _ = segmented(lists, busy.value)
                parts.append(found.route[found.single])
            key, n = np.unique(np.concatenate(parts), return_counts=True)
            yield {"route": key.view(np.int64), "n": n}

        counted = map_rows(docs.select("k1", "text"), singles, "route long, n long", rows=10_000)
        again = sc.broadcast(bitmap_of(counted.groupBy("route").agg(F.sum("n").alias("n")).where("n >= 2"), "route"))

    def segments(texts: pa.Array, wanted: pa.Array):
        """Segments to compare, part by part: row, start in its text, route, whether single, words."""
        for rows, lists in _parts(texts):
            found, first = segmented(lists, busy and busy.value)
            # what one text of the part wants is wanted wherever it stands
            some = wanted.take(pa.array(rows)).flatten().to_numpy().view(np.uint64)
            keep = np.isin(found.least, some)
            if found.single.any():
                keep &= ~found.single | maybe(again.value, found.route)
            text, start = found.text[keep], found.start[keep]
            size = found.end[keep] - start + window - 1
            start = start - first[text]
            yield (np.array(rows)[text], start, found.route[keep].view(np.int64), found.single[keep],
                   [b" ".join(lists[i][s:s + n]) for i, s, n in zip(text.tolist(), start.tolist(), size.tolist(), strict=True)])

    def contents(k1: pa.Array, k2: pa.Array, ids: pa.Array, texts: pa.Array, wanted: pa.Array) -> Iterator[dict[str, list]]:
        for _, _, route, single, parts in segments(texts, wanted):
            yield {"route": route, "single": single, "words": [p.decode("utf-8", "surrogatepass") for p in parts]}

    def places(k1: pa.Array, k2: pa.Array, ids: pa.Array, texts: pa.Array, wanted: pa.Array) -> Iterator[dict[str, list]]:
        a, b = k1.to_numpy(), k2.to_numpy()
        for row, start, route, _, parts in segments(texts, wanted):
            names = _names(route.tolist(), parts)
            yield {"k1": a[row], "k2": b[row], "start": start, "s1": names[:, 0], "s2": names[:, 1]}

    # doc_id goes along so that this exchange of the texts is the one that the last join reads
    marked = docs.join(hits, ["k1", "k2"]).select("k1", "k2", "doc_id", "text", "hits")
    found = map_rows(marked, contents, "route long, single boolean, words string", rows=500)
    intervals = (found.groupBy("route", "words", "single").agg(F.count(F.lit(1)).alias("copies"))
                 .where("copies > 1 or not single").select("route", "words", "copies", "single")
                 .repartition("route").sortWithinPartitions("route")
                 .mapInArrow(_shards(window, most_words), "s1 long, s2 long, lo int, hi int"))
    placed = map_rows(marked, places, "k1 long, k2 long, start int, s1 long, s2 long", rows=500)
    return (placed.join(intervals, ["s1", "s2"])
            .groupBy("k1", "k2").agg(F.collect_list(F.struct((F.col("start") + F.col("lo")).alias("lo"),
                                                             (F.col("start") + F.col("hi")).alias("hi"))).alias("spans")))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (a 128-bit key of id and text, the same for repeated rows), doc_id, text."""
    i, t = F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.xxhash64(i, t).alias("k1"), F.xxhash64(F.lit(1), t, i).alias("k2"), i.alias("doc_id"),
                       t.alias("text"))


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text",
                   **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: one row per input row.

    Words are maximal runs without ASCII white space, unchanged; the kept words are joined by one space.  A null
    or empty text has no words; texts shorter than a window keep all; a repeated row repeats all windows of its
    text.  An empty table gives an empty result; other columns are ignored.
    """
    keyed = _keyed(docs, id_col, text_col)
    spans = repeated_spans(keyed, window, **options)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def clean(k1: pa.Array, k2: pa.Array, ids: pa.Array, texts: pa.Array, found: pa.Array) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_text": []}
        for t, own_spans in zip(texts, found.to_pylist(), strict=True):
            own = words(t.as_py())
            gone = 0
            if own_spans:
                step = np.zeros(len(own) + 1, np.int64)
                for s in own_spans:
                    step[s["lo"]] += 1
                    step[s["hi"]] -= 1
                covered = np.cumsum(step[:-1]) > 0
                gone = int(covered.sum())
                kept = [own[i] for i in np.flatnonzero(~covered).tolist()]
            else:
                kept = own
            out["n_words"].append(len(own))
            out["n_removed"].append(gone)
            out["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        yield {"doc_id": ids, **out}

    joined = keyed.join(spans, ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "spans")
    return map_rows(joined, clean, f"doc_id {kind}, n_words long, n_removed long, kept_text string", rows=500)


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

