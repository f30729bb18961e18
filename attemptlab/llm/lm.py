"""Language-model scores by a probabilistic suffix tree, next to a word unigram score.

Symbols are tokens: the lower-cased words of a text and one end.  The root of the tree is the unigram
distribution (unseen words are one symbol).  A context of one or two preceding words becomes a state when symbols
follow it ``least_count`` times or more and its next-token distribution diverges from that of the context without
its oldest word (log-likelihood gain against a penalty per stored symbol); the shorter suffix of a state is a state
too.  Distributions are smoothed by absolute discounting: what is taken from the stored symbols goes to all others
in proportion to the shorter state.  Each token is scored by the longest state that is a suffix of its history.

All counts are taken over all training documents, no context or symbol is left out for its rank, and the tables
stay distributed: words, (word, word) and (two words, word), combined in the tasks before one aggregation each.
Bitmaps of fixed size say which words, pairs and states can matter; they may let too much through, never too
little.

The log probability of a text is a sum of one number per word, pair and triple of words in it: a state adds its
back-off weight to the token after it, and a stored symbol adds what it has over the sum of the shorter ones and its
state's weight.  At most ``common_words`` frequent words and the head of the tree (its most frequent rows, at most
``most_contexts`` states and ``most_entries`` stored symbols) are broadcast; every other word, pair or triple that a
text asks for is joined with its number by hash, in one join for all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import BLANKS, bitmap, bitmap_of, held_fold, maybe, mix, stored

_END = np.int64(-0x61C8864680B583EB)      # hash of the end token and, as a context, of the start of a text
_CHUNK = 1_000_000
DISCOUNT = 0.75
_LEAST_WORD, _LEAST_HEAD = 4, 8      # rarer words, or pairs and triples, are joined at any size of the corpus
_WORD, _DOC, _PAIR, _TRIPLE = range(4)      # what a row of the scoring join is about


class WordHash:
    """64-bit hashes of all words of some bytes at once, A-Z as a-z: polynomials in numbers of the bytes."""

    def __init__(self):
        self.number = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.number[ord("A"):ord("Z") + 1] = self.number[ord("a"):ord("z") + 1]
        self.blank = np.isin(np.arange(256), [ord(c) for c in BLANKS])
        self.number[self.blank] = 0
        step = np.uint64(0x9E3779B97F4A7C15)
        self.low = np.cumprod(np.append(np.uint64(1), np.full(0xFFFF, step)), dtype=np.uint64)
        self.high = np.cumprod(np.append(np.uint64(1), np.repeat(self.low[-1:] * step, 0xFFFF)), dtype=np.uint64)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first byte of each word."""
        raw = np.frombuffer(data, np.uint8)
        gap = self.blank[raw]
        first = ~gap
        first[1:] &= gap[:-1]
        start = np.flatnonzero(first)
        if not len(start):
            return np.zeros(0, np.int64), start
        raw, at = raw[start[0]:], start - start[0]
        place = np.arange(len(raw)) - np.repeat(at, np.diff(np.append(at, len(raw))))
        value = self.number[raw] * self.low[place & 0xFFFF]
        if len(raw) > 0xFFFF and place.max() > 0xFFFF:
            value *= self.high[place >> 16 & 0xFFFF]
        return mix(np.add.reduceat(value, at)).view(np.int64), start


def word_hashes(held: WordHash, items: list[bytes]) -> np.ndarray:
    return held.of(b" ".join(items))[0]


def tokens(held: WordHash, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and of its end, text after text, and the number of each text."""
    data = [(text or "").encode("utf-8", "surrogatepass") for text in texts]
    h, start = held.of(b"\n".join(data))
    upto = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
    n = np.diff(np.append(0, np.searchsorted(start, upto))) + 1
    out, inner = np.full(len(h) + len(data), _END), np.ones(len(h) + len(data), bool)
    inner[np.cumsum(n) - 1] = False
    out[inner] = h
    return out, n


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch in runs of bounded size, with the row of the first."""
    first, run, size = 0, [], 0
    for row, text in enumerate(column):
        run.append(text.as_py())
        size += len(run[-1] or "")
        if size >= _CHUNK:
            yield first, run
            first, run, size = row + 1, [], 0
    if run:
        yield first, run


def contexts(hashes: np.ndarray, depth: int) -> np.ndarray:
    """For each token the hash of the ``depth`` tokens before it; the start of the text stands before the first."""
    before = np.concatenate([np.full(depth, _END), hashes[:-1]]).view(np.uint64)
    key = before[depth - 1:].copy()
    for k in range(1, depth):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + before[depth - 1 - k:len(before) - k])
    return key.view(np.int64)


def pair_context(older: np.ndarray, newer: np.ndarray) -> np.ndarray:
    """Hash of a context of two words, as ``contexts`` makes it."""
    with np.errstate(over="ignore"):
        return mix(newer.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + older.view(np.uint64)).view(np.int64)


def find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted keys, -1 if it is not there."""
    if not len(keys):
        return np.full(len(values), -1)
    order = np.argsort(values)                 # neighbours are then searched in the same stretch of keys
    sought = values[order]
    spot = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
    at = np.empty(len(values), np.int64)
    at[order] = np.where(keys[spot] == sought, spot, -1)
    return at


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, parts, size = WordHash(), [], 0

    def rows() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    for batch in batches:
        for _, texts in _parts(batch.column(0)):
            parts.append(tokens(held, texts)[0])
            size += len(parts[-1])
            if size >= 4 * _CHUNK:
                yield rows()
                parts, size = [], 0
    if size:
        yield rows()


@dataclass
class Level:
    """Words, pairs or triples of the head by hash: what each adds to the score of its last token as a stored symbol,
    and what it adds to the token after it as a state (log10)."""
    keys: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray

    @classmethod
    def of(cls, symbols: pa.Table | None, states: pa.Table | None) -> Level:
        """From tables of (key, number); a key may be in both."""
        sides = [(np.zeros(0, np.int64), np.zeros(0)) if t is None else (t[0].to_numpy(), t[1].to_numpy()) for t in (symbols, states)]
        keys = np.unique(np.concatenate([k for k, _ in sides]))
        out = cls(keys, np.zeros(len(keys)), np.zeros(len(keys)))
        for (k, v), to in zip(sides, (out.symbol, out.weight), strict=True):
            to[np.searchsorted(keys, k)] = v
        return out


@dataclass
class Tree:
    """The head of the tree.  ``can`` are bitmaps of all its pairs and triples, ``tail`` of those outside the head."""
    words: Level                   # states of one word, the start of a text among them
    levels: list[Level]            # pairs (symbols after one word, states of two words), triples (symbols after two)
    can: list[np.ndarray]
    tail: list[np.ndarray]

    def search(self, hashes: np.ndarray):
        """log10 lift of each token over the root by the head, and the keys and places of pairs and of triples that may
        be outside the head.

        Texts may stand one after the other: their ends are the starts of the next.
        """
        before = np.append(_END, hashes[:-1])
        pair = pair_context(before, hashes)
        out = np.zeros(len(hashes))
        place = find(self.words.keys, before)
        at = np.flatnonzero(place >= 0)
        out[at] += self.words.weight[place[at]]
        pairs, triples = self.levels
        at = np.flatnonzero(maybe(self.can[0], pair))
        place = find(pairs.keys, pair[at])
        hit, place = at[place >= 0], place[place >= 0]
        out[hit] += pairs.symbol[place]
        after = hit + 1
        inner = after < len(out)                   # no pair with an end is a state
        out[after[inner]] += pairs.weight[place[inner]]
        known = np.zeros(len(hashes), bool)
        known[hit] = True
        ask = ~known[at] & maybe(self.tail[0], pair[at])
        asked = at[ask]
        known[asked] = True
        # a stored triple is made of a state and of a symbol after its newer word
        at = np.flatnonzero(known & np.append(False, known[:-1]) & (before != _END))
        triple = pair_context(pair[at - 1], pair[at])
        can = maybe(self.can[1], triple)
        at, triple = at[can], triple[can]
        place = find(triples.keys, triple)
        hit = place >= 0
        out[at[hit]] += triples.symbol[place[hit]]
        ask = ~hit & maybe(self.tail[1], triple)
        return out, (pair[asked], asked), (triple[ask], at[ask])

    def lift(self, hashes: np.ndarray) -> np.ndarray:
        """log10 of each token's probability after its longest state in the head, less that of the root."""
        return self.search(hashes)[0]


def _tally(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs and how often each is there, equal hashes ``a`` near each other (compresses better).

    A pair may come out in two rows where hashes collide; their counts add up.
    """
    key = a.view(np.uint64) & np.uint64(0xFFFFF00000000000) | pair_context(a, b).view(np.uint64) >> np.uint64(20)
    order = np.argsort(key)
    a, b = a[order], b[order]
    new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]
    at = np.flatnonzero(new)
    return a[at], b[at], np.diff(np.append(at, len(a)))


def _count_next(known, wanted):
    """(c, s, n): pairs of known words; with ``wanted`` the known pairs ``s`` after a wanted context ``c`` of two words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, size = WordHash(), [], 0

        def rows() -> pa.RecordBatch:
            h = np.concatenate(parts)
            c, s = np.append(_END, h[:-1]), h
            good = maybe(known.value, h)
            if wanted is None:
                good &= np.append(True, good[:-1]) if len(good) else good
            else:
                first = c == _END
                s = pair_context(c, h)
                c = np.append(_END, s[:-1])
                good = maybe(known.value, s) & maybe(wanted.value, c) & ~first
            c, s, n = _tally(c[good], s[good])
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(s), pa.array(n)], names=["c", "s", "n"])

        for batch in batches:
            for _, texts in _parts(batch.column(0)):
                parts.append(tokens(held, texts)[0])
                size += len(parts[-1])
                if size >= 2 * _CHUNK:
                    yield rows()
                    parts, size = [], 0
        if size:
            yield rows()

    return run


def _most(df: DataFrame, col: str, most: int, least: int = 1) -> int:
    """Smallest power-of-two bound (``least`` or more) from which on ``col`` leaves at most ``most`` rows."""
    steps = {r["p"]: r["v"] for r in df.where(F.col(col) >= least).groupBy(F.floor(F.log2(col) + 1e-9).cast("int").alias("p"))
             .agg(F.count(F.lit(1)).alias("v")).collect()}
    taken, bound = 0, 1 << 62
    for p in sorted(steps, reverse=True):
        if taken + steps[p] > most:
            break
        taken, bound = taken + steps[p], 1 << p
    return max(bound, least)


def _keyed(df: DataFrame, a: str, b: str) -> DataFrame:
    """``df`` with the hash ``e`` of two columns in this order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = pair_context(batch[a].to_numpy(), batch[b].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], names=[*batch.schema.names, "e"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, e long")


def _states(rows: DataFrame, per_symbol: float, least: float, name: str) -> tuple[DataFrame, DataFrame]:
    """(c, total, weight) and (e, n, root, lift, more): contexts that pass the divergence test, their stored symbols.

    ``rows`` has c, s, e, n, total (of the context), root and below: the symbol's natural log probability at the root
    and in the state one level up.  ``more`` is the symbol's lift less the state's weight and the lift one level up.
    """
    own = F.log((F.col("n") - F.lit(DISCOUNT)) / F.col("total"))
    sums = rows.groupBy("c").agg(
        F.max("total").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("held"),
        F.sum(F.exp("below")).alias("covered"), F.sum(F.col("n") * (own - F.col("below"))).alias("gain"))
    free = 1 - (F.col("held") - F.lit(DISCOUNT) * F.col("kinds")) / F.col("total")
    weight = F.log(free) - F.log(F.greatest(1 - F.col("covered"), F.lit(1e-12)))
    kept = sums.withColumn("weight", weight).where(
        F.col("gain") + (F.col("total") - F.col("held")) * F.col("weight") >= F.lit(per_symbol) * F.col("kinds") + F.lit(least))
    states = stored(kept.select("c", "total", (F.col("weight") / np.log(10)).alias("weight")), f"{name}-states")
    entries = rows.join(states.select("c", "weight"), "c").select(
        "e", "n", "root", ((own - F.col("root")) / np.log(10)).alias("lift"),
        ((own - F.col("below")) / np.log(10) - F.col("weight")).alias("more"))
    return states, stored(entries, f"{name}-symbols")


@dataclass
class Model:
    """The head of the tree, and the numbers of all other words, pairs and triples: (tag, h, lift)."""
    tree: Tree
    rest: DataFrame


def fit_model(train: DataFrame, counts: DataFrame, scale: float, most_contexts: int = 1 << 19, most_entries: int = 1 << 21,
              common_words: int = 1 << 20, least_count: int = 4, per_symbol: float = 1.0, least: float = 8.0,
              least_head: int = 1) -> Model:
    """Tree over all contexts of one and two words; symbols are stored that follow ``least_count`` times or more.

    ``counts`` has h, n (words and the end); the root gives a token the probability (n + 0.5) / ``scale``.  A symbol
    that follows so often is itself that frequent, as is its pair with the newer word: rarer words and pairs are not
    counted further.  ``most_contexts`` and ``most_entries`` bound the head that is broadcast, not the tree;
    ``common_words`` bounds the states of one word in it.  Pairs and triples that occur less than ``least_head`` times
    are never in the head.
    """
    sc = train.sparkSession.sparkContext
    text, enough = train.select("text"), counts.where(F.col("n") >= least_count)
    known = sc.broadcast(bitmap_of(enough, "h"))
    pairs = (text.mapInArrow(_count_next(known, None), "c long, s long, n long").groupBy("c", "s")
             .agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    least_common = _most(enough.where(F.col("h") != int(_END)), "n", common_words, least_count)
    top = enough.where(F.col("n") >= least_common).toArrow().sort_by("h")
    common = sc.broadcast((top["h"].to_numpy(), top["n"].to_numpy()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the hash of the pair and the counts of its words (null if not common)."""
        words_, times = common.value
        for batch in batches:
            c, s = batch["c"].to_numpy(), batch["s"].to_numpy()
            n = []
            for x in (c, s):
                at = find(words_, x)
                n.append(pa.array(times[at] if len(times) else at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pair_context(c, s)), *n],
                                             names=["c", "s", "n", "e", "total", "times"])

    full = stored(pairs.mapInArrow(fill, "c long, s long, n long, e long, total long, times long"), "pairs")
    rare = enough.where(F.col("n") < least_common)
    for col, of in (("total", "c"), ("times", "s")):
        if full.where(F.col(col).isNull()).isEmpty():
            continue
        other = full.where(F.col(col).isNull()).drop(col).join(rare.select(F.col("h").alias(of), F.col("n").alias(col)), of)
        full = full.where(F.col(col).isNotNull()).unionByName(other)
    root = F.log((F.col("times") + 0.5) / F.lit(float(scale)))
    one = _states(full.select("c", "s", "e", "n", "total", root.alias("root"), root.alias("below")), per_symbol, least, "one")

    # contexts of two words: pairs whose newer word is a state; a pair occurs as often as it is followed by something
    wanted = stored(full.where(F.col("s") != int(_END)).join(one[0].select(F.col("c").alias("s")), "s", "left_semi")
                    .select(F.col("e").alias("c"), F.col("n").alias("total")), "contexts")
    followed, asked = sc.broadcast(bitmap_of(one[1], "e")), sc.broadcast(bitmap_of(wanted, "c"))
    triples = (text.mapInArrow(_count_next(followed, asked), "c long, s long, n long").groupBy("c", "s")
               .agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))
    below = one[1].select(F.col("e").alias("s"), "root", (F.col("root") + F.col("lift") * np.log(10)).alias("below"))
    tried = triples.join(wanted, "c").join(below, "s").select("c", "s", "n", "total", "root", "below")
    two = _states(stored(_keyed(tried, "c", "s"), "triples"), per_symbol, least, "two")

    # the head: pairs and triples that occur often enough; a pair has its symbol and its state on the same side
    pair_symbols, pair_states, triple_symbols = (
        one[1].select(F.col("e").alias("h"), "n", F.col("more").alias("lift")),
        two[0].select(F.col("c").alias("h"), F.col("total").alias("n"), F.col("weight").alias("lift")),
        two[1].select(F.col("e").alias("h"), "n", F.col("more").alias("lift")))
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(
        F.pow(F.lit(2.0), F.floor(F.log2("n") + 1e-9)).cast("long"))
    steps: dict[int, list[int]] = {}
    for is_state, table in ((1, pair_states), (0, pair_symbols), (0, triple_symbols)):
        for r in table.groupBy(step.alias("least")).agg(F.count(F.lit(1)).alias("v")).collect():
            steps.setdefault(r["least"], [0, 0])[is_state] += r["v"]
    bound, kinds, n = 1 << 62, 0, 0
    for s in sorted(steps, reverse=True):
        kinds, n = kinds + steps[s][0], n + steps[s][1]
        if n > most_contexts or kinds > most_entries or s < least_head:
            break
        bound = s

    def head(table: DataFrame) -> pa.Table:
        return table.where(F.col("n") >= bound).select("h", "lift").toArrow()

    def tail(table: DataFrame) -> DataFrame:
        return table.where(F.col("n") < bound)

    one_word = (F.col("total") >= least_common) | (F.col("c") == int(_END))
    levels = [Level.of(head(pair_symbols), head(pair_states)), Level.of(head(triple_symbols), None)]
    outside = [bitmap_of(tail(pair_symbols).select("h").union(tail(pair_states).select("h")), "h"),
               bitmap_of(tail(triple_symbols), "h")]
    tree = Tree(Level.of(None, one[0].where(one_word).select("c", "weight").toArrow()), levels,
                [t | bitmap(x.keys) for t, x in zip(outside, levels, strict=True)], outside)
    rest = one[0].where(~one_word).select(F.lit(_WORD).alias("tag"), F.col("c").alias("h"), F.col("weight").alias("lift"))
    for tag, table in ((_PAIR, pair_symbols), (_PAIR, pair_states), (_TRIPLE, triple_symbols)):
        rest = rest.union(tail(table).select(F.lit(tag).alias("tag"), "h", "lift"))
    return Model(tree, rest)


def fit_tree(train: DataFrame, counts: DataFrame, n_train: int, scale: float, **options) -> Tree:
    """The head of the tree; all of it where it fits the bounds."""
    return fit_model(train, counts, scale, **options).tree


_ROW = ["tag", "h", "rid", "n", "doc"]


def _score(tree, common, unseen: float, end: float):
    """A row for each document with what the broadcast tables say, and one for each of its words, pairs and triples
    that is asked from the tables outside; ``unseen`` and ``end`` are the base of an unseen word and of the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = WordHash()
        keys, logs = common.value
        for batch in batches:
            rids = batch.column(0).to_numpy()
            kind = pa.struct([("doc_id", batch.schema.field(1).type), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                              ("base", pa.float64()), ("lift", pa.float64())])
            for first, texts in _parts(batch.column(2)):
                rows = len(texts)
                own = rids[first:first + rows]
                flat, n_tokens = tokens(held, texts)
                owner = np.repeat(np.arange(rows), n_tokens)
                lift, pairs, triples = tree.value.search(flat)
                inner = np.flatnonzero(flat != _END)
                spot = find(keys, flat[inner])
                rare, known = inner[spot < 0], inner[spot >= 0]
                base = np.bincount(owner[rare], minlength=rows) * unseen + end
                if len(known):
                    base += np.bincount(owner[known], logs[spot[spot >= 0]], rows)
                doc = [batch.column(1).slice(first, rows), pa.array(n_tokens),
                       pa.array(np.bincount(owner[known], minlength=rows).astype(np.int64)), pa.array(base),
                       pa.array(np.bincount(owner, lift, rows))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, _DOC, np.int32)), pa.array(own), pa.array(own), pa.nulls(rows, pa.int64()),
                     pa.StructArray.from_arrays(doc, fields=list(kind))], names=_ROW)
                for tag, (key, place) in ((_WORD, (flat[rare], rare)), (_PAIR, pairs), (_TRIPLE, triples)):
                    rid, h, n = _tally(own[owner[place]], key)
                    if len(h):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(h), tag, np.int32)), pa.array(h), pa.array(rid), pa.array(n),
                             pa.nulls(len(h), kind)], names=_ROW)

    return run


def score_documents(docs: DataFrame, held_out_fold: int = 1, folds: int = 5, common_words: int = 1 << 20,
                    id_col: str = "doc_id", text_col: str = "text", **tree_options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per input row.

    Tokens are the lower-cased words and one end per document.  A null text counts as empty: it has the end only.
    Repeated rows are scored (and counted in training) one by one; without training documents every count is 0
    and the tree is its root; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    train = rows.where(held_fold("doc_id", folds) != held_out_fold)
    counts = stored(train.select("text").mapInArrow(_count_words, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")),
                    "word-counts")
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"),
                       F.sum(F.when(F.col("h") == int(_END), F.col("n"))).alias("docs")).first()
    n_train, n_docs = total["n"] or 0, total["docs"] or 0
    scale = n_train + 0.5 * (total["v"] + 1)

    in_text = counts.where(F.col("h") != int(_END)).select("h", F.col("n").alias("count"))
    bound = _most(in_text, "count", common_words, _LEAST_WORD)
    top = in_text.where(F.col("count") >= bound).toArrow().sort_by("h")
    common = sc.broadcast((top["h"].to_numpy(), np.log10((top["count"].to_numpy() + 0.5) / scale)))
    model = fit_model(train, counts, scale, common_words=common_words, **({"least_head": _LEAST_HEAD} | tree_options))

    unseen, end = float(np.log10(0.5 / scale)), float(np.log10((n_docs + 0.5) / scale))
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    asked = numbered.mapInArrow(
        _score(sc.broadcast(model.tree), common, unseen, end), "tag int, h long, rid long, n long, doc struct<doc_id: "
        f"{rows.schema['doc_id'].dataType.simpleString()}, n_tokens: long, n_known: long, base: double, lift: double>")
    rare = in_text.where(F.col("count") < bound).select(
        F.lit(_WORD).alias("tag"), "h", F.lit(1).alias("is_word"),
        (F.log10((F.col("count") + 0.5) / F.lit(float(scale))) - F.lit(unseen)).alias("base"), F.lit(0.0).alias("lift"))
    table = rare.unionByName(model.rest.withColumns({"is_word": F.lit(0), "base": F.lit(0.0)}))

    def both(of_doc: str, of_row: str):
        return F.sum(F.coalesce(F.col(f"doc.{of_doc}"), F.col("n") * F.col(of_row)))

    return (asked.join(table.hint("shuffle_hash"), ["h", "tag"], "left").groupBy("rid").agg(
        F.max("doc.doc_id").alias("doc_id"), F.sum("doc.n_tokens").alias("n_tokens"),
        (both("n_known", "is_word") + F.lit(1 if n_docs else 0)).alias("n_known"),
        both("base", "base").alias("base_score"), both("lift", "lift").alias("lift"))
        .select("doc_id", (held_fold("doc_id", folds) == held_out_fold).alias("held_out"),
                F.col("n_tokens").cast("long"), F.col("n_known").cast("long"),
                F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score",
                (F.col("base_score") + F.col("lift")).alias("score")))
