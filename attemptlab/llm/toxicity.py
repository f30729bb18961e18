"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own vector (words of the training windows) next to the mean vector of its hashed character
trigrams.  The network reads every overlapping window of a text; the largest window logit, calibrated on the
labelled documents, is the document's score.

Labels mark whole documents, so the training windows are found first: words that are far more frequent in toxic
documents mark windows of toxic documents as positives; windows of the others, spread evenly, are negatives.
The fit uses a bounded sample of labelled rows (``sample_docs``) and windows (``sample_windows``).  Scoring is
one pass over the texts without a shuffle; the model is a few hundred kilobytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attemptlab.llm.common import map_rows

_WORD = re.compile(r"\w+")
_HELD_WORDS = 300_000
WINDOW, STRIDE = 24, 12


def split(text: str | None) -> list[str]:
    """Lower-cased runs of word characters."""
    return _WORD.findall((text or "").lower())


def windows_of(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[int]:
    """Starts of the overlapping windows of ``n`` words; the last one ends with the text."""
    if n <= window:
        return [0]
    return [*range(0, n - window, stride), n - window]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Embeddings, two gated recurrent directions, attention pooling and a logistic output."""

    def __init__(self, vocabulary: list[str], hidden: int = 8, word_dim: int = 12, char_dim: int = 12,
                 char_buckets: int = 4096, attention: int = 8, seed: int = 7, dtype=np.float32):
        rng = np.random.default_rng(seed)
        self.index = {w: i + 2 for i, w in enumerate(vocabulary)}       # 0 is padding, 1 an unknown word
        self.hidden, self.buckets = hidden, char_buckets
        d, h = word_dim + char_dim, hidden
        rand = lambda *shape, by: (rng.normal(size=shape) * by).astype(dtype)
        self.p = {"word": rand(len(vocabulary) + 2, word_dim, by=0.1), "char": rand(char_buckets, char_dim, by=0.1),
                  "attend": rand(2 * h, attention, by=0.4), "attend_b": np.zeros(attention, dtype),
                  "query": rand(attention, by=0.4), "out": rand(2 * h, by=0.4), "out_b": np.zeros(1, dtype)}
        for k in ("f", "b"):
            self.p |= {f"{k}_in": rand(d, 3 * h, by=0.3), f"{k}_rec": rand(h, 3 * h, by=0.3),
                       f"{k}_bias": np.zeros(3 * h, dtype)}
        self.p["word"][0] = 0

    def char_rows(self, items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the trigrams of ``^word$`` of all words, the word of each, and the trigrams per word."""
        sizes = np.fromiter((len(w) for w in items), np.int64, len(items))
        flat = np.frombuffer("".join(f"^{w}$" for w in items).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        starts = np.cumsum(sizes + 2) - (sizes + 2)
        owner = np.repeat(np.arange(len(items)), sizes)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
        code = ((flat[at] << np.uint64(42)) ^ (flat[at + 1] << np.uint64(21)) ^ flat[at + 2]) \
            * np.uint64(0x9E3779B97F4A7C15)
        return (code >> np.uint64(40)).astype(np.int64) % self.buckets, owner, sizes

    def inputs(self, items: list[str]) -> np.ndarray:
        """Input vector of every word."""
        ids = np.fromiter((self.index.get(w, 1) for w in items), np.int64, len(items))
        bucket, owner, sizes = self.char_rows(items)
        chars = np.zeros((len(items), self.p["char"].shape[1]), self.p["char"].dtype)
        at = np.flatnonzero(sizes)
        if len(bucket):
            chars[at] = np.add.reduceat(self.p["char"][bucket], (np.cumsum(sizes) - sizes)[at], axis=0)
        return np.concatenate([self.p["word"][ids], chars / np.maximum(sizes, 1)[:, None].astype(chars.dtype)], 1)

    def projected(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions receive from input vectors."""
        return np.concatenate([x @ self.p[f"{k}_in"] + self.p[f"{k}_bias"] for k in "fb"], -1)

    def _direction(self, gates: np.ndarray, rec: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States after each step; ``gates`` is (steps, windows, 3 hidden)."""
        h = self.hidden
        state = np.zeros((gates.shape[1], h), gates.dtype)
        out = np.empty((*gates.shape[:2], h), gates.dtype)
        for t in range(len(gates)):
            u = state @ rec
            zr = _sigmoid(gates[t, :, :2 * h] + u[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h:] + r * u[:, 2 * h:])
            if keep is not None:
                keep.append((state, z, r, new, u[:, 2 * h:]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def logits(self, gates: np.ndarray, pad: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit per window from projected inputs (steps, windows, 6 hidden) and the padding mask (steps, windows)."""
        h3, p = 3 * self.hidden, self.p
        steps_f, steps_b = ([], []) if keep is not None else (None, None)
        states = np.concatenate([self._direction(gates[..., :h3], p["f_rec"], steps_f),
                                 self._direction(gates[::-1, :, h3:], p["b_rec"], steps_b)[::-1]], -1)
        squashed = np.tanh(states @ p["attend"] + p["attend_b"])
        score = squashed @ p["query"] - 30 * pad
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnk->nk", weight, states)
        if keep is not None:
            keep.update(f=steps_f, b=steps_b, states=states, squashed=squashed, weight=weight, pooled=pooled)
        return pooled @ p["out"] + p["out_b"]

    def gradients(self, words: list[str], at: np.ndarray, target: np.ndarray, word_at: np.ndarray):
        """Mean logistic loss and its gradients; ``at`` (steps, windows) points into ``words``, -1 is padding."""
        p, h = self.p, self.hidden
        x = self.inputs(words)
        pad = at < 0
        seq = np.where(pad[..., None], 0, x[np.maximum(at, 0)]).astype(x.dtype)
        seq[..., :p["word"].shape[1]] = np.where(pad[..., None], p["word"][0], seq[..., :p["word"].shape[1]])
        keep: dict = {}
        prob = _sigmoid(self.logits(self.projected(seq), pad.astype(x.dtype), keep))
        n = len(target)
        loss = -np.mean(target * np.log(prob + 1e-7) + (1 - target) * np.log(1 - prob + 1e-7))
        d_logit = ((prob - target) / n).astype(x.dtype)
        g = {"out": keep["pooled"].T @ d_logit, "out_b": d_logit.sum(keepdims=True)}
        d_pool = d_logit[:, None] * p["out"]
        d_weight = np.einsum("nk,tnk->tn", d_pool, keep["states"])
        d_states = keep["weight"][..., None] * d_pool
        d_score = keep["weight"] * (d_weight - (keep["weight"] * d_weight).sum(0))
        g["query"] = np.einsum("tn,tna->a", d_score, keep["squashed"])
        d_squash = d_score[..., None] * p["query"] * (1 - keep["squashed"] ** 2)
        g["attend"] = np.einsum("tnk,tna->ka", keep["states"], d_squash)
        g["attend_b"] = d_squash.sum((0, 1))
        d_states = d_states + d_squash @ p["attend"].T
        d_seq = np.zeros_like(seq)
        for k, part, inputs in (("f", d_states[..., :h], seq), ("b", d_states[::-1, :, h:], seq[::-1])):
            d_gates = np.zeros((*seq.shape[:2], 3 * h), x.dtype)
            g[f"{k}_rec"] = np.zeros_like(p[f"{k}_rec"])
            carry = np.zeros((n, h), x.dtype)
            for t in range(len(seq) - 1, -1, -1):
                state, z, r, new, u = keep[k][t]
                d = part[t] + carry
                d_new = d * (1 - z) * (1 - new ** 2)
                d_z = d * (state - new) * z * (1 - z)
                d_r = d_new * u * r * (1 - r)
                d_u = np.concatenate([d_z, d_r, d_new * r], 1)
                d_gates[t] = np.concatenate([d_z, d_r, d_new], 1)
                g[f"{k}_rec"] += state.T @ d_u
                carry = d * z + d_u @ p[f"{k}_rec"].T
            g[f"{k}_bias"] = d_gates.sum((0, 1))
            g[f"{k}_in"] = np.einsum("tnd,tnk->dk", inputs, d_gates)
            back = d_gates @ p[f"{k}_in"].T
            d_seq += back if k == "f" else back[::-1]
        d_seq[pad] = 0
        d_words = np.zeros_like(x)
        np.add.at(d_words, at[~pad], d_seq[~pad])
        wd = p["word"].shape[1]
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], word_at, d_words[:, :wd])
        bucket, owner, sizes = self.char_rows(words)
        g["char"] = np.zeros_like(p["char"])
        np.add.at(g["char"], bucket, (d_words[:, wd:] / np.maximum(sizes, 1)[:, None])[owner])
        g["word"][0] = 0
        return loss, g

    def train(self, windows: list[list[str]], target: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01,
              seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), batch):
                rows = order[s:s + batch]
                words = sorted({w for r in rows for w in windows[r]})
                place = {w: i for i, w in enumerate(words)}
                at = np.full((WINDOW, len(rows)), -1, np.int64)
                for j, r in enumerate(rows):
                    at[:len(windows[r]), j] = [place[w] for w in windows[r]]
                # now and then a word is unknown, so that the characters alone must tell
                word_at = np.array([self.index.get(w, 1) for w in words] or [], np.int64)
                _, g = self.gradients(words, at, target[rows], word_at)
                step += 1
                for k, grad in g.items():
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    lr = rate * (0.3 if epoch >= epochs - 2 else 1.0)
                    self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)) \
                        .astype(self.p[k].dtype)
        return self


class Reader:
    """Scores whole texts in a task: keeps the projected inputs of recent words."""

    def __init__(self, net: Network, chunk: int = 4096):
        self.net, self.chunk = net, chunk
        self._reset()

    def _reset(self) -> None:
        padding = np.concatenate([self.net.p["word"][:1], np.zeros((1, self.net.p["char"].shape[1]), np.float32)], 1)
        self.place: dict[str, int] = {}
        self.table = self.net.projected(padding)

    def _rows(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.place) > _HELD_WORDS:
            self._reset()
        new = sorted({w for t in texts for w in t if w not in self.place})
        if new:
            base = len(self.table)
            self.table = np.concatenate([self.table, self.net.projected(self.net.inputs(new))])
            self.place.update((w, base + i) for i, w in enumerate(new))
        return [np.fromiter((self.place[w] for w in t), np.int32, len(t)) for t in texts]

    def logits(self, texts: list[list[str]]) -> np.ndarray:
        """Largest window logit per text."""
        best = np.full(len(texts), -np.inf)
        at, owner = [], []
        for i, rows in enumerate(self._rows(texts)):
            if len(rows) <= WINDOW:
                one = np.zeros((1, WINDOW), np.int32)
                one[0, :len(rows)] = rows
            else:
                one = rows[np.array(windows_of(len(rows)))[:, None] + np.arange(WINDOW)]
            at.append(one)
            owner.append(np.full(len(one), i))
        at, owner = np.concatenate(at), np.concatenate(owner)
        for s in range(0, len(at), self.chunk):
            ids = np.ascontiguousarray(at[s:s + self.chunk].T)
            np.maximum.at(best, owner[s:s + self.chunk],
                          self.net.logits(self.table[ids], (ids == 0).astype(np.float32)))
        return best


def _batches(texts: list[str | None], words_at_once: int = 400_000) -> Iterator[list[list[str]]]:
    held, n = [], 0
    for t in texts:
        held.append(split(t))
        n += len(held[-1])
        if n >= words_at_once:
            yield held
            held, n = [], 0
    if held:
        yield held


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-dimensional logistic fit by Newton steps, slope kept positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * x + b)
        g = np.array([((p - y) * x).sum() + 0.01 * (a - 1), (p - y).sum() + 0.01 * b])
        w = p * (1 - p)
        hess = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hess, g)
        a, b = a - np.clip(step[0], -0.5, 0.5), b - np.clip(step[1], -2, 2)
    return max(float(a), 1e-3), float(b)


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 6000, sample_windows: int = 12_000,
        least_docs: int = 3, least_log_odds: float = 2.0):
    """(network, slope, shift) from labelled documents, or (None, 0, shift) if a class is missing.

    ``docs`` has doc_id, text; ``labels`` has doc_id, toxic (0 or 1; null is no label).
    """
    spark = docs.sparkSession
    toxic = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).collect()
    if not picked:
        return None, 0.0, -4.0
    sample = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked],
                                   f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, toxic int")
    rows = docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic")     # at most sample_docs rows

    def words_of(ids: pa.Array, texts: pa.Array, flags: pa.Array) -> Iterator[dict[str, list]]:
        word, flag = [], []
        for t, f in zip(texts.to_pylist(), flags.to_pylist(), strict=True):
            own = sorted(set(split(t)))
            word += own
            flag += [f] * len(own)
        yield {"word": word, "toxic": flag}

    totals = rows.groupBy().agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = totals["n1"] or 0, totals["n"] - (totals["n1"] or 0)
    if not n1 or not n0:
        return None, 0.0, 4.0 if n1 else -4.0
    odds = F.log((F.col("d1") + 0.5) / (n1 + 1.0)) - F.log((F.col("d0") + 0.5) / (n0 + 1.0))
    cues = {r["word"] for r in map_rows(rows, words_of, "word string, toxic int")
            .groupBy("word").agg(F.sum("toxic").alias("d1"), F.sum(1 - F.col("toxic")).alias("d0"))
            .where((F.col("d1") >= max(least_docs, n1 // 50)) & (odds >= least_log_odds))
            .orderBy(odds.desc(), "word").limit(1000).collect()}
    per_doc = max(2, sample_windows // max(1, len(picked)))

    def cut(ids: pa.Array, texts: pa.Array, flags: pa.Array) -> Iterator[dict[str, list]]:
        out: dict[str, list] = {"toxic": [], "words": []}
        for t, f in zip(texts.to_pylist(), flags.to_pylist(), strict=True):
            own = split(t)
            if f:
                hits = [i for i, w in enumerate(own) if w in cues]
                starts = sorted({min(max(0, i - b), max(0, len(own) - WINDOW)) for i in hits[:8] for b in (4, 12, 20)})
            else:
                every = windows_of(len(own))
                starts = every if len(every) <= per_doc else [every[i * len(every) // per_doc] for i in range(per_doc)]
            for s in starts:
                out["toxic"].append(f)
                out["words"].append(own[s:s + WINDOW])
        yield out

    got = map_rows(rows, cut, "toxic int, words array<string>").orderBy(F.xxhash64("words"), "words") \
        .limit(2 * sample_windows).collect()
    target = np.array([r["toxic"] for r in got], np.float32)
    if not 0 < target.sum() < len(target):
        return None, 0.0, float(np.log(n1 / n0))
    seen: dict[str, int] = {}
    for r in got:
        for w in set(r["words"]):
            seen[w] = seen.get(w, 0) + 1
    net = Network(sorted(w for w, k in seen.items() if k >= 3))
    net.train([r["words"] for r in got], target)

    def judge(ids: pa.Array, texts: pa.Array, flags: pa.Array) -> Iterator[dict[str, list]]:
        yield {"logit": np.concatenate([reader.logits(b) for b in _batches(texts.to_pylist())]), "toxic": flags}

    reader = Reader(net)
    judged = map_rows(rows, judge, "logit double, toxic int").collect()
    slope, shift = _platt(np.array([r["logit"] for r in judged]), np.array([r["toxic"] for r in judged], float))
    return net, slope, shift


def score_documents(docs: DataFrame, model, text_col: str = "text", score_col: str = "toxic_score") -> DataFrame:
    """All columns of ``docs`` and ``score_col`` (0 to 1, six places) for every row, in one pass.

    A null or empty text is one window of padding.  Repeated rows are scored one by one.
    """
    net, slope, shift = model
    if net is None:
        return docs.withColumn(score_col, F.lit(round(float(_sigmoid(np.array(shift))), 6)))
    holder: dict = {}

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        reader = holder.setdefault("reader", Reader(net))
        if not len(texts):
            return pd.Series([], dtype="float64")
        logit = np.concatenate([reader.logits(b) for b in _batches(texts.tolist())])
        return pd.Series(np.round(_sigmoid(slope * logit + shift), 6))

    return docs.withColumn(score_col, score(F.col(text_col)))
