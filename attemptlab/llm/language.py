"""Language identification with a string kernel.

The blended-spectrum presence kernel of two texts is the number of character n-grams (all sizes up to ``size``)
that both contain, divided by the root of the product of their numbers of distinct n-grams.  Landmark texts give
a Nystroem map of the kernel, on which one ridge regression per language (one against the rest) is fitted.
Documents are scored in blocks: a 0/1 matrix of the n-grams that occur in landmarks, times the landmark matrix
(the kernel block), times the dual weights.

Scoring is one pass over the texts without a shuffle.  The fit uses a bounded sample of labelled rows
(``per_language`` each, ``most_rows`` in all); the broadcast model is the n-gram table of ``landmarks`` texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.llm.common import held_fold, map_rows

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct codes of the n-grams (n up to ``size``, at most 3) of a lower-cased text.

    Every run of other characters than letters counts as one blank; a text without letters has none.
    """
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return np.zeros(0, np.int64)
    c = np.where(letter, code, 32).astype(np.int64)
    c = np.concatenate([[32], c, [32]])
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]
    parts = [c]
    for n in range(1, size):
        parts.append((parts[-1][:-1] << 21) | c[n:])
    return np.unique(np.concatenate(parts))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray        # sorted n-grams of the landmarks
    landmarks: np.ndarray    # (n-grams, landmarks), 0/1 divided by the root of the landmark's size
    weights: np.ndarray      # (landmarks, languages)
    bias: np.ndarray

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel block: documents against landmarks."""
        present = np.zeros((len(sets), len(self.table)), np.float32)
        root = np.ones((len(sets), 1), np.float32)
        for i, s in enumerate(sets):
            if len(s):
                at = np.searchsorted(self.table, s)
                at[at == len(self.table)] = 0
                present[i, at[self.table[at] == s]] = 1
                root[i] = np.sqrt(len(s))
        return (present @ self.landmarks) / root

    def scores(self, sets: list[np.ndarray]) -> np.ndarray:
        return self.kernel(sets) @ self.weights + self.bias


def fit_sets(sets: list[np.ndarray], langs: list[str], landmarks: int = 128, ridge: float = 1e-2) -> Model:
    """Model from n-gram sets and their languages; the landmarks are taken in turn from the languages."""
    names = sorted(set(langs))
    turn = sorted(range(len(sets)), key=lambda i: (sum(x == langs[i] for x in langs[:i]), langs[i]))
    marks = [sets[i] for i in turn[:landmarks]]
    table = np.unique(np.concatenate(marks))
    matrix = np.zeros((len(table), len(marks)), np.float32)
    for j, s in enumerate(marks):
        matrix[np.searchsorted(table, s), j] = 1 / np.sqrt(len(s))
    model = Model(names, table, matrix, np.zeros((len(marks), 0), np.float32), np.zeros(0, np.float32))
    value, vector = np.linalg.eigh(model.kernel(marks).astype(float))
    good = value > 1e-6 * value.max()
    to_features = vector[:, good] / np.sqrt(value[good])
    x = model.kernel(sets).astype(float) @ to_features
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    # every language weighs the same, however many rows it has
    share = np.array([1 / langs.count(a) for a in langs])[:, None] * len(langs) / len(names)
    mean_x, mean_y = (share * x).sum(0) / share.sum(), (share * y).sum(0) / share.sum()
    xc = x - mean_x
    dual = np.linalg.solve(xc.T @ (share * xc) + ridge * len(x) * np.eye(x.shape[1]) / 10, xc.T @ (share * (y - mean_y)))
    model.weights = (to_features @ dual).astype(np.float32)
    model.bias = (mean_y - mean_x @ dual).astype(np.float32)
    return model


def fit(labelled: DataFrame, size: int = 3, per_language: int = 300, most_rows: int = 3000,
        landmarks: int = 128) -> Model | None:
    """Model from ``labelled`` (doc_id, text, lang), or None without usable rows."""
    spark = labelled.sparkSession
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = (labelled.where("lang is not null and text is not null").select("doc_id", "lang")
           .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language)
           .orderBy("n", "lang").limit(most_rows).select("doc_id").collect())
    if not ids:
        return None
    kind = labelled.schema["doc_id"].dataType.simpleString()
    picked = spark.createDataFrame([(r[0],) for r in ids], f"doc_id {kind}").distinct()

    def sets(texts: pa.Array, langs: pa.Array) -> Iterator[dict[str, list]]:
        yield {"lang": langs, "grams": [grams(t, size) for t in texts.to_pylist()]}

    rows = labelled.join(F.broadcast(picked), "doc_id", "left_semi").where("lang is not null")  # at most most_rows ids
    got = map_rows(rows.select("text", "lang"), sets, "lang string, grams array<long>").where(F.size("grams") > 0) \
        .orderBy("lang", F.xxhash64("grams")).collect()
    if not got:
        return None
    return fit_sets([np.array(r["grams"], np.int64) for r in got], [r["lang"] for r in got], landmarks)


def identify(docs: DataFrame, model: Model | None, size: int = 3, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): one row per input row.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(ids: pa.Array, texts: pa.Array) -> Iterator[dict[str, list]]:
        m = shared.value
        sets = [grams(t.as_py(), size) for t in texts]
        if m is None:
            yield {"doc_id": ids, "lang_pred": ["und"] * len(sets), "score": [0.0] * len(sets)}
            return
        s = m.scores(sets).astype(float)
        p = np.exp(4 * (s - s.max(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = s.argmax(1).tolist()
        yield {"doc_id": ids, "lang_pred": [m.languages[b] if len(g) else "und" for b, g in zip(best, sets, strict=True)],
               "score": [round(float(p[i, b]), 6) if len(sets[i]) else 0.0 for i, b in enumerate(best)]}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), predict,
                    f"doc_id {kind}, lang_pred string, score double", rows=256)


def identify_held_out(docs: DataFrame, folds: int = 5, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from labelled documents outside fold 0 only.

    Repeated rows are predicted one by one; an empty table gives an empty result; a null lang is no label;
    other columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang")
    model = fit(rows.where(held_fold("doc_id", folds) != 0), **options)
    return identify(rows, model, options.get("size", 3)).select(
        "doc_id", (held_fold("doc_id", folds) == 0).alias("held_out"), "lang_pred", "score")
