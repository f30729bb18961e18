"""Sequence packing by Karmarkar-Karp multiway differencing.

Each document becomes the token ids of its whole text followed by one end id.  Whole windows are cut off the
front of a document; what is left is cut into small pieces, and batches of pieces are divided into windows by
the largest differencing method: every piece starts as a partial partition (one loaded window, the others
empty), and the two partial partitions with the largest spreads are merged again and again, the fullest window
of one onto the emptiest of the other.  If the fullest window of the result is over the capacity, the window
count rises and the batch is differenced again.

Every task packs the documents it reads: nothing is shuffled, so a hot source or a very long document costs
only its own tokens, and a lost task is repeated with the same result.  Memory per task is one Arrow batch plus
the pieces of one packing batch.

Defined cases: a null text counts as empty; a document without tokens is the end id alone; repeated rows are
packed once each; ids may have any type that Arrow carries, nulls included (integers come back as long); an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long")

_ENCODERS: dict = {}


def _byte_of_char() -> dict[str, int]:
    """Inverse of the printable alphabet in which byte-level vocabularies spell bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(keep)]
    return {**{chr(b): b for b in keep}, **{chr(256 + i): b for i, b in enumerate(other)}}


def build_encoder(vocabulary_json: str, pattern: str):
    """Byte-level BPE encoder with the ids of a ``tokenizers`` file, added tokens included."""
    import tiktoken

    spec = json.loads(vocabulary_json)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    to_byte = _byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i
             for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def encode(encoder, text: str) -> np.ndarray:
    """Ids of ordinary text."""
    return encoder.encode_to_numpy(text, disallowed_special=())


def encode_document(encoder, text: str) -> np.ndarray:
    """Ids of a text in which an added token is one id, as ``tokenizers`` gives them by default."""
    return encoder.encode_to_numpy(text, allowed_special="all")


def difference(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each piece by multiway Karmarkar-Karp differencing."""
    n = len(sizes)
    if windows <= 1 or n <= 1:
        return np.zeros(n, np.int64)
    loads: dict[int, np.ndarray] = {}
    heap = []
    for i, s in enumerate(sizes):
        one = np.zeros(windows, np.int64)
        one[0] = s
        loads[i] = one
        heap.append((-int(s), i))
    heapq.heapify(heap)
    merges: dict[int, tuple[int, int, np.ndarray]] = {}
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = loads.pop(a) + loads.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        loads[node] = both
        merges[node] = (a, b, order)
        heapq.heappush(heap, (-int(both[0]), node))
        node += 1
    out = np.empty(n, np.int64)
    todo = [(heap[0][1], np.arange(windows))]
    while todo:
        at, window_of = todo.pop()
        if at < n:
            out[at] = window_of[0]
            continue
        a, b, order = merges.pop(at)
        placed = np.empty(windows, np.int64)
        placed[order] = window_of
        todo.append((a, placed))
        todo.append((b, placed[::-1]))
    return out


def pack_batch(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Window of each piece and the number of windows; the count rises until every load fits."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, windows)
        most = int(np.bincount(at, weights=sizes, minlength=windows).max())
        if most <= capacity:
            return at, windows
        windows += max(1, (most - capacity) * windows // (4 * capacity))


def cut(tokens: int, capacity: int, piece: int) -> tuple[int, list[tuple[int, int]]]:
    """Number of whole windows at the front, and (start, length) of the pieces of the rest."""
    whole = tokens // capacity
    return whole, [(s, min(piece, tokens - s)) for s in range(whole * capacity, tokens, piece)]


def _packer(vocabulary, pattern: str, capacity: int, piece: int, batch_windows: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary.value)
        if key not in _ENCODERS:
            _ENCODERS[key] = build_encoder(vocabulary.value, pattern)
        encoder = _ENCODERS[key]
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        waiting: list[tuple] = []
        load, kind = 0, pa.int64()

        def flush() -> None:
            nonlocal sequence, load
            sizes = np.array([w[2] for w in waiting], np.int64)
            at, windows = pack_batch(sizes, capacity)
            total = np.bincount(at, weights=sizes, minlength=windows).astype(np.int64)
            filled = np.zeros(windows, np.int64)
            used = np.cumsum(total > 0) - 1
            for w, k in zip(waiting, at.tolist(), strict=True):
                out.append((*w, sequence + int(used[k]), int(filled[k]), int(total[k])))
                filled[k] += w[2]
            sequence += int((total > 0).sum())
            waiting.clear()
            load = 0

        def emit() -> pa.RecordBatch:
            docs, *numbers = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(docs, kind), *(pa.array(c, pa.int64()) for c in numbers)],
                                              names=["doc_id", *(x.split()[0] for x in NUMBERS.split(", "))])

        for batch in batches:
            kind = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode_document(encoder, text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = len(ids)
                whole, rest = cut(n, capacity, piece)
                for k in range(whole):
                    part = ids[k * capacity:(k + 1) * capacity]
                    out.append((doc, k * capacity, capacity, zlib.crc32(part.tobytes()), n, sequence, 0, capacity))
                    sequence += 1
                for s, m in rest:
                    waiting.append((doc, s, m, zlib.crc32(ids[s:s + m].tobytes()), n))
                    load += m
                if load >= batch_windows * capacity:
                    flush()
                if len(out) >= 20_000:
                    yield emit()
        if waiting:
            flush()
        if out:
            yield emit()

    return run


def pack_documents(docs: DataFrame, vocabulary_path: str, pattern: str, capacity: int = 1024, piece: int = 256,
                   batch_windows: int = 128, end_id: int = 0, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """One row per piece: document, place in it, checksum of its ids, and its sequence and offset there.

    ``vocabulary_path`` is read on the driver and sent to the tasks (the size of one vocabulary file), so
    executors need no copy of it.  ``piece`` bounds the pieces that are differenced, ``batch_windows`` the
    windows that are differenced together.  A null text packs as its end id alone, repeated rows are packed once
    each, an empty table gives an empty result; the id keeps its type, but integers become long.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.schema[id_col].dataType
    kind = "long" if isinstance(own, T.IntegralType) else own.simpleString()
    rows = docs.select(F.col(id_col).cast(kind).alias("doc_id"), F.col(text_col))
    return rows.mapInArrow(_packer(vocabulary, pattern, capacity, piece, batch_windows, end_id), f"doc_id {kind}, {NUMBERS}")
