"""Text helpers shared by the operators of this package (used inside tasks and on the driver)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attemptlab.session import shuffles_dropped, stored  # noqa: F401

#: ASCII white space as every contract of this package defines it: space and the code points 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"

_HELD_WORDS = 400_000
_BITS = 26                # a bitmap has 2 ** _BITS bits


class WordHash(dict):
    """64-bit hash of a word given as bytes; remembers recent words, within bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _HELD_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words of a text in UTF-8: maximal runs without ASCII white space; ``lower`` maps A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def word_hashes(held: WordHash, items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(held.__getitem__, items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash (elementwise bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every run of ``n`` words."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = hashes[:m].copy()
    for i in range(1, n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + m]
    return mix(acc)


def held_fold(id_col: str | Column, folds: int = 5) -> Column:
    """Remainder of the CRC-32 of the id written as text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("")), "UTF-8")), F.lit(folds))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_rows(df: DataFrame, fn: Callable[..., Iterator[dict[str, list]]], schema: str, rows: int = 2000) -> DataFrame:
    """``mapInArrow`` with ``fn(columns...)`` called on at most ``rows`` rows; ``fn`` yields dicts of columns."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                for out in fn(*part.columns):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word of a bitmap and the bit in it, from the leading bits of each key."""
    slot = keys.view(np.uint64) >> np.uint64(64 - _BITS)
    return (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63))


def bitmap(keys: np.ndarray) -> np.ndarray:
    """Bitmap of some hashes."""
    bits = np.zeros(1 << (_BITS - 6), np.uint64)
    np.bitwise_or.at(bits, *_slots(keys))
    return bits


def bitmap_of(df: DataFrame, col: str) -> np.ndarray:
    """Bitmap of the hashes in a column: a key whose bit is 0 is not among them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (_BITS - 6), np.uint64)
        for batch in batches:
            np.bitwise_or.at(bits, *_slots(batch.column(0).to_numpy()))
        at = np.flatnonzero(bits)
        for s in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[s:s + 100_000]), pa.array(bits[at[s:s + 100_000]].view(np.int64))],
                                             names=["at", "bits"])

    with shuffles_dropped(df.sparkSession):
        got = df.select(col).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (_BITS - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def maybe(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    word, bit = _slots(keys)
    return (bitmap[word] & bit) != 0
