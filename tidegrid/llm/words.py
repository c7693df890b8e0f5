"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is ``[^\\x20\\x09-\\x0D]+``.  Texts are UTF-8; lower-casing touches A-Z only, so byte
work and character work agree.  Hashes are 64-bit polynomials of the bytes, mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession

PATTERN = r"[^\x20\x09-\x0D]+"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = bytes(b in (32, 9, 10, 11, 12, 13) for b in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base ** i`` for i < n in 64-bit arithmetic; the longest table so far is kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(table)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """``starts``/``ends`` are byte places in ``data``; text ``d`` owns words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.multiply(self.data + np.uint8(1), powers(_BASE, n), out=total[1:])  # no byte of UTF-8 is 255
        np.cumsum(total[1:], out=total[1:])
        body = (total[self.ends] - total[self.starts]) * powers(_INVERSE, n + 1)[self.starts]
        return mix(body + (self.ends - self.starts).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def split(texts: Iterable[str | None], lower: bool) -> Words:
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b"\n".join(raw) + b"\n"
    data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
    blank = np.frombuffer(joined.translate(_SPACE), np.int8)
    edge = np.flatnonzero(np.diff(blank, prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    ends = np.append(ends, len(data)) if len(ends) < len(starts) else ends
    ends_of_text = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.searchsorted(starts, ends_of_text)]).astype(np.int64)
    return Words(data, starts, ends, first)


def window_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, across text borders too; the caller masks those."""
    n = len(word_hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * powers(_BASE, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(_INVERSE, n)[: n - width + 1])


def span_hashes(word_hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of ``word_hashes[lo:hi]`` for many spans."""
    n = len(word_hashes)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * powers(_BASE, n), out=total[1:])
    return mix((total[hi] - total[lo]) * powers(_INVERSE, n + 1)[lo] + (hi - lo).astype(np.uint64))


def give_back() -> None:
    """Hand freed memory back at the end of a task: Python workers live on and would keep it."""
    pa.default_memory_pool().release_unused()
    ctypes.CDLL(None).malloc_trim(0)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for jobs that run inside: whole texts make the usual batch tens of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def batches(frames: Iterator[pd.DataFrame], text: str = "text", most: int = 600_000) -> Iterator[pd.DataFrame]:
    """Cut frames so that the texts of each hold about ``most`` characters, one row at least."""
    for frame in frames:
        if frame.empty:
            continue
        size = frame[text].str.len().fillna(0).to_numpy()
        part = (np.cumsum(size) - size) // most
        for at in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
            yield frame.iloc[at]
        del frame, size, part
    give_back()


def groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition that is sorted by ``keys``, many small ones in a frame.

    Every frame holds complete groups; only the group that is cut by the end of an Arrow
    batch is carried over, so memory is bounded by a batch and the largest group.
    """
    rest: list[pd.DataFrame] = []  # frames of one group, the last so far
    for frame in frames:
        if frame.empty:
            continue
        key = frame[keys].to_numpy()
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = other[-1] + 1 if len(other) else 0
        if cut:
            yield pd.concat([*rest, frame.iloc[:cut]], ignore_index=True)
            rest = [frame.iloc[cut:]]
        elif rest and (rest[0][keys].to_numpy()[0] == key[-1]).all():
            rest.append(frame)
        else:
            if rest:
                yield pd.concat(rest, ignore_index=True)
            rest = [frame]
    if rest:
        yield pd.concat(rest, ignore_index=True)
    del rest
    give_back()


def borders(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Start of each group in a sorted frame, and the end."""
    key = frame[keys].to_numpy()
    change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
    return np.concatenate([[0], change, [len(frame)]])
