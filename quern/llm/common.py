"""What the operators of this subpackage share: Arrow batches, words and their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: Code points that separate words: blank and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"
#: A word as a regular expression for Spark, DuckDB and Python.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts are handled in slices of about this many bytes, so the arrays of a slice stay small; one text is never cut.
SLICE_BYTES = 1 << 20


def text_slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts have about size bytes together."""
    offsets = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :]
    first, n = 0, batch.num_rows
    while first < n:
        last = int(np.searchsorted(offsets[: n + 1], offsets[first] + size, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def joined_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, a line feed after each, and where each text starts, with the end. Nulls are empty."""
    parts = [b"" if x is None else x for x in texts.cast(pa.binary()).to_pylist()]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in parts], out=starts[1:])
    return np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), starts


_IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of the bytes start and end."""
    gap = np.concatenate(([True], _IS_SPACE[data], [True]))
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    return edges[0::2], edges[1::2]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15


def text_words(texts: pa.Array, lower: bool = False) -> list[list[bytes]]:
    """The words of each text as UTF-8 bytes, A-Z in lower case if asked; none for nulls. Words stand between the code points of SPACES."""
    return [(x.lower() if lower else x).split() if x else [] for x in texts.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, one after the other, and where each text's words start, with the end."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=starts[1:])
    return np.fromiter(map(xxh64_intdigest, chain.from_iterable(words)), np.uint64, int(starts[-1])), starts


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive hashes."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = mix64(out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k])
    return out


def map_texts(df: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[pa.Array, pa.Array], dict], size: int = SLICE_BYTES) -> DataFrame:
    """Apply rows(ids, texts) to slices of df's texts, of about size bytes, inside tasks; it returns a column of values for each field of schema.

    Only the two columns are read, under names of their own, so other columns of df can have any name."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in text_slices(batch, "text", size):
                part = batch.slice(first, last - first)
                out = rows(part.column("id"), part.column("text"))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[k] for k in names)], names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
