"""Small helpers for text columns inside ``mapInArrow`` tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch between Spark and a Python worker, where the session sets no limit of its own.
BATCH_BYTES = 8 << 20
#: Bytes of text that one step of a task works on at a time.
CHUNK_BYTES = 1 << 20
#: What a worker remembers for the operator it works for, see ``kept``.
_KEPT: dict[tuple, object] = {}


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches of bounded bytes, however long a row's text is."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def kept(operator: str, key: object, make: Callable):
    """``make()``, remembered by a worker until it works for another operator: memos of a pipeline's stages do not add up."""
    if any(held[0] != operator for held in _KEPT):
        _KEPT.clear()
    if (operator, key) not in _KEPT:
        _KEPT[operator, key] = make()
    return _KEPT[operator, key]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying it; a null is empty."""
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    elif pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def byte_texts(column: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes, a null as empty."""
    data, at = byte_view(column)
    raw, at = memoryview(data), at.tolist()
    return [bytes(raw[a:b]) for a, b in zip(at, at[1:])]


def strings(column: pa.Array) -> list[str]:
    """The column's strings, a null as empty; bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in column.to_pylist()]
    except UnicodeDecodeError:
        return [x.decode("utf-8", "replace") for x in byte_texts(column)]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes of the column ``text``, one row at least."""
    if batch.num_rows == 0:
        return
    _, at = byte_view(batch.column(text))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


class Memo(dict):
    """``key -> make([key])[0]`` with two generations of at most ``limit`` keys each.

    ``fill`` takes distinct keys and makes all missing ones in one call.  Only the memory is bounded:
    a key that fell out is made anew, with the same value.
    """

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def fill(self, keys) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        missing = []
        for key in [k for k in keys if k not in self]:
            value = self.old.get(key)
            if value is None:
                missing.append(key)
            else:
                self[key] = value
        if missing:
            self.update(zip(missing, self.make(missing)))
