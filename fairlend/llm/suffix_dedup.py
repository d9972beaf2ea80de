"""Operator 9: removal of repeated byte strings by suffix arrays.

Parts of texts whose 400-byte windows may repeat are brought together by the
anchors of their windows (see ``repeats``).  Each shard is joined to one
string, its suffix array is made by induced sorting, and permuted common
prefixes show which suffixes share 400 bytes with a neighbour.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.repeats import Windows, cut
from fairlend.llm.suffix_array import common_prefixes, suffix_order
from fairlend.llm.text import byte_view

WINDOW, GRAM, WIDE = 400, 64, 2_048


def byte_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where the texts begin."""
    data, at = byte_view(column)
    return data[at[0]:at[-1]], at - at[0]


def shared_suffixes(texts: list[bytes], context: list[bool], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(text, first window, windows) of the suffixes that share ``window`` bytes with another one."""
    size = np.array([len(x) for x in texts], np.int64)
    # Symbol 0 ends the string, 1 ends a text, bytes begin at 2.
    text = np.ones(int(size.sum()) + len(texts) + 1, np.int16)
    text[-1] = 0
    at = np.cumsum(size + 1) - size - 1
    place = np.arange(size.sum()) + np.repeat(np.arange(len(texts)), size)
    text[place] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 2
    left = np.zeros(len(text), np.int64)
    left[place] = np.repeat(at + size, size) - place
    order = suffix_order(text)
    length, before = common_prefixes(text, order, left)
    hit = np.zeros(len(text), bool)
    long = np.flatnonzero(length >= window)
    hit[long] = True
    hit[before[long]] = True
    found = np.flatnonzero(hit)
    if not len(found):
        return
    owner = np.searchsorted(at, found, "right") - 1
    fresh = np.ones(len(found), bool)
    fresh[1:] = (np.diff(found) != 1) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(fresh)
    for i, n in zip(head.tolist(), np.diff(np.append(head, len(found))).tolist()):
        yield int(owner[i]), int(found[i] - at[owner[i]]), n


def _apply(column: pa.Array, masks: list[np.ndarray]) -> list[pa.Array]:
    data, at = byte_units(column)
    kept, total, gone, spans = [], [], [], []
    for a, b, mask in zip(at.tolist(), at[1:].tolist(), masks):
        total.append(b - a)
        gone.append(int(mask.sum()))
        spans.append(int((np.diff(mask.astype(np.int8), prepend=0) == 1).sum()))
        kept.append((data[a:b][~mask] if gone[-1] else data[a:b]).tobytes())
    return [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (total, gone, spans))]


def drop_repeated_bytes(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept`` (binary: the bytes left), ``n_bytes``, ``n_removed`` and ``n_spans``.

    A byte of a text, taken as UTF-8, goes if a string of ``window`` bytes
    that covers it also starts at another place, in any document; strings are
    those of the input and never cross documents.  ``n_spans`` counts maximal
    removed runs.  A null text has no bytes; shorter texts lose none; rows with equal doc_id
    and text are separate documents; a null doc_id is kept.  Other columns are
    kept; the four columns replace columns of those names.
    """
    fields = "kept binary, n_bytes long, n_removed long, n_spans long"
    w = Windows(window, min(GRAM, 1 << (window.bit_length() - 1)), byte_units, WIDE)
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    return cut(docs, w, lambda texts, context: shared_suffixes(texts, context, window), _apply, fields, "byte-repeats")


def suffix_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    return drop_repeated_bytes(docs.select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
