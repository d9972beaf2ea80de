"""Operator 3: substring dedup by prefix-partitioned suffix trees.

Suffixes of 35 words are split into groups by a run of words that all suffixes
of a group contain: the anchor of their window (see ``repeats``), or where too
many different texts share an anchor, all 35 words.  A group fits in memory.
Its tree is built from the root down, word by word: nodes with a single leaf
are dropped, and what is left at 35 words are the leaves below deep internal
nodes, that is, the suffixes whose first 35 words start at two places or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.repeats import Windows, cut
from fairlend.llm.text import byte_texts, kept

WINDOW, GRAM, WIDE = 35, 8, 4_096
#: Word hashes a worker remembers.
MEMO = 150_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, and where the texts begin; words end at blanks and \\t to \\r."""
    known = kept("substring", "words", _Hashes)
    parts = [np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
             for words in (x.split() for x in byte_texts(column))]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=at[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), at


def deep_leaves(texts: list[bytes], context: list[bool], window: int = WINDOW) -> Iterator[tuple[int, int, int]]:
    """(text, first window, windows) of the suffixes below tree nodes of ``window`` words and two leaves or more."""
    size = np.array([len(x) // 8 for x in texts], np.int64)
    words = np.unique(np.frombuffer(b"".join(texts), np.uint64), return_inverse=True)[1].astype(np.int64)
    at = np.cumsum(size) - size
    own = np.maximum(size - window + 1, 0)
    text = np.repeat(np.arange(len(texts)), own)
    first = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    start, leaves = at[text] + first, np.arange(len(text))
    node = np.zeros(len(text), np.int64)
    for depth in range(window):
        _, child, below = np.unique(node << 32 | words[start[leaves] + depth], return_inverse=True, return_counts=True)
        inner = below[child] > 1
        leaves, node = leaves[inner], child[inner].astype(np.int64)
        if not len(leaves):
            return
    leaves = np.sort(leaves)
    fresh = np.ones(len(leaves), bool)
    fresh[1:] = (np.diff(leaves) != 1) | (text[leaves[1:]] != text[leaves[:-1]])
    head = np.flatnonzero(fresh)
    for i, n in zip(head.tolist(), np.diff(np.append(head, len(leaves))).tolist()):
        yield int(text[leaves[i]]), int(first[leaves[i]]), n


def _apply(column: pa.Array, masks: list[np.ndarray]) -> list[pa.Array]:
    kept, total, gone = [], [], []
    for text, mask in zip(byte_texts(column), masks):
        words = text.split()
        total.append(len(words))
        gone.append(int(mask.sum()))
        if gone[-1]:
            words = [w for w, m in zip(words, mask.tolist()) if not m]
        kept.append(b" ".join(words))
    return [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())]


def drop_repeated_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``kept`` (the words left, joined by one blank), ``n_words`` and ``n_removed``.

    Words are runs of other than blank and \\t to \\r, compared as 64-bit
    hashes.  A word goes if a window of ``window`` words that covers it starts
    at another place too, in any document; windows are those of the input.  A
    null text has no words; a text of fewer words than a window loses none;
    rows with equal doc_id and text are separate documents; a null doc_id is
    kept.  Other columns are kept; kept, n_words and n_removed replace columns
    of those names.
    """
    fields = "kept string, n_words long, n_removed long"
    w = Windows(window, min(GRAM, 1 << (window.bit_length() - 1)), word_units, WIDE)
    docs = docs.drop("kept", "n_words", "n_removed")
    return cut(docs, w, lambda texts, context: deep_leaves(texts, context, window), _apply, fields, "word-repeats")


def substring_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of ``docs`` (doc_id, text)."""
    return drop_repeated_words(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs``, same columns, with repeated passages cut out of ``text``; untouched texts stay as they are."""
    names = docs.columns
    made = drop_repeated_words(docs.withColumnsRenamed({c: f"c_{c}" for c in names if c not in ("doc_id", "text")}))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    size = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("c_n_chars")) if "n_chars" in names else None
    return made.select(*(F.col("doc_id") if c == "doc_id" else text.alias("text") if c == "text"
                         else size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                         else F.col(f"`c_{c}`").alias(c) for c in names))


#: DuckDB SQL for the registered query.
ORACLE = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
windows as (
  select r, k, md5(array_to_string(list_slice(w, k, k + 34), ' ')) as h
  from (select r, w, unnest(generate_series(1, len(w) - 34)) as k from docs where len(w) >= 35)),
repeated as (select r, k from (select r, k, count(*) over (partition by h) as n from windows) where n > 1),
gone as (select distinct r, unnest(generate_series(k, k + 34)) as j from repeated),
words as (select r, j, w[j] as word from (select r, w, unnest(generate_series(1, len(w))) as j from docs)),
left_over as (
  select r, string_agg(word, ' ' order by j) as kept, count(*) as n
  from words anti join gone using (r, j) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from docs left join left_over using (r)
"""
