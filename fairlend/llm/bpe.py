"""Operator 8: byte-level BPE encoding and decoding.

A piece of a text (see ``pretokens``) is encoded by a queue of merge ranks:
one bucket per rank holds the positions in a linked list of tokens at which a
pair of that rank begins, a two-level bitmap marks the buckets in use, and
find-first-set picks the lowest rank.  An entry whose pair has changed since
is stale and skipped.  A merge costs a few steps whatever the piece's length,
so a piece of millions of bytes takes time in proportion to its size.

Short pieces of equal length, which most are, take their merges together: each
is a row of tokens, and a round makes the lowest merge of every row, so that
the rows stay equally long; those without a merge left are done.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fairlend.llm.pretokens import by_pieces
from fairlend.llm.text import byte_view, chunks, in_batches, kept, Memo, strings

#: Pieces a worker remembers per generation.
MEMO = 150_000
#: A bitmap word has 2 ** SHIFT bits; two levels hold 4 ** SHIFT ranks.
SHIFT = 8
#: At least ``FEW`` pieces of a length of ``SHORT`` bytes at most are merged together, about ``CELLS`` bytes at a time.
FEW, SHORT, CELLS = 16, 128, 1 << 18
#: The rank of a pair that makes no token.
NONE = np.iinfo(np.int64).max


class RankQueue:
    """Positions by rank: lowest rank first, then lowest position.  Empty again after each piece."""

    def __init__(self, n_ranks: int):
        self.shift = SHIFT
        while 1 << 2 * self.shift < n_ranks:
            self.shift += 1
        self.mask = (1 << self.shift) - 1
        self.bit = [1 << i for i in range(self.mask + 1)]
        self.top, self.words = 0, [0] * (self.mask + 1)
        self.buckets: list[list[int]] = [[] for _ in range(n_ranks)]

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets[rank]
        if bucket:
            heappush(bucket, position)
            return
        bucket.append(position)
        word = rank >> self.shift
        self.words[word] |= self.bit[rank & self.mask]
        self.top |= self.bit[word]

    def pop(self) -> tuple[int, int] | None:
        top = self.top
        if not top:
            return None
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        low = bits & -bits
        rank = (word << self.shift) + low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        bits ^= low
        self.words[word] = bits
        if not bits:
            self.top = top ^ self.bit[word]
        return rank, bucket.pop()


def encode_piece(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one piece: the piece itself if it is a token, else merges by rank, leftmost first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, get, push, pop = len(piece), ranks.get, queue.push, queue.pop
    after, before = list(range(1, n + 2)), list(range(-1, n))
    pair = [get(piece[i:i + 2], -1) for i in range(n - 1)]  # rank of the pair that begins here, -1: none
    pair.append(-1)
    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    while (found := pop()) is not None:
        rank, i = found
        if pair[i] != rank:
            continue  # stale
        j = after[i]
        k = after[i] = after[j]
        pair[j] = -1
        if k < n:
            before[k] = i
            rank = pair[i] = get(piece[i:after[k]], -1)
            if rank >= 0:
                push(rank, i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            rank = pair[h] = get(piece[h:k], -1)
            if rank >= 0:
                push(rank, h)
    out, i = [], 0
    while i < n:
        k = after[i]
        out.append(ranks[piece[i:k]])
        i = k
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    def read() -> dict[bytes, int]:
        with open(path, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}

    return kept("bpe", ("ranks", path), read)


class PieceEncoder:
    """Ids of pieces, as little-endian unsigned 32-bit integers; short ones of equal length are merged together."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.size = ranks, max(ranks.values()) + 1
        self.queue = RankQueue(self.size)
        # A pair is looked up by two ids: every byte must have one, and no two tokens the same.
        self.together = all(bytes([x]) in ranks for x in range(256)) and len(set(ranks.values())) == len(ranks)
        if self.together:
            self.bytes = np.array([ranks[bytes([x])] for x in range(256)], np.int64)
            pairs = {ranks[x[:k]] * self.size + ranks[x[k:]]: rank for x, rank in ranks.items()
                     for k in range(1, len(x)) if x[:k] in ranks and x[k:] in ranks} | {NONE: NONE}
            keys = np.fromiter(pairs, np.int64, len(pairs))
            order = np.argsort(keys)
            self.pairs, self.made = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token that two tokens make."""
        key = left * self.size + right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.made[at], NONE)

    def _alike(self, pieces: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row numbers, their ids) of the rows of a matrix of bytes, in the order in which they are done."""
        rows, ids = np.arange(len(pieces)), self.bytes[pieces]
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        while rank.shape[1]:
            at = rank.argmin(1)  # the lowest, leftmost
            best = rank[np.arange(len(at)), at]
            more = best != NONE
            if not more.all():
                yield rows[~more], ids[~more]
                rows, ids, rank, at, best = rows[more], ids[more], rank[more], at[more], best[more]
            if not len(rows):
                return
            every, column = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            ids = np.where(column <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[every, at] = best
            rank = np.where(column[:-1] < at[:, None], rank[:, :-1], rank[:, 1:])
            k = np.flatnonzero(at > 0)
            rank[k, at[k] - 1] = self._rank(ids[k, at[k] - 1], best[k])
            k = np.flatnonzero(at < rank.shape[1])
            rank[k, at[k]] = self._rank(best[k], ids[k, at[k] + 1])
        yield rows, ids

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        out, lengths = [b""] * len(pieces), {}
        for i, x in enumerate(pieces):
            whole = self.ranks.get(x)
            if whole is None:
                lengths.setdefault(len(x), []).append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        for length, alike in lengths.items():
            if not self.together or length > SHORT or len(alike) < FEW:
                for i in alike:
                    out[i] = np.array(encode_piece(pieces[i], self.ranks, self.queue), "<u4").tobytes()
                continue
            step = CELLS // length
            for start in range(0, len(alike), step):
                part = alike[start:start + step]
                together = np.frombuffer(b"".join([pieces[i] for i in part]), np.uint8).reshape(len(part), length)
                for rows, ids in self._alike(together):
                    raw, width = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
                    for k, i in enumerate(rows.tolist()):
                        out[part[i]] = raw[k * width:(k + 1) * width]
        return out


def _tokens(path: str) -> pa.Array:
    """The bytes of every id, null where the vocabulary has none."""
    ranks = load_ranks(path)
    table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())


def encode_bpe(df: DataFrame, ranks_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a binary column ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers.

    ``ranks_path`` names a vocabulary file that every worker can read.  A null
    or empty text has no ids.  All other columns are kept as they are; ``out``
    replaces a column of that name.
    """
    rest = [c for c in df.columns if c != out]
    df = df.select(*(F.col(f"`{c}`") for c in rest))
    return df.transform(in_batches, _encoding(ranks_path, text, rest, out), f"{_ddl(df)}, `{out}` binary" if rest else f"`{out}` binary")


def _encoding(ranks_path: str, text: str, rest: list[str], out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = kept("bpe", ("memo", ranks_path), lambda: Memo(PieceEncoder(load_ranks(ranks_path)), MEMO))
        for whole in batches:
            for batch in chunks(whole, text):
                ids = by_pieces(strings(batch.column(text)), memo)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*rest, out])

    return run


def decode_bpe(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with a binary column ``out``: the bytes that the ids in the binary column ``ids`` stand for.

    Null or empty ids give empty bytes.  An id that the vocabulary lacks raises.
    """
    rest = [c for c in df.columns if c != out]
    df = df.select(*(F.col(f"`{c}`") for c in rest))
    return df.transform(in_batches, _decoding(ranks_path, ids, rest, out), f"{_ddl(df)}, `{out}` binary")


def _decoding(ranks_path: str, ids: str, rest: list[str], out: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = kept("bpe", ("tokens", ranks_path), lambda: _tokens(ranks_path))
        for whole in batches:
            for batch in chunks(whole, ids):
                data, at = byte_view(batch.column(ids))
                data, at = data[at[0]:at[-1]], at - at[0]
                if (at % 4).any():
                    raise ValueError("ids are 4 bytes each")
                tokens = table.take(pa.array(np.frombuffer(data.tobytes(), "<u4")))
                if tokens.null_count:
                    raise IndexError("an id that the vocabulary lacks")
                raw, ends = byte_view(tokens)
                raw, ends = memoryview(raw), ends[at // 4].tolist()
                decoded = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*rest, out])

    return run


def round_trip_bpe(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded): ``encode_bpe`` of ``text``, then ``decode_bpe`` of its ids, one Python worker a task for both."""
    encode, decode = _encoding(ranks_path, "text", ["doc_id", "text"], "ids"), _decoding(ranks_path, "ids", ["doc_id", "ids"], "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return decode(batch.select(["doc_id", "ids"]) for batch in encode(batches))

    docs = docs.select("doc_id", "text")
    return docs.transform(in_batches, run, f"{_ddl(docs.select('doc_id'))}, ids binary, decoded binary")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def bpe_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of ``docs`` (doc_id, text).

    A null text counts as empty; a null doc_id is kept; repeated rows give one
    row each; other columns of ``docs`` are ignored.
    """
    return round_trip_bpe(docs, ranks_path).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
