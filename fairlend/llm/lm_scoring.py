"""Operator 12: scores of a language model over classes of words (Brown's class bigrams).

A word's probability is that of its class after the class before, times that of
the word in its class.  Words get their classes by the exchange method.

* Words of the training texts are counted in full.  The most frequent ones, at
  most ``HEAD``, have ids that every task knows; all others, the tail, are
  carried as words and meet their counts and classes in joins.
* Texts become ids once.  Each round of the exchange is a pass over the ids in
  which a task adds up class counts around every fourth head word; the tasks'
  sums are merged by a tree, and blocks of words move in tasks of their own.
* Each tail word gets its class by one exchange against the head's classes,
  from all its occurrences.
* Transition and word probabilities count all training tokens.  A word outside
  them has what absolute discounting takes from the words of every class.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fairlend.llm.tables import stored
from fairlend.llm.text import CHUNK_BYTES, byte_texts, byte_view, chunks, in_batches
from fairlend.llm.word_classes import assigned, exchange, likelihood

#: Words with ids: bounds what tasks hold and what the driver sends them.
HEAD = 1 << 18
CLASSES = 64
#: Rounds of the exchange; a round moves every PARTS-th word.
ROUNDS, PARTS = 12, 4
#: Head words whose counts form a row between tasks.
BLOCK = 1024
#: Tasks' sums that one task adds up.
FAN = 64
#: Distinct words that a task counts before it hands them on.
DISTINCT = 600_000
#: Bytes from which a word is known by its digest, after a blank, which no word holds.
LONG = 64
#: Weight of the classes' own frequencies in a transition, in tokens.
PRIOR = 1.0
#: The word that ends each text.
END = b""
#: Slices of a power of two in the count histogram that sets the head's least count.
FINE = 32
#: Tokens that a task of the exchange counts at a time.
STEP = 1 << 21

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The text's words in lists of about CHUNK_BYTES, A-Z as a-z, very long ones as digests."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > CHUNK_BYTES:
            gap = _SPACE.search(text, at + CHUNK_BYTES)
            end = gap.start() if gap else end
        words = text[at:end].lower().split()
        if end - at >= LONG and words and max(map(len, words)) >= LONG:
            words = [w if len(w) < LONG else b" " + blake2b(w, digest_size=32).digest() for w in words]
        yield words
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the column text, one row per word and stretch of texts."""
    seen: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})
        seen.clear()
        return out

    for batch in batches:
        for part in chunks(batch, "text"):
            seen[END] += part.num_rows
            for text in byte_texts(part.column("text")):
                for words in words_of(text):
                    seen.update(words)
                    if len(seen) >= DISTINCT:
                        yield flush()
    if seen:
        yield flush()


@dataclass
class Vocabulary:
    """Counts of the training tokens: all of them, distinct ones, ones seen once and twice, and the head's words by id."""
    tokens: int
    distinct: int
    once: int
    twice: int
    words: list[bytes]
    counts: np.ndarray


def vocabulary(docs: DataFrame) -> Vocabulary:
    """Of the texts of ``docs`` that are not held out; END has id 0, the others follow by falling count."""
    parts = in_batches(docs.where("not held_out").select("text"), _counted, "word binary, n long")
    table = stored(parts.groupBy("word").agg(F.sum("n").alias("n")), "lm-words")
    tokens, distinct, once, twice, ends = table.agg(
        F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2),
        F.max(F.when(F.col("word") == END, F.col("n")))).first()
    # The least slice of counts from which on no more than HEAD words remain; slices are 32 to a power of two.
    part = F.floor(F.log2(F.col("n").cast("double")) * FINE).cast("int")
    sizes = table.where(F.col("word") != END).groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    left, least = HEAD - 1, None
    for row in sorted(sizes, reverse=True):
        if row.n > left:
            break
        left, least = left - row.n, row.part
    rows = [] if least is None else table.where((F.col("word") != END) & (part >= least)).collect()
    rows = sorted(((-r.n, bytes(r.word)) for r in rows))
    return Vocabulary(int(tokens or 0), distinct, once, twice, [END, *(w for _, w in rows)],
                      np.array([ends or 0, *(-n for n, _ in rows)], np.int64))


class _Ids(dict):
    """Word to id; what is not there has the id ``rest``."""

    def __init__(self, head: list[bytes]):
        super().__init__((w, i) for i, w in enumerate(head))
        self.rest = len(head)

    def __missing__(self, word: bytes) -> int:
        return self.rest


def _coded(head: list[bytes], fields: list[pa.Field]):
    """ids (32 bits each, END last, ``len(head)`` for a tail word) and the tail's words, in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(head)
        rest, get = len(head), ids.__getitem__
        for batch in batches:
            for part in chunks(batch, "text"):
                coded, tails = [], []
                for text in byte_texts(part.column("text")):
                    pieces, tail = [], []
                    for words in words_of(text):
                        piece = np.fromiter(map(get, words), np.int32, len(words))
                        tail += [words[i] for i in np.flatnonzero(piece == rest)]
                        pieces.append(piece)
                    coded.append(np.concatenate([*pieces, np.zeros(1, np.int32)]).tobytes())
                    tails.append(tail)
                keep = [part.column(f.name).cast(f.type) for f in fields]
                yield pa.record_batch([*keep, pa.array(coded, pa.binary()), pa.array(tails, pa.list_(pa.binary()))],
                                      names=[*(f.name for f in fields), "ids", "tail"])
    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the column and where each row's begin (with the end of the last)."""
    data, at = byte_view(column)
    return data[at[0]:at[-1]].view(np.int32), (at - at[0]) // 4


def _before(ids: np.ndarray) -> np.ndarray:
    """The id before each: a row's first follows an END, which is also what the row before ends with."""
    return np.concatenate([np.zeros(1, ids.dtype), ids[:-1]])


def _around(classes: np.ndarray, turn: int | None):
    """(block, cells): sums of one task, a row per block of head words, and the class pairs as block -1."""
    head, k = len(classes) - 1, CLASSES + 1
    width = 2 * k + 1
    size = -(-head // PARTS) if turn is not None else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, cells = np.zeros(k * k, np.int64), np.zeros(size * width, np.int64)
        start = np.full(head + 1, -1, np.int64)  # of a word's cells; -1 for words of other rounds and the tail
        if turn is not None:
            mine = np.arange(turn, head, PARTS)
            start[mine] = mine // PARTS * width

        def count(ids: np.ndarray) -> None:
            nonlocal pairs, cells
            new = classes[ids].astype(np.int64)
            old = np.concatenate([classes[:1].astype(np.int64), new[:-1]])
            pairs += np.bincount(old * k + new, minlength=k * k)
            if turn is None:
                return
            at, twin = start[ids], _before(ids) == ids
            here = np.flatnonzero(at >= 0)
            # before a word, or the word itself; after it, the next text's first word standing after this one's END
            codes = [at[here] + np.where(twin[here], 2 * k, old[here])]
            first, follow = start[_before(ids)], ~twin
            here = np.flatnonzero((first >= 0) & follow)
            codes.append(first[here] + k + new[here])
            cells += np.bincount(np.concatenate(codes), minlength=len(cells))

        held, have = [], 0
        for batch in batches:
            ids, _ = _flat(batch.column(0))
            held, have = held + [ids], have + len(ids)
            if have >= STEP:
                count(np.concatenate(held))
                held, have = [], 0
        if have:
            count(np.concatenate(held))
        yield pa.record_batch({"block": pa.array([-1], pa.int32()), "cells": pa.array([_packed(pairs)], pa.binary())})
        for at in range(0, size, BLOCK):
            part = cells[at * width:(at + BLOCK) * width]
            if part.any():
                yield pa.record_batch({"block": pa.array([at // BLOCK], pa.int32()),
                                       "cells": pa.array([_packed(part)], pa.binary())})
    return run


def _packed(cells: np.ndarray) -> bytes:
    """Counts as 32-bit numbers, after a byte that says so, or as 64-bit ones if they need it."""
    small = cells.max(initial=0) < 1 << 31
    return (b"4" + cells.astype(np.int32).tobytes()) if small else b"8" + cells.tobytes()


def _unpacked(cells: bytes) -> np.ndarray:
    kind = np.int32 if cells[:1] == b"4" else np.int64
    return np.frombuffer(cells, kind, offset=1).astype(np.int64)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the cells of consecutive rows with equal block and group."""
    at, total = None, None

    def done():
        return pa.record_batch({"block": pa.array([at[0]], pa.int32()), "task": pa.array([at[1]], pa.int64()),
                                "cells": pa.array([_packed(total)], pa.binary())})

    for batch in batches:
        for block, group, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                       byte_texts(batch.column(2))):
            if (block, group) == at:
                total += _unpacked(cells)
            else:
                if at is not None:
                    yield done()
                at, total = (block, group), _unpacked(cells)
    if at is not None:
        yield done()


def merged(parts: DataFrame, tasks: int) -> DataFrame:
    """(block, task, cells) with one row per block: a tree in which a task adds up FAN rows of a block at most."""
    while True:
        group = F.expr(f"task div {FAN}")
        parts = parts.select("block", group.alias("task"), "cells").repartition("block", "task")
        parts = in_batches(parts.sortWithinPartitions("block", "task"), _added, "block int, task long, cells binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            return parts


def _moved(classes: np.ndarray, pairs: np.ndarray, turn: int):
    """(block, classes) of each block's words after their moves."""
    k = CLASSES + 1
    mine = classes[:-1][turn::PARTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                rows = _unpacked(cells).reshape(-1, 2 * k + 1)
                own = mine[block * BLOCK:(block + 1) * BLOCK]
                new = exchange(rows[:len(own), :k], rows[:len(own), k:2 * k], rows[:len(own), 2 * k], own, pairs, CLASSES)
                yield pa.record_batch({"block": pa.array([block], pa.int32()),
                                       "classes": pa.array([new.astype(np.uint8).tobytes()], pa.binary())})
    return run


def head_classes(coded: DataFrame, head: int, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each head id and, last, CLASSES for the tail; matrix of class pairs), the best of all rounds.

    ``coded``: the column ids of the training texts.  A round moves every
    PARTS-th word, all blocks at once; should the likelihood fall by it, an
    earlier round's classes are the result.
    """
    cores = coded.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, tokens >> 28)
    rows = coded.coalesce(tasks)
    k = CLASSES + 1
    classes = np.append(np.arange(head) % CLASSES, CLASSES).astype(np.uint8)
    best = None
    for turn in range(ROUNDS + 1):
        part = turn % PARTS if turn < ROUNDS else None
        sums = in_batches(rows, _around(classes, part), "block int, cells binary")
        sums = stored(merged(sums.withColumn("task", F.spark_partition_id().cast("long")).select("block", "task", "cells"),
                             tasks), "lm-around")
        cells = sums.where("block = -1").first()
        pairs = _unpacked(bytes(cells.cells)).reshape(k, k) if cells else np.zeros((k, k), np.int64)
        value = likelihood(pairs)
        if best is None or value > best[0]:
            best = value, classes.copy(), pairs
        if part is None:
            return best[1], best[2]
        moved = in_batches(sums.where("block >= 0").select("block", "cells"), _moved(classes, pairs, part),
                           "block int, classes binary")
        for block, new in moved.collect():  # at most HEAD / PARTS bytes in all
            mine = np.arange(part, head, PARTS)[block * BLOCK:(block + 1) * BLOCK]
            classes[mine] = np.frombuffer(new, np.uint8)


def _tails(classes: np.ndarray, keys: int):
    """(row, held_out, pos, near, word): a row per tail word; near is 256 times the class before plus the class after."""
    rest = len(classes) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = _flat(batch.column("ids"))
            at = np.flatnonzero(ids == rest)
            row = np.searchsorted(starts, at, "right") - 1
            near = classes[_before(ids)[at]].astype(np.int32) * 256 + classes[ids[at + 1]]
            keep = [batch.column(c).take(pa.array(row)) for c in range(keys)]
            yield pa.record_batch([*keep, pa.array((at - starts[row]).astype(np.int32)), pa.array(near),
                                   batch.column("tail").flatten()],
                                  names=[*batch.schema.names[:keys], "pos", "near", "word"])
    return run


def whole_keys(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, first row of each key, and their number) of rows that come sorted by ``key``; no key is torn between two."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        last = pc.sum(pc.equal(rows.column(key), rows.column(key)[-1])).as_py()
        if last < len(rows):
            yield _keyed(rows.slice(0, len(rows) - last), key)
        held = rows.slice(len(rows) - last)
    if held is not None:
        yield _keyed(held, key)


def _keyed(rows: pa.Table, key: str) -> tuple[pa.RecordBatch, np.ndarray]:
    batch = rows.combine_chunks().to_batches()[0]
    code = batch.column(key).dictionary_encode().indices.to_numpy()
    return batch, np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))


def _classed(pairs: np.ndarray):
    """(word, n, class) from (word, near, n) sorted by word: one exchange for each word."""
    k = len(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, starts in whole_keys(batches, "word"):
            words = len(starts) - 1
            word = np.repeat(np.arange(words), np.diff(starts))
            near, n = (part.column(c).to_numpy().astype(np.int64) for c in ("near", "n"))
            own = assigned(word, near // 256 * k + near % 256, n, words, pairs, CLASSES)
            yield pa.record_batch({"word": part.column("word").take(pa.array(starts[:-1])), "n": pa.array(
                np.add.reduceat(n, starts[:-1])), "class": pa.array(own.astype(np.int32))})
    return run


def tail_classes(tails: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(word, n, class) of every tail word of the training texts, from all its occurrences.

    A word's neighbours are pairs of classes, at most (CLASSES + 1) ** 2 rows;
    no tail word is more frequent than the rarest word of the head.
    """
    seen = (tails.where("not held_out").select("word", "near").repartition("word")
            .groupBy("word", "near").agg(F.count("*").alias("n")).sortWithinPartitions("word"))
    return in_batches(seen, _classed(pairs), "word binary, n long, class int")


_ENTRY = "struct<pos:int,near:int,class:int,n:long>"


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, held_out, tail: list of the other columns) from rows sorted by row and place."""
    for part, starts in whole_keys(batches, "row"):
        first = pa.array(starts[:-1])
        entries = pa.StructArray.from_arrays([part.column(c) for c in ("pos", "near", "class", "n")], ["pos", "near", "class", "n"])
        yield pa.record_batch([part.column("row").take(first), part.column("held_out").take(first),
                               pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), entries)],
                              names=["row", "held_out", "tail"])


def tail_lists(tails: DataFrame, known: DataFrame) -> DataFrame:
    """(row, held_out, tail) of the rows that have tail words: each with its count and class, by place."""
    found = tails.join(known, "word", "left").select(
        "row", "held_out", "pos", "near", F.coalesce("class", F.lit(CLASSES)).alias("class"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return in_batches(found.repartition("row").sortWithinPartitions("row", "pos"), _listed,
                      f"row long, held_out boolean, tail array<{_ENTRY}>")


def _sequences(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of the tail words of all rows, by row and place: row, class before (or after a tail word, its class), class,
    class after, n, and whether the next word is a tail word as well."""
    lists = batch.column("tail")
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten()
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos, near, own, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4))
    joined = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1)
    old, new = near // 256, near % 256
    old[1:][joined] = own[:-1][joined]
    return row, old, own, new, n, np.append(joined, False)


def _tail_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n) of the pairs of classes that a tail word is part of."""
    k = CLASSES + 1
    total = np.zeros(k * k, np.int64)
    for batch in batches:
        _, old, own, new, _, joined = _sequences(batch)
        code = np.concatenate([old * k + own, (own * k + new)[~joined]])
        total += np.bincount(code, minlength=k * k)
    at = np.flatnonzero(total)
    yield pa.record_batch({"pair": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})


@dataclass
class ClassModel:
    """log10 probabilities: ``step[a, b]`` of class b after class a, and row CLASSES after an unknown word;
    ``unknown[a]`` of an unknown word; ``size[c]`` of the tokens of a class; and the discount of a word's count."""
    step: np.ndarray
    unknown: np.ndarray
    size: np.ndarray
    discount: float
    voc: Vocabulary
    classes: np.ndarray
    tail: DataFrame | None = None  # (word, n, class) of the training words without an id

    def word(self, n, own):
        """log10 probability of a word with count ``n`` in its class."""
        return np.log10(n - self.discount) - self.size[own]

    def base(self, n):
        """log10 probability of a word with count ``n`` by counts alone."""
        return np.log10((n + 0.1) / (self.voc.tokens + 0.1 * (self.voc.distinct + 1)))


def class_model(pairs: np.ndarray, kinds: np.ndarray, voc: Vocabulary, classes: np.ndarray) -> ClassModel:
    """The model of ``pairs`` of classes of all training tokens, and ``kinds``, the distinct words of each class.

    Every word's count is discounted by n1 / (n1 + 2 n2) (one more each, so that it lies between 0 and 1);
    a class gives what its words lose to one unknown word.  All words and the unknown one add up to 1
    after any class.
    """
    discount = (voc.once + 1) / (voc.once + 2 * voc.twice + 2)
    size = pairs.sum(axis=0).astype(np.float64)
    own = size / size.sum()
    step = (pairs + PRIOR * own) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
    step = np.vstack([step, own])
    lost = np.divide(discount * kinds, size, out=np.zeros(CLASSES), where=size > 0)
    with np.errstate(divide="ignore"):
        return ClassModel(np.log10(step), np.log10(step @ lost), np.log10(size), discount, voc, classes)


def _head_scores(model: ClassModel, keys: int):
    """Keys, n_tokens, n_known, base_score, score of each row by its head words and the pairs of head words."""
    ids_base = np.append(model.base(model.voc.counts), 0.0)
    own = model.classes[:-1].astype(np.int64)
    ids_word = np.append(model.word(model.voc.counts, own), 0.0)
    step = np.zeros((CLASSES + 1, CLASSES + 1))  # 0 beside a tail word
    step[:CLASSES, :CLASSES] = model.step[:CLASSES]
    rest = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, starts = _flat(batch.column(keys))
            c = model.classes[ids]
            old = _before(c)
            old[0] = model.classes[0]
            first = starts[:-1]
            yield pa.record_batch([
                *batch.columns[:keys], pa.array(np.diff(starts)), pa.array(np.add.reduceat((ids < rest).astype(np.int64), first)),
                pa.array(np.add.reduceat(ids_base[ids], first)),
                pa.array(np.add.reduceat(ids_word[ids] + step[old, c], first))],
                names=[*batch.schema.names[:keys], "n_tokens", "n_known", "base_score", "score"])
    return run


def _tail_scores(model: ClassModel):
    """(row, tail_known, tail_base, tail_score): what a row's tail words add."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, old, own, new, n, joined = _sequences(batch)
            known = n > 0
            at = np.minimum(own, CLASSES - 1)
            with np.errstate(invalid="ignore"):  # an empty class, which no known word has
                inside = model.step[old, at] + model.word(np.maximum(n, 1), at)
            score = np.where(known, inside, model.unknown[old])
            score = score + np.where(joined, 0.0, model.step[own, np.minimum(new, CLASSES - 1)])
            first = np.flatnonzero(np.diff(row, prepend=-1))  # every row here has a tail word
            yield pa.record_batch({
                "row": batch.column("row"), "tail_known": pa.array(np.add.reduceat(known.astype(np.int64), first)),
                "tail_base": pa.array(np.add.reduceat(model.base(n), first)),
                "tail_score": pa.array(np.add.reduceat(score, first))})
    return run


def held_out(doc_id: str) -> Column:
    """Whether crc32 of the id's text is divisible by 10; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def score_texts(docs: DataFrame) -> tuple[DataFrame, ClassModel | None]:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) for each row of ``docs`` (doc_id, held_out, text), and
    the model, learned from the rows that are not held out (None where there are none).

    A null text is empty: its end alone is scored.  Repeated rows count as often
    as they are there.  Without a row to learn from, every token is the one
    unknown word, whose probability is 1.
    """
    voc = vocabulary(docs)
    if not voc.tokens:
        n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
        zero = F.lit(0.0)
        return docs.select("doc_id", "held_out", n.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"),
                           zero.alias("base_score"), zero.alias("score")), None
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out",
                       F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [pa.field("row", pa.int64()), pa.field("doc_id", _arrow(docs, "doc_id")), pa.field("held_out", pa.bool_())]
    coded = stored(in_batches(rows, _coded(voc.words, fields),
                              f"row long, doc_id {kind}, held_out boolean, ids binary, tail array<binary>"), "lm-ids")
    classes, pairs = head_classes(coded.where("not held_out").select("ids"), len(voc.words), voc.tokens)

    tails = stored(in_batches(coded.where(F.size("tail") > 0).select("row", "held_out", "ids", "tail"), _tails(classes, 2),
                              "row long, held_out boolean, pos int, near int, word binary"), "lm-tails")
    known = stored(tail_classes(tails, pairs), "lm-tail-words")
    lists = stored(tail_lists(tails, known), "lm-tail-lists")

    model = _model(lists, known, classes, pairs, voc)
    by_head = in_batches(coded.select("row", "doc_id", "held_out", "ids"), _head_scores(model, 3),
                         f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    by_tail = in_batches(lists.select("row", "tail"), _tail_scores(model),
                         "row long, tail_known long, tail_base double, tail_score double")
    model.tail = known
    both = by_head.join(by_tail, "row", "left")
    return both.select("doc_id", "held_out", "n_tokens",
                       (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
                       (F.col("base_score") + F.coalesce("tail_base", F.lit(0.0))).alias("base_score"),
                       (F.col("score") + F.coalesce("tail_score", F.lit(0.0))).alias("score")), model


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)


def _model(lists: DataFrame, known: DataFrame, classes: np.ndarray, pairs: np.ndarray, voc: Vocabulary) -> ClassModel:
    """Pairs of head words as the exchange counted them, and all pairs with a tail word; (CLASSES + 1)^2 numbers arrive."""
    k = CLASSES + 1
    whole = pairs.copy()
    whole[CLASSES], whole[:, CLASSES] = 0, 0
    found = in_batches(lists.where("not held_out").select("tail"), _tail_pairs, "pair int, n long")
    for pair, n in found.groupBy("pair").agg(F.sum("n")).collect():
        whole[pair // k, pair % k] += n
    kinds = np.bincount(classes[:-1], minlength=CLASSES).astype(np.float64)
    for own, n in known.groupBy("class").count().collect():
        kinds[own] += n
    return class_model(whole[:CLASSES, :CLASSES], kinds, voc, classes)


def scoring_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of ``docs``.

    Rows whose id's crc32 is divisible by 10 are held out, the others taught.
    ``perplexity`` is that of the row's tokens under the class model.  Null
    texts are empty, null ids are taught; an empty table gives no rows;
    columns beside doc_id and text are ignored.
    """
    rows, model = score_texts(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"))
    tokens = F.lit(model.voc.tokens if model else 0).cast("long")
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", tokens.alias("train_tokens"), "base_score", "score",
                       F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
