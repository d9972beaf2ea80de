"""Operator 4: toxicity by bags of subword embeddings and a linear softmax.

A word's vector is the mean of the vectors of its character n-grams and of the
word itself, hashed to buckets; a text's vector is the mean over its words; a
softmax on it gives the class.  Bucket vectors and softmax are trained
together in numpy, in a task, on a bounded sample of labelled rows, so misspellings that
were never seen share the n-grams of those that were.  As all of this is
linear, a trained model is one number per bucket and an intercept.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from fairlend.llm.text import byte_view, chunks, in_batches, Memo, strings

#: Training rows of each label at most.
TOXIC_ROWS, CLEAN_ROWS = 2_500, 5_000
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4, 5)
STEPS, BATCH, RATE, GAIN, SEED = 300, 128, 1.0, 30.0, 7
#: Neutral words that every mean counts besides a text's own, so that one odd word does not decide a short text.
PAD = 15
#: Words a worker remembers per generation.
MEMO = 150_000
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))


def is_held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id's text divisible by 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5)) == 0


def word_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, ends): the n-gram buckets of each word in turn, and where each word's end."""
    marked = [f"<{w.lower().strip(_EDGES)}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    stops = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(stops, sizes) - np.arange(len(codes))  # characters up to the word's end
    owners, buckets = [], []
    rolling = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        shifted = codes[n - 1:]
        rolling = rolling[:len(shifted)] * np.uint64(0x100000001B3) + shifted
        if n in GRAMS:
            here = np.flatnonzero(left[:len(shifted)] >= n)
            owners.append(word[here])
            buckets.append(_bucket(rolling[here] + np.uint64(n)))
    whole = np.add.reduceat(codes * (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)),
                            stops - sizes) if len(words) else np.zeros(0, np.uint64)
    owners.append(np.arange(len(words)))
    buckets.append(_bucket(whole))
    owner, bucket = np.concatenate(owners), np.concatenate(buckets)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.cumsum(np.bincount(owner, minlength=len(words)))


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return ((h ^ h >> np.uint64(29)) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    """A bucket's share of a word's logit, and the intercept."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[str]) -> list[float]:
        buckets, ends = word_grams(words)
        sizes = np.diff(ends, prepend=0)
        return (np.add.reduceat(self.weights[buckets], ends - sizes) / sizes).tolist()


def text_bag(text: str, together: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares): the weights with which bucket vectors add up to the vector of the whole text."""
    count = Counter(text.split())
    words, total = list(count), np.zeros(BUCKETS)
    for k in range(0, len(words), together):
        part = words[k:k + together]
        grams, ends = word_grams(part)
        sizes = np.diff(ends, prepend=0)
        share = np.array([count[w] for w in part]) / ((count.total() + PAD) * sizes)
        total += np.bincount(grams, np.repeat(share, sizes), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), total[at].astype(np.float32)


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """``fit`` on the bags of ``texts``."""
    return fit([text_bag(x) for x in texts], toxic)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray) -> Model:
    """Bucket vectors and softmax together, by Adagrad over shuffled batches of texts (see ``text_bag``)."""
    toxic = np.asarray(toxic, np.int64)
    if not len(bags) or not toxic.any():
        return Model(np.zeros(BUCKETS), -9.0)
    if toxic.all():
        return Model(np.zeros(BUCKETS), 9.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    seen = [np.full_like(a, 1e-6) for a in (vectors, out, bias)]
    place = np.zeros(BUCKETS, np.int64)
    epochs = -(-STEPS * BATCH // len(bags))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            pick = order[k:k + BATCH]
            all_buckets = np.concatenate([bags[i][0] for i in pick])
            part = np.concatenate([bags[i][1] for i in pick]) * np.float32(GAIN)
            owner = np.repeat(np.arange(len(pick)), [len(bags[i][0]) for i in pick])
            if not len(all_buckets):
                continue
            bucket = np.flatnonzero(np.bincount(all_buckets, minlength=BUCKETS))
            place[bucket] = np.arange(len(bucket))
            used = place[all_buckets]
            own_vectors = vectors[bucket]
            text = np.stack([np.bincount(owner, part * own_vectors[used, d], len(pick)) for d in range(DIM)], 1)
            logit = text @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), toxic[pick]] -= 1
            p /= len(pick)
            back = p @ out.T
            step = np.stack([np.bincount(used, back[owner, d] * part, len(bucket)) for d in range(DIM)], 1).astype(np.float32)
            for where, grad, held, total in ((bucket, step, vectors, seen[0]), (slice(None), text.T @ p, out, seen[1]),
                                             (slice(None), p.sum(0), bias, seen[2])):
                total[where] += grad * grad
                held[where] -= rate * grad / np.sqrt(total[where])
    return Model((vectors @ (out[:, 1] - out[:, 0]) * GAIN).astype(np.float64), float(bias[1] - bias[0]))


def learn_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the rows of ``labels`` (doc_id, toxic) that are not held out.

    At most ``TOXIC_ROWS`` and ``CLEAN_ROWS`` ids of each label are used, the
    first by a hash of the id, with their whole texts; repeated label rows
    count once.  Tasks reduce each text to its bag, which has at most
    ``BUCKETS`` entries of six bytes however long the text is; one task trains
    on these, and the driver gets a number per bucket.  Labels other than 0 and 1 and rows without an id are ignored;
    without toxic rows every score is near 0.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    sample = None
    for value, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)):
        part = usable.where(F.col("toxic") == value).select("doc_id").distinct().orderBy(*order).limit(n)
        part = part.withColumn("toxic", F.lit(value))
        sample = part if sample is None else sample.union(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, "text"):
                made = [text_bag(x) for x in strings(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("toxic"),
                     *(pa.array([x[i].tobytes() for x in made], pa.binary()) for i in (0, 1))], names)

    names = ["doc_id", "toxic", "buckets", "shares"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    bags = (docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id")
            .select("doc_id", "toxic", "text")
            .transform(in_batches, run, f"doc_id {kind}, toxic int, buckets binary, shares binary"))
    found = in_batches(bags.repartition(1), _fitted, "weights binary, bias double").first()
    return Model(np.frombuffer(found.weights, np.float64), found.bias) if found else fit([], np.zeros(0))


def _views(batches: list[pa.RecordBatch], column: str, kind: type) -> list[np.ndarray]:
    """The arrays of a binary column, not copied."""
    out = []
    for batch in batches:
        data, at = byte_view(batch.column(column))
        out += [np.frombuffer(data, kind, (b - a) // np.dtype(kind).itemsize, a) if b > a else np.zeros(0, kind)
                for a, b in zip(at.tolist(), at[1:].tolist())]
    return out


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all bags of the sample, in an order that does not depend on the tasks they come from."""
    held = [b for b in batches if b.num_rows]
    if held:
        rows = pa.Table.from_batches(held)
        order = pc.sort_indices(rows, [(x, "ascending") for x in rows.column_names]).to_pylist()
        bags = list(zip(_views(held, "buckets", np.uint16), _views(held, "shares", np.float32)))
        bags = [bags[i] for i in order]
        model = fit(bags, rows["toxic"].to_numpy()[order])
        yield pa.record_batch({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": pa.array([model.bias])})


def score_toxicity(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: the probability that ``text`` is toxic, from all its words.

    A null text is empty, and an empty text has the intercept's score.  Other
    columns are kept; ``out`` replaces a column of that name.
    """
    rest = [c for c in docs.columns if c != out]
    docs = docs.select(*(F.col(f"`{c}`") for c in rest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(model.words, MEMO)
        for whole in batches:
            for batch in chunks(whole, "text"):
                split = [x.split() for x in strings(batch.column("text"))]
                logit = np.full(len(split), model.bias)
                memo.fill(set().union(*split))
                for i, words in enumerate(split):
                    if words:
                        logit[i] += sum(map(memo.__getitem__, words)) / (len(words) + PAD)
                score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*rest, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.transform(in_batches, run, f"{fields}, `{out}` double")


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from a score of 0.5) of every row of ``docs`` (doc_id, text).

    A null doc_id is kept; repeated rows get equal scores; other columns are
    ignored; an empty table gives no rows.
    """
    scored = score_toxicity(docs.select("doc_id", "text"), learn_toxicity(docs, labels))
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
