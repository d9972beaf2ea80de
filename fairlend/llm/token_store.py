"""Operator 10: token ids as files of Huffman-coded blocks.

``encode_hub`` tokenizes with a tokenizer file of the ``tokenizers`` library,
``write_token_files`` codes all ids by a canonical length-limited Huffman code
of their counts over the whole input and writes them in document order, and
``read_token_files`` gives them back.

File format (a folder):

``code/``    Parquet, one row ``lengths binary``: byte i is the code length of
             id i (0: never occurs).  The canonical code follows from it.
``blocks/``  Parquet, one row per segment of whole documents, about
             ``SEGMENT`` ids: ``part``, ``segment`` (ascending with the
             documents), ``before`` (ids of the part's earlier segments), ``n_ids``,
             ``payload`` (the codes, first bit highest),
             ``checkpoints`` (little-endian int64: the bit offset of every
             ``BLOCK`` ids, at which decoding can begin), ``doc_ids``,
             ``doc_sizes`` (ids of each document).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairlend.llm.huffman import Code, code_lengths
from fairlend.llm.pretokens import by_pieces
from fairlend.llm.text import byte_view, chunks, in_batches, kept, Memo, strings
from fairlend.plans.session import shared_dir

BLOCK = 512
SEGMENT = 1 << 19
#: Pieces that are encoded together, and that a worker remembers per generation.
TOGETHER, MEMO = 1024, 400_000
_IDS, _ID_ROWS = ["doc_id", "tie", "ids", "wide"], "doc_id long, tie long, ids binary, wide boolean"
_BLOCKS = ("part int, segment int, before long, n_ids long, payload binary, checkpoints binary, "
           "doc_ids array<bigint>, doc_sizes array<bigint>")


def id_code(largest: int) -> str:
    """How ids up to ``largest`` are held before they are coded: little-endian unsigned, 16 bits if they fit."""
    return "<u2" if largest < 1 << 16 else "<u4"


class HubEncoder:
    """Ids by a tokenizer file, as ``code``; pieces that a worker remembers do not go through the library again."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code = id_code(size - 1)
        self.width = np.dtype(self.code).itemsize
        # A byte-level token has one character per byte.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.memo = Memo(self._make, MEMO)

    def _make(self, keys: list[bytes]) -> list[bytes]:
        """Runs of letters after a blank stay separate when joined; all other pieces go alone."""
        missing = b"\0".join(keys).decode("utf-8").split("\0") if b"\0" not in b"".join(keys) else [k.decode("utf-8") for k in keys]
        added = [a for a in self.added if a in "".join(missing)]
        out: list[bytes] = [b""] * len(missing)
        plain, other = [], []
        for i, x in enumerate(missing):
            (plain if x[0] == " " and x[1:].isalpha() and not (added and any(a in x for a in added)) else other).append(i)
        groups = [plain[i:i + TOGETHER] for i in range(0, len(plain), TOGETHER)]
        words = [[missing[i] for i in g] for g in groups]
        for group, texts, found in zip(groups, words, self._library(["".join(x) for x in words])):
            ids = np.array(found, np.int64)
            raw = ids.astype(self.code).tobytes()
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(keys[i]) for i in group])) + 1
            a = 0
            for i, b in zip(group, (ends * self.width).tolist()):
                out[i] = raw[a:b]
                a = b
        for i, found in zip(other, self._library([missing[i] for i in other])):
            out[i] = np.array(found, self.code).tobytes()
        return out

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, by its pieces."""
        # Added tokens are found before a text is split: such a text goes to the library as it is.
        whole = {i for i, x in enumerate(texts) if any(a in x for a in self.added)}
        out = by_pieces(["" if i in whole else x for i, x in enumerate(texts)], self.memo)
        for i in whole:
            out[i] = np.array(self._library([texts[i]])[0], self.code).tobytes()
        return out


def encode_hub(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """(doc_id, tie, ids, wide): the ids of each text, then ``end_id``, as 32-bit integers if ``wide``, else 16-bit.

    The tokenizer must be byte-level BPE.  A null text is empty.  ``tie``
    orders rows of equal doc_id by their text, so that reruns agree.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept("token files", tokenizer_path, lambda: HubEncoder(tokenizer_path))
        end, wide = np.array([end_id], encode.code).tobytes(), encode.width == 4
        for whole in batches:
            for batch in chunks(whole, "text"):
                ids = [x + end for x in encode(strings(batch.column("text")))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"),
                                                  pa.array(ids, pa.binary()), pa.array([wide] * len(ids))], _IDS)

    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").transform(in_batches, 
        run, _ID_ROWS)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of each id over all rows; its length is the largest id + 1.

    Tasks count first; one row per task and 4,096 ids is shuffled, and one
    array of the vocabulary's size reaches the driver.
    """
    width = 4096

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for whole in batches:
            for batch in chunks(whole, "ids"):
                data, at = byte_view(batch.column("ids"))
                code = "<u4" if batch.column("wide")[0].as_py() else "<u2"
                found = np.bincount(np.frombuffer(data[at[0]:at[-1]].tobytes(), code))
                if len(found) > len(total):
                    total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
                total[:len(found)] += found
        at = [k for k in range(0, len(total), width) if total[k:k + width].any()]
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "n": pa.array(
            [np.pad(total[k:k + width], (0, max(0, k + width - len(total)))).tolist() for k in at],
            pa.list_(pa.int64()))})

    rows = (tokens.select("ids", "wide").transform(in_batches, local, "k long, n array<long>")
            .select("k", F.posexplode("n")).where("col > 0").groupBy((F.col("k") + F.col("pos")).alias("id"))
            .agg(F.sum("col").alias("n")).collect())
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_token_files(tokens: DataFrame, path: str) -> None:
    """Write (doc_id, tie, ids, wide) to ``path`` in ascending order of doc_id, nulls first (see the module)."""
    spark = tokens.sparkSession
    lengths = code_lengths(count_ids(tokens))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}/code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, segment = Code(lengths), TaskContext.get().partitionId(), 0
        held, ids, sizes, n, before = [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            payload, marks = code.encode(np.concatenate(held), BLOCK)
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "before": pa.array([before], pa.int64()), "n_ids": pa.array([n], pa.int64()), "payload": pa.array([payload], pa.binary()),
                "checkpoints": pa.array([marks.astype("<i8").tobytes()], pa.binary()),
                "doc_ids": pa.array([ids], pa.list_(pa.int64())), "doc_sizes": pa.array([sizes], pa.list_(pa.int64()))})

        for batch in batches:
            for doc_id, raw, wide in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "wide"))):
                got = np.frombuffer(raw, "<u4" if wide else "<u2").astype(np.int64)
                held.append(got)
                ids.append(doc_id)
                sizes.append(len(got))
                n += len(got)
                if n >= SEGMENT:
                    yield flush()
                    held, ids, sizes, n, before, segment = [], [], [], 0, before + n, segment + 1
        if ids:
            yield flush()

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first()]
    (tokens.repartitionByRange(width, *order).sortWithinPartitions(*order).select("doc_id", "ids", "wide")
     .transform(in_batches, run, _BLOCKS).write.parquet(f"{path}/blocks"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): every document of ``write_token_files``, decoded from its blocks.

    ``start`` counts the ids of all documents before; ``ids`` are
    little-endian unsigned 32-bit integers.
    """
    lengths = bytes(spark.read.parquet(f"{path}/code").first().lengths)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    # What stands before each part: a row per part, however many documents there are.
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        before[r.part], total = total, total + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for k in range(batch.num_rows):
                r = batch.slice(k, 1).to_pylist()[0]
                ids = code.decode(r["payload"], np.frombuffer(r["checkpoints"], "<i8"), r["n_ids"], BLOCK)
                raw, sizes = memoryview(ids.astype("<u4").tobytes()), np.array(r["doc_sizes"], np.int64)
                ends = np.cumsum(sizes)
                at = ends - sizes
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "start": pa.array(at + r["before"] + before[r["part"]], pa.int64()),
                    "n_tokens": pa.array(sizes, pa.int64()),
                    "ids": pa.array([bytes(raw[4 * a:4 * b]) for a, b in zip(at.tolist(), ends.tolist())],
                                    pa.binary())})

    return blocks.transform(in_batches, run, "doc_id long, start long, n_tokens long, ids binary")


def token_file_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs`` (doc_id, text), read back from token files.

    Null texts are empty and have the end id alone.  Rows without a doc_id
    stand first; rows of equal doc_id are ordered by their text.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    held = shared_dir(spark, "ids")
    encode_hub(docs, tokenizer_path, end_id).write.option("compression", "zstd").parquet(held)
    path = shared_dir(spark, "token-files")
    write_token_files(spark.read.schema(_ID_ROWS).parquet(held), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
