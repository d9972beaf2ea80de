import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from fairlend.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def encoded(texts):
    run = bpe._encoding(PATH, "text", ["text"], "ids")
    return [np.frombuffer(x, "<u4").tolist() for b in run([pa.RecordBatch.from_pydict({"text": pa.array(texts)})]) for x in b.column("ids").to_pylist()]


def test_new_pieces_of_equal_length_are_merged_together(monkeypatch):
    one_by_one = []
    monkeypatch.setattr(bpe, "encode_piece", lambda piece, *a, f=bpe.encode_piece: (one_by_one.append(piece), f(piece, *a))[1])
    texts = [" ".join(np.base_repr(10**12 + 7919**2 * i, 26).translate(str.maketrans("0123456789", "qrstuvwxyz")) for i in range(k, k + 200)) for k in (0, 200)]
    assert encoded(texts) == [LIBRARY.encode_ordinary(x) for x in texts]
    assert len(one_by_one) < 10  # the first word has no blank


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcdeo' 1é漢\0\n", max_size=200), min_size=20, max_size=60))
def test_ids_of_many_texts_are_the_librarys(texts):
    assert encoded([*texts, None]) == [*map(LIBRARY.encode_ordinary, texts), []]


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=2, max_size=5), max_size=30), st.randoms(),
       st.integers(1, 12).flatmap(lambda n: st.lists(st.text(alphabet="abc", min_size=n, max_size=n), min_size=20, max_size=40)))
def test_any_vocabulary(more, random, pieces):
    tokens = [*(bytes([x]) for x in range(256)), *(x.encode() for x in sorted(more))]
    random.shuffle(tokens)
    ranks = {x: i for i, x in enumerate(tokens)}
    library = tiktoken.Encoding("any", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    got = bpe.PieceEncoder(ranks)([x.encode() for x in pieces])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode_ordinary(x) for x in pieces]


def test_vocabulary_without_every_byte_and_lengths_at_the_bounds(monkeypatch):
    ranks = {b"a": 0, b"b": 1, b"ab": 2, b"aba": 3}
    encode = bpe.PieceEncoder(ranks)
    assert not encode.together
    assert [np.frombuffer(x, "<u4").tolist() for x in encode([b"abab", b"bbbb"] * 20)] == [[2, 2], [1, 1, 1, 1]] * 20
    monkeypatch.setattr(bpe, "CELLS", 300)  # two rows at a time
    encode = bpe.PieceEncoder(bpe.load_ranks(PATH))
    for size in (bpe.SHORT, bpe.SHORT + 1):
        pieces = ["".join(chr(97 + (i * i * k) % 23) for i in range(size)) for k in range(1, bpe.FEW + 4)]
        got = encode([x.encode() for x in pieces])
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [LIBRARY.encode_ordinary(x) for x in pieces]


def test_an_id_that_the_vocabulary_lacks_raises(tmp_path):
    path = tmp_path / "ranks"
    path.write_bytes(b"YQ== 0\nYg== 2\n")
    decode = bpe._decoding(str(path), "ids", ["ids"], "decoded")
    rows = lambda *ids: [pa.RecordBatch.from_pydict({"ids": pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())})]
    assert next(iter(decode(rows([0, 2], [], [2])))).column("decoded").to_pylist() == [b"ab", b"", b"b"]
    for bad in (1, 3):
        with pytest.raises(IndexError):
            list(decode(rows([0, bad])))
    with pytest.raises(ValueError):
        list(decode([pa.RecordBatch.from_pydict({"ids": pa.array([b"\0\0\0\0\0", b"\0\0\0"], pa.binary())})]))
