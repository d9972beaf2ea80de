import public_tokenizers
import pyarrow as pa
import regex
from hypothesis import given, settings, strategies as st

from fairlend.llm.pretokens import piece_bytes
from fairlend.llm.text import byte_view
from fairlend.llm.token_store import HubEncoder

PATTERN = regex.compile(public_tokenizers.PATTERN)
TEXTS = st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab sSt'relvmd  \n\t\0 1٣é!?-"), st.characters(exclude_categories=["Cs"])), max_size=12), max_size=8)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_pieces_of_texts_cut_together_end_with_their_text(texts):
    pieces, first = piece_bytes(*byte_view(pa.array(["left out", *texts], pa.large_string()).slice(1)))
    cut = [x.decode() for x in pieces.to_pylist()]
    assert [cut[a:b] for a, b in zip(first, first[1:])] == [PATTERN.findall(x) for x in texts]


def test_a_distinct_piece_of_many_texts_is_looked_up_once(monkeypatch):
    encode = HubEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    monkeypatch.setattr(encode.memo, "fill", lambda keys, fill=encode.memo.fill: (asked.extend(keys), fill(keys)))
    assert len({*encode(["one two two"] * 50)}) == 1
    assert sorted(asked) == [b" two", b"one"]
