"""Splitting text into the pieces that byte-level BPE encodes separately.

The pieces are the matches of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
They are found from runs of equal character class with array operations; the
classes come from the ``regex`` library, so they are those of the pattern.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from fairlend.llm.text import byte_view, Memo

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
_CLASS = np.full(0x110000, UNKNOWN, np.uint8)
_TESTS = [(regex.compile(p), c) for p, c in ((r"\s", SPACE), (r"\p{L}", LETTER), (r"\p{N}", NUMBER))]


def _classes(codes: np.ndarray) -> np.ndarray:
    got = _CLASS[codes]
    if (got == UNKNOWN).any():
        for u in np.unique(codes[got == UNKNOWN]).tolist():
            _CLASS[u] = next((c for test, c in _TESTS if test.match(chr(u))), OTHER)
        got = _CLASS[codes]
    return got


def piece_starts(codes: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
    """The index of the first character of each piece of a text, given as its code points; ``texts``: where more texts begin."""
    n = len(codes)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _classes(codes)
    begins = np.ones(n, bool)  # a run of one class
    begins[1:] = kind[1:] != kind[:-1]
    follows = np.ones(n, bool)  # the text goes on from the character before
    if texts is not None:
        follows[texts] = False
        begins[texts] = True
    starts = begins.copy()
    # The last space before other characters is a piece of its own, or with a blank the head of the next.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & follows[1:])
    starts[last] = True
    starts[last[codes[last] == 32] + 1] = False
    # A lone apostrophe that no blank precedes takes the letters of a contraction with it.
    quote = np.flatnonzero((codes[:-1] == 39) & starts[:-1] & begins[:-1] & (kind[1:] == LETTER) & follows[1:])
    if len(quote):
        one = codes[quote + 1]
        two = np.where((quote + 2 < n) & follows[np.minimum(quote + 2, n - 1)], codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for q, size in ((quote[short], 2), (quote[long], 3)):
            starts[q + 1] = False
            after = q + size
            starts[after[after < n]] = True
    return np.flatnonzero(starts)


def pieces(text: str) -> list[str]:
    """The pieces of ``text`` in order; joined they give it back."""
    at = piece_starts(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)).tolist()
    return [text[a:b] for a, b in zip(at, [*at[1:], len(text)])]


def piece_keys(text: str) -> list[bytes] | list[str]:
    """The pieces as keys for a memo: Latin-1 bytes where the text has no other characters, which is faster, else strings."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return pieces(text)
    if not raw:
        return []
    if 0 in raw:
        return pieces(text)
    codes = np.frombuffer(raw, np.uint8)
    return np.insert(codes, piece_starts(codes)[1:], 0).tobytes().split(b"\0")


def piece_bytes(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pieces of the UTF-8 texts that ``at`` cuts ``data`` into, as one binary array, and where each text's begin in it."""
    raw = data[at[0]:at[-1]]
    at = at - at[0]
    text = raw.tobytes()
    if text.isascii():
        starts = piece_starts(raw, at[at < len(raw)])
    else:
        first = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each character
        codes = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
        starts = first[piece_starts(codes, np.searchsorted(first, at[at < len(raw)]))]
    offsets = np.append(starts, len(raw)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
    return pieces, np.searchsorted(starts, at)


def by_pieces(texts: list[str], memo: Memo) -> list[bytes]:
    """What ``memo`` has for the pieces of each text, joined.  The pieces of all texts are cut and numbered together; a distinct one is looked up once."""
    pieces, first = piece_bytes(*byte_view(pa.array(texts, pa.large_string())))
    numbered = pieces.dictionary_encode()
    distinct = numbered.dictionary.to_pylist()
    memo.fill(distinct)
    made = pa.array(list(map(memo.__getitem__, distinct)), pa.large_binary())
    raw, ends = byte_view(made.take(numbered.indices))
    raw, ends = memoryview(raw), ends[first].tolist()
    return [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]


def piece_text(key: bytes | str) -> str:
    return key.decode("latin-1") if isinstance(key, bytes) else key
