"""Operator 12 against plain counting, and its model against the definition of a distribution."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fairlend.llm import lm_scoring, word_classes
from fairlend.llm.lm_scoring import score_texts, scoring_report, words_of
from fairlend.llm.word_classes import assigned, exchange, f, likelihood

SCHEMA = "doc_id long, text string, n_known int, row long, tail string"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return WORD.findall(lower) + [b""]


def out_of_fold(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def texts(n, seed=3):
    """Sentences of a small grammar, so that classes help, over many names that are rare."""
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        parts = []
        for _ in range(int(r.integers(1, 9))):
            parts += [["The", "a", "One"][r.integers(3)], f"noun{r.zipf(1.4) % 300}", f"verb{r.integers(12)}",
                      ["in", "ON", "by"][r.integers(3)], f"Place{r.integers(40)}."]
        out.append((i, "\t".join(parts) if i % 7 else "  ".join(parts) + "\n"))
    return out


ODD = [(5000, None), (5001, ""), (5002, " \n "), (None, "the noun1 verb1"), (5003, "É é ÀB c"),
       (5004, "w" * 70_000 + " the"), (5005, "noun1 " * 300_000), (7, "the same id"), (7, "the same id")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("head", [1 << 18, 40, 1])
def test_counts_and_base_score(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rows = texts(120) + ODD
    got = scoring_report(frame(spark, rows))
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    count = Counter(w for i, t in rows if not out_of_fold(i) for w in tokens(t))
    total, kinds = sum(count.values()), len(count)
    want = []
    for i, t in rows:
        own = tokens(t)
        base = math.fsum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        want.append((str(i), out_of_fold(i), len(own), sum(count[w] > 0 for w in own), total, base))
    have = sorted((str(r.doc_id), *r[1:6]) for r in got.collect())
    assert [h[:5] for h in have] == [w[:5] for w in sorted(want)]
    np.testing.assert_allclose([h[5] for h in have], [w[5] for w in sorted(want)], rtol=1e-12)


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_scores_follow_the_model_and_add_up(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    rows = texts(150) + ODD
    docs = frame(spark, rows).select("doc_id", lm_scoring.held_out("doc_id").alias("held_out"), "text")
    scored, model = score_texts(docs)
    count = Counter(w for i, t in rows if not out_of_fold(i) for w in tokens(t))
    own = {w: int(c) for w, c in zip(model.voc.words, model.classes)}
    tail = {bytes(r.word): (r.n, r["class"]) for r in model.tail.collect()}
    own.update({w: c for w, (_, c) in tail.items()})
    long = {b"w" * 70_000: next((w for w in own if w.startswith(b" ")), b"")}
    assert set(own) == {long.get(w, w) for w in count}
    assert all(count[w] == n for w, (n, _) in tail.items() if not w.startswith(b" "))
    # A distribution after any class, the unknown word included.
    ways = 10 ** model.step
    kept = np.zeros(len(ways) - 1)
    for w, c in count.items():
        kept[own[long.get(w, w)]] += 10 ** model.word(c, own[long.get(w, w)])
    np.testing.assert_allclose(ways @ kept + 10 ** model.unknown, 1.0, rtol=1e-9)

    def score(text):
        last, total = own[b""], 0.0
        for w in tokens(text):
            k = long.get(w, w)
            if k in own:
                total += model.step[last, own[k]] + model.word(count[w], own[k])
                last = own[k]
            else:
                total += model.unknown[last]
                last = lm_scoring.CLASSES
        return total

    have = sorted((str(r.doc_id), r.score) for r in scored.collect())
    want = sorted((str(i), score(t)) for i, t in rows)
    assert [h[0] for h in have] == [w[0] for w in want]
    np.testing.assert_allclose([h[1] for h in have], [w[1] for w in want], rtol=1e-9)


def test_held_out_perplexity_beats_counts(spark):
    rows = texts(900)
    held = [r for r in scoring_report(frame(spark, rows)).collect() if r.held_out]
    assert len(held) > 50
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_reruns_agree(spark):
    rows = texts(80)
    a, b = (sorted(map(tuple, scoring_report(frame(spark, rows)).collect())) for _ in range(2))
    assert a == b


def test_empty_and_nothing_to_learn(spark):
    assert scoring_report(frame(spark, [])).collect() == []
    held = next(i for i in range(100) if out_of_fold(i))
    rows = scoring_report(frame(spark, [(held, "some words"), (held, None)])).collect()
    assert sorted(tuple(r)[1:7] for r in rows) == [(True, 1, 0, 0, 0.0, 0.0), (True, 3, 0, 0, 0.0, 0.0)]


def pairs_of(seq, classes, k):
    m = np.zeros((k, k), np.int64)
    np.add.at(m, (classes[seq[:-1]], classes[seq[1:]]), 1)
    return m


def around(seq, w, classes, k):
    before, after = np.zeros(k, np.int64), np.zeros(k, np.int64)
    a, b = seq[:-1], seq[1:]
    np.add.at(before, classes[a[(b == w) & (a != w)]], 1)
    np.add.at(after, classes[b[(a == w) & (b != w)]], 1)
    return before, after, int(((a == w) & (b == w)).sum())


@pytest.mark.parametrize("turn", [0, 3])
def test_task_sums_equal_recounting(turn):
    """The counts around a round's words, over texts that end in id 0, against a loop."""
    import pyarrow as pa
    r = np.random.default_rng(turn)
    head, k = 41, lm_scoring.CLASSES + 1
    classes = np.append(r.integers(0, 9, head), lm_scoring.CLASSES).astype(np.uint8)
    docs = [np.append(r.integers(1, head + 1, n), 0).astype(np.int32) for n in (0, 3, 200, 1, 50)]
    batch = pa.record_batch({"ids": pa.array([d.tobytes() for d in docs], pa.binary())})
    out = pa.Table.from_batches(lm_scoring._around(classes, turn)(iter([batch, batch]))).to_pydict()
    got = dict(zip(out["block"], map(lm_scoring._unpacked, out["cells"])))
    seq = np.concatenate([[0], *docs])
    assert (got[-1].reshape(k, k) == 2 * pairs_of(seq, classes, k)).all()
    cells = got[0].reshape(-1, 2 * k + 1)
    for i, w in enumerate(range(turn, head, lm_scoring.PARTS)):
        before, after, own = around(seq, w, classes, k)
        assert (cells[i, :k] == 2 * before).all() and (cells[i, k:2 * k] == 2 * after).all() and cells[i, -1] == 2 * own


def test_exchange_takes_the_best_move():
    """Against recounting all pairs for every class a word could go to."""
    r = np.random.default_rng(5)
    seq = r.zipf(1.5, 3000) % 25
    k = 6
    classes = (np.arange(25) % (k - 1)).astype(np.uint8)
    for w in range(25):
        before, after, own = around(seq, w, classes, k)
        new = exchange(before[None], after[None], np.array([own]), classes[w:w + 1], pairs_of(seq, classes, k), k - 1)
        values = []
        for c in range(k - 1):
            trial = classes.copy()
            trial[w] = c
            values.append(likelihood(pairs_of(seq, trial, k)))
        assert values[new[0]] >= max(values) - 1e-6
        classes[w] = new[0]


def test_assigned_takes_the_best_class():
    r = np.random.default_rng(9)
    m = r.integers(0, 40, (5, 5))
    near = [[(1, 1)], [(7, 3), (24, 1)], [(0, 2), (6, 5), (12, 1)]]
    word = np.repeat(np.arange(3), [len(x) for x in near])
    code, n = (np.array([e[i] for x in near for e in x]) for i in range(2))
    got = assigned(word, code, n, 3, m, 4)
    for w, entries in enumerate(near):
        def gain(c):
            total = sum(t for _, t in entries)
            out = sum(f(m[a // 5, c] + t) - f(m[a // 5, c]) + f(m[c, a % 5] + t) - f(m[c, a % 5]) for a, t in entries)
            return out - sum(f(s + total) - f(s) for s in (m[c].sum(), m[:, c].sum()))
        assert gain(got[w]) >= max(gain(c) for c in range(4)) - 1e-9


def test_words_of_long_texts():
    text = (b"Aa bB\tc\x0bd " * 400_000) + b"x" * 100
    assert [len(w) for ws in words_of(text) for w in ws][-1] == 33
    assert sum(len(ws) for ws in words_of(text)) == 1_600_001
    assert word_classes.f(0) == 0


def test_keys_are_not_torn_between_batches():
    import pyarrow as pa
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 4]
    batches = [pa.record_batch({"k": pa.array(keys[a:b]), "v": pa.array(range(a, b))}) for a, b in
               ((0, 1), (1, 1), (1, 4), (4, 6), (6, 8), (8, 10))]
    got = [(b.column("k").to_pylist(), s.tolist()) for b, s in lm_scoring.whole_keys(iter(batches), "k")]
    assert [k for ks, _ in got for k in ks] == keys
    assert all(len(set(ks[a:b])) == 1 for ks, s in got for a, b in zip(s, s[1:]))
    assert sum(len(s) - 1 for _, s in got) == 4 and list(lm_scoring.whole_keys(iter([]), "k")) == []
