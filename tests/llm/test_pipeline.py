import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from fairlend.llm.source_mixing import ORACLE
from fairlend.llm.toxicity import PAD, learn_toxicity
from tests.llm.test_bpe import library
from tests.llm.test_jaccard_join import shingles


def made():
    rng = random.Random(8)
    words = ["".join(rng.choice("abdeglmnorstu") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passage = text(60)
    docs, labels = [], []
    for i in range(240):
        w = text(rng.randint(5, 150))
        if i % 6 == 0:
            for _ in range(len(w) // 15 + 1):
                w.insert(rng.randrange(len(w)), rng.choice(["zwekkig", "zwekkel", "zwekkum"]))
        elif i % 7 == 0:
            k = rng.randrange(len(w))
            w[k:k] = passage
        docs.append([i, " ".join(w), "en", f"src{i % 4}"])
        labels.append([i, 1, int(i % 6 == 0)])
    for i in range(40):  # copies and near copies of clean documents
        w = docs[6 * i + 1][1].split()
        if i % 2:
            w[rng.randrange(len(w))] = "changed"
        docs.append([1000 + i, "\n".join(w), "en", "src1"])
    docs += [[2000, None, "en", None], [2001, "", "de", "src0"], [2002, "word " * 3_000, None, "src2"], [None, "no id", "en", "src0"],
             [3, docs[3][1], "en", "src3"], [None, "no id", "en", "src0"]]
    return [(*d, None if d[1] is None else len(d[1])) for d in docs], labels


def write(folder, docs, labels):
    names = corpus_pipeline.COLUMNS
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table({n: pa.array([d[i] for d in docs], k) for i, (n, k) in enumerate(zip(names, kinds))}
                            | {"score": pa.array(["x"] * len(docs), pa.string())}), folder / "documents.parquet")
    pq.write_table(pa.table({n: pa.array([x[i] for x in labels], pa.int64())
                             for i, n in enumerate(("doc_id", "quality", "toxic"))}), folder / "labels.parquet")


def rows(df):
    return Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    write(folder, *made())
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made_now = stage(spark, docs, str(folder))
        path = f"{folder}/stage-{k}"
        made_now.write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return str(folder), out


def test_toxic_documents_go(spark, stages):
    folder, out = stages
    before, after = out[0]
    model = learn_toxicity(before, spark.read.parquet(f"{folder}/labels.parquet"))
    want = Counter()
    for r in before.select(*corpus_pipeline.COLUMNS).collect():
        w = (r.text or "").split()
        if model.bias + (sum(model.words(w)) / (len(w) + PAD) if w else 0) < 0:
            want[tuple(r)] += 1
    assert rows(after) == want and after.columns == corpus_pipeline.COLUMNS
    left = {r.doc_id for r in after.collect()}
    clean = [i for i in range(240) if i % 6]
    assert np.mean([i in left for i in clean]) > 0.95 > 0.2 > np.mean([i in left for i in range(0, 240, 6)])


def test_one_document_of_each_group(stages):
    before, after = stages[1][1]
    docs = [tuple(r) for r in before.select(*corpus_pipeline.COLUMNS).collect()]
    sets = [shingles(d[1]) for d in docs]
    low = list(range(len(docs)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low[root(a)] = root(b)
    least = {}
    for k, d in enumerate(docs):
        if d[0] is not None:
            least[root(k)] = min(d[0], least.get(root(k), d[0]))
    want = Counter()
    for k, d in enumerate(docs):
        if d[0] is None or not sets[k] or d[0] == least[root(k)]:
            want[d] = 1 if d[0] is not None else want[d] + 1
    assert rows(after) == want


def test_passages_are_cut(stages):
    before, after = stages[1][2]
    docs = [tuple(r) for r in before.select(*corpus_pipeline.COLUMNS).collect()]
    split = [(d[1] or "").encode().split() for d in docs]
    seen = Counter(tuple(w[k:k + 35]) for w in split for k in range(len(w) - 34))
    want = Counter()
    for d, w in zip(docs, split):
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(k, k + 35)}
        if gone:
            text = b" ".join(x for k, x in enumerate(w) if k not in gone).decode()
            d = (d[0], text, *d[2:4], len(text))
        want[d] += 1
    assert rows(after) == want


def test_sources_are_mixed(stages):
    before, after = stages[1][3]
    documents = before.toArrow()  # noqa: F841
    taken = Counter()
    for doc_id, size, _, _, words in duckdb.connect().sql(ORACLE).fetchall():
        taken[doc_id, size] += words
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += len((r.text or "").split())
    want = Counter()
    for (doc_id, _), n in taken.items():
        want[doc_id] += n
    assert +got == +want
    whole = {tuple(r) for r in before.select(*corpus_pipeline.COLUMNS).collect()}
    cut = [r for r in after.select(*corpus_pipeline.COLUMNS).collect() if tuple(r) not in whole]
    assert len(cut) <= len({r.source for r in before.collect()})


def test_encoding_and_run(spark, stages):
    folder, out = stages
    before, after = out[4]
    want = Counter()
    for r in before.collect():
        ids = np.array(library().encode_ordinary(r.text or ""), "<u4").tobytes()
        want[r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, after.collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want


def test_empty_table(spark, tmp_path):
    write(tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
