import hashlib

import numpy as np
import pyarrow as pa

from equispan.llm.arrowtext import slices
from equispan.llm.minhash import edited, fingerprint_documents, near_duplicates, shingles_of, signatures_of
from equispan.llm.queries import op8_document_fingerprints


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def check(docs, rows):
    docs = sorted([(d, t or "") for d, t in docs], key=lambda r: (-(r[0] if r[0] is not None else -1 << 60), r[1]))
    want, error = [], []
    for k, (d, t) in enumerate(docs):
        e = edited(t, docs[(k + 1) % len(docs)][1])
        want.append((d, len(t), hashlib.sha256(e.encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=str) == sorted(want, key=str)
    by = {(r.doc_id, r.n_chars, r.edited_sha256): r for r in rows}
    for k, (d, t) in enumerate(docs):
        r = by[want[k]]
        n = docs[(k + 1) % len(docs)][1]
        for got, other in ((r.near_edited, edited(t, n)), (r.near_next, n)):
            a, b = shingle_set(t), shingle_set(other)
            error.append(got - len(a & b) / len(a | b))
        assert (r.near_edited == 1) >= (t == edited(t, n)) and len(r.fingerprint) == len(r.edited_fingerprint) == 512
    assert np.abs(error).mean() < 0.03 and np.abs(error).max() < 0.25
    texts = {}
    for r in rows:
        text = next(t for d, t in docs if d == r.doc_id and len(t) == r.n_chars)
        assert texts.setdefault(text, r.fingerprint) == r.fingerprint


def test_query(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, op8_document_fingerprints(spark, d).collect())


def test_edges(spark):
    docs = [(5, "five words are here now " * 3), (5, "five words are here now " * 3), (9, None), (-3, ""), (7, "é ß ü"), (None, "no id " * 9),
            (1 << 40, "x " * 400_000), (6, "alpha beta gamma delta"), (8, " "), (5, "more of the same id, but another text than that")]
    df = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, near_next string")
    check(docs, fingerprint_documents(df).collect())
    assert fingerprint_documents(df.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert fingerprint_documents(one).collect()[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_shingles_do_not_cross_texts():
    texts = ["a b c d e f", "", "a b c", "A\tb  c d e", "a b c d e"]
    (_, _, data, offsets), = slices(pa.array(texts))
    h, begin = shingles_of(data, offsets)
    parts = [h[begin[k]:begin[k + 1]].tolist() for k in range(5)]
    assert [len(p) for p in parts] == [2, 1, 1, 1, 1]
    assert parts[3] == parts[4] == parts[0][:1] and parts[1] != parts[2]
    assert (signatures_of(data, offsets)[3] == signatures_of(data, offsets)[4]).all()


def test_near_duplicates_equal_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    base = " ".join(f"w{k}" for k in range(200))
    rows += [(9000 + k, base.replace(f"w{7 * k} ", f"x{k} ")) for k in range(12)] + [(9100, base), (9100, base), (9101, None), (None, ""), (9102, "a b")]
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    want = sorted(((d, least.get(x)) for (d, _), x in zip(rows, label, strict=True)), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == want
    assert near_duplicates(df.limit(0)).count() == 0
