import zlib
from collections import Counter

import numpy as np

from equispan.llm.queries import op4_toxicity
from equispan.llm.toxicity import _distinct, feature_counts, fit, fit_sample, labelled_texts, score, score_toxicity


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op4_toxicity(spark, d).collect()
    assert len(rows) == spark.read.parquet(f"{d}/documents.parquet").count()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.score, toxic[r.doc_id]) for r in rows if r.held_out and r.doc_id in toxic]
    bad, good = np.array([s for s, t in held if t]), np.array([s for s, t in held if not t])
    auc = (bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2
    assert auc > 0.9
    assert (good < 0.7).mean() > 0.97 and (bad >= 0.7).mean() > 0.6


def test_edges(spark):
    texts = [("you mean idiot " + "x y " * (k % 5), 1) for k in range(40)] + [(f"a kind person {k}", 0) for k in range(60)]
    docs = spark.createDataFrame([(k, t, 9.0, "h") for k, (t, _) in enumerate(texts)]
                                 + [(200, None, 1.0, None), (201, "", 1.0, ""), (None, "idiot " * 40000, 1.0, ""), (5, "what an IDIOTic thing", 1.0, "")],
                                 "doc_id long, text string, score double, held_out string")
    labels = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)] + [(3, 0), (None, 1), (7, None), (999, 1)],
                                   "doc_id long, toxic int")
    out = score_toxicity(docs, labels).collect()
    assert len(out) == 104 and all(0 <= r.score <= 1 for r in out)
    by = {(r.doc_id, r.text and r.text[:4]): r.score for r in out}
    assert by[200, None] == by[201, ""]
    assert by[None, "idio"] > by[201, ""] and by[50, "a ki"] < 0.7 < by[1, "you "]
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert fit(docs, labels.where("toxic = 1"))[-1] > 0
    assert score(docs.select("doc_id", "text"), fit(docs, labels)).columns == ["doc_id", "text", "score"]


def test_counts_cover_all_labelled_rows_and_the_sample_is_bounded(spark):
    texts = [f"word{k % 7} other{k % 3} tail" for k in range(400)] + ["", None]
    docs = spark.createDataFrame([(k // 4, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(k, k % 3 == 0) for k in range(90)] + [(1, True), (None, True), (2, None)], "doc_id long, toxic boolean")
    known = {k: k % 3 == 0 or k == 1 for k in range(90)}
    labelled = labelled_texts(docs, labels)
    want = Counter()
    for k, t in enumerate(texts):
        if k // 4 in known:
            data = np.frombuffer((t or "").encode(), np.uint8)
            for f in _distinct(data, np.array([0, len(data)]))[1].tolist():
                want[f, known[k // 4]] += 1
    got = {r.feature: (r.p, r.q) for r in feature_counts(labelled).collect()}
    assert got == {f: (want[f, True], want[f, False]) for f, _ in want}
    assert labelled.count() == 360
    for most in (1, 10, 1000):
        assert fit_sample(labelled, most).count() == min(most, len({(k // 4, t) for k, t in enumerate(texts) if k // 4 in known}))
    many = spark.createDataFrame([(1, "same text", 0)] * 300 + [(2, "an idiot", 1)], "doc_id long, text string, toxic int")
    assert fit_sample(labelled_texts(many, many.select("doc_id", "toxic")), 20).count() == 2  # equal rows count once
    assert np.isfinite(fit(docs, labels, max_rows=1)).all()
