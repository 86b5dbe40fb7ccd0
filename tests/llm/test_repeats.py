import hashlib
import random
from collections import Counter

import pytest

from equispan.llm import repeats
from equispan.llm.queries import op1_suffix_array_dedup
from equispan.llm.repeats import remove_repeats


def brute(docs, length=200):
    texts = [(t or "").encode() for _, t in docs]
    starts = Counter(t[k:k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (doc, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if starts[t[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert sum(r[2] for r in want) > 1000
    assert sorted((tuple(r) for r in op1_suffix_array_dedup(spark, d).collect()), key=str) == want


def made(seed):
    rng = random.Random(seed)
    word = [rng.choice("abcdefghij") * rng.randint(1, 3) + rng.choice("äxyz") for _ in range(60)]
    parts = ["".join(rng.choice(word) for _ in range(rng.randint(5, 400))) for _ in range(12)]
    docs = [(k, "".join(rng.choice(parts)[rng.randint(0, 80):rng.randint(81, 900)] for _ in range(rng.randint(1, 6)))) for k in range(60)]
    base = parts[0] * 3
    for k in range(50):  # near copies: the same landmarks in many different runs
        at = rng.randint(0, len(base) - 1)
        docs.append((100 + k, base[:at] + f"<{k}>" + base[at + 1:]))
    docs += [(200, "ab" * 700), (201, "z" * 199), (202, "z" * 200), (203, "q" * 201), (204, None), (204, ""), (205, "same" * 60), (205, "same" * 60),
             (None, parts[1]), (None, parts[1]), (206, "é" * 150 + "tail")]
    return docs


@pytest.mark.parametrize("seed", range(2))
def test_edges(spark, seed):
    docs = made(seed)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, spans string").repartition(3)
    want = brute(docs)
    for group_runs in (5000, 7):
        got = remove_repeats(df, group_runs=group_runs).collect()
        assert sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                       for r in got), key=str) == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(3)
    long_ = "".join(rng.choice("abcdefghijklmnop ") for _ in range(2_500_000))
    copy = long_[1_048_000:1_049_500]
    docs = spark.createDataFrame([(1, long_), (2, "x" + copy + "y")], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeats(docs).collect()}
    assert [tuple(s) for s in rows[2].spans] == [(1, 1501)]
    assert [tuple(s) for s in rows[1].spans] == [(1_048_000, 1_049_500)]


def test_a_hot_landmark_is_not_copied(spark, monkeypatch):
    """A passage that n documents share inside different surroundings: what is compared grows with n, not with its square."""
    real = repeats._double
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefghij") for _ in range(150))

    def bytes_compared(n):
        total = spark.sparkContext.accumulator(0)

        def counted(length):
            inner = real(length)

            def run(batches):
                def tee():
                    for batch in batches:
                        total.add(batch.nbytes)
                        yield batch
                yield from inner(tee())
            return run

        monkeypatch.setattr(repeats, "_double", counted)
        texts = ["".join(rng.choice("klmnopqrst") for _ in range(120)) + passage + "".join(rng.choice("klmnopqrst") for _ in range(120)) for _ in range(n)]
        texts[1] = texts[0][:30] + "#" + texts[0][31:]
        docs = list(enumerate(texts))
        out = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), group_runs=7).collect()
        assert sorted(((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest())
                       for r in out), key=str) == brute(docs)
        return total.value

    small = bytes_compared(150)
    assert 0 < bytes_compared(600) < 6 * small
