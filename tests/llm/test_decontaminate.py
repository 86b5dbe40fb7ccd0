import hashlib
import re

import pytest
from pyspark.sql import Row

from equispan.llm.decontaminate import decontaminate
from equispan.llm.queries import op9_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    grams = {}
    for item, text in items:
        w = WORD.findall(low(text))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[k:k + n]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w = WORD.findall(low(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k:k + n])) in grams:
                    hit.update(range(k, k + n))
                    found |= grams[g]
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{d}/benchmark.parquet").collect()
    got = sorted((tuple(r) for r in op9_benchmark_decontamination(spark, d).collect()), key=str)
    want = brute(docs, items)
    assert got == want
    assert sum(r[5] for r in want) > 5


@pytest.mark.parametrize("block_words", [10_000, 20])
def test_edges(spark, block_words):
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    items = [(1, " ".join(words)), (2, "Two, THREE"), (3, None), (4, ""), (5, "éa ß"), (10, "two three")]
    docs = [(1, " ".join(words[:13])), (2, " ".join(words[:12])), (3, None), (4, ""), (5, "--"), (6, "x two-three éa ß" * 3),
            (7, " ".join(["two three"] * 3000)), (7, " ".join(["two three"] * 3000)), (8, "y " * 50000 + " ".join(words))]
    frame = spark.createDataFrame([Row(doc_id=a, text=b, items="clash", _start="s") for a, b in docs], "doc_id long, text string, items string, _start string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(frame, bench, block_words=block_words).collect()
    want = brute(docs, items)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(),
                    r.contaminated) for r in got), key=str) == want
    assert all(r["items"] == sorted(set(r["items"])) for r in got)
    empty = decontaminate(frame.limit(0), bench)
    assert empty.count() == 0
    assert decontaminate(frame, bench.limit(0)).where("n_hit > 0").count() == 0
