import re

import numpy as np
import pytest
import xxhash

from equispan.llm.queries import op7_simhash_near_dedup
from equispan.llm.simhash import link_units, near_duplicates, one_of_each_group


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    shingles = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius=4):
    """Smallest label reachable over a list of (label, fingerprint)."""
    fps = np.array([p for _, p in prints], np.uint64)
    label = [d for d, _ in prints]
    least = {}
    seen = [False] * len(fps)
    for k in range(len(fps)):
        if seen[k]:
            continue
        group, todo = [], [k]
        seen[k] = True
        while todo:
            i = todo.pop()
            group.append(i)
            near = np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= radius)
            for j in near:
                if not seen[j]:
                    seen[j] = True
                    todo.append(int(j))
        ids = [label[i] for i in group if label[i] is not None]
        for i in group:
            least[i] = min(ids) if ids else None
    return [least[k] for k in range(len(fps))]


def check(docs, got):
    prints = [(d, print_of(t)) for d, t in docs]
    want = sorted(((d, f"{p:016x}", c) for (d, p), c in zip(prints, classes(prints), strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, op7_simhash_near_dedup(spark, d).collect())


def test_edges_and_split_units(spark):
    base = [f"w{k}" for k in range(300)]
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One"), (4, "one"), (None, "one two"), (5, "a b c"), (6, "x " * 30000)]
    for k in range(150):
        words = list(base)
        words[k] = f"new{k}"
        docs.append((1000 + k, " ".join(words)))
    frame = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, root int")
    for unit in (2048, 8):
        check(docs, near_duplicates(frame, unit=unit).collect())
    assert near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_bit_sliced_comparison(seed):
    rng = np.random.default_rng(seed)
    fp = rng.integers(0, 1 << 63, 12, np.uint64)[rng.integers(0, 12, 700)]
    for _ in range(6):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    unit = np.sort(rng.integers(0, 9, 700))
    label = link_units(unit, fp)
    for u in range(9):
        rows = np.flatnonzero(unit == u)
        want = classes([(int(r), int(fp[r])) for r in rows])
        assert label[rows].tolist() == want


def test_one_of_each_group_and_texts_of_one_doc_id(spark):
    far = ["alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue black white pink"]
    rows = [(7, far[0]), (7, far[1]), (7, far[1]), (3, far[0]), (9, far[2]), (9, far[2].upper()), (None, far[2]), (None, far[2])]
    kept = one_of_each_group(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, component_id string")).collect()
    assert sorted(((r.doc_id, low(r.text)) for r in kept), key=str) == sorted([(3, far[0]), (7, far[1]), (9, far[2]), (None, far[2]), (None, far[2])], key=str)
