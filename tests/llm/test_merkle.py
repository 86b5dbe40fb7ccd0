import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from equispan.llm.merkle import document_manifest
from equispan.llm.queries import op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int, level int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def leaf(doc, text):
    def told(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(told, (doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)))


def expected(docs):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) by plain recomputation."""
    groups = defaultdict(list)
    for d in docs:
        groups[d["source"]].append(d)
    proofs, ends = [], []
    def level_up(nodes, fan=16):
        """nodes: (hash, members below).  Siblings are added to each member's proof."""
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), fan):
                run = nodes[k:k + fan]
                for j, (_, below) in enumerate(run):
                    for m in below:
                        m["steps"].append(([x for x, _ in run[:j]], [x for x, _ in run[j + 1:]]))
                up.append((h(*[x for x, _ in run]), [m for _, below in run for m in below]))
            nodes = up
        return nodes[0]
    for source in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        rows = sorted(groups[source], key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d, d["text"])))
        members = [{"doc": d, "steps": []} for d in rows]
        proofs += members
        end = level_up([(leaf(m["doc"], m["doc"]["text"]), [m]) for m in members])
        for m in members:
            m["subroot"] = end[0]
        ends.append(end)
    root = level_up(ends)[0]
    out = []
    for m in proofs:
        d = m["doc"]
        hit = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
        now = leaf(d, low(d["text"]) if hit else d["text"])
        for before, after in m["steps"]:
            now = h(*before, now, *after)
        out.append((d["doc_id"], leaf(d, d["text"]), m["subroot"], root, h(*[x for b, a in m["steps"] for x in b + a]), now, now == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def proved(spark, docs):
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], "x", 1, 2) for d in docs], SCHEMA)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return sorted((tuple(r) for r in document_manifest(df, hit).select(*COLUMNS).collect()), key=str)


def made(n, source, start=0):
    return [{"doc_id": start + k, "text": f"Text {k} of A", "lang": "en" if k % 3 else None, "source": source, "n_chars": k} for k in range(n)]


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [r.asDict() for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in op13_merkle_manifest(spark, d).select(*COLUMNS).collect()), key=str)
    assert got == sorted(expected(docs), key=str)
    assert {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("docs", [
    [], made(1, "a"), made(1, None), made(2, "a"), made(16, "a"), made(17, None), made(257, "a") + made(1, "b", 900),
    [x for k in range(18) for x in made(1 + k % 2, f"s{k}", 100 * k)] + made(3, "é", 5000) + made(2, "Z", 6000) + made(2, "", 7000),
])
def test_shapes(spark, docs):
    assert proved(spark, docs) == (sorted(expected(docs), key=str) if docs else [])


def test_nulls_ties_repeats_long_texts(spark):
    docs = made(5, "a") + made(5, "a") + [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": None, "text": "", "lang": "", "source": "", "n_chars": -1},
        {"doc_id": 7, "text": "É A" * 200_000, "lang": "x", "source": None, "n_chars": 600_000}]
    docs += [dict(docs[0], text="other")]
    assert proved(spark, docs) == sorted(expected(docs), key=str)


def test_blocks_of_a_large_source(spark, monkeypatch):
    monkeypatch.setattr("equispan.llm.merkle.BLOCK", 8)
    docs = made(600, "hot") + made(3, "a", 1000) + made(1, "z", 2000)
    assert proved(spark, docs) == sorted(expected(docs), key=str)
