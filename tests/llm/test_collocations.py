import re
from collections import Counter

import duckdb
import pytest

from equispan.llm.collocations import SQL, collocations, frequent_phrases
from equispan.llm.queries import op12_phrase_collocations

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
SCHEMA = "doc_id long, text string, lang string, n long, phrase string, key long, shard int"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def counted(docs, most=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", low(text)):
            w = re.findall("[^\x20\x09]+", piece)
            if w:
                n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    return f, n


def expected(docs, support=30, top=2000):
    f, n = counted(docs)
    often = {k: a for k, a in f.items() if a >= support}
    longer = Counter()
    for (lang, w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                longer[lang, w[i:i + size]] = max(longer[lang, w[i:i + size]], a)
    out = []
    for lang in n:
        rows = []
        for (of, w), a in often.items():
            if of != lang or len(w) < 2 or 100 * longer[lang, w] >= 80 * a:
                continue
            cut = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            rows.append((-cut[0], -a, " ".join(w).encode(), f[lang, w[:cut[1]]], f[lang, w[cut[1]:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def frame(spark, docs):
    return spark.createDataFrame([(k, t, x, 1, "p", 2, 3) for k, (x, t) in enumerate(docs)], SCHEMA)


def test_query_equals_brute_force_and_sql(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("lang", "text").collect()]
    rows = got(op12_phrase_collocations(spark, d))
    assert rows == expected(docs) and len(rows) > 100
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(con.sql(SQL).select(*COLUMNS).fetchall()) == rows


DOCS = [("en", "New York City is big. New York City, new york!"), (None, "New York"), ("und", "new\tYORK  city"), ("en", ""), ("en", None),
        ("fr", "a a a a a a"), ("fr", "A a.a a\na\x0ba"), ("fr", "é É ü . é É ü"), ("en", "x" * 50_000 + " y"), ("en", "x" * 50_000 + " y"),
        (None, None), ("en", ",;:. \t ")] * 3


@pytest.mark.parametrize("support,shards", [(2, 4), (6, 1), (6, 3), (9, 16), (30, 4)])
def test_edges_by_support_and_shards(spark, support, shards):
    out = collocations(frame(spark, DOCS), support=support, shards=shards, top=5, bits=12)
    assert got(out) == expected(DOCS, support, 5)


def test_empty_table(spark):
    assert got(collocations(frame(spark, []))) == []


def test_phrases_spread_thin_over_shards_and_full_bitmap(spark):
    docs = [("en", f"alpha beta gamma delta {k} {k % 7} tail") for k in range(31)] + [("en", f"rare{k} pair{k}") for k in range(500)]
    f, n = counted(docs)
    want = sorted([(x, " ".join(w), a) for (x, w), a in f.items() if a >= 30] + [(x, None, a) for x, a in n.items()], key=str)
    for bits in (6, 20):  # one word of bits is full at once
        rows = frequent_phrases(frame(spark, docs), bits=bits).collect()
        assert sorted((tuple(r) for r in rows), key=str) == want


def test_exact_beyond_64_bits(spark):
    big = 1 << 50
    q = spark.sql(f"SELECT (cast({big} AS decimal(20, 0)) * 2000000) div (cast({big} AS decimal(20, 0)) + cast({big + 1} AS decimal(20, 0))) AS s")
    assert q.first()[0] == 2_000_000 * big // (2 * big + 1)
