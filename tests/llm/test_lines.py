import random
from collections import defaultdict

from equispan.llm.lines import dedup_lines, line_classes
from equispan.llm.queries import op2_line_dedup
from pyspark.sql import functions as F


def shingles(s):
    return {s[k:k + 5] for k in range(len(s) - 4)} or {s}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def roots_of(lines):
    """Components of all similar pairs, by an inverted index over shingles with a length filter."""
    lines = sorted(set(lines))
    sets = [shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    index = defaultdict(list)
    df = defaultdict(int)
    for s in sets:
        for g in s:
            df[g] += 1
    for k, s in enumerate(sets):
        rare = sorted(s, key=lambda g: (df[g], g))[:len(s) - int(0.8 * len(s)) + 1]  # prefix filter: a similar pair shares one
        seen = set()
        for g in rare:
            for j in index[g]:
                if j not in seen:
                    seen.add(j)
                    if find(j) != find(k) and min(len(s), len(sets[j])) >= 0.8 * max(len(s), len(sets[j])) and similar(lines[j], lines[k]):
                        parent[find(k)] = find(j)
            index[g].append(k)
    return {x: find(k) for k, x in enumerate(lines)}


def brute(docs):
    docs = [(d, t or "") for d, t in docs]
    root = roots_of([x for _, t in docs for x in t.split("\n") if x.strip(" ")])
    first = {}
    for d, t in docs:
        for p, x in enumerate(t.split("\n")):
            if x.strip(" "):
                at = (d is not None, d or 0, p)
                first[root[x]] = min(first.get(root[x], at), at)
    out = []
    for d, t in docs:
        kept = [x for p, x in enumerate(t.split("\n")) if not x.strip(" ") or first[root[x]] == (d is not None, d or 0, p)]
        out.append((d, "\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept)))
    return sorted(out, key=str)


def test_query_equals_all_pairs(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in op2_line_dedup(spark, d).collect()), key=str)
    assert sum(r[3] for r in want) > 20
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 0.02 * len(want)  # banding may miss three pairs in a thousand


def test_edges(spark):
    base = "The quick brown fox jumps over the lazy dog and runs away into the deep dark forest near the old stone bridge"
    docs = [(1, base + "\nshort\n\n  \nshort"), (2, base.replace("lazy", "tired") + "\nshor\nab"), (3, None), (4, ""), (None, "ab\nx"),
            (5, "ab"), (6, "ab\n" + base + " again"), (7, "0123456789" * 3000), (8, "0123456789" * 2999 + "012345678x"), (9, "\n\n"), (10, "é\r\nß")]
    docs += [(100 + k, base[:k] + chr(0x100 + k) * 6 + base[k + 6:]) for k in range(0, 100, 3)]
    df = spark.createDataFrame([(*r, 5) for r in docs], "doc_id long, text string, n_lines int")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(df).collect()), key=str)
    assert got == brute(docs)
    assert dedup_lines(df.limit(0)).count() == 0
    twice = dedup_lines(spark.createDataFrame([(1, "a\nb"), (1, "a\nb")], "doc_id long, text string")).collect()
    assert [r.text for r in twice] == ["a\nb", "a\nb"]


def test_no_link_is_lost_in_a_chain(spark):
    """Each line is similar to the next one only; all of them share keys with many others."""
    words = [f"word{k:03d}" for k in range(40)]
    lines = []
    for k in range(0, 40):
        words = list(words)
        words[k] = f"other{k:03d}"
        lines.append(" ".join(words))
    docs = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string").select(
        "doc_id", F.lit(0).cast("long").alias("_k"), "text")
    want = roots_of(lines)
    assert len(set(want.values())) == 1
    assert line_classes(docs).select("root").distinct().count() == 1


def test_short_and_periodic_lines_equal_all_pairs(spark):
    rng = random.Random(4)
    lines = ["-----", "------", "- - - -", "- - - - -", "Item 123", "Item 1234", "|---|---|", "|---|---|---|", "Chapter 1", "Chapter 10",
             "* * * * *", "* * * * * *", "=" * 40, "=" * 300, "+--" * 9, "+--" * 200, "0123456789" * 2, "0123456789" * 500]
    for size in range(5, 15):
        for _ in range(6):
            word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123") for _ in range(size))
            lines += [word, word + rng.choice("xyz"), rng.choice("xyz") + word, word[:-1], word[:-1] + "é"]
    for period in range(1, 40):  # on both sides of FEW
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123") for _ in range(period))
        lines += [(word * 40)[:k] for k in (period + 4, period + 5, 2 * period + 4, 3 * period + 9, 20 * period + 4)]
        lines += [(word * 40)[:6 * period] + "!", word + "#" + word]
    lines = sorted({x for x in lines if x.strip()})
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs).collect()), key=str)
    want = brute(list(enumerate(lines)))
    assert sum(r[3] for r in want) > 200
    assert got == want
