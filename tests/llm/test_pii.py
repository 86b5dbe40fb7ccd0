import hashlib
import random
import re

from equispan.llm.pii import find_personal_data
from equispan.llm.queries import op5_personal_data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in value.split(".")),
            "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m[0])] for k, p in BASE.items()}


def row(doc, text):
    b = base(text)
    joined = ",".join(f"{k}:{s}:{e}" for k in BASE for s, e in b[k])
    return (doc, *(len(b[k]) for k in BASE), hashlib.sha256(joined.encode()).hexdigest())


def test_query_equals_plain_patterns(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = op5_personal_data(spark, d).collect()
    want = sorted((row(r.doc_id, r.text) for r in docs), key=str)
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=str) == want
    assert all(sum(w[k] for w in want) > 3 for k in range(1, 5))
    text = {r.doc_id: r.text for r in docs}
    for r in got:
        b = base(text[r.doc_id])
        assert r.spans.startswith(",".join(f"{k}:{s}:{e}" for k in BASE for s, e in b[k]))


TEXTS = [
    None, "", "a@b.c_d@e.f a@b a@b. @b.c x@y.z.w- a@@b.c", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3 999999999999999999999.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 5", "+1 (743) 555-3824. +12 +123456789 ++441234567890 +1 2", "é 4111111111111111ß é@x.y",
    "1 " * 30000, "a" * 200000 + "@b.c", "9" * 100000, "a@b" + ".c" * 1500, ("x@y.zz, " * 700), "\x014111 1111\x011111 1111 \x01", "١٢٣ 1.1.1.1\n2.2.2.2",
    "4111-1111 1111-1111", "..@.. 1.1.1.1@a.b", "+1.1.1.1.1 4222222222222",
    "10.0.0.1 127.0.0.1 192.168.0.1 0.0.0.0 1.2.3.00", "00.000.0000.0 0256.1.1.1 1.2.3.0255 1.2.3.00256 255.255.255.255",
]


def test_edges(spark):
    docs = [(k if k % 5 else None, t) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3])]
    df = spark.createDataFrame([(*r, "e") for r in docs], "doc_id long, text string, email string")
    out = find_personal_data(df).collect()
    got = sorted(((r.doc_id, *(len(r[k]) for k in BASE), hashlib.sha256(",".join(
        f"{k}:{s.start}:{s.end}" for k in BASE for s in r[k]).encode()).hexdigest()) for r in out), key=str)
    assert got == sorted((row(*r) for r in docs), key=str)
    assert find_personal_data(df.limit(0)).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000000000004"]
    docs = [(k, f"{'filler ' * k}Charge my Visa card {c} for it") for k, c in enumerate(cards)]
    docs += [(10, "please charge my VISA card 4111111111111112, thanks"), (11, "the order number 4111111111111112 is late"),
             (12, "my visa card AB-4111 is old"), (13, "his visa card 4111111111111113"), (14, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    out = {r.doc_id: [tuple(s) for s in r.id] for r in find_personal_data(df).collect()}
    at = docs[4][1].index("4111")
    assert out[10] == [(at, at + 16)]
    assert out[13] == [(14, 30)]  # the words before it are the same two
    assert out[12] == [(13, 20)]  # of another form, in the same words
    assert not any(out[k] for k in (0, 1, 2, 3, 11, 14))
    assert not any(r.id for r in find_personal_data(df, support=5).collect())


def test_full_shapes_discover_too_and_mixed_contexts_do_not(spark):
    docs = [(k, f"please email me: user{k}@mail{k}.com") for k in range(6)] + [(10, "please email me: user-at-mail77"), (11, "please email me: handle_9981")]
    docs += [(20 + k, f"see page no: {100000 + k}") for k in range(20)] + [(50 + k, f"see page no: 10.0.0.{k}") for k in range(3)]
    out = {r.doc_id: [tuple(s) for s in r.id] for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {k for k, v in out.items() if v} == {10, 11}
    assert out[10] == [(17, 31)]


def test_long_texts_equal_plain_patterns(spark):
    rnd = random.Random(3)
    numbers = " ".join(f"n{k}, {rnd.randrange(10 ** 15)}" for k in range(50_000))  # above 1 MB
    bits = ["0", "1", "25", "4111 1111 1111 1111", "+1 (743) 555-3824", "1.2.3.4", ".", "-", " ", " ", "+", "a@b.c", "(", ")", "é", "\n", "x", "\x01", ","]
    docs = [(k, "".join(rnd.choices(bits, k=6000))) for k in range(40)] + [(100, numbers), (100, numbers), (101, "1 " * 9000 + "a@b.c"), (None, docs_words(rnd))]
    out = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, {k: [tuple(s) for s in r[k]] for k in BASE}) for r in out), key=str)
    assert got == sorted(((d, base(t)) for d, t in docs), key=str)
    assert sum(len(x["card"]) for _, x in got) > 1000


def docs_words(rnd):
    return " ".join(rnd.choice(["mail a.b@c.de now", "word", "call +44 20 7946 0958", "10.0.0.1:"]) for _ in range(20_000))


def test_contexts_reach_over_pieces(spark):
    """An instance right behind a cut has its two words in the piece before."""
    cards = ["4111111111111111", "5500005555555559", "340000000000009"]
    docs = [(k, f"my visa card {c}") for k, c in enumerate(cards)]
    for k in range(30):
        docs.append((100 + k, "w" * (4070 + k) + " my visa card 4111111111111113 " + "more " * 2000))
    out = {r.doc_id: [tuple(s) for s in r.id] for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, text in docs[3:]:
        at = text.index("4111")
        assert out[k] == [(at, at + 16)]


def test_random_texts_equal_plain_patterns(spark):
    rnd = random.Random(9)
    bits = ["0", "00", "1", "9", "25", "255", "256", "4111", "1111", ".", ".", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "é", "\n", "\x01", "%"]
    part = ["0", "00", "1", "9", "25", "255", "256", "0255", "000"]
    docs = [(k, "".join(rnd.choices(bits, k=rnd.randrange(40))) + ".".join(rnd.choices(part, k=rnd.choice([0, 3, 4, 4, 5, 8])))) for k in range(1500)]
    out = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: {k: [tuple(s) for s in r[k]] for k in BASE} for r in out}
    assert got == {k: base(t) for k, t in docs}
    assert sum(len(x["ip"]) for x in got.values()) > 20
