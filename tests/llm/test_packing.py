import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from equispan.llm.packing import encoder, pack, pack_documents, plan
from equispan.llm.queries import op10_best_fit_packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, tokenizer, slack):
    want = defaultdict(list)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for p in range(-(-len(ids) // 4096)):
            part = ids[p * 4096:(p + 1) * 4096]
            want[doc, p].append((p * 4096, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece].append((r.start, r.length, r.ids_crc32))
        places[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(n for p in places.values() for _, n in p)
    assert len(places) <= -(-total // 4096) * (1 + slack) + 1


def test_query_places_all_pieces(spark, tokenizer):
    d = "/root/testdata/sf0.01"
    texts = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    check(op10_best_fit_packing(spark, d).collect(), texts, tokenizer, 0.002)


def test_edges(spark, tokenizer):
    texts = [(1, None), (2, ""), (2, ""), (3, "word " * 9000), (4, "a <|endoftext|> b"), (None, "it's, x."), (5, "word " * 4095), (6, "word " * 4096)]
    texts += [(10 + k, "tie tie tie") for k in range(300)]
    docs = spark.createDataFrame([(*t, 7) for t in texts], "doc_id long, text string, sequence_id int")
    rows = pack_documents(docs).collect()
    check(rows, texts, tokenizer, 0.01)
    assert all(len(r.ids) == r.length for r in rows)
    assert pack_documents(docs.limit(0)).count() == 0
    parts = spark.range(500).selectExpr("id doc_id", "1 + id % 3 length", "id clash")
    packed = pack(parts, capacity=10, part_rows=20).collect()
    assert len({r.sequence_id for r in packed}) == -(-sum(r.length for r in packed) // 10)
    with pytest.raises(ValueError, match="lengths"):
        pack(parts, capacity=2)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(6, 1, 20000), 1, 4096).astype(int)
    x, n = np.unique(lengths, return_counts=True)
    runs, sequences = plan(dict(zip(x.tolist(), n.tolist(), strict=True)))
    assert sum(r[2] for r in runs) == len(lengths)
    assert sequences <= -(-int(lengths.sum()) // 4096) * 1.003
    assert len(runs) < 30_000


def lists(encoded):
    return [x.tolist() for x in np.split(encoded[0], encoded[1][1:-1])]


@pytest.mark.parametrize("text", ["", " a  b\n\nc\t d", "don't, won't.,", "x,.'s ,y", "É ́e ﬁ ,.a", "1,2.3 a1,", "a\x1cb\x85c d e", "''', a',", "ǅ ªº ʰa, İstanbul. ΑΣ, ﬃ", "İ, İ. aİ,. İİ.", "ÅΣ. ẞ, ŉ. ǰ,"])
def test_remembered_parts_equal_whole_texts(text, tokenizer):
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = tokenizer.encode(text, add_special_tokens=False).ids
    assert lists(encode(pa.array([text, "", text]))) == [want, [], want]


def test_random_texts_equal_whole_texts(tokenizer):
    rnd = np.random.default_rng(2)
    signs = list("aBcİıΣßﬁŉǰÅ\u0301\u0307éÉ,.' \n1") + ["İ.", "İ,", " the "]
    texts = ["".join(rnd.choice(signs, rnd.integers(0, 25))) for _ in range(3000)]
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    got = [ids for k in range(0, len(texts), 100) for ids in lists(encode(pa.array(["", *texts]).slice(k + 1, 100)))]
    assert got == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_forgotten_parts_are_encoded_again(tokenizer, monkeypatch):
    monkeypatch.setattr("equispan.llm.packing.REMEMBERED", 5)
    encode = encoder(public_tokenizers.path("word_bpe_49k.json"))
    for text in ["one two three, four. (five) six!", "three, one seven", "", "eight one. six!"]:
        assert lists(encode(pa.array([text]))) == [tokenizer.encode(text, add_special_tokens=False).ids]
