import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import public_tokenizers
import test_decontaminate
import test_lines
import test_packing
import test_simhash
from tokenizers import Tokenizer

import corpus_pipeline
from equispan.llm.toxicity import score_toxicity

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = docs.columns
    labels = spark.read.parquet(f"{D}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]

    toxic = {r.doc_id for r in score_toxicity(docs, labels).collect() if r.predicted}
    civil = stages["toxicity"](spark, docs, D).cache()
    assert civil.columns == names and toxic
    assert rows(civil) == sorted((tuple(r) for r in docs.collect() if r.doc_id not in toxic), key=str)

    lined = stages["line_dedup"](spark, civil, D).cache()
    given = {r.doc_id: r for r in civil.collect()}
    want = []
    for d, text, _, removed in test_lines.brute([(r.doc_id, r.text) for r in given.values()]):
        if not removed or text.replace("\n", "").strip(" "):
            want.append((d, text, given[d].lang, given[d].source, len(text)))
    assert lined.columns == names
    assert len(set(rows(lined)) ^ set(want)) <= 4  # banding may miss one pair in a thousand

    single = stages["simhash_near_dedup"](spark, lined, D).cache()
    prints = [(r.doc_id, test_simhash.print_of(r.text)) for r in lined.collect()]
    stay = {d for (d, _), c in zip(prints, test_simhash.classes(prints), strict=True) if d == c}
    assert single.columns == names
    assert rows(single) == sorted((tuple(r) for r in lined.collect() if r.doc_id in stay), key=str)

    clean = stages["decontamination"](spark, single, D).cache()
    items = spark.read.parquet(f"{D}/benchmark.parquet").collect()
    bad = {r[0] for r in test_decontaminate.brute([(r.doc_id, r.text) for r in single.collect()], items) if r[5]}
    assert clean.columns == names and bad
    assert rows(clean) == sorted((tuple(r) for r in single.collect() if r.doc_id not in bad), key=str)

    packed = stages["packing"](spark, clean, D).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    test_packing.check(packed, [(r.doc_id, r.text) for r in clean.collect()], tokenizer, 0.01)
    assert corpus_pipeline.run(spark, D).count() == len(packed)


def test_nulls_ties_and_empty_tables(spark):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, "en", None, 0), (1, None, "en", None, 0), (None, "a b c", None, "s", 5), (2, "", None, None, None),
                                  (3, "x " * 20000, "en", "s", 1), (4, "one two\nthree", "en", "s", 1), (4, "one two\nthree", "en", "s", 1)], kinds)
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, D)
            assert kept.columns == docs.columns
        assert (corpus_pipeline.STAGES[-1][1](spark, kept, D).count() > 0) == (table is docs)
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, D).collect()} == {1, None, 3, 4}
    assert corpus_pipeline.keep_one_of_each_group(spark, docs, D).count() == 4
