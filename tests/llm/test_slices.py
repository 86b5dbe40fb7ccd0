"""What a task holds at once stays small: the slices of text that n-grams and phrases are taken from."""
import tracemalloc

import numpy as np
import pyarrow as pa

from equispan.llm import collocations, toxicity


def peak(run):
    tracemalloc.start()
    out = list(run())
    size = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, size / (1 << 20)


def texts(n=4000):
    words = np.random.default_rng(1).integers(0, 3000, (n, 150))
    return [" ".join(f"w{k}x" for k in row) for row in words]


def test_toxicity_counts_in_small_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(texts()), pa.array(np.arange(4000) % 2)], names=["_text", "toxic"])
    out, size = peak(lambda: toxicity._count(iter([batch])))
    assert out[0].num_rows and size < 150


def test_phrases_are_counted_in_small_parts():
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 4000), pa.array(texts()), pa.array(np.zeros(4000, np.int32))], names=["lang", "text", "shard"])
    total = [0]

    def run():
        for out in collocations._short(iter([batch] * 4)):
            total[0] += int(out.column("n").to_numpy().sum())
            yield 0
    _, size = peak(run)
    assert total[0] == 4 * 4000 * (150 + 149) and size < 110
