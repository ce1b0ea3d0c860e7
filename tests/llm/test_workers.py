"""Workers forget their tables and go on as before."""

import numpy as np

from trackhouse.llm import bpe, words, workers


def test_forget_and_release(spark):
    before = words.powers(3, 1000)
    bpe._classes()
    workers.forget()
    assert words._powers.cache_info().currsize == 0 and bpe._classes.cache_info().currsize == 0
    assert all((a == b).all() for a, b in zip(before, words.powers(3, 1000)))

    def fill(batches):
        for b in batches:
            words.powers(5, 100_000)
            yield b

    def kept(batches):
        for b in batches:
            yield type(b).from_pydict({"id": np.full(b.num_rows, words._powers.cache_info().currsize)})

    spark.range(0, 64, 1, 8).mapInArrow(fill, "id long").count()
    workers.release(spark)
    assert {r.id for r in spark.range(0, 8, 1, 8).mapInArrow(kept, "id long").collect()} == {0}
