"""Training blocks of the language model: their number is bounded, and every block takes part."""

import numpy as np

from reelstack.llm import lm_score

SHAPE = lm_score.Shape(vocab=12, rare=5, dim=6)
WORDS = "red blue green one two three far near up down left right".split()


def test_blocks_grow_where_their_number_may_not(spark):
    rng = np.random.default_rng(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(WORDS, 30))) for i in range(60)], "id long, text string")
    lex = lm_score.lexicon(lm_score.word_counts(docs.select("text"), SHAPE), 5, SHAPE)
    fit = lambda **sizes: lm_score.train(docs, docs.select("text").limit(10), lex, **sizes)
    one, capped, many = fit(), fit(block_tokens=50, most_blocks=1), fit(block_tokens=50)
    assert np.allclose(one.out, capped.out, atol=1e-6) and np.allclose(one.near, capped.near, atol=1e-6)
    assert np.isfinite(many.out).all() and not np.allclose(one.out, many.out, atol=1e-6)
