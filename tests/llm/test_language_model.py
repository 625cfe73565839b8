"""The language model learns from both sides: it tells texts from their words in another order, and does better than counting words."""

import numpy as np

from loomgraph.llm import lm


def test_scores_know_the_order_of_words(spark, sf_dir):
    texts = [r.text for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("text").collect() if r.text]
    rng = np.random.default_rng(4)
    mixed = []
    for t in texts:
        words = "".join(c if c.isalpha() else " " for c in t).split()
        mixed.append(" ".join(rng.permutation(words)) if words else "")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    counts = lm.word_counts(df)
    words = lm.vocabulary(counts)
    context = spark.sparkContext
    net = lm.train(lm.settle(lm.coded(df, context.broadcast(words))))
    coder = lm.Coder(words)

    def means(some):
        tokens, owner = coder.tokens(some)
        at = np.flatnonzero(owner >= 0)
        n = np.bincount(owner[at], minlength=len(some))
        return np.bincount(owner[at], weights=net.scores(tokens, at), minlength=len(some)), n

    (own, n), (other, m) = means(texts), means(mixed)
    assert (n == m).all() and (own[n > 1] > other[n > 1]).mean() >= 0.9
    code, *_ = coder.coded(texts)
    share = np.bincount(code, minlength=lm.CLASSES**2) / len(code)
    assert own.sum() / n.sum() >= np.log(share[code]).mean() + 0.64

