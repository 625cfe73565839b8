"""Languages by the hundred: none is left out, whatever their number."""

import numpy as np
import pytest

from loomgraph.llm import chain, language


def words(k, n=60):
    rng = np.random.default_rng(k)
    parts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 2)) for _ in range(12)]
    return ["".join(rng.choice(parts) for _ in range(rng.integers(2, 4))) for _ in range(n)]


def texts(n, rows, seed=1):
    rng = np.random.default_rng(seed)
    own = [words(k) for k in range(n)]
    return [(" ".join(rng.choice(own[k]) for _ in range(40)), f"l{k:03d}") for k in range(n) for _ in range(rows)]


def test_two_hundred_labels_are_learned_and_predicted(spark, monkeypatch):
    monkeypatch.setattr(language, "CELLS", 1 << 19)
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts(200, 8))], "doc_id long, text string, lang string")
    model = language.learned(df)
    assert len(model.langs) == 200 and model.chain.emit.shape == (2048, 200)
    told = spark.createDataFrame([(i, t, None) for i, (t, _) in enumerate(texts(200, 2, seed=2))], df.schema)
    got = language.identify(told, model).collect()
    right = [r.lang_pred == f"l{r.doc_id // 2:03d}" for r in got]
    assert np.mean(right) > 0.95 and {r.lang_pred for r in got} == set(model.langs)
    assert language.keep_identified(told, model).count() > 0.95 * len(got)


def test_more_labels_than_a_model_holds_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGS", 20)
    rows = spark.createDataFrame([(i, "some words", f"x{i}") for i in range(60)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 20"):
        language.sample(rows)


def test_expected_pairs_equal_enumeration():
    rng = np.random.default_rng(3)
    model = chain.Chain(*(rng.normal(0, 1, s) for s in ((3,), (3, 3), (1, 3))))
    scores, lengths = rng.normal(0, 1, (9, 3)), np.array([4, 0, 3, 2])
    got = chain.posteriors(scores, lengths, model, pairs=True)[1]
    want, at = np.zeros((3, 3)), 0
    for n in lengths:
        weights = {}
        for path in np.ndindex(*(3,) * n):
            weights[path] = np.exp(sum(scores[at + t, x] for t, x in enumerate(path)) + (model.start[path[0]] if n else 0) + sum(model.move[a, b] for a, b in zip(path, path[1:])))
        for path, w in weights.items():
            for a, b in zip(path, path[1:]):
                want[a, b] += w / sum(weights.values())
        at += n
    assert np.allclose(got, want)
