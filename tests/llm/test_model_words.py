"""Words of the language model."""

import numpy as np
import pytest

from loomgraph.llm import lm
from loomgraph.llm.language import words_of


@pytest.mark.parametrize("texts", [["", "", "a b", "", "é x1 \n y", "𝒜 Ω\ud800z", ""], [""], ["1 2"], ["a"], ["Aa aa", "b" * 300]])
def test_hashes_are_those_of_all_words(texts):
    # The model took words apart in full, with lines and digits that it has no use for.
    want, (hashes, text) = words_of(texts), lm.hashes_of(texts)
    assert want.hashes.tolist() == hashes.tolist() and want.text.tolist() == text.tolist()


def test_a_step_moves_weights_by_the_plain_gradients(monkeypatch):
    """Sums by products and by pairs of numbers against sums one by one."""
    rng = np.random.default_rng(1)
    tokens, owner = lm.laid(rng.zipf(1.3, 3000) % lm.VOCABULARY, np.repeat([0, 1], 1500), 2)
    at, net = np.flatnonzero(owner >= 0), lm.Network()
    before, h = net.w["near"].copy(), net.hidden(tokens, at)
    wrong = net._wrong(h @ net.w["class"] + net.w["class_bias"], tokens[at] // lm.CLASSES, False)
    back = wrong @ net.w["class"].T
    inner = np.stack([net._wrong((x @ net.w["word"][c] + net.w["word_bias"][c])[None], np.array([m]), False)[0] for x, c, m in zip(h, tokens[at] // lm.CLASSES, tokens[at] % lm.CLASSES)])
    back += np.stack([x @ net.w["word"][c].T for x, c in zip(inner, tokens[at] // lm.CLASSES)])
    back *= (1 - h * h) / len(at)
    net.learn(tokens, at)
    for k, p in enumerate(lm.PLACES):
        g = np.zeros_like(before[k])
        np.add.at(g, tokens[at + p], back)
        want = before[k] + 0.2 * g / np.sqrt(lm.FIRST_SUMS["near"] + (g * g).mean(axis=1))[:, None]
        assert np.allclose(net.w["near"][k], want, atol=2e-3)
