"""Linear-chain conditional random fields in numpy, over many sequences at once.

Sequences lie one after another in flat arrays. Steps go along time, over all sequences that are still running; sorted by
length, those are a prefix, so each step is a few array operations whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Weights: ``start`` (labels), ``move`` (labels x labels), ``emit`` (features x labels)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def spans_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the sequences that aren't empty, longest first."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[: np.count_nonzero(lengths)]
    return starts[order], lengths[order]


def _steps(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each time but the first, how many sequences run on and where their tokens lie."""
    running = np.bincount(lengths, minlength=1)[::-1].cumsum()[::-1] if len(lengths) else np.zeros(1, int)
    for t in range(1, int(lengths[0]) if len(lengths) else 0):
        k = int(running[t + 1])
        yield k, starts[:k] + t


def posteriors(scores: np.ndarray, lengths: np.ndarray, chain: Chain, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward: each token's label probabilities and, if asked for, the expected label pairs, summed."""
    starts, lengths = spans_of(lengths)
    local = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
    move = np.exp(chain.move - chain.move.max())
    ahead, back = np.empty_like(local), np.ones_like(local)
    now = local[starts] * np.exp(chain.start - chain.start.max())
    ahead[starts] = now = now / now.sum(axis=1, keepdims=True)
    steps = list(_steps(starts, lengths))
    for k, at in steps:
        now = (now[:k] @ move) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    expected = np.zeros_like(move, dtype=np.float64) if pairs else None
    for k, at in reversed(steps):
        later = local[at] * back[at]
        before = later @ move.T
        if pairs:
            whole = np.einsum("ij,ij->i", ahead[at - 1], before)  # of each sequence: over all pairs
            expected += move * ((ahead[at - 1] / whole[:, None]).T @ later)
        back[at - 1] = before / before.sum(axis=1, keepdims=True)
    both = ahead * back
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-30), expected


def viterbi(scores: np.ndarray, lengths: np.ndarray, chain: Chain) -> np.ndarray:
    """The likeliest labels of all sequences together."""
    starts, lengths = spans_of(lengths)
    labels = np.zeros(len(scores), dtype=np.int8)
    if not len(starts):
        return labels
    from_ = np.zeros(scores.shape, dtype=np.int8)
    final = np.empty((len(starts), scores.shape[1]), dtype=scores.dtype)
    now = final[:] = scores[starts] + chain.start
    steps = list(_steps(starts, lengths))
    for k, at in steps:
        best, who = now[:k, :1] + chain.move[:1], np.zeros((k, scores.shape[1]), dtype=np.int8)
        for i in range(1, scores.shape[1]):  # labels are few; a step per label keeps arrays flat
            other = now[:k, i : i + 1] + chain.move[i : i + 1]
            better = other > best
            best = np.where(better, other, best)
            who[better] = i
        from_[at] = who
        final[:k] = now = best + scores[at]
    labels[starts + lengths - 1] = final.argmax(axis=1)
    for _, at in reversed(steps):
        labels[at - 1] = from_[at, labels[at]]
    return labels


def emissions(chain: Chain, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum the weights of each token's features; ``features`` is flat, ``counts`` (1 at least) says how many a token has."""
    return np.add.reduceat(chain.emit[features], np.cumsum(counts) - counts, axis=0) if len(counts) else np.zeros((0, chain.emit.shape[1]), np.float32)


def train(data: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], features: int, labels: int, rounds: int = 4, rate: float = 0.15, decay: float = 1e-4, seed: int = 7) -> Chain:
    """Maximise the likelihood of labelled batches by AdaGrad.

    A batch is (flat features, features a token, tokens a sequence, labels of tokens).
    """
    chain = Chain(np.zeros(labels, np.float32), np.zeros((labels, labels), np.float32), np.zeros((features, labels), np.float32))
    sums = [np.full_like(w, 1e-2) for w in (chain.start, chain.move, chain.emit)]
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for b in rng.permutation(len(data)):
            flat, counts, lengths, gold = data[b]
            if not len(gold):
                continue
            likely, pairs = posteriors(emissions(chain, flat, counts), lengths, chain, pairs=True)
            wrong = np.eye(labels, dtype=np.float32)[gold] - likely
            starts, sizes = spans_of(lengths)
            inner = np.ones(len(gold), dtype=bool)
            inner[starts] = False
            seen = np.zeros_like(pairs)
            np.add.at(seen, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1.0)
            spread = np.repeat(wrong, counts, axis=0)
            grads = [wrong[starts].sum(axis=0), seen - pairs, np.stack([np.bincount(flat, weights=spread[:, k], minlength=features) for k in range(labels)], axis=1)]
            for w, total, g in zip((chain.start, chain.move, chain.emit), sums, grads, strict=True):
                g = g / len(starts) - decay * w
                total += g * g
                w += (rate * g / np.sqrt(total)).astype(np.float32)
    return chain
