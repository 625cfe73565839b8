"""Language-model scoring by masked pseudo-likelihood."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import over_batches, settle
from .language import PRIME, letters

#: Words are predicted as one of CLASSES classes, then as one of CLASSES members: two small softmaxes, exactly normalised.
CLASSES = 64
RARE = 63  # buckets that stand for words outside the vocabulary
EDGE = CLASSES * CLASSES - 1  # the token beyond a text's ends
VOCABULARY = CLASSES * CLASSES - RARE - 1
#: Neighbours seen on either side, and the size of the hidden layer.
SIDE, HIDDEN = 2, 24
PLACES = [k for k in range(-SIDE, SIDE + 1) if k]
#: Rounds of training over all positions; words of a step, words that steps are drawn from at a time, and pieces of the weights.
ROUNDS, STEP, SHUFFLED, PIECES = 1, 8192, 1 << 16, 16
#: AdaGrad's sums at first. Gradients are means over a step, so those of one word's weights are tiny, and sums must begin below their
#: squares: else no word's vector moves in one round, and the network learns little but how common words are.
FIRST_SUMS = {"near": 1e-9}
#: Words that one copy of the network learns from, about: the corpus is dealt out to copies by its rows' hashes, whatever its
#: partitions, and copies are added up a FAN at a time.
COPY_WORDS, FAN = 2_000_000, 32


#: Sums over short rows are products with ones, which are several times as fast.
ONES = np.ones(CLASSES, np.float32)
#: Counts of words with at least one in FREQUENT of all tokens, so of at most FREQUENT words, go to every task; those of the rest are joined.
FREQUENT = 1 << 20


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words that ``words_of`` finds, and the text of each; where words lie isn't asked for."""
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.zeros(len(raw) + 2, np.uint32)
    np.take(letters(), raw, out=codes[1:-1], mode="clip")
    inside = codes != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, length = edge[::2], edge[1::2] - edge[::2]
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    begin = np.cumsum(length) - length
    mixed = codes[inside].astype(np.uint64)
    mixed *= PRIME
    place = np.arange(len(mixed))
    place -= np.repeat(begin, length)
    mixed *= np.cumprod(np.full(int(length.max()), 0x100000001B3, dtype=np.uint64))[place]
    hashes = np.add.reduceat(mixed, begin)
    hashes ^= hashes >> np.uint64(31)
    upto = np.searchsorted(first, np.cumsum([len(t) + 1 for t in texts]))
    return hashes, np.repeat(np.arange(len(texts)), np.diff(upto, prepend=0))


def word_counts(docs: DataFrame) -> DataFrame:
    """``hash, n``: how often the corpus holds each of its words."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            found, n = np.unique(hashes_of([t or "" for t in batch.column(0).to_pylist()])[0], return_counts=True)
            return {"hash": found.view(np.int64), "n": n.astype(np.int64)}

        return apply

    return over_batches(docs.select("text"), "hash bigint, n bigint", "text", make, 1 << 19).groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> np.ndarray:
    """Hashes of the commonest words, most frequent first."""
    top = counts.orderBy(F.desc("n"), "hash").limit(VOCABULARY).collect()
    return np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)


def rare_words(counts: DataFrame, words: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """``hash, n`` of all words outside the vocabulary, and how many tokens each bucket stands for."""
    known = counts.sparkSession.createDataFrame([(h,) for h in words.view(np.int64).tolist()], "hash bigint")
    rest = counts.join(F.broadcast(known), "hash", "left_anti")
    # Hashes are unsigned: 2 ** 64 leaves 16 when divided by RARE.
    bucket = F.pmod(F.pmod("hash", F.lit(RARE)) + F.when(F.col("hash") < 0, (1 << 64) % RARE).otherwise(0), F.lit(RARE)).cast("int")
    held = np.zeros(RARE)
    for r in rest.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        held[r["bucket"]] = r["n"]
    return rest, held


class Coder:
    """Words to token numbers: the rank of a known word, a bucket of the rest."""

    def __init__(self, words: np.ndarray) -> None:
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts' tokens and the text of each, then the hash and the text of each word outside the vocabulary."""
        hashes, text = hashes_of(texts)
        at = np.minimum(np.searchsorted(self.sorted, hashes), max(0, len(self.sorted) - 1))
        known = self.sorted[at] == hashes if len(self.sorted) else np.zeros(len(hashes), bool)
        rare = np.flatnonzero(~known)
        code = self.order[at] if len(self.sorted) else np.zeros(len(hashes), np.int64)
        code[rare] = VOCABULARY + (hashes[rare] % np.uint64(RARE)).astype(np.int64)
        return code, text, hashes[rare], text[rare]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' tokens ``laid`` out."""
        code, text, _, _ = self.coded(texts)
        return laid(code, text, len(texts))


def laid(code: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with SIDE edges before, between and after texts, and the text of each (-1 at edges)."""
    place = np.arange(len(code)) + SIDE * (text + 1)
    tokens, owner = np.full(len(code) + SIDE * (texts + 1), EDGE), np.full(len(code) + SIDE * (texts + 1), -1)
    tokens[place], owner[place] = code, text
    return tokens, owner


class Network:
    """Each neighbour's vector for its place, summed, through tanh, to the word's class and to the word within it."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None, seed: int = 29) -> None:
        rng = np.random.default_rng(seed)
        make = lambda *s: (0.1 * rng.standard_normal(s)).astype(np.float32)
        self.sums: dict[str, np.ndarray] = {}
        self.seen = 0  # targets of the training rounds
        self.w = weights or {"near": make(len(PLACES), CLASSES * CLASSES, HIDDEN), "class": make(HIDDEN, CLASSES), "class_bias": np.zeros(CLASSES, np.float32), "word": make(CLASSES, HIDDEN, CLASSES), "word_bias": np.zeros((CLASSES, CLASSES), np.float32)}

    def hidden(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.tanh(sum(self.w["near"][k, tokens[at + p]] for k, p in enumerate(PLACES)))

    @staticmethod
    def _grouped(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of rows by class, the classes there are, and where each begins in that order (and the last ends)."""
        order = np.argsort(classes.astype(np.uint8), kind="stable")
        begin = np.flatnonzero(np.diff(classes[order], prepend=-1))
        return order, classes[order][begin], np.append(begin, len(order))

    def _logits(self, h: np.ndarray, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Of rows by class, the members' logits within it."""
        out = np.empty((len(h), CLASSES), np.float32)
        for c, i, j in zip(found.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            np.matmul(h[i:j], self.w["word"][c], out=out[i:j])
            out[i:j] += self.w["word_bias"][c]
        return out

    def _tame(self) -> bool:
        """Whether no logit can be beyond the reach of an exponential: hidden values lie between -1 and 1."""
        w = self.w
        most = [np.abs(w["class"]).sum(axis=0).max() + np.abs(w["class_bias"]).max(), np.abs(w["word"]).sum(axis=1).max() + np.abs(w["word_bias"]).max()]
        return bool(max(most) < 60)

    @staticmethod
    def _chosen(logits: np.ndarray, gold: np.ndarray, tame: bool) -> np.ndarray:
        """Log-softmax at one column of each row."""
        if not tame:
            logits -= logits.max(axis=1, keepdims=True)
        picked = logits[np.arange(len(gold)), gold]
        return picked - np.log(np.exp(logits, out=logits) @ ONES)

    @staticmethod
    def _wrong(logits: np.ndarray, gold: np.ndarray, tame: bool) -> np.ndarray:
        """Gradient of the log-softmax at one column of each row."""
        if not tame:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits *= (-1 / (logits @ ONES))[:, None]
        logits[np.arange(len(gold)), gold] += 1
        return logits

    def scores(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of each token at ``at`` given the words on both sides; arrays stay small enough for caches."""
        out, tame = np.empty(len(at), np.float32), self._tame()
        for i in range(0, len(at), 8192):
            part = at[i : i + 8192]
            order, found, begin = self._grouped(tokens[part] // CLASSES)
            part = part[order]
            h = self.hidden(tokens, part)
            now = self._chosen(h @ self.w["class"] + self.w["class_bias"], tokens[part] // CLASSES, tame)
            out[i + order] = now + self._chosen(self._logits(h, found, begin), tokens[part] % CLASSES, tame)
        return out

    def learn(self, tokens: np.ndarray, at: np.ndarray, rate: float = 0.2) -> None:
        """One step of AdaGrad on the tokens at ``at``; rows of ``near`` share a step size each."""
        w, tame = self.w, self._tame()
        if not self.sums:
            self.sums = {k: np.full(v.shape[:2] if k == "near" else v.shape, FIRST_SUMS.get(k, 1e-7), np.float32) for k, v in w.items()}
        order, found, begin = self._grouped(tokens[at] // CLASSES)
        at = at[order]
        h, n = self.hidden(tokens, at), np.float32(len(at))

        def move(name: str, where, g: np.ndarray) -> None:
            g /= n
            self.sums[name][where] += g * g
            w[name][where] += rate * g / np.sqrt(self.sums[name][where])

        wrong = self._wrong(h @ w["class"] + w["class_bias"], tokens[at] // CLASSES, tame)
        back = wrong @ w["class"].T
        move("class", slice(None), h.T @ wrong)
        move("class_bias", slice(None), np.ones(len(at), np.float32) @ wrong)
        wrong = self._wrong(self._logits(h, found, begin), tokens[at] % CLASSES, tame)
        grads, sums, ones = np.empty((len(found), HIDDEN, CLASSES), np.float32), np.empty((len(found), CLASSES), np.float32), np.ones(len(at), np.float32)
        for k, (c, i, j) in enumerate(zip(found.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
            back[i:j] += wrong[i:j] @ w["word"][c].T
            np.matmul(h[i:j].T, wrong[i:j], out=grads[k])
            np.matmul(ones[i:j], wrong[i:j], out=sums[k])
        move("word", found, grads)
        move("word_bias", found, sums)
        back *= (1 - h * h) / n
        for k, p in enumerate(PLACES):
            ids = tokens[at + p].astype(np.uint16)  # two bytes are sorted by counting
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            first = np.flatnonzero(np.diff(ids.astype(np.int32), prepend=-1))
            # Two numbers at a time: sums of complex numbers are sums of their parts.
            g, rows = np.add.reduceat(back[order].view(np.complex64), first, axis=0).view(np.float32), ids[first]
            self.sums["near"][k][rows] += (g * g).mean(axis=1)
            w["near"][k][rows] += rate * g / np.sqrt(self.sums["near"][k][rows])[:, None]

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w[k].ravel() for k in sorted(self.w)])

    @staticmethod
    def shaped(flat: np.ndarray) -> Network:
        net, at = Network(), 0
        for k in sorted(net.w):
            n = net.w[k].size
            net.w[k], at = flat[at : at + n].reshape(net.w[k].shape).astype(np.float32), at + n
        return net


def coded(docs: DataFrame, words) -> DataFrame:
    """``row, doc_id, draw, n_tokens, tokens, rare``: each text's tokens as two bytes each, and the hashes of its words outside
    the vocabulary (broadcast ``words``). ``draw`` is a hash of id and text."""

    def make():
        coder = Coder(words.value)

        def apply(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(3).to_pylist()]
            code, text, hashes, owner = coder.coded(texts)
            ends = np.cumsum(np.bincount(text, minlength=len(texts)))
            left = np.bincount(owner, minlength=len(texts))
            rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), pa.array(hashes.view(np.int64)))
            tokens = [x.tobytes() for x in np.split(code.astype("<u2"), ends[:-1])]
            return {"row": batch.column(0), "doc_id": batch.column(1), "draw": batch.column(2), "n_tokens": np.diff(ends, prepend=0), "tokens": pa.array(tokens, pa.binary()), "rare": rare}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", "text").alias("draw"), "text")
    return over_batches(numbered, f"row bigint, doc_id {kind}, draw bigint, n_tokens bigint, tokens binary, rare array<bigint>", "text", make, 1 << 19)


def _steps(own: Network, parts: list[np.ndarray], rng: np.random.Generator) -> int:
    """Learn from every position of some texts, in random order."""
    tokens, owner = laid(np.concatenate(parts).astype(np.int64), np.repeat(np.arange(len(parts)), list(map(len, parts))), len(parts))
    at = np.flatnonzero(owner >= 0)
    rng.shuffle(at)
    for i in range(0, len(at), STEP):
        own.learn(tokens, at[i : i + STEP])
    return len(at)


def _round(table: DataFrame, copies: int, net, number: int) -> Network:
    """Copies of the network each learn from all positions of the texts that hashes deal to them, in the order of these; the
    copies' mean, by words seen, is next.

    What a copy sees depends on the rows alone, so partitions don't show in the result. Weights go out in pieces, and are
    added up a FAN of copies at a time; each piece's copies are added up as they stream by, so no task holds more than its sums.
    """
    columns = "copy int, piece int, seen double, weights binary, wide boolean"

    def learn(batches):
        now, own, rng, parts, held, seen = None, None, None, [], 0, 0

        def ended():
            n = seen + (_steps(own, parts, rng) if held else 0)
            if n:
                pieces = np.array_split(own.flat().astype("<f4"), PIECES)
                yield pa.RecordBatch.from_pydict({"copy": pa.array([now] * PIECES, pa.int32()), "piece": pa.array(range(PIECES), pa.int32()), "seen": [float(n)] * PIECES, "weights": [p.tobytes() for p in pieces], "wide": [False] * PIECES})

        for batch in batches:
            for copy, tokens in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if copy != now:
                    if now is not None:
                        yield from ended()
                    now, own, rng, parts, held, seen = copy, Network.shaped(net.value), np.random.default_rng([number, copy]), [], 0, 0
                parts.append(np.frombuffer(tokens.as_buffer(), "<u2"))
                held += len(parts[-1])
                if held >= SHUFFLED:
                    seen += _steps(own, parts, rng)
                    parts, held = [], 0
        if now is not None:
            yield from ended()

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        totals: Counter[tuple[int, int]] = Counter()
        for batch in batches:
            for copy, piece, seen, weights, wide in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                key = copy, piece
                sums[key] = sums.get(key, 0.0) + seen * np.frombuffer(weights, "<f8" if wide else "<f4").astype(np.float64)
                totals[key] += seen
        for key in sums:
            yield pa.RecordBatch.from_pydict({"copy": pa.array([key[0]], pa.int32()), "piece": pa.array([key[1]], pa.int32()), "seen": [totals[key]], "weights": [(sums[key] / totals[key]).tobytes()], "wide": [True]})

    dealt = table.filter("n_tokens > 0").select(F.pmod("draw", F.lit(copies)).cast("int").alias("copy"), "tokens", "draw")
    rows = dealt.repartitionByRange(copies, "copy").sortWithinPartitions("copy", "draw").select("copy", "tokens").mapInArrow(learn, columns)
    left = copies
    while left > 1:
        left = -(-left // FAN)
        rows = rows.withColumn("copy", F.pmod("copy", F.lit(left))).repartition(left * PIECES, "copy", "piece").mapInArrow(add, columns)
    found = rows.orderBy("piece").collect()
    if not found:
        return Network()
    mean = Network.shaped(np.concatenate([np.frombuffer(r["weights"], "<f8" if r["wide"] else "<f4").astype(np.float64) for r in found]))
    mean.seen = int(found[0]["seen"])
    return mean


def train(table: DataFrame, rounds: int = ROUNDS, copy_words: int = COPY_WORDS) -> Network:
    """The network after ``rounds`` of distributed training over all positions of all texts of ``table`` (``coded``, settled)."""
    context, net = table.sparkSession.sparkContext, Network()
    words = table.agg(F.sum("n_tokens")).first()[0] or 0
    for k in range(rounds if words else 0):
        seen = net.seen
        net = _round(table, -(-words // copy_words), context.broadcast(net.flat()), k)
        net.seen += seen
    return net


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS, copy_words: int = COPY_WORDS) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood, perplexity`` for each row of ``docs`` (doc_id, text).

    A token is a run of letters. ``log_likelihood`` sums over all tokens of the whole text the log-probability of the token
    given two words on either side. The network predicts the commonest words (VOCABULARY) and buckets of all others; a word
    in a bucket has the bucket's probability times its share of the bucket's tokens in the corpus. Null texts and texts
    without letters have no tokens: sum 0, and no mean. Repeated rows score alike. The result doesn't depend on how the table
    is partitioned. An empty table trains nothing and scores nothing.
    """
    context = docs.sparkSession.sparkContext
    counts = settle(word_counts(docs))
    words = vocabulary(counts)
    # Rows keep their numbers once they are written; texts are read twice, to count and to code them.
    table = settle(coded(docs, context.broadcast(words)))
    net = train(table, rounds, copy_words)
    rest, held = rare_words(counts, words)
    least = max(1, (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT)
    often = rest.filter(F.col("n") >= least).toArrow().sort_by("hash")
    weights = context.broadcast(net.flat())
    often = context.broadcast((often["hash"].to_numpy(), np.log(often["n"].to_numpy()), np.log(np.maximum(held, 1))))

    def make():
        own = Network.shaped(weights.value)
        frequent, logs_of, bucket_logs = often.value

        def apply(batch: pa.RecordBatch) -> dict:
            n = batch.column(2).to_numpy()
            code = np.concatenate([np.frombuffer(t.as_buffer(), "<u2") for t in batch.column(3)]).astype(np.int64)
            tokens, owner = laid(code, np.repeat(np.arange(len(n)), n), len(n))
            at = np.flatnonzero(owner >= 0)
            total = np.bincount(owner[at], weights=own.scores(tokens, at), minlength=len(n))
            rare = batch.column(4)
            hashes, text = rare.flatten().to_numpy(), np.repeat(np.arange(len(n)), rare.value_lengths().to_numpy())
            total -= np.bincount(text, weights=bucket_logs[(hashes.view(np.uint64) % np.uint64(RARE)).astype(np.int64)], minlength=len(n))
            where = np.minimum(np.searchsorted(frequent, hashes), max(0, len(frequent) - 1))
            found = frequent[where] == hashes if len(frequent) else np.zeros(len(hashes), bool)
            total += np.bincount(text[found], weights=logs_of[where[found]], minlength=len(n))
            left = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(text[~found], minlength=len(n)))]), pa.int32()), pa.array(hashes[~found]))
            return {"row": batch.column(0), "doc_id": batch.column(1), "n_tokens": n, "total": total, "rare": left}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = settle(over_batches(table.select("row", "doc_id", "n_tokens", "tokens", "rare"), f"row bigint, doc_id {kind}, n_tokens bigint, total double, rare array<bigint>", "tokens", make, 1 << 18), table)
    terms = scored.select("row", F.explode("rare").alias("hash")).join(rest.filter(F.col("n") < least), "hash").groupBy("row").agg(F.sum(F.log("n")).alias("more"))
    whole = scored.join(terms, "row", "left").withColumn("log_likelihood", F.col("total") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"), F.exp(-mean).alias("perplexity"))
