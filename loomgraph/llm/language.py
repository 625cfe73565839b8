"""Language identification of code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chain import Chain, emissions, posteriors, train
from .common import over_batches

#: Bounds of the labelled sample the model is fitted on: rows of each language, and characters in all. Beyond MANY languages
#: characters get fewer in proportion, as a word's work grows with the square of them.
SAMPLE_ROWS = 400
SAMPLE_CHARS = 8_000_000
MANY = 64
#: Languages that a model may tell apart; with more labels than that the column holds something else, and learning raises.
MOST_LANGS = 4096
#: Characters that a sampled text should be allowed at least; with many languages fewer rows of each are taken instead.
EXCERPT = 1_000
#: Buckets of hashed features, and how many of a language's commonest words its lexicon holds.
BUCKETS = 1 << 17
LEXICON = 400
#: Weights of a model at most, about: with very many languages there are fewer buckets.
CELLS = 1 << 24
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Letters of a word at most; longer runs are taken for codes when a text is judged.
LONGEST = 20


@cache
def letters() -> np.ndarray:
    """For each code point its small form if it is a letter, else 0."""
    small = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            small[c] = ord(y) if len(y) == 1 else c
    return small


@dataclass
class Words:
    """The words (runs of letters) of some texts: codes with a 0 around each word, and where words and lines are."""

    codes: np.ndarray
    first: np.ndarray
    length: np.ndarray
    hashes: np.ndarray
    text: np.ndarray  # of each word
    line: np.ndarray  # of each word, over all texts
    code: np.ndarray  # whether the run is part of a code: next to a digit, or over LONGEST letters

    def picked(self, which: np.ndarray) -> Words:
        """Some of the words, their letters alone."""
        first, length = self.first[which], self.length[which]
        begin = np.cumsum(length + 1) - length
        chars = np.repeat(first - begin, length) + (at := np.arange(int(length.sum())) + np.repeat(np.arange(1, len(which) + 1), length))
        codes = np.zeros(int(length.sum()) + len(which) + 1, np.uint32)
        codes[at] = self.codes[chars]
        return Words(codes, begin, length, self.hashes[which], self.text[which], self.line[which], self.code[which])


def words_of(texts: list[str]) -> Words:
    """A line break, and the end of a text, ends a sequence."""
    joined = "\n".join(texts)
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.concatenate([np.zeros(1, np.uint32), letters()[raw], np.zeros(1, np.uint32)])
    inside = codes != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first, length = edge[::2], edge[1::2] - edge[::2]
    chars = np.flatnonzero(inside)
    place = chars - np.repeat(first, length)
    powers = np.cumprod(np.full(int(length.max()) if len(length) else 1, 0x100000001B3, dtype=np.uint64))
    mixed = (codes[chars].astype(np.uint64) * PRIME) * powers[place]
    hashes = np.add.reduceat(mixed, np.cumsum(length) - length) if len(length) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    breaks = np.flatnonzero(raw == 10)
    digit = np.concatenate([[False], (raw >= 48) & (raw <= 57), [False]])
    code = digit[first - 1] | digit[first + length] | (length > LONGEST)
    return Words(codes, first, length, hashes ^ (hashes >> np.uint64(31)), np.searchsorted(ends, first - 1, side="right"), np.searchsorted(breaks, first - 1), code)


def _bucket(kind: int, *codes: np.ndarray) -> np.ndarray:
    h = np.full(len(codes[0]), kind + 1, dtype=np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * PRIME
        h ^= h >> np.uint64(29)
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def buckets_for(langs: int) -> int:
    """A power of two."""
    return min(BUCKETS, 1 << max(6, (CELLS // max(1, langs)).bit_length() - 1))


def features(w: Words, lexicon: np.ndarray, flags: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Flat feature ids and their count by word: all n-grams of 1 to 3 letters with the word's edges, affixes of 2 to 4
    letters, the word itself, and which lexicons hold it."""
    c, last = w.codes, w.first + w.length - 1
    chars = np.flatnonzero(c != 0)
    grams = [_bucket(1, c[chars]), _bucket(2, c[chars - 1], c[chars]), _bucket(3, c[chars - 1], c[chars], c[chars + 1])]
    at = lambda base, k, low, high: np.where((base + k >= low) & (base + k <= high), c[np.clip(base + k, 0, len(c) - 1)], 0)
    heads = [at(w.first, k, w.first, last) for k in range(4)]
    tails = [at(last, -k, w.first, last) for k in range(4)]
    if len(lexicon):
        where = np.minimum(np.searchsorted(lexicon, w.hashes), len(lexicon) - 1)
        known = np.where(lexicon[where] == w.hashes, flags[where], 0)
    else:
        known = np.zeros(len(w.first), np.int64)
    own = [_bucket(10 + n, *heads[:n]) for n in (2, 3, 4)] + [_bucket(20 + n, *tails[:n]) for n in (2, 3, 4)]
    own += [_bucket(30, w.hashes), _bucket(31, known)]
    counts = 3 * w.length + len(own)
    flat = np.empty(int(counts.sum()), dtype=np.int64)
    starts = np.cumsum(counts) - counts
    spread = np.repeat(starts, w.length) + 3 * (chars - np.repeat(w.first, w.length))
    for k, g in enumerate(grams):
        flat[spread + k] = g
    for k, g in enumerate(own):
        flat[starts + 3 * w.length + k] = g
    return flat & (buckets - 1), counts


#: A text is in no known language if words that fit none hold more than this share of its letters.
STRANGE = 0.5


@dataclass
class Background:
    """Which words fit any of the learned languages, by the letter trigrams of these, whatever the number of languages.

    ``logs`` holds trigrams' log-probabilities (trigrams x languages). A word is strange if the mean of its trigrams' is
    below ``least`` in every language: hardly a word is, of known texts that the trigrams weren't counted on.
    """

    logs: np.ndarray
    least: float = -np.inf

    def scores(self, w: Words) -> np.ndarray:
        """For each word, the mean log-probability of its trigrams in the language that it fits best."""
        if not len(w.first):
            return np.zeros(0)
        chars = np.flatnonzero(w.codes != 0)
        each = self.logs[_bucket(3, w.codes[chars - 1], w.codes[chars], w.codes[chars + 1]) & (len(self.logs) - 1)]
        return (np.add.reduceat(each, np.cumsum(w.length) - w.length, axis=0) / w.length[:, None]).max(axis=1)

    def strange(self, w: Words, scores: np.ndarray, texts: int) -> np.ndarray:
        """The share of each text's letters that lies in strange words; codes don't count, and a text without words has 1."""
        weight = w.length * ~w.code
        letters_ = np.bincount(w.text, weights=weight, minlength=texts)
        odd = np.bincount(w.text, weights=weight * (scores < self.least), minlength=texts)
        return np.where(letters_ > 0, odd / np.maximum(letters_, 1), 1.0)


def _background(labelled: list[tuple[str, str]], langs: list[str]) -> Background:
    """Trigrams are counted on three of four texts; the fourth says how words of known text score: the bound lies a standard
    deviation below the score that one word in a thousand doesn't reach."""
    buckets = buckets_for(len(langs))
    logs = np.empty((buckets, len(langs)), np.float32)
    held = []
    for k, lang in enumerate(langs):
        own = [t for t, x in labelled if x == lang]
        held += own[3::4]
        w = words_of([t for i, t in enumerate(own) if i % 4 != 3])
        chars = np.flatnonzero(w.codes != 0)
        counts = np.bincount(_bucket(3, w.codes[chars - 1], w.codes[chars], w.codes[chars + 1]) & (buckets - 1), minlength=buckets)
        logs[:, k] = np.log((counts + 0.1) / (counts.sum() + 0.1 * buckets))
    out = Background(logs)
    scores = out.scores(words_of(held or [t for t, _ in labelled]))
    if len(scores):
        out.least = float(np.quantile(scores, 0.001) - scores.std())
    return out


@dataclass
class Model:
    langs: list[str]
    chain: Chain
    lexicon: np.ndarray
    flags: np.ndarray
    background: Background


def _lexicons(labelled: list[tuple[str, str]], langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each language's commonest words, and a number for the set of languages that have the word among them: a bit
    for each, or the hash of the bits where they don't fit."""
    flags: dict[int, int] = {}
    for k, lang in enumerate(langs):
        found, n = np.unique(words_of([t for t, x in labelled if x == lang]).hashes, return_counts=True)
        for h in found[np.argsort(-n, kind="stable")[:LEXICON]].tolist():
            flags[h] = flags.get(h, 0) | 1 << k
    order = sorted(flags)
    number = lambda bits: bits if bits < 1 << 63 else xxhash.xxh64_intdigest(bits.to_bytes(-(-len(langs) // 8), "little")) >> 1
    return np.array(order, dtype=np.uint64), np.array([number(flags[h]) for h in order], dtype=np.int64)


def fit(labelled: list[tuple[str, str]], seed: int = 11) -> Model:
    """Train on texts of known language.

    Sequences are lines. So that transitions between languages can be learned, every fourth sequence is made of a line
    and one in another language: labelled tables name one language a text, and hold no switches of their own.
    """
    langs = sorted({lang for _, lang in labelled})
    lexicon, flags = _lexicons(labelled, langs)
    rng = np.random.default_rng(seed)
    lines = [(line, langs.index(lang)) for text, lang in labelled for line in text.split("\n") if any(c.isalpha() for c in line)]
    order = rng.permutation(len(lines))
    data, batch = [], []
    for n, i in enumerate(order):
        batch.append([lines[i], lines[rng.integers(len(lines))]] if n % 4 == 0 else [lines[i]])
        if len(batch) == 400 or n == len(order) - 1:
            parts = [part for seq in batch for part in seq]
            w = words_of([p[0] for p in parts])
            n_words = np.bincount(w.text, minlength=len(parts))
            at = np.cumsum([len(seq) for seq in batch]) - [len(seq) for seq in batch]
            flat, counts = features(w, lexicon, flags, buckets_for(len(langs)))
            data.append((flat.astype(np.int32), counts, np.add.reduceat(n_words, at), np.array([p[1] for p in parts])[w.text]))
            batch = []
    return Model(langs, train(data, buckets_for(len(langs)), len(langs)), lexicon, flags, _background(labelled, langs))


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
    """Each text's language: of the most words, as forward-backward expects; the score is its share of the words. Then
    whether the text fits any learned language at all."""
    w = words_of(texts)
    # Score each distinct word once.
    _, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
    distinct = w.picked(one)
    scores = emissions(model.chain, *features(distinct, model.lexicon, model.flags, len(model.chain.emit)))[back]
    fit_ = model.background.scores(distinct)[back]
    _, lengths = np.unique(w.line, return_counts=True)
    likely, _ = posteriors(scores, lengths, model.chain)
    total = np.stack([np.bincount(w.text, weights=likely[:, k], minlength=len(texts)) for k in range(len(model.langs))], axis=1)
    n = np.bincount(w.text, minlength=len(texts))
    known = model.background.strange(w, fit_, len(texts)) <= STRANGE
    best = total.argmax(axis=1)
    share = total[np.arange(len(texts)), best] / np.maximum(n, 1)
    return [model.langs[b] if k else "und" for b, k in zip(best, n, strict=True)], [float(min(1.0, s)) if k else 0.0 for s, k in zip(share, n, strict=True)], known.tolist()


def held_out(doc_id: str = "doc_id"):
    """Whether a document may not be learned from: the CRC-32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows that are not held out: at most ``rows`` of each language, those of the smallest hashes.

    A first look counts each language's rows; the second takes the smallest hashes of id and text, in their order. A text
    longer than a fair share of ``chars`` is learned from by its beginning, so languages of long texts have rows as well.
    With very many languages there are fewer rows of each; more than MOST_LANGS raise.
    """
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if not counts:
        return []
    if len(counts) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} different languages are labelled")
    chars = chars * MANY // max(MANY, len(counts))
    rows = max(1, min(rows, chars // (EXCERPT * len(counts))))
    most = max(1, chars // (rows * len(counts)))
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2.0 * rows / n))]), F.col("lang"))
    cut = F.substring("text", 1, most)
    excerpt = F.when(F.length("text") <= most, F.col("text")).otherwise(F.coalesce(F.nullif(F.regexp_replace(cut, r"\S+$", ""), F.lit("")), cut))
    hashed = known.withColumn("h", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(5)), F.lit(1 << 30)))
    some = hashed.filter(F.col("h") < share * float(1 << 30)).select("lang", "h", excerpt.alias("text")).dropDuplicates(["lang", "h"])
    first = some.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= rows)
    return [(r["text"], r["lang"]) for r in sorted(first.collect(), key=lambda r: (r["lang"], r["n"]))]


def learned(docs: DataFrame) -> Model | None:
    """A model of the labelled rows, if there are any."""
    labelled = sample(docs.select("doc_id", "text", "lang"))
    return fit(labelled) if labelled else None


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, known`` for each row of ``docs`` (doc_id, text, lang).

    ``lang`` is used to learn, never to predict. Null texts and texts without a letter are ``und`` with score 0. ``known`` says
    whether the text fits any learned language; ``lang_pred`` is the nearest one either way. Repeated
    rows are predicted alike. Without any labelled row, as in an empty table, all texts are ``und``.
    """
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model or learned(docs))

    def make():
        own = shared.value

        def apply(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            langs, scores, known = predict(own, texts) if own else (["und"] * len(texts), [0.0] * len(texts), [False] * len(texts))
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs, "score": scores, "known": known}

        return apply

    kind = docs.schema["doc_id"].dataType.simpleString()
    return over_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), f"doc_id {kind}, held_out boolean, lang_pred string, score double, known boolean", "text", make, 1 << 20)


def keep_identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Keep rows in a known language; drop those that are ``und``, and those whose words fit no learned language.

    Each row is judged by its own text in the pass that reads it, so ids may be null or repeated. Columns stay as they are.
    Without any labelled row nothing is known, and nothing kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or learned(docs))

    def make():
        own = shared.value

        def apply(batch: pa.RecordBatch) -> dict:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            kept = batch.filter(pa.array(predict(own, texts)[2] if own else [False] * len(texts), pa.bool_()))
            return dict(zip(kept.schema.names, kept.columns, strict=True))

        return apply

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return over_batches(docs, schema, "text", make, 1 << 20)
