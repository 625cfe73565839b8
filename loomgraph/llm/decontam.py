"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import digest, over_batches, settle, small, spare, utf8

WINDOW = 13
SHINGLE = 5
#: Bits of the map that says which shingles a benchmark has: 256 a shingle, between 2 ** 16 and 2 ** 27 (16 MB). Beyond 2 ** 19
#: shingles the map lets more positions pass to the join, which decides.
LEAST_BITS, MOST_BITS = 16, 27
#: A to Z become small, other ASCII but digits and small letters becomes a blank; all other bytes are parts of words.
WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), dtype=np.uint64, count=len(words))


def hash_runs(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words, from the words' own hashes."""
    runs = max(0, len(words) - n + 1)
    out = np.full(runs, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + runs]) * MIX
        out ^= out >> np.uint64(29)
    return out


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, words`` (of one window), ``offsets`` and ``hashes`` of its shingles; an item shorter than a window is one."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            out = {"item_id": [], "words": [], "hashes": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text)
                codes = hash_words(words)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    run = words[i : i + window]
                    out["item_id"].append(item)
                    out["words"].append(b" ".join(run).decode("utf-8", "replace"))
                    out["hashes"].append(hash_runs(codes[i : i + window], min(shingle, len(run))).view(np.int64).tolist())
            return out

        return apply

    kind = items.schema["item_id"].dataType.simpleString()
    return over_batches(items.select("item_id", utf8().alias("_t")), f"item_id {kind}, words string, hashes array<bigint>", "_t", make)


class Map:
    """The top bits of hashes, as a map that every task gets: its size is bounded whatever the input."""

    def __init__(self, hashes: DataFrame) -> None:
        """``hashes`` has a column ``hash``."""
        n = hashes.agg(F.approx_count_distinct("hash")).first()[0]
        self.bits = min(MOST_BITS, max(LEAST_BITS, (256 * n - 1).bit_length()))
        top = F.shiftrightunsigned("hash", 64 - self.bits)
        rows = hashes.select(F.shiftright(top, 6).alias("at"), F.expr(f"shiftleft(1L, cast(pmod(shiftrightunsigned(hash, {64 - self.bits}), 64) as int))").alias("bit"))
        found = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
        longs = np.zeros(1 << (self.bits - 6), dtype=np.int64)
        longs[found["at"].to_numpy()] = found["bits"].to_numpy()
        self.bytes = longs.astype("<i8").view(np.uint8)

    def probe(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of a document's shingles of n words that the map may hold."""
        runs = hash_runs(codes, n)
        top = runs >> np.uint64(64 - self.bits)
        at = np.flatnonzero(self.bytes[(top >> np.uint64(3)).astype(np.int64)] >> (top & np.uint64(7)).astype(np.uint8) & 1)
        return at, runs[at].view(np.int64)


def rarity(docs: DataFrame, known: Broadcast, lengths: list[int]) -> DataFrame:
    """``hash, n``: how often the whole corpus holds each shingle that the map knows."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            counts: Counter[int] = Counter()
            for text in batch.column(0).to_pylist():
                codes = hash_words(words_of(text))
                for n in lengths:
                    counts.update(known.value.probe(codes, n)[1].tolist())
            return {"hash": list(counts), "n": list(counts.values())}

        return apply

    return over_batches(docs.select(utf8().alias("_t")), "hash bigint, n bigint", "_t", make).groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """``hash, offset, words, n_window``: the prefix of each distinct window.

    A window is a set of shingles that must all be found, so of its shingles in order of rarity the necessary prefix
    is the rarest alone. Windows with a shingle that the corpus lacks can't occur and go.
    """
    shingles = windows.select("words", F.posexplode("hashes").alias("offset", "hash")).distinct()
    ranked = shingles.join(counts, "hash", "left").groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset")).alias("rarest"))
    return ranked.filter("rarest.n > 0").select("rarest.hash", "rarest.offset", "words", F.size(F.split("words", " ")).alias("n_window"))


def owners(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``words, owned`` and ``owned, item``: windows of the same items share a number, so that items are listed once for them all."""
    pairs = windows.select("words", F.col("item_id").cast("string").alias("item")).distinct()
    mark = lambda seed: F.bit_xor(F.xxhash64("item", F.lit(seed)))
    sets = settle(pairs.groupBy("words").agg(F.struct(F.count("*").alias("n"), mark(1).alias("a"), mark(2).alias("b")).alias("owned")))
    chosen = sets.groupBy("owned").agg(F.min("words").alias("words"))
    return sets, settle(chosen.join(pairs, "words").select("owned", "item"))


def _candidates(docs: DataFrame, key: str, known: Broadcast, lengths: list[int], reach: int) -> DataFrame:
    """Each document, numbered, with its word count and, where a prefix token may stand, the words around it."""

    def make():
        def apply(batch: pa.RecordBatch) -> dict:
            out = {"row": batch.column(0), key: batch.column(1), "n_words": [], "hits": []}
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                codes, hits = hash_words(words), []
                for n in lengths:
                    for p, h in zip(*(x.tolist() for x in known.value.probe(codes, n)), strict=True):
                        first = max(0, p - reach)
                        hits.append({"pos": p, "hash": h, "first": first, "near": b" ".join(words[first : p + reach + n]).decode("utf-8", "replace")})
                out["n_words"].append(len(words))
                out["hits"].append(hits)
            return out

        return apply

    kind = docs.schema[key].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), key, utf8().alias("_t"))
    return over_batches(numbered, f"row bigint, {key} {kind}, n_words bigint, hits array<struct<pos: int, hash: bigint, first: int, near: string>>", "_t", make)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, percent: int = 5, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items, contaminated`` for each row of ``docs`` (doc_id, or another ``key``, and text).

    ``n_hit`` counts words inside any occurrence of a benchmark window, ``items`` lists the items (as strings, sorted) with
    occurring windows, and a document is contaminated if hit words are ``percent`` or more of all. Null and empty texts have
    no words and no hits. Every row has a result of its own, whether its id is null or repeated. Repeated items
    count once by id; windows that items share count for each of them. An empty benchmark contaminates nothing.
    """
    docs, spread = docs.select(key, "text"), docs.sparkSession.sparkContext.broadcast
    windows = settle(benchmark_windows(items.select("item_id", "text"), window, shingle))
    lengths = sorted({min(shingle, r[0]) for r in windows.select(F.least(F.size(F.split("words", " ")), F.lit(shingle))).distinct().collect()})
    counts = rarity(docs, spread(Map(windows.select(F.explode("hashes").alias("hash")))), lengths)
    rare = settle(prefixes(windows, counts))
    # Rows keep their numbers once they are written.
    found = settle(_candidates(docs, key, spread(Map(rare)), lengths, window))
    start = F.col("hit.pos") - F.col("offset")
    # Positional and length bounds come first, then the exact words.
    fits = (start >= 0) & (start + F.col("n_window") <= F.col("n_words"))
    same = F.slice(F.split("hit.near", " "), F.greatest(start - F.col("hit.first") + 1, F.lit(1)), F.col("n_window")) == F.split("words", " ")
    places = found.select("row", "n_words", F.explode("hits").alias("hit")).join(small(rare), F.col("hit.hash") == F.col("hash")).filter(fits & same)
    sets, listed = owners(windows)
    span = F.struct(start.cast("int").alias("s"), (start + F.col("n_window")).cast("int").alias("e"))
    hits = settle(places.select("row", span.alias("span"), "words").join(small(sets), "words").groupBy("row").agg(F.collect_set("span").alias("spans"), F.collect_set("owned").alias("owned")))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
    union = F.aggregate(F.sort_array("spans"), zero, lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["total"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("total")))
    named = hits.select("row", F.explode("owned").alias("owned")).join(small(listed), "owned").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hit = settle(hits.select("row", union["total"].cast("long").alias("n_hit")).join(named, "row"))
    counted = found.select("row", key, "n_words").join(small(hit), "row", "left").select(key, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Drop contaminated documents; the table's columns stay as they are.

    Each row goes or stays by its own text, whatever its id: texts are told apart by their digests. A null text stays.
    """
    key = spare(docs, "_digest")
    marked = docs.withColumn(key, digest())
    bad = contamination(marked, items, key=key).filter("contaminated").select(key).distinct()
    return marked.join(small(settle(bad)), key, "left_anti").select(docs.columns)
