"""Alignment of two tokenizers: where tokens of both end at the same byte of a text, and how often pairs of tokens do so in the corpus."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import read_bytes
from .common import over_batches, settle, small, utf8

FOLDER = "/opt/tokenizers"
BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of text that are aligned at a time; pairs whose counts every task holds, the commonest; others are joined.
BLOCK, COMMON = 4 << 20, 1 << 18
#: Distinct segments whose tokens a worker keeps, and their characters; beyond either it starts anew.
KEPT, KEPT_CHARS = 400_000, 16 << 20
#: Pairs that a task counts before it hands them on.
PAIRS = 1 << 20
#: Fixed value: how byte-level BPE splits texts before it merges.
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Where a text may be cut: before a blank that follows no white space. Neither tokenizer has a token over such a place: the first
#: splits there, and no piece of the second holds a blank behind another character.
CUT = re.compile(r"(?<=[^\s\u180e\u200b\ufeff]) ")
SEGMENT = re.compile(r" ([^ ]*(?:(?<=[\s\u180e\u200b\ufeff]) [^ ]*)*)")
ODD = re.compile(r"[\s\u180e\u200b\ufeff] |^ ")


def _byte_level() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Flat ids of many segments; grows at the end."""

    def __init__(self):
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of segments by number, one after the other, and how many each has."""
        first = self.at[segments]
        n = self.at[segments + 1] - first
        return self.ids[np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)], n


class Coder:
    """Both tokenizers, and the tokens of segments met before."""

    def __init__(self, byte_bpe: bytes, piece_bpe: bytes):
        from sentencepiece import SentencePieceProcessor

        self.a_encode, self.a_bytes = _byte_bpe(byte_bpe)
        self.b = SentencePieceProcessor(model_proto=piece_bpe)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if any("▁" in piece(i).lstrip("▁") for i in range(len(self.b_bytes))):
            raise ValueError("a piece holds a blank behind another character: texts can't be cut at blanks")
        self.blank = self.b.piece_to_id("▁")
        self.a_size, self.b_size = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.chars, self.good = 0, np.zeros(0, bool)
        self.a_tokens, self.b_tokens = Tokens(), Tokens()

    def encode(self, segments: list[str]) -> np.ndarray:
        """Numbers of segments, which stand without their leading blank. New ones are encoded, each once."""
        number = self.number
        new = [s for s in dict.fromkeys(segments) if s not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.chars += sum(map(len, new))
            encode = self.a_encode
            texts = [" " + s for s in new]
            wanted = [t.encode() for t in texts]
            b = self.b.encode(new, num_threads=1)
            if "" in new:
                b[new.index("")] = [self.blank]
            good = self._keep(self.a_tokens, [encode(t) for t in texts], self.a_bytes, self.a_size, wanted)
            self.good = np.concatenate([self.good, good & self._keep(self.b_tokens, b, self.b_bytes, self.b_size, wanted)])
        return np.fromiter(map(number.__getitem__, segments), np.int64, len(segments))

    @staticmethod
    def _keep(tokens: Tokens, ids: list[list[int]], of: list[bytes], size: np.ndarray, wanted: list[bytes]) -> np.ndarray:
        """Keep the ids of new segments; whether their bytes give each segment back."""
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
        tokens.add(flat, counts)
        ends = np.concatenate([[0], np.cumsum(size[flat])])[np.cumsum(counts)]
        back = b"".join([of[x] for x in flat.tolist()])
        if back == b"".join(wanted) and (ends == np.cumsum([len(w) for w in wanted])).all():
            return np.ones(len(ids), bool)
        return np.array([back[at:end] == w for at, end, w in zip([0, *ends[:-1].tolist()], ends.tolist(), wanted, strict=True)], bool)

    def trim(self) -> None:
        if len(self.number) > KEPT or self.chars > KEPT_CHARS:
            self.clear()


def _byte_bpe(file: bytes):
    """An encoder of a byte-level BPE from its tokenizer file (ids of a text, special tokens as plain text), and its tokens' bytes.

    Where tokens are numbered in the order of their merges, as is usual, ranks alone say how to encode, which is quicker.
    """
    chars, held = _byte_level(), json.loads(file)
    names = held["model"]["vocab"]
    size = 1 + max([*names.values(), *(t["id"] for t in held["added_tokens"])])
    tokens = [b""] * size
    for t in held["added_tokens"]:
        tokens[t["id"]] = t["content"].encode()
    for name, i in names.items():
        tokens[i] = bytes(chars[c] for c in name)
    merges = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in held["model"]["merges"]]
    split = held.get("pre_tokenizer") or {}
    plain = not held.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if plain and merges == sorted(set(merges)) and len(names) == len(merges) + 256:
        import tiktoken

        own = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks={tokens[i]: i for i in names.values()}, special_tokens={})
        return own.encode_ordinary, tokens
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    other = Tokenizer.from_str(file.decode())
    other.encode_special_tokens = True
    return lambda text: other.encode(text, add_special_tokens=False).ids, tokens


#: The coders of this worker process, by the digest of their files.
CODERS: dict[str, Coder] = {}


def coder(files: tuple[bytes, bytes]) -> Coder:
    key = hashlib.md5(files[0] + files[1]).hexdigest()
    if key not in CODERS:
        CODERS[key] = Coder(*files)
    return CODERS[key]


def segments_of(text: str) -> list[str]:
    """A text (with a blank before it) cut at CUT; every segment without its leading blank."""
    return SEGMENT.findall(" " + text) if ODD.search(text) else text.split(" ")


def pieces_of(text: str, limit: int) -> list[str]:
    """A long text in pieces of about ``limit`` characters, cut where segments are."""
    out, at = [], 0
    while len(text) - at > limit and (m := CUT.search(text, at + limit)):
        out.append(text[at : m.start()])
        at = m.end()
    return [*out, text[at:]]


_TEN = 10 ** np.arange(10)


def _written(ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of decimal numbers with a mark behind each, and where each number's mark ends."""
    n = np.searchsorted(_TEN, ids, side="right").clip(1)
    end = np.cumsum(n + 1)
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[end - 1] = marks
    rest = ids.astype(np.int32)
    for k in range(int(n.max(initial=0))):
        here = np.flatnonzero(n > k)
        out[end[here] - 2 - k] = rest[here] % 10 + 48
        rest = rest // 10
    return out, end


@dataclass
class Aligned:
    """What a run of pieces gives: counts of each piece, the pairs of all links in order, and the written groups."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    pairs: np.ndarray
    at: np.ndarray  # where each piece's links start; one more at the end
    written: np.ndarray
    until: np.ndarray  # where each piece's groups end in ``written``

    def groups(self, i: int) -> memoryview:
        """The i-th piece's groups as bytes, with a semicolon at the end."""
        return memoryview(self.written)[int(self.until[i - 1]) if i else 0 : int(self.until[i])]


def align(own: Coder, texts: list[str]) -> Aligned:
    """Align texts (each with a blank before it), laid one after another.

    Ends of tokens are counted once by byte for either tokenizer; places with ends of both cut the whole run into groups, and
    differences of running sums at the texts' ends give each text its part. A text that either tokenizer doesn't give back
    has no tokens. No token is empty, so that at each cut one token of either ends: a link.
    """
    cut_up = [segments_of(t) for t in texts]
    numbers = own.encode([s for segs in cut_up for s in segs])
    counts = np.array([len(s) for s in cut_up])
    text_of = np.repeat(np.arange(len(texts)), counts)
    good = np.bincount(text_of, weights=~own.good[numbers], minlength=len(texts)) == 0
    kept = good[text_of]
    (a, a_n), (b, b_n) = own.a_tokens.of(numbers[kept]), own.b_tokens.of(numbers[kept])
    own.trim()
    a_of, b_of = (np.bincount(text_of[kept], weights=n, minlength=len(texts)).astype(np.int64) for n in (a_n, b_n))
    a_end, b_end = np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b])
    size = int(a_end[-1]) + 1 if len(a_end) else 1
    cut = (np.bincount(a_end, minlength=size) > 0) & (np.bincount(b_end, minlength=size) > 0)
    a_cuts, b_cuts = cut[a_end], cut[b_end]
    before = np.cumsum(cut)  # cuts up to each byte
    doc_end = np.concatenate([[0], a_end])[np.cumsum(a_of)]  # the byte that each text ends at
    at = np.concatenate([[0], before[doc_end]])
    pairs = a[a_cuts].astype(np.int64) << 32 | b[b_cuts]
    out = Aligned(good, a_of, b_of, np.diff(at), pairs, at, np.zeros(0, np.uint8), np.zeros(len(texts), np.int64))
    if len(a):
        # A's tokens of a group stand before B's: a token's place is its own number and that of the other side's before it.
        a_group, b_group = before[a_end] - a_cuts, before[b_end] - b_cuts
        a_total, b_total = np.flatnonzero(a_cuts) + 1, np.flatnonzero(b_cuts) + 1
        a_at = np.arange(len(a)) + np.concatenate([[0], b_total])[a_group]
        b_at = np.arange(len(b)) + a_total[b_group]
        ids, marks = np.empty(len(a) + len(b), np.int32), np.full(len(a) + len(b), ord(","), np.uint8)
        ids[a_at], ids[b_at] = a, b
        marks[a_at[a_cuts]], marks[b_at[b_cuts]] = ord("|"), ord(";")
        out.written, end = _written(ids, marks)
        out.until = np.concatenate([[0], end])[np.cumsum(a_of + b_of)]
    return out


def _runs(batch: pa.RecordBatch, own: Coder) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of pieces of the batch's texts, of about BLOCK bytes, with each piece's row. Rows without tokens have none."""
    rows, pieces, held = [], [], 0
    for i, value in enumerate(batch.column("text").to_pylist()):
        try:
            text = value.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if not text:
            continue
        cut_up = pieces_of(text, BLOCK)
        if len(cut_up) > 1 and not all(align(own, [p]).good[0] for p in cut_up):
            continue  # one bad piece spoils the text
        for piece in cut_up:
            if held and held + len(piece) > BLOCK:
                yield rows, pieces
                rows, pieces, held = [], [], 0
            rows.append(i)
            pieces.append(piece)
            held += len(piece)
    if rows:
        yield rows, pieces


def _counted(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, with its numbers added."""
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
    return pairs[first], np.add.reduceat(n, first) if len(first) else n


SCHEMA = "n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, pairs array<bigint>, times array<int>"


def _align_rows(docs: DataFrame, files, text: str) -> DataFrame:
    """Every row's figures, its different pairs of ids (A's in the upper half) and how many of its links hold each."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}"

    def apply(own: Coder, part: pa.RecordBatch) -> dict:
        sums = {c: np.zeros(part.num_rows, np.int64) for c in ("n_a", "n_b", "n_groups")}
        hashes: dict[int, hashlib._Hash] = {}
        met = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for rows, pieces in _runs(part, own):
            found = align(own, pieces)
            for c, x in sums.items():
                np.add.at(x, rows, getattr(found, c))
            met.append((np.repeat(rows, found.n_groups), found.pairs))
            for i in np.flatnonzero(found.n_groups).tolist():
                if rows[i] in hashes:
                    hashes[rows[i]].update(b";")
                else:
                    hashes[rows[i]] = hashlib.sha256()
                hashes[rows[i]].update(found.groups(i)[:-1])
        row, pair = (np.concatenate(x) for x in zip(*met))
        order = np.lexsort((pair, row))
        row, pair = row[order], pair[order]
        first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])])) if len(row) else row
        at = pa.array(np.searchsorted(row[first], np.arange(part.num_rows + 1)), pa.int32())
        times = np.diff(np.append(first, len(row))).astype(np.int32)
        return sums | {
            "doc_id": part.column("doc_id"),
            "groups_sha256": [hashes[i].hexdigest() if i in hashes else "" for i in range(part.num_rows)],
            "pairs": pa.ListArray.from_arrays(at, pa.array(pair[first])),
            "times": pa.ListArray.from_arrays(at, pa.array(times)),
        }

    return over_batches(docs.select("doc_id", utf8(text).alias("text")), schema, "text", lambda: partial(apply, coder(files.value)), BLOCK)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, n``: how many links of the corpus hold a pair of ids. Tasks add up before they hand on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        pairs, n = none, none
        for batch in batches:
            pairs, n = np.concatenate([pairs, batch.column("pairs").flatten().to_numpy()]), np.concatenate([n, batch.column("times").flatten().to_numpy()])
            if len(pairs) > 2 * PAIRS:
                pairs, n = _counted(pairs, n)
            if len(pairs) > PAIRS:
                yield pa.RecordBatch.from_pydict({"pair": pairs, "n": n})
                pairs, n = none, none
        pairs, n = _counted(pairs, n)
        yield pa.RecordBatch.from_pydict({"pair": pairs, "n": n})

    return aligned.select("pairs", "times").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _looked_up(aligned: DataFrame, known) -> DataFrame:
    """Every row's sums over the pairs that tasks hold; its other pairs are listed in ``rare``."""
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = known.value
        for batch in batches:
            own, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.concatenate([[0], np.cumsum(np.diff(batch.column("pairs").offsets.to_numpy()))])
            place = np.searchsorted(pair, own)
            there = pair[place] == own
            # A missing pair stands at the end of the list, so that its number of links is 0 here.
            sums = [_summed(np.where(there, v[place], 0) * times, at) for v in (best.astype(np.int64), count)]
            rare = pa.StructArray.from_arrays([pa.array(own[~there]), pa.array(times[~there])], ["pair", "times"])
            lists = pa.ListArray.from_arrays(pa.array(_places(~there, at), pa.int32()), rare)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, sums), lists], names=[*kept, "n_best", "count_sum", "rare"])

    return aligned.mapInArrow(run, f"{schema}, n_best bigint, count_sum bigint, rare array<struct<pair:bigint,times:bigint>>")


def _places(marked: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many are marked before each place."""
    return np.concatenate([[0], np.cumsum(marked)])[at]


def _summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring places, by running sums."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[at])


def alignment(docs: DataFrame, byte_bpe: str = f"{FOLDER}/{BYTE_BPE}", piece_bpe: str = f"{FOLDER}/{PIECE_BPE}", text: str = "text", common: int = COMMON) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row of ``docs``.

    Tokenizer A is a byte-level BPE, B a BPE over pieces with byte fallback; both see a blank before the text. ``n_best`` counts links
    whose pair of ids is, in the whole corpus, the commonest of its B id, ``count_sum`` adds up the corpus's counts of all links.
    Texts are encoded once; each row's different pairs are kept with its figures, counted, and looked up: tasks hold the
    ``common`` commonest pairs, the other ones come by a join, so that results don't depend on that bound. Null and empty texts,
    and those that a tokenizer doesn't give back byte by byte (for instance with U+2581), have no tokens: zeros and an empty
    digest. Repeated rows each count and have a row; an empty table gives none. Long texts are aligned piece by piece, whole. The
    two files are read by the driver and sent to tasks.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(read_bytes(spark, p) for p in (byte_bpe, piece_bpe)))
    aligned = settle(_align_rows(docs, files, text))
    counts = settle(pair_counts(aligned).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = settle(counts.groupBy("b").agg(F.max("n").alias("most")))
    judged = settle(counts.join(small(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    top = judged.orderBy(F.desc("n"), "pair").limit(common).toArrow().sort_by("pair")
    known = tuple(np.append(top.column(c).to_numpy(), np.array(end)) for c, end in (("pair", 1 << 62), ("n", 0), ("best", False)))
    found = settle(_looked_up(aligned, spark.sparkContext.broadcast(known)).withColumn("_row", F.monotonically_increasing_id()))
    rare = found.select("_row", F.inline("rare")).join(judged, "pair")
    more = rare.groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"))
    plus = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
    return found.join(small(settle(more)), "_row", "left").select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), plus("n_best", "_best"), plus("count_sum", "_sum"), "groups_sha256")
