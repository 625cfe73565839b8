"""Codes of vectors: integer product quantisation whose nearest entries are found through a vector-approximation file."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Bits of a coordinate's cell in the approximation file.
BITS = 2
#: Integers are held within this bound, so that squared distances over long vectors stay below 2^63.
BOUND = 1 << 25
#: Vectors that are encoded at a time.
BLOCK = 4096


class Cells:
    """The approximation file of one part's codebook: each entry's coordinates as numbers of cells, and the cells' bounds.

    A coordinate's cells hold equally many entries each (as far as they go), and reach from the least to the largest of them.
    """

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        k, width = entries.shape
        n = min(1 << bits, k)
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.cell = np.empty((k, width), np.int64)
        np.put_along_axis(self.cell, order, np.broadcast_to((np.arange(k) * n // k)[:, None], (k, width)), axis=0)
        self.low, self.high = (np.stack([f(self.entries, axis=0, where=self.cell == c, initial=start) for c in range(n)], axis=1) for f, start in ((np.min, 1 << 62), (np.max, -(1 << 62))))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of each row's squared distance to each entry, from tables made once a row."""
        lower = np.zeros((len(x), len(self.entries)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            under, over = self.low[j] - x[:, j, None], x[:, j, None] - self.high[j]
            near = np.maximum(np.maximum(under, over), 0)
            far = np.maximum(np.abs(under), np.abs(over))
            lower += (near * near)[:, self.cell[:, j]]
            upper += (far * far)[:, self.cell[:, j]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, of equally near ones the first, and its squared distance.

        Only entries whose lower bound doesn't pass the least upper bound are looked at.
        """
        lower, upper = self.bounds(x)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))
        gap = x[row] - self.entries[entry]
        exact = np.full(lower.shape, np.iinfo(np.int64).max)
        exact[row, entry] = np.einsum("ij,ij->i", gap, gap)
        best = exact.argmin(axis=1)
        return best, exact[np.arange(len(x)), best]


def integers(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, v``: whole numbers ``floor(4096 x)`` of the vectors that can be encoded, within ``BOUND`` of zero."""
    x = F.col(vector)
    fine = x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * float(SCALE), F.lit(float(BOUND))), F.lit(-float(BOUND)))).cast("bigint"))
    return table.filter(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), whole.alias("v"))


def first_vectors(kept: DataFrame, n: int = ENTRIES) -> list[list[int]]:
    """Vectors of the ``n`` smallest ids, null last; where rows share an id, the smallest vector. Each look brings ``n`` rows."""
    found: list[list[int]] = []
    some, done = kept.filter("vec_id is not null"), False
    while not done and len(found) < n:
        rows = some.orderBy("vec_id", "v").limit(n).collect()
        ids = list(dict.fromkeys(r["vec_id"] for r in rows))
        found += [next(list(r["v"]) for r in rows if r["vec_id"] == i) for i in ids][: n - len(found)]
        done = len(rows) < n
        some = some if done else some.filter(F.col("vec_id") > F.lit(ids[-1]))
    if len(found) < n:
        found += [list(r["v"]) for r in kept.filter("vec_id is null").orderBy("v").limit(1).collect()]
    return found


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, PARTS, width)


def _sums(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``part, entry, j, total, n``: sums of each coordinate over the parts of each entry. A task hands on one row an entry and coordinate."""
    _, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        total, n = np.zeros((PARTS, k, width), np.int64), np.zeros((PARTS, k), np.int64)
        for _, x in _blocks(batches, width):
            for p in range(PARTS):
                best, _ = cells[p].nearest(x[:, p])
                np.add.at(total[p], best, x[:, p])
                n[p] += np.bincount(best, minlength=k)
        p, e, j = np.nonzero(np.broadcast_to(n[:, :, None] > 0, total.shape))
        yield pa.RecordBatch.from_pydict({"part": p.astype(np.int32), "entry": e.astype(np.int32), "j": j.astype(np.int32), "total": total[p, e, j], "n": n[p, e]})

    each = kept.select("v").mapInArrow(run, "part int, entry int, j int, total bigint, n bigint")
    return each.groupBy("part", "entry", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))


def train(kept: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, coordinate) after rounds of assigning and averaging. An entry that no part takes stays.

    A round is one pass over the vectors and one sum in Spark; what comes to the driver is as large as the codebooks.
    """
    for _ in range(rounds):
        new = books.copy()
        for r in _sums(kept, books).collect():
            new[r["part"], r["entry"], r["j"]] = int(r["total"]) // r["n"]
        if (new == books).all():
            break  # further rounds would change nothing
        books = new
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of each vector: its parts' entries as hex digits, and its squared distance from them."""
    width = books.shape[2]
    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for part, x in _blocks(batches, width):
            found = [cells[p].nearest(x[:, p]) for p in range(PARTS)]
            codes = np.stack([best for best, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(run, schema)


def vector_codes(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` for each row whose vector can be encoded.

    Vectors are cut into 8 parts, each with a codebook that starts from the vectors of the smallest ids. Rows are dropped
    whose vector is null, empty, holds null or non-finite components, or has no multiple of 8 of them; so are vectors of another
    length than the one with the smallest id. Numbers beyond 2^25 in amount (8,192 before scaling) count as that. Ids may be null
    (last) or repeat: each row is encoded, and each id starts one entry. With fewer ids than entries, codebooks are smaller; an empty table
    gives no rows. Rows without a label are one group of ``label_error``.
    """
    kept = settle(integers(table, vec_id, vector, label))
    lead = kept.select("vec_id", F.size("v").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").first()
    length = lead["n"] if lead else PARTS
    kept = kept.filter(F.size("v") == length)
    firsts = first_vectors(kept, entries)
    books = np.array(firsts or np.zeros((1, length)), dtype=np.int64).reshape(-1, PARTS, length // PARTS).transpose(1, 0, 2)
    books = train(kept, books, rounds if firsts else 0)
    coded = settle(encode(kept, books))
    sums = settle(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    # One side has a row a label; the other may be cut where a label has very many rows.
    found = coded.join(small(sums), F.col("label").eqNullSafe(F.col("_label")), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
