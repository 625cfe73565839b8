"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, searched apart and merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

K = 20
#: Distinct vectors of a shard, about; queries that one task searches a shard for, about.
SHARD, CHUNK = 8192, 16384
#: Shards of that size; with more vectors shards grow along with their number, up to this many times.
FEW, GROWN = 16, 8
#: Links of a node above the ground level and on it; nodes that a search keeps while a graph is built, and afterwards.
M, GROUND, BUILD, SEARCH = 16, 32, 64, 320
#: Nodes that a search of one of many shards keeps at least.
LEAST = 96
#: Nodes opened at a time in a search, and searches that run side by side.
OPEN, SIDE = 4, 512


@dataclass
class Graph:
    """Flat arrays: ``links[level]`` holds each node's neighbours on that level, -1 where it has fewer."""

    points: np.ndarray  # float32, the vectors scaled into the unit ball and lifted onto the sphere
    level: np.ndarray
    links: list[np.ndarray]
    entry: int


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Points whose distances from a query (lifted by 0) are in the order of inner products: all have the length of the longest."""
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norms.max()
    rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", unit, unit)))
    return np.concatenate([unit, rest[:, None]], axis=1).astype(np.float32)


def _apart(points: np.ndarray, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its row of nodes; infinite where there is none."""
    near = points[nodes]
    gap = np.einsum("bnd,bnd->bn", near, near) - 2 * np.einsum("bnd,bd->bn", near, queries) + np.einsum("bd,bd->b", queries, queries)[:, None]
    gap[nodes < 0] = np.inf
    return gap


def _once(nodes: np.ndarray) -> np.ndarray:
    """Each row's nodes in order, with -1 for those that repeat."""
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return nodes


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, width: int, open_: int = OPEN) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest nodes that a best-first search of one level finds for each query, nearest first (-1: none).

    ``starts`` has a row of nodes for each query. All queries walk side by side, each opening its nearest closed nodes in turn,
    until none of those it keeps is closed.
    """
    n = len(queries)
    ids = np.full((n, width), -1, np.int64)
    gaps = np.full((n, width), np.inf, np.float32)
    opened = np.ones((n, width), bool)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column stands for no node
    at = np.arange(n)
    new = starts
    while len(at):
        new = np.where(seen[at[:, None], new], -1, new)
        new = _once(new)
        seen[at[:, None], new] = True
        seen[:, -1] = False
        gap = _apart(points, queries[at], new).astype(np.float32)
        both_gap = np.concatenate([gaps[at], gap], axis=1)
        both_ids = np.concatenate([ids[at], new], axis=1)
        both_open = np.concatenate([opened[at], new < 0], axis=1)
        best = np.argsort(both_gap, axis=1, kind="stable")[:, :width]
        gaps[at], ids[at], opened[at] = (np.take_along_axis(x, best, axis=1) for x in (both_gap, both_ids, both_open))
        going = ~opened[at].all(axis=1)
        at = at[going]
        if not len(at):
            break
        closed = ~opened[at]
        pick = closed & (np.cumsum(closed, axis=1) <= open_)
        opened[at] |= pick
        which = np.argsort(~pick, axis=1, kind="stable")[:, :open_]
        nodes = np.where(np.take_along_axis(pick, which, axis=1), np.take_along_axis(ids[at], which, axis=1), -1)
        new = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(at), -1)
    return ids, gaps


def _descend(graph: Graph, queries: np.ndarray, down_to: int) -> np.ndarray:
    """The nearest node on each query's way from the entry down to the level above ``down_to``."""
    at = np.full((len(queries), 1), graph.entry)
    for level in range(len(graph.links) - 1, down_to, -1):
        at = beam(graph.points, graph.links[level], queries, at, 1, 1)[0]
    return at


def _chosen(points: np.ndarray, own: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates at most ``most``, nearest first: those nearer to the node itself than to any one chosen before.

    Places that are left are filled with the nearest of the rest, so that close groups stay joined to the others.
    """
    nodes = _once(np.where(nodes == own[:, None], -1, nodes))
    gap = _apart(points, points[own], nodes)
    order = np.argsort(gap, axis=1, kind="stable")
    nodes, gap = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(gap, order, axis=1)
    there = nodes >= 0
    near = points[nodes]
    squares = np.einsum("bnd,bnd->bn", near, near)
    between = squares[:, :, None] + squares[:, None, :] - 2 * near @ near.transpose(0, 2, 1)
    keep = np.zeros_like(there)
    for c in range(nodes.shape[1]):
        clear = ~(keep & (between[:, :, c] <= gap[:, c, None])).any(axis=1)
        keep[:, c] = there[:, c] & clear & (keep.sum(axis=1) < most)
    # Chosen ones first, then the rest, both nearest first.
    rank = np.argsort(np.where(keep, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((len(own), most), -1, np.int64)
    out[:, : rank.shape[1]] = np.take_along_axis(nodes, rank, axis=1)
    return out


def _link_back(points: np.ndarray, links: np.ndarray, source: np.ndarray, targets: np.ndarray) -> None:
    """Add each source to the neighbours of its targets; lists that overflow are chosen anew."""
    most = links.shape[1]
    a, b = np.repeat(source, targets.shape[1]), targets.ravel()
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    node, first, n = np.unique(b, return_index=True, return_counts=True)
    wide = np.full((len(node), most + int(n.max(initial=0))), -1, np.int64)
    wide[:, :most] = links[node]
    wide[np.repeat(np.arange(len(node)), n), most + np.arange(len(b)) - np.repeat(first, n)] = a
    wide = np.sort(_once(wide), axis=1)[:, ::-1]  # those there are stand first
    full = wide[:, most:].max(axis=1, initial=-1) >= 0
    links[node[~full]] = wide[~full, :most]
    at, rows = node[full], wide[full]
    for i in range(0, len(at), 256):
        part = rows[i : i + 256]
        links[at[i : i + 256]] = _chosen(points, at[i : i + 256], part[:, (part >= 0).any(axis=0)], most)


def build(points: np.ndarray, seed: int = 7, links: int = M, ground: int = GROUND, width: int = BUILD) -> Graph:
    """Insert all points, in batches that grow with the graph: each searches the graph so far and its own batch."""
    n = len(points)
    rng = np.random.default_rng(seed)
    level = np.minimum(np.floor(-np.log(1.0 - rng.random(n)) / np.log(links)), 8).astype(np.int64)
    level[0] = level.max(initial=0)
    graph = Graph(points, level, [np.full((n, ground if k == 0 else links), -1, np.int64) for k in range(int(level[0]) + 1)], 0)
    done = 1
    while done < n:
        batch = np.arange(done, min(n, done + min(SIDE, done)))
        for k in range(int(level[0]), -1, -1):
            own = batch[level[batch] >= k]
            if not len(own):
                continue
            start = _descend(graph, points[own], k)
            found, _ = beam(points, graph.links[k], points[own], start, width)
            # Those of the same batch haven't been linked yet: their nearest come by exact distances.
            gap = np.sum(points[own] ** 2, axis=1)[:, None] + np.sum(points[own] ** 2, axis=1)[None, :] - 2 * points[own] @ points[own].T
            np.fill_diagonal(gap, np.inf)
            beside = own[np.argsort(gap, axis=1, kind="stable")[:, : min(width // 2, len(own) - 1)]]
            most = graph.links[k].shape[1]
            near = np.concatenate([_chosen(points, own[i : i + 128], np.concatenate([found[i : i + 128], beside[i : i + 128]], axis=1), most // 2) for i in range(0, len(own), 128)])
            graph.links[k][own, : most // 2] = near
            _link_back(points, graph.links[k], own, near)
        done += len(batch)
    return graph


def shards_of(vectors: int, shard: int = SHARD) -> int:
    """How many shards vectors are dealt to: of ``shard`` each while they are few, then both their number and their size grow."""
    units = max(1, -(-vectors // shard))
    return units if units <= FEW else max(math.ceil(math.sqrt(FEW * units)), -(-units // GROWN))


def width_in(shards: int, grown: float = 1.0, width: int = SEARCH) -> int:
    """Nodes that a search of one of ``shards`` keeps, where ``width`` find a query's nearest in a single one.

    Vectors are dealt by hash, so a shard has its part of the nearest only, and the first few of a search are found by fewer nodes:
    searches of all shards together cost a query less than in proportion to their number. Shards ``grown`` to
    several times their size need more.
    """
    return max(min(width, LEAST), min(width, round(width * math.sqrt(max(1.0, grown) / shards))))


def search(graph: Graph, queries: np.ndarray, width: int = SEARCH, whole: int | None = None) -> np.ndarray:
    """Nodes near each query, nearest first (-1: none). A graph of at most ``whole`` nodes (if not given: ``width``) is read whole."""
    n = len(graph.points)
    if n <= max(width, whole or 0):
        return np.broadcast_to(np.arange(n), (len(queries), n))
    return np.concatenate([beam(graph.points, graph.links[0], q, _descend(graph, q, 0), width)[0] for q in (queries[i : i + SIDE] for i in range(0, len(queries), SIDE))])


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component to the last: equal vectors score equally."""
    out = np.zeros(a.shape[:-1])
    for j in range(a.shape[-1]):
        out += a[..., j] * b[..., j]
    return out


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _build_shard(k: int):
    def make(key: tuple, table: pa.Table) -> pa.Table:
        """One row for a shard: its vectors, their ids and the graph, as bytes of flat arrays."""
        table = table.combine_chunks()
        width = key[0].as_py()
        vectors = _fixed(table.column("v").combine_chunks(), width).astype(np.float64)
        ids = table.column("ids").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], vectors[i].tobytes()))  # whatever order rows came in
        np.random.default_rng(5).shuffle(order)
        vectors, ids = vectors[order], [ids[i] for i in order]
        graph = build(lifted(vectors))
        flat = [vectors, np.cumsum([0, *map(len, ids)]), np.concatenate([np.array(x, np.int64) for x in ids]), graph.points, *[x.astype(np.int32) for x in graph.links]]
        row = {"width": [width], "shard": [key[1].as_py()], "arrays": [[x.tobytes() for x in flat]]}
        return pa.table(row, schema=pa.schema([("width", pa.int32()), ("shard", pa.int32()), ("arrays", pa.list_(pa.binary()))]))

    return make


def _search_shard(k: int, beam_width: int, whole: int):
    schema = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def found(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        if not index.num_rows or not queries.num_rows:
            return schema.empty_table()
        width = key[0].as_py()
        parts = index.column("arrays")[0].as_py()
        vectors, starts, ids = np.frombuffer(parts[0]).reshape(-1, width), np.frombuffer(parts[1], np.int64), np.frombuffer(parts[2], np.int64)
        n = len(vectors)
        graph = Graph(np.frombuffer(parts[3], np.float32).reshape(n, -1), np.zeros(0), [np.frombuffer(x, np.int32).reshape(n, -1) for x in parts[4:]], 0)
        queries = queries.combine_chunks()
        own = _fixed(queries.column("v").combine_chunks(), width).astype(np.float64)
        row, query = (queries.column(c).to_numpy() for c in ("row", "query_id"))
        size = np.sqrt(np.einsum("ij,ij->i", own, own))
        out = []
        for i in range(0, len(own), SIDE):
            q = own[i : i + SIDE]
            lifted_q = np.concatenate([q / size[i : i + SIDE, None], np.zeros((len(q), 1))], axis=1).astype(np.float32)
            near = search(graph, lifted_q, max(beam_width, 2 * k), whole)
            at, place = np.nonzero(near >= 0)
            node = near[at, place]
            score = scores(q[at], vectors[node])
            # The best nodes by score, then smallest id, then all their ids.
            best = np.lexsort((ids[starts[node]], -score, at))
            at, node, score = at[best], node[best], score[best]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            at, node, score = at[nth <= k], node[nth <= k], score[nth <= k]
            n_ids = starts[node + 1] - starts[node]
            each = np.repeat(np.arange(len(node)), n_ids)
            vec_id = ids[np.arange(len(each)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids) + np.repeat(starts[node], n_ids)]
            at, node, score = at[each], node[each], score[each]
            # The query's own row is no candidate: one row of its id and vector goes.
            self_ = (vec_id == query[i : i + SIDE][at]) & (vectors[node] == q[at]).all(axis=1)
            mine = np.flatnonzero(self_)
            kept = np.ones(len(at), bool)
            kept[mine[np.unique(at[mine], return_index=True)[1]]] = False
            at, vec_id, score = at[kept], vec_id[kept], score[kept]
            best = np.lexsort((vec_id, -score, at))
            at, vec_id, score = at[best], vec_id[best], score[best]
            nth = np.arange(len(at)) - np.searchsorted(at, at)
            at, vec_id, score = at[nth < k], vec_id[nth < k], score[nth < k]
            out.append(pa.table([row[i : i + SIDE][at], query[i : i + SIDE][at], vec_id, score], schema=schema))
        return pa.concat_tables(out)

    return found


def _clean(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id, v`` of the rows that take part; -0.0 is 0.0."""
    x = F.col(vector)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0)
    return table.filter(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("id"), F.transform(x, lambda c: c.cast("double") + F.lit(0.0)).alias("v"))


def index(rows: DataFrame, k: int = K, shard: int = SHARD) -> tuple[DataFrame, int, float]:
    """A settled row for each shard of ``rows`` (id, v), the number of shards that vectors are dealt to by hash, and how many times ``shard`` they hold.

    Equal vectors are one node, with their ``k + 1`` smallest ids: of equally near rows no others can be among the nearest
    ``k``. They are cut to these before the shuffle, so that a vector with very many rows is no task of its own.
    """
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("_n") <= k + 1)
    nodes = settle(first.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    n = nodes.count()
    shards = shards_of(n, shard)
    dealt = nodes.select(F.size("v").cast("int").alias("width"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "ids")
    return settle(dealt.groupBy("width", "shard").applyInArrow(_build_shard(k), "width int, shard int, arrays array<binary>")), shards, n / (shards * shard)


def nearest(table: DataFrame, queries: DataFrame | None = None, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, shard: int = SHARD, chunk: int = CHUNK, width: int = SEARCH) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``table`` of the largest inner product that are found for each row of
    ``queries`` (rows of ``table``; those whose id is divisible by 20 if not given), nearest first, ties by smaller id.

    Vectors are dealt to shards of a bounded size by hash; each shard's graph is built by one task. A task searches one shard for
    one chunk of queries, and a window merges what shards found. ``width`` holds for a single shard; searches of more keep fewer nodes each (``width_in``). Rows with a null id, or whose vector is null, empty, zero or holds
    null or non-finite components, take no part; vectors are compared with those of the same length. A query's own row is no candidate,
    other rows of the same id or vector are; repeated query rows have results each. Ids are whole numbers. Shards of at most ``width``
    vectors are read whole, so that small tables have exact results; an empty table has none.
    """
    rows = _clean(table, vec_id, vector)
    asked = _clean(queries, vec_id, vector) if queries is not None else rows.filter(F.col("id") % 20 == 0)
    asked = settle(asked.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("query_id"), F.size("v").cast("int").alias("width"), "v"))
    graphs, shards, grown = index(rows, k, shard)
    chunks = max(1, -(-asked.count() // chunk))
    left = graphs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["width", "shard", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search_shard(k, width_in(shards, grown, width), width), "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
